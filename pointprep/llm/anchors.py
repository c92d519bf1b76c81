"""Sampled positions by which equal windows of different texts find each other.

A text is a sequence of symbols. An anchor is a position whose gram, a few symbols long, has
the least hash of all grams in some window; equal windows therefore have an anchor at the
same place. Everything a window that holds an anchor can contain is the anchor's context. So
* a gram that occurs in one context only once cannot lie in a repeated window,
* of two anchors with equal contexts all windows are equal, which needs one hash to see,
* only anchors with a shared gram and a context of their own have to be compared in detail.
Two rounds of counting on (gram, context) hashes sort anchors into these kinds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pointprep.llm import common
from pointprep.llm.common import arrow_map
from pointprep.session import discard, shuffles_freed

#: Contexts of one gram that are compared in one task, about 50 MB of bytes or two million windows; windows of grams with more are
#: compared by their hashes over all tasks.
HOT_CONTEXTS = 60_000

#: What is to be done with an anchor: all its windows repeat; its context is to be compared; by hashes; another row compares it.
SETTLED, SHIP, HOT, WANT = 1, 2, 4, 8

_BASE = 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1
_P = np.uint64((1 << 61) - 1)
_BASE61 = 0x0B4A8D7C35E91F27


def stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``common.stage``; the shuffles behind it are gone once it is written."""
    with shuffles_freed(df.sparkSession):
        return common.stage(df, label)


def materialize(df: DataFrame, label: str) -> DataFrame:
    return stage(df, label)[0]


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) <= n:
            size = max(n + 1, 2 * len(cls.up))
            cls.up, cls.down = (np.full(size, v, np.uint64) for v in (_BASE, pow(_BASE, -1, 1 << 64)))
            cls.up[0] = cls.down[0] = 1
            np.multiply.accumulate(cls.up, out=cls.up)
            np.multiply.accumulate(cls.down, out=cls.down)


def times61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo 2^61 - 1 of numbers below it."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    mid = ah * bl + al * bh
    t = np.uint64(2) * (ah * bh) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half) + al * bl
    t = (t & _P) + (t >> np.uint64(61))
    return np.where(t >= _P, t - _P, t)


class _Powers61:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        while len(cls.up) <= n:
            k = len(cls.up)
            for side, base in (("up", _BASE61), ("down", pow(_BASE61, -1, int(_P)))):
                had = getattr(cls, side)
                setattr(cls, side, np.concatenate([had, times61(had, np.full(k, pow(base, k, int(_P)), np.uint64))]))


class WindowHashes:
    """Hashes of any windows of a sequence of 64-bit symbols: polynomials modulo the prime 2^61 - 1.

    A power of two as modulus would let texts of two letters collide that double and swap themselves.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        _Powers61.reach(n)
        terms = times61((symbols & _P) % _P, _Powers61.up[:n])
        low = np.cumsum(terms & np.uint64(0xFFFFFFFF)) % _P
        high = times61(np.cumsum(terms >> np.uint64(32)), np.full(n, 1 << 32, np.uint64))
        self.prefix = np.zeros(n + 1, np.uint64)
        self.prefix[1:] = (high + low) % _P

    def of(self, first: int, last: int, window: int) -> np.ndarray:
        """Hashes of the windows that start from ``first`` to ``last``."""
        s, e = slice(first, last + 1), slice(first + window, last + 1 + window)
        return mix(times61((self.prefix[e] + _P - self.prefix[s]) % _P, _Powers61.down[s])).view(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def sliding(x: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """``pick`` over every ``width`` neighbours, by running values from both ends of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, fill, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1: width - 1 + n])


def find_anchors(symbols: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Positions and gram hashes of the anchors of a sequence of 64-bit symbols; None if it is shorter than a window.

    A gram's hash only chooses anchors and brings them together, what is equal is judged by contexts.
    """
    n = len(symbols)
    if n < window:
        return None
    _Powers.reach(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * _Powers.up[:n], out=prefix[1:])
    g = mix((prefix[gram:] - prefix[:-gram]) * _Powers.down[: n - gram + 1])
    width = window - gram + 1
    least = np.zeros(n - window + 1 + 2 * (width - 1), np.uint64)
    least[width - 1: width - 1 + n - window + 1] = sliding(g, width, np.minimum, _M64)
    at = np.flatnonzero(g == sliding(least, width, np.maximum, 0))
    return at, g[at].view(np.int64)


def reach(at: int, n: int, window: int, gram: int) -> tuple[int, int]:
    """First and last start of a window that holds the gram at ``at``, in a text of ``n`` symbols."""
    return max(at - (window - gram), 0), min(at, n - window)


def contexts_of(at: np.ndarray, raw: bytes, size: int, n: int, window: int, gram: int) -> np.ndarray:
    """Hash of each anchor's context and of the place of the anchor in it; ``raw`` has ``size`` bytes a symbol."""
    view = memoryview(raw)
    lo, hi = np.maximum(at - (window - gram), 0), np.minimum(at + window, n)
    seeds = ((at - lo) << 32) + (hi - lo)
    found = [xxhash.xxh3_64_intdigest(view[a * size: b * size], s) for a, b, s in zip(lo.tolist(), hi.tolist(), seeds.tolist())]
    return np.array(found, np.uint64).view(np.int64)


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``row`` of each row's own, written out, so that null and repeated keys spread like any others."""
    return materialize(docs.withColumn("row", F.monotonically_increasing_id()), "rows")


def anchor_rows(docs: DataFrame, symbols: Callable[[str], tuple[np.ndarray, bytes, int]], window: int, gram: int) -> tuple[DataFrame, str]:
    """``row``, ``key``, ``gram``, ``context`` and the ``positions`` where both occur in the text; written out, with its path.

    ``symbols`` gives a text's symbols, their bytes and the bytes of one.
    """

    def rows(batches: Iterator[dict]):
        for batch in batches:
            for r, k, t in zip(batch["row"].to_pylist(), batch["key"].to_pylist(), batch["text"]):
                values, raw, size = symbols(t.as_py() or "")
                found = find_anchors(values, window, gram)
                if found is None:
                    continue
                at, grams = found
                places: dict[tuple[int, int], list[int]] = {}
                for p, g, c in zip(at.tolist(), grams.tolist(), contexts_of(at, raw, size, len(values), window, gram).tolist()):
                    places.setdefault((g, c), []).append(p)
                for (g, c), at_all in places.items():
                    yield r, k, g, c, at_all

    return stage(arrow_map(docs.select("row", "key", "text"), rows, "row long, key long, gram long, context long, positions array<int>"), "anchors")


def sort_anchors(docs: DataFrame, symbols: Callable[[str], tuple[np.ndarray, bytes, int]], window: int, gram: int, settled: Column) -> DataFrame:
    """Per ``row`` the list ``work`` of (gram, context, kind, positions) that can lie in repeated windows; written out.

    ``settled`` says from ``n``, the occurrences of a context, ``least``, its smallest key, and ``key``
    whether a context's windows all repeat. One of the rows with the smallest key compares a context, and the others
    with that key WANT its result. Counts are combined before each shuffle, and no row waits for the others of its gram.
    """
    anchors, path = anchor_rows(docs, symbols, window, gram)
    contexts = anchors.groupBy("gram", "context").agg(F.sum(F.size("positions")).alias("n"), F.min("key").alias("least"), F.min_by("row", "key").alias("first"))
    grams = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("all")).filter(F.col("all") > 1)
    known = contexts.join(grams, "gram").select("gram", "context", "n", "least", "first", "contexts")
    several = F.col("contexts") > 1
    kind = (
        F.when(settled, SETTLED).otherwise(0)
        + F.when(several & (F.col("row") == F.col("first")), F.when(F.col("contexts") > HOT_CONTEXTS, SHIP + HOT).otherwise(SHIP)).otherwise(0)
        + F.when(several & (F.col("row") != F.col("first")) & (F.col("key") == F.col("least")) & ~settled, WANT).otherwise(0)
    )
    rows = anchors.join(known, ["gram", "context"]).select("row", "gram", "context", kind.cast("int").alias("kind"), "positions").filter("kind > 0")
    per = rows.groupBy("row").agg(F.collect_list(F.struct("gram", "context", "kind", "positions")).alias("work"))
    work = materialize(per, "work")
    discard(docs.sparkSession, path)
    return work


def work_of(column) -> Callable[[int], list[tuple[int, int, int, list[int]]]]:
    """Access to a batch's work lists: for a row number its (gram, context, kind, positions)."""
    ends, there = column.offsets.to_pylist(), column.is_valid().to_pylist()
    grams, contexts, kinds = (column.values.field(f).to_pylist() for f in ("gram", "context", "kind"))
    lists = column.values.field("positions")
    starts, positions = lists.offsets.to_pylist(), lists.values.to_pylist()

    def read(i: int) -> list[tuple[int, int, int, list[int]]]:
        if not there[i]:
            return []
        return [(grams[j], contexts[j], kinds[j], positions[starts[j]: starts[j + 1]]) for j in range(ends[i], ends[i + 1])]

    return read


def crowded_work(work: DataFrame) -> DataFrame:
    """The work lists of texts with contexts of crowded grams, cut down to these."""
    hot = F.filter("work", lambda w: w["kind"].bitwiseAND(HOT) > 0)
    return work.select("row", hot.alias("work")).filter(F.size("work") > 0)


def compare_by_hashes(contexts: DataFrame, repeats: Callable[[], Column], piece: int) -> DataFrame:
    """For contexts of crowded grams, which of their windows repeat.

    ``contexts`` has ``row``, ``key``, ``gram``, ``context``, ``offset`` of the first window relative to the anchor and
    ``hashes``. Windows are compared ``piece`` at a time, then one by one where
    the whole piece does not repeat, so that a crowded gram spreads over all tasks and few rows come
    of it. A piece that repeats stays as one reference for the others. ``repeats`` judges from ``key``,
    ``least`` and ``n`` of all that is equal. Returns ``row``, ``gram``, ``context`` and ``spans``, pairs of first and last offset.
    """
    last = F.col("offset") + F.size("hashes") - 1
    cut = contexts.withColumn("i", F.explode(F.sequence(F.floor(F.col("offset") / piece), F.floor(last / piece))))
    cut = cut.withColumns({"a": F.greatest(F.col("i") * piece, F.col("offset")), "b": F.least(F.col("i") * piece + piece - 1, last)})
    cut = cut.withColumn("part", F.slice("hashes", F.col("a").cast("int") - F.col("offset") + 1, (F.col("b") - F.col("a") + 1).cast("int")))
    spark = contexts.sparkSession
    # Read twice, cut once.
    pieces, cut_path = stage(cut.select("row", "key", "gram", "context", "a", "b", "part", F.xxhash64("part").alias("h")), "cut")
    same = ["gram", "a", "b", "h"]
    least = pieces.groupBy(*same).agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
    judged, judged_path = stage(pieces.join(least, same).withColumn("whole", repeats()).drop("h", "n"), "pieces")
    discard(spark, cut_path)
    whole = judged.filter("whole").select("row", "gram", "context", "a", "b")
    single = judged.filter(~F.col("whole") | (F.col("key") == F.col("least"))).select(
        "row", "key", "gram", "context", "whole", F.posexplode("part").alias("i", "h"), "a"
    ).withColumn("at", F.col("a") + F.col("i")).drop("a", "i")
    same = ["gram", "at", "h"]
    # A piece known to repeat counts for two.
    single, single_path = stage(single, "windows")
    least = single.groupBy(*same).agg(F.min("key").alias("least"), F.sum(F.col("whole").cast("int") + 1).alias("n")).filter("n > 1")
    found = single.filter(~F.col("whole")).join(least, same).filter(repeats()).select("row", "gram", "context", F.col("at").alias("a"), F.col("at").alias("b"))
    spans = materialize(whole.unionAll(found).groupBy("row", "gram", "context").agg(
        F.collect_set(F.array(F.col("a").cast("int"), F.col("b").cast("int"))).alias("spans")
    ), "spans")
    discard(spark, judged_path)
    discard(spark, single_path)
    return spans


def mark_starts(work: list, spans: dict[tuple[int, int], list], n: int, window: int, gram: int) -> np.ndarray:
    """The starts of repeated windows of a text of ``n`` symbols, as a boolean array."""
    up: list[int] = []
    down: list[int] = []
    for g, c, kind, positions in work:
        if kind & SETTLED:
            for p in positions:
                first, last = reach(p, n, window, gram)
                up.append(first)
                down.append(last + 1)
        else:
            for a, b in spans.get((g, c), ()):
                up += [p + a for p in positions]
                down += [p + b + 1 for p in positions]
    size = n - window + 2
    return (np.bincount(up, minlength=size) - np.bincount(down, minlength=size))[:-1].cumsum() > 0 if up else np.zeros(size - 1, bool)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of whole numbers as few as cover the same, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """The symbols that lie in a window with one of the starts."""
    change = np.zeros(n + 1, np.int64)
    edges = np.diff(np.concatenate([[0], starts.astype(np.int8), [0]]))
    change[np.flatnonzero(edges == 1)] += 1
    np.add.at(change, np.flatnonzero(edges == -1) - 1 + window, -1)
    return change[:-1].cumsum() > 0
