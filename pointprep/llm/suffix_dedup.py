"""Removal of long byte strings that occur more than once, by a distributed merge sort of suffixes.

The suffix array is sparse: it holds the suffixes that begin at anchors (see ``anchors``), cut to the
length of a window, and of those only the ones that counting could not settle. Each map task sorts
its suffixes into runs and front-codes them: of a suffix it sends the bytes beyond the prefix
it shares with the one before. A task that gathers the runs of a share of the grams merges
them with a loser tree whose players carry their common prefix with the last winner; the
longer prefix wins unseen, and bytes are compared from there on only when prefixes tie. The merge
yields the suffix array with its common-prefix lengths, from which, together with the bytes
to the left of each anchor, follow the windows that repeat.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pointprep.llm import anchors as an
from pointprep.llm.common import arrow_map

WINDOW = 400
GRAM = 100
#: Bytes of contexts in one sorted run, and in the share of one merging task.
RUN_BYTES = 24 << 20
SHARE_BYTES = 12 << 20
#: Up to so many suffixes of one gram are compared pair by pair; more by classes at each length.
PAIRWISE = 12

_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_symbols(text: str) -> tuple[np.ndarray, bytes, int]:
    data = text.encode()
    return _TABLE[np.frombuffer(data, np.uint8)], data, 1


def common_prefix(a: bytes, b: bytes, k: int = 0) -> int:
    """Length of the common prefix of two strings that are known to share ``k`` bytes."""
    n = min(len(a), len(b))
    step = 32
    while k < n and a[k: k + step] == b[k: k + step]:
        k += step
    if k >= n:
        return n
    x, y = a[k: k + step], b[k: k + step]
    m = min(len(x), len(y))
    differ = int.from_bytes(x[:m]) ^ int.from_bytes(y[:m])
    return k + m - (differ.bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[int], bytes]:
    """Sorted strings as shared prefix lengths, lengths of the rest, and the rests."""
    shared, before = [], b""
    for s in suffixes:
        shared.append(common_prefix(before, s))
        before = s
    rests = [s[k:] for s, k in zip(suffixes, shared)]
    return shared, list(map(len, rests)), b"".join(rests)


def front_decode(shared: list[int], lengths: list[int], rests: bytes) -> Iterator[tuple[int, bytes]]:
    before, at = b"", 0
    for k, n in zip(shared, lengths):
        before = before[:k] + rests[at: at + n]
        at += n
        yield k, before


class LoserTree:
    """Merge of sorted runs of (shared prefix with the one before, string, payload)."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.text: list[bytes | None] = [None] * self.size
        self.load: list[object] = [None] * self.size
        #: Common prefix of each player with the last string that won against it.
        self.prefix = [0] * self.size
        for i in range(len(runs)):
            self._advance(i)
        self.losers = [0] * self.size

    def _advance(self, i: int) -> None:
        item = next(self.runs[i], None)
        self.prefix[i], self.text[i], self.load[i] = item if item is not None else (0, None, None)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.text[a], self.text[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        k, m = self.prefix[a], self.prefix[b]
        if k > m:
            return a, b
        if k < m:
            return b, a
        k = common_prefix(x, y, k)
        if x[k: k + 1] <= y[k: k + 1]:
            self.prefix[b] = k
            return a, b
        self.prefix[a] = k
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        """Strings in order, each with the prefix it shares with the one before."""
        if not self.runs:
            return
        winner = self._build(1) if self.size > 1 else 0
        while self.text[winner] is not None:
            yield self.prefix[winner], self.text[winner], self.load[winner]
            self._advance(winner)
            node = (winner + self.size) // 2
            while node:
                winner, self.losers[node] = self._play(self.losers[node], winner)
                node //= 2


def repeated_offsets(right: list[int], lefts: list[bytes], several: list[bool], window: int) -> list[list[tuple[int, int]]]:
    """For suffixes of one gram in order, which windows around each anchor repeat.

    ``right[i]`` is the prefix that suffix i shares with suffix i - 1, ``lefts`` are the bytes before the
    anchors, nearest first. ``several`` marks contexts that are known to repeat as a whole; they only serve
    the others. Returns for each the spans of distances from window start to anchor.
    """
    m = len(lefts)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    if m <= PAIRWISE:
        for i in range(m):
            reach = window
            for j in range(i + 1, m):
                reach = min(reach, right[j])
                if several[i] and several[j]:
                    continue
                left = common_prefix(lefts[i], lefts[j])
                if left + reach >= window:
                    span = (max(0, window - reach), left)
                    spans[i].append(span)
                    spans[j].append(span)
        return spans
    order = sorted(range(m), key=lefts.__getitem__)
    shared = np.zeros(m, int)
    for n in range(1, m):
        shared[n] = common_prefix(lefts[order[n - 1]], lefts[order[n]])
    place = np.empty(m, int)
    place[order] = np.arange(m)
    length = np.array([len(x) for x in lefts])
    right_at = np.array(right)
    # Classes change only at these distances.
    longest = max(map(len, lefts))
    cuts = sorted({0, *(int(s) + 1 for s in set(shared.tolist())), *(int(x) + 1 for x in set(length.tolist())), *(window - r for r in set(right))} & set(range(longest + 1)))
    for d, end in zip(cuts, [*cuts[1:], longest + 1]):
        need = window - d
        by_right = np.cumsum(right_at < need)
        by_left = np.cumsum(shared < d)[place]
        _, where, counts = np.unique(by_right * (m + 1) + by_left, return_inverse=True, return_counts=True)
        for i in np.flatnonzero((counts[where] > 1) & (length >= d)).tolist():
            if spans[i] and spans[i][-1][1] == d - 1:
                spans[i][-1] = (spans[i][-1][0], end - 1)
            else:
                spans[i].append((d, end - 1))
    return spans


def _runs(batches: Iterator[dict], shares: int, window: int, gram: int) -> Iterator[tuple]:
    """Sorted front-coded runs of the contexts that are to be compared."""
    held: list[tuple] = []
    size = 0

    def flush():
        held.sort()
        at = 0
        while at < len(held):
            share = held[at][0]
            end = at
            while end < len(held) and held[end][0] == share:
                end += 1
            part = held[at:end]
            shared, lengths, rests = front_code([x[1] for x in part])
            yield (share, shared, lengths, rests, [len(x[2]) for x in part], b"".join(x[2] for x in part), *([x[i] for x in part] for i in (3, 4, 5, 6)))
            at = end

    for g, c, k, hot, several, left, suffix in _contexts(batches, window, gram):
        if not hot:
            held.append((g % shares, suffix, left, g, c, k, several))
            size += len(left) + len(suffix) + 200
            if size > RUN_BYTES:
                yield from flush()
                held, size = [], 0
    yield from flush()


def _contexts(batches: Iterator[dict], window: int, gram: int) -> Iterator[tuple]:
    for batch in batches:
        work_at = an.work_of(batch["work"])
        for i, k in enumerate(batch["row"].to_pylist()):
            todo = [w for w in work_at(i) if w[2] & an.SHIP]
            if not todo:
                continue
            data = batch["text"][i].as_py().encode()
            for g, c, kind, positions in todo:
                p = positions[0]
                first, _ = an.reach(p, len(data), window, gram)
                yield g, c, k, bool(kind & an.HOT), bool(kind & an.SETTLED), data[first:p][::-1], data[p: p + window]


RUN_SCHEMA = (
    "share long, shared array<int>, lengths array<int>, rests binary, left_lengths array<int>, lefts binary, "
    "gram array<long>, context array<long>, key array<long>, several array<boolean>"
)


def _merge(rows: list[dict], window: int, gram: int) -> Iterator[tuple]:
    """Merge the runs of a share; yields the spans of each context that repeats in part."""

    def players(row):
        at = 0
        loads = zip(row["left_lengths"], row["gram"], row["context"], row["key"], row["several"])
        for (k, s), (n, *load) in zip(front_decode(row["shared"], row["lengths"], row["rests"]), loads):
            yield k, s, (row["lefts"][at: at + n], *load)
            at += n

    block: list[tuple[int, tuple]] = []

    def flush():
        if len(block) > 1:
            spans = repeated_offsets([b[0] for b in block], [b[1][0] for b in block], [b[1][4] for b in block], window)
            for (_, (_, g, c, k, several)), found in zip(block, spans):
                if found and not several:
                    # Offsets count from the anchor to the right.
                    yield k, g, c, [(-b, -a) for a, b in an.united(found)]

    for shared, _, load in LoserTree([players(r) for r in rows]):
        if shared < gram and block:
            yield from flush()
            block = []
        block.append((shared, load))
    yield from flush()


def _prepared(docs: DataFrame, window: int, gram: int, text: str, key: str) -> DataFrame:
    """Rows of the input with what is known of the windows in them.

    The rows are written once with a number of their own, by which all else goes; keys are only handed on.
    Texts are shuffled once; both passes read that exchange.
    """
    named = an.identified(docs.select(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.coalesce(text, F.lit("")).alias("text")))
    keyed = named.withColumn("key", F.col("row"))
    work = an.sort_anchors(keyed, byte_symbols, window, gram, F.col("n") > 1)
    kinds = {r["k"]: r["count"] for r in work.select(F.explode("work.kind").alias("k")).groupBy("k").count().collect()}
    shipped = sum(n for k, n in kinds.items() if k & an.SHIP and not k & an.HOT)
    shares = max(1, math.ceil(shipped * 2 * window / SHARE_BYTES))
    dealt = named.repartition("row")
    # All columns, also those that no run needs: an exchange of other columns would be another exchange.
    joined = dealt.join(work, "row", "left").select("id", "row", "text", "work")
    runs = arrow_map(joined, lambda b: _runs(b, shares, window, gram), RUN_SCHEMA, out_rows=1)

    def merge(batches: Iterator[dict]):
        share, held = None, []
        for batch in batches:
            columns = [batch[f] for f in batch]
            for values in zip(*columns):
                row = dict(zip(batch, (v.as_py() for v in values)))
                if row["share"] != share:
                    yield from _merge(held, window, gram)
                    share, held = row["share"], []
                held.append(row)
        yield from _merge(held, window, gram)

    merged = arrow_map(
        runs.repartitionById(shares, F.col("share").cast("int")).sortWithinPartitions("share"), merge,
        "row long, gram long, context long, spans array<array<int>>",
    )
    if any(k & an.HOT for k in kinds):

        def hashes(batches: Iterator[dict]):
            for g, c, k, hot, several, left, suffix in _contexts(batches, window, gram):
                if hot:
                    data = left[::-1] + suffix
                    hashes = an.WindowHashes(_TABLE[np.frombuffer(data, np.uint8)])
                    yield g, c, k, k, -len(left), hashes.of(0, min(len(left), len(data) - window), window)

        crowded, crowded_path = an.stage(arrow_map(
            named.join(an.crowded_work(work), "row").select("row", "text", "work"), hashes,
            "gram long, context long, row long, key long, offset int, hashes array<long>", out_rows=2_000,
        ), "crowded")
        merged = merged.unionByName(an.compare_by_hashes(crowded, lambda: F.col("n") > 1, round((window - gram + 1) ** 0.5)))
        an.discard(docs.sparkSession, crowded_path)
    per = merged.groupBy("row").agg(F.collect_list(F.struct("gram", "context", "spans")).alias("factors"))
    return dealt.join(work, "row", "left").join(per, "row", "left").select(F.col("id").alias("key"), "text", "work", "factors")


def removed_bytes(data: bytes, work: list, factors: list | None, window: int, gram: int) -> np.ndarray:
    """Which bytes of a text go."""
    if not work or len(data) < window:
        return np.zeros(len(data), bool)
    spans = {(f["gram"], f["context"]): f["spans"] for f in factors or ()}
    return an.covered(an.mark_starts(work, spans, len(data), window, gram), window, len(data))


def _rows(batches: Iterator[dict], window: int, gram: int) -> Iterator[tuple]:
    for batch in batches:
        work_at = an.work_of(batch["work"])
        for i, k in enumerate(batch["key"].to_pylist()):
            data = batch["text"][i].as_py().encode()
            gone = removed_bytes(data, work_at(i), batch["factors"][i].as_py(), window, gram)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
            kept, at = [], 0
            for a, b in edges:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            yield None if k == (1 << 63) - 1 else k, data, edges, b"".join(kept)


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What is left of each text without the bytes that lie in a ``window``-byte string that also starts elsewhere.

    Elsewhere is any other place of any text, the same one included; places overlap freely, and strings
    are judged on the input. Returns ``key``, ``n_bytes``, ``n_removed``, ``spans`` (removed runs as first byte and
    the one after the last) and ``kept``, binary since a cut may fall within a character. A null text
    counts as empty. Each row is a text of its own, so rows with equal keys remove from each other.
    """
    rows = _prepared(docs, window, gram, text, key)
    return arrow_map(
        rows, lambda batches: ((k, len(d), len(d) - len(kept), spans, kept) for k, d, spans, kept in _rows(batches, window, gram)),
        f"{key} long, n_bytes long, n_removed long, spans array<array<long>>, kept binary", out_rows=500,
    )


def dedup_digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of what ``dedup_bytes`` keeps."""
    rows = _prepared(docs, window, gram, text, key)
    return arrow_map(
        rows,
        lambda batches: ((k, len(d), len(d) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for k, d, spans, kept in _rows(batches, window, gram)),
        f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )
