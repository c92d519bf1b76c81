"""Context-triggered piecewise fingerprints of texts and their likeness.

A hash of the last seven bytes decides where a chunk ends: at block level k it ends where
the k lowest bits are zero, so every boundary of level k + 1 is one of level k. The level of
a text is the smallest one that leaves at most 64 chunks. A chunk is written as two letters
of its hash; a fingerprint is ``level:chunks at level:chunks at level + 1``, so texts whose
levels differ by one still share a level at which they can be compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from pointprep.llm.common import arrow_map

WINDOW = 7
MAX_CHUNKS = 64
#: Chunks in a row that two signatures must share before they count as alike at all.
MIN_RUN = 3
#: Bytes hashed at a time, so that the working arrays stay small for any text.
BLOCK = 1 << 20
#: Rows that a range of keys is meant to hold.
RANGE_ROWS = 8_000

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PAIRS = [a + b for a in LETTERS for b in LETTERS]
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_COEF = np.array([(_BASE * (2 * i + 3)) & 0xFFFFFFFF | 1 for i in range(WINDOW)], np.uint32)


class _Powers:
    """Powers of the hash base and of its inverse, grown as longer texts come, at most one block."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) <= n:
            size = max(n + 1, 2 * len(cls.up))
            cls.up, cls.down = (np.full(size, v, np.uint64) for v in (_BASE, _BASE_INV))
            cls.up[0] = cls.down[0] = 1
            np.multiply.accumulate(cls.up, out=cls.up)
            np.multiply.accumulate(cls.down, out=cls.down)


def _boundaries(data: bytes, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of chunks of level ``low`` and more, their levels, and the prefix hash at each end, text end last."""
    n, total = len(data), 0
    ends, levels, sums = [], [], []
    mask = np.uint32((1 << low) - 1)
    for start in range(0, n, BLOCK):
        raw = np.frombuffer(data, np.uint8, min(BLOCK, n - start), start)
        before = np.frombuffer(data, np.uint8, min(WINDOW - 1, start), start - min(WINDOW - 1, start))
        context = np.zeros(WINDOW - 1 + len(raw), np.uint32)
        context[WINDOW - 1:] = raw
        context[WINDOW - 1:] += np.uint32(1)
        if len(before):
            context[WINDOW - 1 - len(before): WINDOW - 1] = before.astype(np.uint32) + np.uint32(1)
        h = context[WINDOW - 1:] * _COEF[0]
        for j in range(1, WINDOW):
            h += context[WINDOW - 1 - j: len(context) - j] * _COEF[j]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        _Powers.reach(len(raw))
        at = np.flatnonzero((h & mask) == 0)
        hit = h[at].astype(np.int64)
        prefix = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _Powers.up[: len(raw)], dtype=np.uint64)
        scale = np.uint64(pow(_BASE, start, 1 << 64))
        ends.append(at + (start + 1))
        levels.append(np.where(hit == 0, 32, np.log2(np.maximum(hit & -hit, 1)).astype(np.int64)))
        sums.append(prefix[at] * scale + np.uint64(total))
        total = (total + int(prefix[-1]) * int(scale)) & _M64
    ends.append(np.array([n]))
    levels.append(np.array([99]))
    sums.append(np.array([total], np.uint64))
    return np.concatenate(ends), np.concatenate(levels), np.concatenate(sums)


def _signature(ends: np.ndarray, sums: np.ndarray) -> str:
    if len(ends) > 1 and ends[-1] == ends[-2]:
        ends, sums = ends[:-1], sums[:-1]
    starts = [0, *ends[:-1].tolist()]
    sums = sums.tolist()
    letters = []
    for i, start in enumerate(starts):
        h = (sums[i] - (sums[i - 1] if i else 0)) * pow(_BASE_INV, start, 1 << 64) & _M64
        h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & _M64
        letters.append(_PAIRS[h >> 52])
    return "".join(letters)


def fingerprint(data: bytes) -> str:
    """The fingerprint of a text's UTF-8 bytes; no bytes give ``0::``."""
    if not data:
        return "0::"
    low = max(0, int(math.log2(len(data) / MAX_CHUNKS + 1)) - 3)
    while True:
        with np.errstate(over="ignore"):
            ends, levels, sums = _boundaries(data, low)
        # Chunks at level k: the boundaries of that level, and the rest if the text goes on.
        counts = np.bincount(np.minimum(levels, 40), minlength=41)[::-1].cumsum()[::-1]
        if counts[low] > MAX_CHUNKS or low == 0:
            break
        low = max(0, low - 4)
    level = next(k for k in range(low, 41) if counts[k] <= MAX_CHUNKS)
    parts = [_signature(ends[levels >= k], sums[levels >= k]) for k in (level, level + 1)]
    return f"{level}:{parts[0]}:{parts[1]}"


def _score(a: str, b: str) -> float:
    """1 less the share of chunks to delete and insert to turn one signature into the other."""
    left = [a[i: i + 2] for i in range(0, len(a), 2)]
    right = [b[i: i + 2] for i in range(0, len(b), 2)]
    run = min(MIN_RUN, len(left), len(right))
    if not run:
        return 0.0
    runs = {tuple(left[i: i + run]) for i in range(len(left) - run + 1)}
    if not any(tuple(right[i: i + run]) in runs for i in range(len(right) - run + 1)):
        return 0.0
    # Longest common subsequence, one machine word of states per step.
    masks: dict[str, int] = {}
    for i, t in enumerate(left):
        masks[t] = masks.get(t, 0) | 1 << i
    full = state = (1 << len(left)) - 1
    for t in right:
        hit = state & masks.get(t, 0)
        state = (state + hit | state - hit) & full
    common = len(left) - state.bit_count()
    return 2 * common / (len(left) + len(right))


def likeness(a: str, b: str) -> float:
    """0 to 1: the best score over the levels that both fingerprints hold; equal ones give 1."""
    if a == b:
        return 1.0
    (level_a, *sig_a), (level_b, *sig_b) = a.split(":"), b.split(":")
    by_level = dict(zip((int(level_a), int(level_a) + 1), sig_a))
    return max(
        (_score(by_level[k], s) for k, s in zip((int(level_b), int(level_b) + 1), sig_b) if k in by_level), default=0.0
    )


def with_following(rows: DataFrame, key: str, tie: str) -> tuple[DataFrame, int]:
    """Deal rows into ranges of ``key``, each ending with a copy of the row that follows it.

    Returns the rows with ``__range``, ``__last`` (true on the copies) and the number of
    ranges. Null keys come first. The last range ends with a copy of the very first row.
    Splits are quantiles of the key column alone; only those numbers reach the driver.
    """
    n = max(1, math.ceil(rows.select(key).count() / RANGE_ROWS))
    keyed = rows.withColumn("__k", F.col(key).cast("double"))
    cuts = keyed.select("__k").approxQuantile("__k", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    if len(splits) > 2:
        cut = Bucketizer(splits=splits, inputCol="__k", outputCol="__b", handleInvalid="keep")
        keyed = cut.transform(keyed).withColumn("__range", F.when(F.col(key).isNull(), 0).otherwise(F.col("__b").cast("int")))
    else:
        keyed = keyed.withColumn("__range", F.lit(0))
    keyed = keyed.drop("__k", "__b")
    # The first key of each range: one number per range.
    firsts = sorted(
        (r["__range"], r["nulls"] > 0, r["k"])
        for r in keyed.groupBy("__range").agg(F.min(key).alias("k"), F.count_if(F.col(key).isNull()).alias("nulls")).collect()
    )
    if not firsts:
        return keyed.withColumn("__last", F.lit(False)), 1
    spark = rows.sparkSession
    before = [firsts[i - 1][0] for i in range(len(firsts))]
    heads = spark.createDataFrame(
        [(r, None if null else k, p) for (r, null, k), p in zip(firsts, before)], "__range int, __first long, __to int"
    )
    head_rows = (
        keyed.join(F.broadcast(heads), "__range").filter(F.col(key).eqNullSafe(F.col("__first")))
        .withColumn("__n", F.row_number().over(Window.partitionBy("__range").orderBy(F.asc_nulls_first(tie))))
        .filter("__n = 1")
    )
    copies = head_rows.withColumn("__range", F.col("__to")).select(*keyed.columns).withColumn("__last", F.lit(True))
    return keyed.withColumn("__last", F.lit(False)).unionByName(copies), len(splits) - 1


def fingerprint_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``fingerprint`` of every whole text; a null text counts as empty."""

    def rows(batches: Iterator[dict]):
        for batch in batches:
            for k, t in zip(batch[key].to_pylist(), batch[text]):
                yield k, fingerprint((t.as_py() or "").encode())

    return arrow_map(docs.select(key, text), rows, f"{key} {docs.schema[key].dataType.simpleString()}, fingerprint string")


def fingerprint_with_edits(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text's fingerprint, that of an edited copy, and the likeness to it and to the next text.

    The edited copy ends, instead of in its last floor(n / 2) code points, in as many first
    ones of the text with the next larger key (all, if that is shorter); the last text is
    followed by the first. Null texts count as empty; null keys come first; rows with equal
    keys follow each other in the order of their texts. One row comes out for each row in.
    The texts are shuffled once, by ranges of the key.
    """
    dealt, n = with_following(docs.select(F.col(key).cast("long").alias(key), F.coalesce(text, F.lit("")).alias("text")), key, "text")
    dealt = dealt.repartitionById(n, F.col("__range")).sortWithinPartitions("__last", F.asc_nulls_first(key), "text")

    def rows(batches: Iterator[dict]):
        held = None
        for batch in batches:
            for k, t in zip(batch[key].to_pylist(), batch["text"]):
                whole = t.as_py()
                own = fingerprint(whole.encode())
                if held is not None:
                    yield _edited(*held, whole, own)
                held = k, whole, own

    return arrow_map(
        dealt.select(key, "text"), rows,
        f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def _edited(key, text: str, own: str, following: str, its: str) -> tuple:
    half = len(text) // 2
    changed = (text[: len(text) - half] + following[:half]).encode()
    mark = fingerprint(changed)
    return key, len(text), hashlib.sha256(changed).hexdigest(), own, mark, likeness(own, mark), likeness(own, its)
