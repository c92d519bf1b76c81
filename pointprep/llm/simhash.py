"""SimHash fingerprints and their near-duplicate classes by a binary trie self-join.

Each distinct fingerprint is dealt to groups that share 28 of its bits: of four bands of 16
bits one must be equal in any pair that differs in at most three bits, and of the four
quarters of the other 48 bits one must be equal again. Within a group the sorted
fingerprints form a binary trie. Pairs of its nodes are walked down together, adding up
the bits in which they differ, and dropped once these exceed the budget. A group hands on
a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from pointprep.llm.common import arrow_map, materialize
from pointprep.plans.components import connected_components

BUDGET = 3
SHINGLE = 3
#: Distinct fingerprints that one group may hold before it is dealt out once more.
GROUP_ROWS = 50_000
#: Rows of groups that a task is meant to hold.
TASK_ROWS = 100_000
#: Node pairs walked at a time.
PAIRS = 1 << 20
#: Shingles whose bits are summed at a time.
BLOCK = 1 << 16

_LOWER = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def simhash(text: str) -> int:
    """Bit i is set if it is set in over half the hashes of the word shingles; no words give 0."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(SHINGLE, len(words))
    a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    h = xxhash.xxh64_intdigest
    n = len(a)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([h(joined[i:j], 42) for i, j in zip(a[at: at + BLOCK], b[at: at + BLOCK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def simhash_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and its fingerprint ``fp`` as a signed 64-bit number; a null text counts as empty."""

    def rows(batches: Iterator[dict]):
        for batch in batches:
            for k, t in zip(batch[key].to_pylist(), batch[text]):
                fp = simhash(t.as_py() or "")
                yield k, fp - (1 << 64) if fp >> 63 else fp

    return arrow_map(docs.select(key, text), rows, f"{key} {docs.schema[key].dataType.simpleString()}, fp long")


def trie_links(values: np.ndarray, bits: int, budget: int = BUDGET) -> np.ndarray:
    """Index pairs of sorted distinct numbers of ``bits`` bits that differ in at most ``budget`` of them."""
    n = len(values)
    prefixes = [np.unique(values >> np.uint64(bits - t), return_index=True) for t in range(bits + 1)]
    nodes = [p[0] for p in prefixes]
    first = [np.append(p[1], n) for p in prefixes]
    children = []
    for t in range(bits):
        wanted = nodes[t] << np.uint64(1)
        pair = []
        for bit in (0, 1):
            want = wanted | np.uint64(bit)
            at = np.searchsorted(nodes[t + 1], want)
            there = at < len(nodes[t + 1])
            there[there] = nodes[t + 1][at[there]] == want[there]
            pair.append(np.where(there, at, -1))
        children.append(pair)
    found = []
    todo = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int8))]
    while todo:
        t, u, v, e = todo.pop()
        # A pair of lone leaves is settled by its numbers.
        lone = (first[t][u + 1] - first[t][u] == 1) & (first[t][v + 1] - first[t][v] == 1)
        if lone.any():
            i, j = first[t][u[lone]], first[t][v[lone]]
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            found.append(np.stack([i[near], j[near]], axis=1))
            u, v, e = u[~lone], v[~lone], e[~lone]
        if not len(u) or t == bits:
            continue
        (u0, u1), (v0, v1) = ([c[x] for c in children[t]] for x in (u, v))
        same = u == v
        kids = [(u0, v0, e), (u1, v1, e), (u0, v1, e + 1), (np.where(same, -1, u1), v0, e + 1)]
        u, v, e = (np.concatenate([k[i] for k in kids]) for i in range(3))
        keep = (u >= 0) & (v >= 0) & (e <= budget)
        u, v, e = u[keep], v[keep], e[keep].astype(np.int8)
        for at in range(0, len(u), PAIRS):
            todo.append((t + 1, u[at: at + PAIRS], v[at: at + PAIRS], e[at: at + PAIRS]))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _forest(n: int, links: np.ndarray) -> Iterator[tuple[int, int]]:
    """The links that join what was not joined yet."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in links.tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            yield i, j


def _field(value, start: int, width: int):
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1))


def simhash_links(prints: DataFrame) -> DataFrame:
    """``src`` and ``dst``: links between distinct fingerprints ``fp`` that differ in 1 to 3 bits.

    Every two fingerprints within the budget end up connected; of links that close a
    circle within a group one is left out.
    """
    # Rotated so that the equal band comes first, the group then holds 48 other bits.
    bands = prints.select(F.explode(F.array(*[
        F.struct(F.lit(j).alias("band"), (F.shiftleft("fp", 16 * j).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * j)) if j else F.col("fp")).alias("r"))
        for j in range(4)
    ])).alias("b")).select("b.band", "b.r")
    quarters = bands.select("band", F.explode(F.array(*[
        F.struct(
            F.lit(q).alias("quarter"),
            F.shiftleft(_field(F.col("r"), 48, 16), 12).bitwiseOR(_field(F.col("r"), 12 * q, 12)).alias("same"),
        ) for q in range(4)
    ])).alias("k"), "r").select(F.col("band").cast("tinyint").alias("band"), F.col("k.quarter").cast("tinyint").alias("quarter"), F.col("k.same").cast("int").alias("same"), "r")
    keys = ["band", "quarter", "same"]
    # A group of one has no links; a crowded one is cut by nine more equal bits of its other 36.
    sizes = quarters.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    grouped = quarters.join(sizes, keys).withColumn("part", F.when(F.col("n") > GROUP_ROWS, F.array(*[
        F.struct(F.lit(p).alias("p"), F.abs(F.xxhash64(*[_field(F.col("r"), 12 * q + 3 * p, 3) for q in range(4)], "quarter")).alias("x")) for p in range(4)
    ])).otherwise(F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).cast("long").alias("x"))))).select(*keys, "r", F.explode("part").alias("part"))
    keys = [*keys, "part"]
    # Rows are few bytes but much work, so tasks are sized by rows. A fingerprint has 16 of them at least.
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism * 2, prints.count() * 16 // TASK_ROWS)
    ordered = grouped.repartition(tasks, *keys).sortWithinPartitions(*keys, "r")

    def rows(batches: Iterator[dict]):
        held_key, held = None, []

        def links():
            if len(held) < 2:
                return
            band = held_key[0]
            rotated = np.sort(np.array(held, np.int64).view(np.uint64))
            turn = np.uint64(16 * band)
            own = (rotated >> turn | rotated << np.uint64(64 - 16 * band)) if band else rotated
            own = own.view(np.int64).tolist()
            # The leading band is equal within a group.
            tail = rotated & np.uint64((1 << 48) - 1)
            for i, j in _forest(len(own), trie_links(tail, 48)):
                yield min(own[i], own[j]), max(own[i], own[j])

        for batch in batches:
            part = batch["part"].to_pylist()
            for b, q, s, x, r in zip(*(batch[c].to_pylist() for c in ("band", "quarter", "same")), part, batch["r"].to_pylist()):
                key = (b, q, s, x["p"], x["x"])
                if key != held_key:
                    yield from links()
                    held_key, held = key, []
                held.append(r)
        yield from links()

    return arrow_map(ordered, rows, "src long, dst long").distinct()


def simhash_classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``fingerprint`` in hex and ``component_id``, the smallest key reachable by links.

    Texts without words have fingerprint zero and are linked like any other. Null texts
    count as empty, repeated rows stay repeated. Documents with equal fingerprints are one
    node, whatever their number, so groups of copies cost nothing in the join.
    """
    prints = materialize(simhash_documents(docs, text, key), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    links = materialize(simhash_links(nodes.select("fp")), "links")
    linked = links.select(F.explode(F.array("src", "dst")).alias("fp")).distinct().join(nodes, "fp")
    labels = connected_components(
        linked.select(F.lit(0).alias("g"), F.col("fp").alias("node")),
        links.select(F.lit(0).alias("g"), "src", "dst"), key="g", node="node",
    )
    roots = labels.join(nodes, F.col("node") == F.col("fp")).groupBy("label").agg(F.min("least").alias("component_id"))
    classes = nodes.join(labels.join(roots, "label").select(F.col("node").alias("fp"), "component_id"), "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")
    )
    # Copies crowd on one fingerprint; the join is an inner one, which Spark can split.
    return prints.join(classes, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
