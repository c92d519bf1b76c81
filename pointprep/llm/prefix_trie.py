"""Trie of conversation prefixes, built in range-partitioned shards around a broadcast skeleton.

A conversation is the path of its turns, each a 128-bit digest of role and text. Equal paths are
counted first; a number of different paths, drawn by hash, become the splitters of a range partition. The members
of a node lie side by side in path order, so a node whose members are in two shards is a prefix of the splitter
between them. All prefixes of splitters form the skeleton, which every task gets. A shard reads its paths in
order with one stack: nodes outside the skeleton are complete when they leave it; skeleton nodes
leave a partial aggregate, and these are reduced by node and then added up from the bottom of the skeleton.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from pointprep.llm.common import arrow_map, materialize

#: Hex digits of a turn's digest; a path is the digests one after the other.
DIGITS = 32
#: Turns of different paths in one shard.
SHARD_TURNS = 300_000
#: Paths drawn for each splitter, and the bytes of all that are drawn: longer paths are cut to their first turns.
DRAWN = 20
DRAWN_BYTES = 16 << 20
#: Conversations of one path whose numbers are put together before the task that reads them all.
CHUNK = 4096
_NOTHING = hashlib.sha256(b"").hexdigest()


def conversation_paths(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id`` and ``path``, its turns in order as (key, bytes): digest of role and text, UTF-8 length of the text.

    A null turn comes first; rows of one turn come by role and then by digest. Null role and text count as
    empty. Rows without a conversation number take no part. Texts stay where they are read.
    """
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256), 1, DIGITS)
    rows = convs.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), r.alias("role"), digest.alias("key"), F.octet_length(t).cast("long").alias("bytes")).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["bytes"].alias("bytes"))).alias("path"))


def replace_heads(paths: DataFrame, base: Column, turns: Column) -> DataFrame:
    """Paths whose first ``turns`` turns are those of the conversation ``base``: all if it has fewer, none if it is absent."""
    asked = paths.select("conv_id", "path", base.alias("__base"), turns.cast("int").alias("__h"))
    heads = paths.select(F.col("conv_id").alias("__base"), F.col("path").alias("__head"))
    mine = F.slice("path", F.col("__h") + 1, F.greatest(F.size("path") - F.col("__h"), F.lit(0)))
    theirs = F.when(F.col("__head").isNotNull(), F.slice("__head", F.lit(1), F.col("__h")))
    joined = asked.join(heads, "__base", "left")
    return joined.select("conv_id", F.when(theirs.isNull(), mine).otherwise(F.concat(theirs, mine)).alias("path"))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """Each different path with its turns' ``sizes``, number ``n`` and ``least`` of its conversations and the digest ``ends`` of them all.

    The digest takes the numbers in ascending order, which only one task can do; it reads them in texts of up to
    ``CHUNK`` numbers that other tasks have put together, and holds none of them.
    """
    keyed = paths.select(
        "conv_id", F.array_join(F.transform("path", lambda p: p["key"]), "").alias("key"), F.transform("path", lambda p: p["bytes"]).alias("sizes")
    )
    chunks = keyed.groupBy("key", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(
        F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"),
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("numbers"),
    )

    def rows(batches: Iterator[dict]):
        now = None
        for batch in batches:
            for key, sizes, n, least, numbers in zip(*(batch[c].to_pylist() for c in ("key", "sizes", "n", "least", "numbers"))):
                if now is None or now[0] != key:
                    if now is not None:
                        yield (*now, digest.hexdigest())
                    now, digest = [key, sizes, n, least], hashlib.sha256(numbers.encode())
                else:
                    now[2] += n
                    digest.update(b"," + numbers.encode())
        if now is not None:
            yield (*now, digest.hexdigest())

    together = chunks.repartition("key").sortWithinPartitions("key", "chunk")
    return materialize(arrow_map(together, rows, "key string, sizes array<long>, n long, least long, ends string"), "paths")


def shared_turns(a: str, b: str) -> int:
    """Turns that two paths begin with in common."""
    n = min(len(a), len(b)) // DIGITS
    k = 0
    while k < n and a[k * DIGITS: (k + 1) * DIGITS] == b[k * DIGITS: (k + 1) * DIGITS]:
        k += 1
    return k


def pick_splitters(drawn: list[str], shards: int) -> list[str]:
    """Splitters from the paths drawn, each cut to the turn that tells it from the path before."""
    drawn = sorted(set(drawn))
    picked = []
    for i in range(1, shards):
        at = i * len(drawn) // shards
        if 0 < at < len(drawn):
            picked.append(drawn[at][: (shared_turns(drawn[at - 1], drawn[at]) + 1) * DIGITS])
    return sorted(set(picked))


def skeleton_of(splitters: list[str]) -> dict[str, int]:
    """All prefixes of the splitters, the root among them, numbered in path order."""
    prefixes = {s[: d * DIGITS] for s in splitters for d in range(len(s) // DIGITS + 1)} | {""}
    return {p: i for i, p in enumerate(sorted(prefixes))}


NODES = (
    "skeleton int, partial boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, bytes long"
)


class _Node:
    __slots__ = ("skeleton", "bytes", "n", "least", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, skeleton: int | None, size: int):
        self.skeleton, self.bytes = skeleton, size
        self.n, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends = _NOTHING
        #: Finished children, whose parent's smallest member is not known yet.
        self.waiting: list[tuple] = []


def shard_nodes(paths: Iterator[tuple], skeleton: dict[str, int]) -> Iterator[tuple]:
    """Rows of ``NODES`` for paths in order: complete nodes, and partial ones of the skeleton."""
    stack: list[_Node] = []
    before = ""

    def leave():
        node = stack.pop()
        parent = stack[-1] if stack else None
        depth = len(stack)
        for row in node.waiting:
            yield (None, False, *row[:2], node.least, *row[2:], None)
        if parent is not None:
            parent.n += node.n
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
        if node.skeleton is not None:
            yield (node.skeleton, True, node.least, depth, None, node.n, node.children, node.leaves, node.saved, node.ends, node.bytes)
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.bytes
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        row = (node.least, depth, node.n, node.children, leaves, saved, node.ends)
        if parent.skeleton is not None:
            yield (parent.skeleton, False, *row[:2], None, *row[2:], None)
        else:
            parent.waiting.append(row)

    for key, sizes, n, least, ends in paths:
        if not stack:
            stack.append(_Node(skeleton[""], 0))
        keep = shared_turns(before, key) + 1
        while len(stack) > keep:
            yield from leave()
        inside = stack[-1].skeleton is not None
        for d in range(len(stack), len(sizes) + 1):
            number = skeleton.get(key[: d * DIGITS]) if inside else None
            inside = number is not None
            stack.append(_Node(number, sizes[d - 1]))
        top = stack[-1]
        top.n, top.ends = top.n + n, ends
        top.least = least if top.least is None else min(top.least, least)
        before = key
    while stack:
        yield from leave()


def combine_skeleton(skeleton: dict[str, int], partial: dict[int, tuple]) -> list[tuple]:
    """Complete rows of the skeleton's nodes from their reduced aggregates (n, least, children, leaves, saved, ends, bytes)."""
    added = {i: [0, 0, 0] for i in skeleton.values()}
    parents = {i: skeleton[p[:-DIGITS]] if p else None for p, i in skeleton.items()}
    done = []
    for prefix, i in sorted(skeleton.items(), key=lambda x: -len(x[0])):
        n, least, children, leaves, saved, ends, size = partial[i]
        children, leaves, saved = (a + b for a, b in zip((children, leaves, saved), added[i]))
        leaves = leaves if children else 1
        saved += (n - 1) * size
        parent = parents[i]
        if parent is not None:
            added[parent] = [a + b for a, b in zip(added[parent], (1, leaves, saved))]
        done.append((i, least, len(prefix) // DIGITS, None if parent is None else partial[parent][1], n, children, leaves, saved, ends))
    return done


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """The trie of ``paths`` (``conv_id``, unique, and ``path`` as from ``conversation_paths``), a row per node.

    A node is a different sequence of first turns; the root has none. Its members are the conversations that begin
    with it. Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes in its subtree, itself included), ``saved_tokens`` (over its
    subtree, members beyond the first times the bytes of the node's last text) and ``ends_sha256`` of the
    members that end there. ``conv_id`` and ``depth`` name a node. No conversations give no nodes.

    A path is one row of ``DIGITS`` characters and 8 bytes a turn; the skeleton is at most ``DRAWN_BYTES``.
    Paths that agree in more turns than a drawn path keeps share a shard, which reads them one by one.
    """
    spark = paths.sparkSession
    distinct = distinct_paths(paths)
    about = distinct.agg(F.count(F.lit(1)).alias("paths"), F.sum(F.size("sizes") + 1).alias("turns")).first()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    kinds = dict(p.split() for p in NODES.split(", "))
    if not about["paths"]:
        return spark.createDataFrame([], ", ".join(f"{c} {kinds[c]}" for c in columns))
    if shards is None:
        shards = max(min(spark.sparkContext.defaultParallelism, about["turns"] // 10_000 + 1), math.ceil(about["turns"] / SHARD_TURNS))
    wanted = DRAWN * shards
    cap = max(1, DRAWN_BYTES // (wanted * DIGITS)) * DIGITS
    chosen = F.pmod(F.xxhash64("key"), F.lit(about["paths"])) < wanted
    drawn = distinct.filter(chosen).select(F.substring("key", 1, cap).alias("key")).distinct().collect()
    splitters = pick_splitters([r["key"] for r in drawn], shards)
    skeleton = skeleton_of(splitters)

    def place(batches: Iterator[dict]):
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("key", "sizes", "n", "least", "ends"))):
                yield (bisect_right(splitters, row[0]), *row)

    placed = arrow_map(distinct, place, "shard int, key string, sizes array<long>, n long, least long, ends string")
    local = placed.repartitionById(len(splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "key")

    def build(batches: Iterator[dict]):
        # One partition may get several shards; a path before all others of its shard starts a new stack there too.
        def rows():
            for batch in batches:
                yield from zip(*(batch[c].to_pylist() for c in ("key", "sizes", "n", "least", "ends")))

        yield from shard_nodes(rows(), skeleton)

    nodes = materialize(arrow_map(local, build, NODES), "nodes")
    reduced = nodes.filter("partial").groupBy("skeleton").agg(
        F.sum("n_convs"), F.min("conv_id"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"),
        F.min(F.when(F.col("ends_sha256") != _NOTHING, F.col("ends_sha256"))), F.max("bytes"),
    ).collect()
    done = combine_skeleton(skeleton, {r[0]: (*r[1:6], r[6] or _NOTHING, r[7]) for r in map(tuple, reduced)})
    top = spark.createDataFrame(done, "skeleton int, " + ", ".join(f"{c} {kinds[c]}" for c in columns))
    # As many rows as the skeleton has nodes.
    parents = F.broadcast(top.select("skeleton", F.col("conv_id").alias("__parent")))
    below = nodes.filter("not partial").join(parents, "skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__parent"))
    return below.select(*columns).unionByName(top.select(*columns))
