"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern, the set of sources they belong to. Token
capacity flows from patterns to the quotas of their sources; the r-th repetition of a
token costs r - 1, so cost is convex and nothing repeats while fresh tokens are left. The
flow is small: a node per pattern and source. Sources that share no pattern with another
have a flow that can be written down; the others are routed one connected group of sources
at a time. Then each pattern picks documents in a seeded order until the tokens routed
through it are met, by thresholds found from sums over hash prefixes, so no group of
documents is ever sorted or windowed whole. Patterns, sources and flows stay tables.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from pointprep.llm.common import WORD, materialize
from pointprep.plans.components import connected_components
from pointprep.plans.salt import salted_join

#: Bits of the seeded hash that one round of sums looks at.
PREFIX_BITS = 12
#: Bytes of a table about patterns that goes to every task; a larger one is joined by pattern.
BROADCAST_BYTES = 16 << 20
#: A flow below this is none.
EPSILON = 1e-6
#: Bits of a row number that count within one task of the table it was given in.
_ROW_BITS = 33
_ALL = (1 << 63) - 1


def quotas(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, stop: float = 2.0) -> list[float]:
    """Targets by weight that add up to ``share`` of all sizes, none above ``stop`` times its size.

    What a stopped source leaves is shared again among the others by weight.
    """
    total = share * sum(sizes)
    targets: list[float | None] = [None] * len(sizes)
    while True:
        free = [i for i, t in enumerate(targets) if t is None]
        rest = total - sum(t for t in targets if t is not None)
        weight = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / weight > stop * sizes[i]]
        for i in over:
            targets[i] = stop * sizes[i]
        if not over:
            for i in free:
                targets[i] = rest * weights[i] / weight
            return [float(t) for t in targets]


def route(patterns: Sequence[tuple[Sequence[int], float]], targets: Sequence[float], copies: int) -> list[list[float]]:
    """Tokens that each pattern gives in its first, second ... copy: a min-cost maximum flow.

    ``patterns`` holds the sources of each pattern and its tokens. Only the arcs into a pattern
    cost anything, r for its r-th repetition, and a path takes one of them. So the paths of cost r
    are those that start with such an arc: the arcs of each cost are opened in turn and filled by
    blocking flows over the shortest paths, until none is left.
    """
    n = len(patterns)
    source, sink = n + len(targets), n + len(targets) + 1
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    head: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, capacity: float) -> int:
        for u, v, c in ((a, b, capacity), (b, a, 0.0)):
            graph[u].append(len(head))
            head.append(v)
            room.append(c)
        return len(head) - 2

    for i, (members, tokens) in enumerate(patterns):
        for s in members:
            arc(i, n + s, float(tokens) * copies)
    for s, t in enumerate(targets):
        arc(n + s, sink, t)
    supply: list[list[int]] = [[] for _ in patterns]
    for _ in range(copies):
        for i, (_, tokens) in enumerate(patterns):
            supply[i].append(arc(source, i, float(tokens)))
        while (level := _levels(graph, head, room, source))[sink] >= 0:
            _fill(graph, head, room, level, source, sink)
    return [[room[e ^ 1] for e in arcs] for arcs in supply]


def _levels(graph: list[list[int]], head: list[int], room: list[float], source: int) -> list[int]:
    """Steps from the source over arcs with room, -1 where there is no way."""
    level = [-1] * len(graph)
    level[source] = 0
    queue = deque([source])
    while queue:
        u = queue.popleft()
        for e in graph[u]:
            if room[e] > EPSILON and level[head[e]] < 0:
                level[head[e]] = level[u] + 1
                queue.append(head[e])
    return level


def _fill(graph: list[list[int]], head: list[int], room: list[float], level: list[int], source: int, sink: int) -> None:
    """Fill paths that go one level up with each step until each of them has a full arc."""
    at = [0] * len(graph)
    path: list[int] = []
    u = source
    while True:
        if u == sink:
            moved = min(room[e] for e in path)
            for e in path:
                room[e] -= moved
                room[e ^ 1] += moved
            # Back to the start of the first arc that is full now.
            keep = next(i for i, e in enumerate(path) if room[e] <= EPSILON)
            u = head[path[keep] ^ 1]
            del path[keep:]
        elif at[u] < len(graph[u]):
            e = graph[u][at[u]]
            if room[e] > EPSILON and level[head[e]] == level[u] + 1:
                path.append(e)
                u = head[e]
            else:
                at[u] += 1
        elif path:
            # Nothing leads on from here.
            u = head[path.pop() ^ 1]
            at[u] += 1
        else:
            return


def word_count(text: str | Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_of(text: str, key: str, seed: int) -> Column:
    """The place of a document in the order in which documents are taken."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), 2)


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, copies: int = 2, seed: int = 42,
                text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Which documents a mix takes, and how often.

    ``source`` is a string or an array of strings; a null is a source of its own and comes
    last. Sources in code point order get ``weights`` in turn. Returns per document ``key``,
    ``size`` in words, ``source_size`` and ``target`` (summed over its sources), ``taken``
    (size times the copies taken), ``copies`` and ``draw``. An empty array takes no part: nothing is
    taken of it. Null texts have size 0. Each row is a document of its own, whatever its key. The order
    is ``draw``, a hash of key and text, so a rerun takes the same; of rows that are equal in both some may be taken and some
    not. A pattern's take misses its flow by half a document at most. There may be any number of sources and patterns; the
    patterns of sources that overlap, directly or through others, are routed together in one task (their sums, never their documents).
    """
    members = F.array_sort(F.array_distinct(
        F.transform(F.col(source), lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("~")))
        if isinstance(docs.schema[source].dataType, ArrayType) else F.array(F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("~")))
    ))
    # The hash is spread over 62 bits, so that prefixes are plain divisions.
    sized = materialize(docs.select(
        F.col(key).alias("key"), F.coalesce(members, F.array().cast("array<string>")).alias("members"), word_count(text).alias("size"),
        draw_of(text, key, seed).alias("u"), F.monotonically_increasing_id().alias("row"),
    ).select("key", F.to_json("members").alias("pattern"), "members", "size", "u", "row"), "sized")
    patterns = sized.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members"))
    patterns = materialize(patterns, "patterns")
    listed = patterns.select("pattern", F.explode("members").alias("source"), "size")
    sources = source_targets(listed.groupBy("source").agg(F.sum("size").alias("size")), weights, share, copies)
    own = F.array_sort(F.collect_list(F.struct("number", "source_size", "target")))
    placed = listed.select("pattern", "source").join(sources, "source").groupBy("pattern").agg(own.alias("own"))
    patterns = materialize(patterns.join(placed, "pattern", "left").select(
        "pattern", "size", F.coalesce("own", F.array().cast("array<struct<number:long,source_size:long,target:double>>")).alias("own"),
    ), "patterns")
    weight = patterns.agg(F.sum(F.octet_length("pattern") + 64 * (copies + 1)).alias("bytes")).first()["bytes"] or 0

    def meet(rows: DataFrame, about: DataFrame, on: list[str]) -> DataFrame:
        """Rows joined with a table about their patterns; both ways give the same."""
        return rows.join(F.broadcast(about), on) if weight <= BROADCAST_BYTES else salted_join(rows, about, on, ["row"])

    flows = materialize(pattern_flows(patterns, copies), "flows")
    ends = _thresholds(sized, flows.filter("flow > 0 and flow < size").select("pattern", "copy", F.col("flow").alias("goal")), meet)
    nothing, whole = (F.struct(F.lit(u).cast("long").alias("u"), F.lit(-1).cast("long").alias("k")) for u in (-1, 1 << 62))
    limit = F.when(F.col("flow") <= 0, nothing).when(F.col("flow") >= F.col("size"), whole).otherwise(F.struct("u", "k"))
    limits = flows.join(ends, ["pattern", "copy"], "left").groupBy("pattern").agg(F.collect_list(limit).alias("limits"))
    per = patterns.join(limits, "pattern", "left").select(
        "pattern", "limits", F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["source_size"]).alias("source_size"),
        F.aggregate("own", F.lit(0.0), lambda a, x: a + x["target"]).alias("target"),
    )
    within = F.size(F.filter("limits", lambda t: (F.col("u") < t["u"]) | (F.col("u") == t["u"]) & (F.col("row") <= t["k"])))
    taken = meet(sized, per, ["pattern"]).withColumn("copies", F.when(F.col("limits").isNull(), 0).otherwise(within))
    return taken.select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", F.col("u").alias("draw")
    )


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, stop: float) -> DataFrame:
    """``source``, its ``number`` in code point order, ``source_size`` and ``target``, as ``quotas`` gives them.

    Every round sends one row per weight to the driver. Targets of free sources only grow, so
    sources that have been stopped stay stopped and the rounds end.
    """
    ranged = materialize(sources.repartitionByRange("source").withColumn("part", F.spark_partition_id()), "sources")
    # One row per range.
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("source"))
    numbered = ranged.join(F.broadcast(parts), "part").select("source", "size", (F.col("before") + place - 1).alias("number"))
    turn = (F.col("number") % len(weights)).cast("int")
    numbered = materialize(numbered.withColumn("turn", turn).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    ), "sources")
    total = share * (numbered.agg(F.sum("size")).first()[0] or 0)
    free_part, stopped, most = F.lit(0.0), F.lit(False), -1
    while True:
        rows = numbered.withColumn("stopped", stopped).groupBy("turn").agg(
            F.count_if(~F.col("stopped")).alias("free"), F.count_if("stopped").alias("over"), F.sum(F.when(F.col("stopped"), F.col("size"))).alias("held")
        ).collect()
        if sum(r["over"] for r in rows) <= most:
            break
        most = sum(r["over"] for r in rows)
        rest = total - stop * sum(r["held"] or 0 for r in rows)
        weight = sum(float(weights[r["turn"]]) * r["free"] for r in rows)
        if weight <= 0:
            break
        free_part = F.lit(float(rest)) * F.col("weight") / F.lit(weight)
        stopped = free_part > F.lit(float(stop)) * F.col("size")
    target = F.when(stopped, F.lit(float(stop)) * F.col("size")).otherwise(free_part)
    return numbered.select("source", "number", F.col("size").alias("source_size"), target.alias("target"))


def pattern_flows(patterns: DataFrame, copies: int) -> DataFrame:
    """``flow`` of every ``pattern`` and ``copy``, beside its ``size``; patterns without sources have none.

    A source that shares no pattern fills its first copy, then its second. The others
    fall into connected groups, and the patterns of a group are routed in one task.
    """
    first = F.col("own")[0]["number"]
    shared = patterns.filter(F.size("own") > 1)
    bonds = shared.select(F.explode(F.transform(F.slice("own", 2, F.size("own") - 1), lambda o: o["number"])).alias("src"), first.alias("dst"))
    nodes = shared.select(F.explode("own.number").alias("node")).distinct()
    groups = connected_components(nodes.withColumn("graph", F.lit(0)), bonds.distinct().withColumn("graph", F.lit(0)), key="graph")
    known = patterns.filter(F.size("own") > 0).withColumn("node", first).join(groups.select("node", "label"), "node", "left")
    target, size = F.col("own")[0]["target"], F.col("size")
    alone = known.filter("label is null").select(
        "pattern", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "size", target.alias("target")
    ).select("pattern", "copy", "size", F.greatest(F.lit(0.0), F.least(size.cast("double"), F.col("target") - F.col("copy") * size)).alias("flow"))
    together = known.filter("label is not null").select(
        "label", "pattern", "size", F.col("own.number").alias("numbers"), F.col("own.target").alias("targets")
    )

    def routed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pattern")
        goal = dict(sorted((s, t) for ss, ts in zip(group["numbers"], group["targets"]) for s, t in zip(ss, ts)))
        place = {s: i for i, s in enumerate(goal)}
        found = route([([place[s] for s in ss], n) for ss, n in zip(group["numbers"], group["size"])], list(goal.values()), copies)
        rows = [(p, c, n, f) for p, n, fs in zip(group["pattern"], group["size"], found) for c, f in enumerate(fs)]
        return pd.DataFrame(rows, columns=["pattern", "copy", "size", "flow"])

    return alone.unionByName(together.groupBy("label").applyInPandas(routed, "pattern string, copy int, size long, flow double"))


def _thresholds(sized: DataFrame, goals: DataFrame, meet: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> DataFrame:
    """The last (``u``, row ``k``) of each pattern and copy whose middle lies within its goal.

    Two rounds of sums over 12 more bits of the hash each leave one slice of a pattern's
    documents, a 2^24-th of them. Equal documents share a place in it, however many there are: places
    are put in order, and the copies of the last one are counted by the task they were read in.
    """
    slices = goals.select("pattern", "copy", F.lit(0).cast("long").alias("slice"), F.lit(0.0).alias("before"), "goal")
    for level in (1, 2):
        width = 62 - level * PREFIX_BITS
        upper = F.shiftright("u", width + PREFIX_BITS) if level > 1 else F.lit(0).cast("long")
        sums = (
            meet(sized.withColumn("slice", upper), slices, ["pattern", "slice"])
            .groupBy("pattern", "copy", "before", "goal", F.shiftright("u", width).alias("slice")).agg(F.sum("size").alias("n"))
        )
        # At most 4096 rows per pattern and copy.
        w = Window.partitionBy("pattern", "copy").orderBy("slice")
        start = F.col("before") + F.sum("n").over(w) - F.col("n")
        last = sums.withColumn("start", start).filter("start <= goal").groupBy("pattern", "copy", "goal").agg(
            F.max_by(F.struct("slice", "start"), "slice").alias("s")
        )
        slices = materialize(last.select("pattern", "copy", "s.slice", F.col("s.start").alias("before"), "goal"), "slices")
    low = 62 - 2 * PREFIX_BITS
    places = meet(sized.withColumn("slice", F.shiftright("u", low)), slices, ["pattern", "slice"]).groupBy(
        "pattern", "copy", "before", "goal", "u").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"))
    w = Window.partitionBy("pattern", "copy").orderBy("u")
    ahead = F.col("goal") - (F.col("before") + F.sum("tokens").over(w) - F.col("tokens"))
    fit = F.when(F.col("tokens") > 0, F.floor(F.col("ahead") * F.col("n") / F.col("tokens") + 0.5)).otherwise(
        F.when(F.col("ahead") >= 0, F.col("n")).otherwise(0))
    ends = places.withColumn("ahead", ahead).withColumn("fit", F.least(F.col("n"), fit)).filter("fit > 0").groupBy("pattern", "copy").agg(
        F.max_by(F.struct("u", "fit", "n"), "u").alias("e")
    )
    ends = materialize(slices.join(ends, ["pattern", "copy"], "left").select(
        "pattern", "copy", F.coalesce("e.u", F.shiftleft("slice", low)).alias("u"), "e.fit",
        F.when(F.col("e").isNull(), F.lit(-1).cast("long")).when(F.col("e.fit") == F.col("e.n"), F.lit(_ALL)).alias("k"),
    ), "ends")
    tied = meet(sized.select("pattern", "u", "row"), ends.filter("k is null").select("pattern", "copy", "u", "fit"), ["pattern", "u"])
    tied = tied.withColumn("task", F.shiftright("row", _ROW_BITS))
    w = Window.partitionBy("pattern", "copy").orderBy("task")
    counts = tied.groupBy("pattern", "copy", "fit", "task").agg(F.count(F.lit(1)).alias("n"))
    there = counts.withColumn("left", F.col("fit") - F.sum("n").over(w) + F.col("n")).filter("left > 0 and left <= n")
    nth = F.row_number().over(Window.partitionBy("pattern", "copy").orderBy("row"))
    rows = tied.join(there.select("pattern", "copy", "task", "left"), ["pattern", "copy", "task"]).withColumn("nth", nth).filter("nth = left")
    return ends.join(rows.select("pattern", "copy", "row"), ["pattern", "copy"], "left").select(
        "pattern", "copy", "u", F.coalesce("k", "row").alias("k")
    )
