"""Exact k-nearest-neighbour join per group.

Both sides are cut into small blocks of nearby rows. A tree of block boxes is searched with
one join per tree level: a query block keeps a target block only if its gap is within the distance
that certainly holds k targets. That distance is loose, so it only serves to find candidates.
The few candidate blocks that already hold k rows are then compared row by row, which gives
every query a real distance to beat, and each query keeps of the candidates only the
blocks whose box is within its own distance. Rows meet by target block, so what is formed
follows the neighbourhood of each query. Ties are broken by target id. Groups of some hundred rows
are not searched at all: a task compares their rows (see ``grouped``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from pointprep.plans.blocks import (
    CURVE,
    Profile,
    assign_blocks,
    block_of,
    box_max_d2,
    box_min_d2,
    boxes,
    merge_boxes,
    partitions_for,
    profile,
    squared_sum,
)
from pointprep.plans.grouped import GROUP_ROWS, nearest_in_groups
from pointprep.plans.salt import salted_join
from pointprep.plans.skew import hot_row_limit
from pointprep.session import materialize

FANOUT = 32
#: Groups with up to so many targets are compared directly.
BLOCK_ROWS = 256
#: Smallest blocks of either side, and the largest of queries.
LEAST_BLOCK = 8
QUERY_BLOCK = 256


@dataclass(frozen=True)
class QueryBlocks:
    """Query rows with their block, and the blocks' boxes, both written out; searches can share them."""

    rows: DataFrame
    boxes: DataFrame
    size: int


def block_queries(
    q_in: DataFrame, keys: Sequence[str], coords: Sequence[str], size: int, about: Profile, curve: bool = False
) -> QueryBlocks:
    """``q_in`` has the keys, ``__q`` and the coordinates; with ``curve`` it has its order too, and nothing is sorted."""
    if curve:
        rows = q_in.withColumn("block", block_of(size)).drop(CURVE)
    else:
        rows = materialize(assign_blocks(q_in, keys, "__q", coords, size, about, 1), "queries")
    return QueryBlocks(rows, materialize(boxes(rows, [*keys, "block"], coords), "boxes"), size)


#: A level of a target tree has a quarter of the boxes below it; a search takes every second level.
TREE_STEP, STRIDE = 4, 2


@dataclass(frozen=True)
class TargetTree:
    """Boxes of all block sizes over rows that know their place on the curve, each level written once."""

    levels: list[DataFrame]
    top: int

    def start(self, size: int) -> int:
        """The level whose blocks have about ``size`` rows."""
        level = 0
        while LEAST_BLOCK * TREE_STEP ** (level + 1) <= size and level + 1 < len(self.levels):
            level += 1
        return level


def target_tree(rows: DataFrame, keys: Sequence[str], coords: Sequence[str]) -> TargetTree:
    """The tree of ``rows`` (or of a part of the rows that were put on the curve), for any number of searches."""
    keys = list(keys)
    level = materialize(boxes(rows.withColumn("__node", block_of(LEAST_BLOCK)), [*keys, "__node"], coords), "tree")
    top = level.agg(F.max("__node")).first()[0] or 0
    levels, left = [level], top
    while left >= TREE_STEP:
        left //= TREE_STEP
        up = levels[-1].withColumn("__node", F.floor(F.col("__node") / TREE_STEP).cast("bigint"))
        levels.append(materialize(merge_boxes(up, [*keys, "__node"], coords), "tree"))
    return TargetTree(levels, top)


def block_sizes(need: int, about: Profile) -> tuple[int, int]:
    """Rows per target and per query block, so that boxes of both sides are about equally large."""
    target = max(LEAST_BLOCK, need // 8)
    ratio = about.largest[1] / max(about.largest[0], 1)
    return target, int(min(QUERY_BLOCK, max(LEAST_BLOCK, target * ratio)))


def _prefixed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys])


def _prune(pairs: DataFrame, group: Sequence[str], need: int) -> DataFrame:
    """Keep boxes whose gap is within the smallest radius sure to hold ``need`` rows.

    ``__seed`` marks the boxes that reach twice this number first.
    """
    by_reach = W.partitionBy(*group).orderBy("__far", "__node").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*group)
    held = pairs.withColumn("__held", F.sum("t_n").over(by_reach))
    radius = F.min(F.when(F.col("__held") >= need, F.col("__far"))).over(whole)
    return (
        held.withColumn("__r2", radius)
        .filter(F.col("__r2").isNull() | (F.col("__near") <= F.col("__r2")))
        .withColumn("__seed", F.col("__held") - F.col("t_n") < 2 * need)
        .drop("__held", "__r2")
    )


def _drop_spare_copies(target_boxes: DataFrame, keys: Sequence[str], coords: Sequence[str], need: int) -> DataFrame:
    """Of a run of blocks that hold one position only, the first rows by id suffice."""
    point = F.lit(True)
    for c in coords:
        point = point & (F.col(f"lo_{c}") == F.col(f"hi_{c}"))
    run = W.partitionBy(*keys, *[f"lo_{c}" for c in coords]).orderBy("__node").rowsBetween(W.unboundedPreceding, -1)
    spots = target_boxes.filter(point).withColumn("__before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    return target_boxes.filter(~point).unionByName(spots.filter(F.col("__before") < need).drop("__before"))


def _levels(t_boxes: DataFrame, keys: Sequence[str], coords: Sequence[str], top: int) -> list[DataFrame]:
    levels = [t_boxes]
    while top >= FANOUT:
        top //= FANOUT
        up = levels[-1].withColumn("__node", F.floor(F.col("__node") / FANOUT).cast("bigint"))
        levels.append(merge_boxes(up, [*keys, "__node"], coords))
    return levels


def _candidate_blocks(q_boxes: DataFrame, levels: list[DataFrame], keys: Sequence[str], coords: Sequence[str], need: int, fan: int, about: Profile) -> DataFrame:
    """Pairs (query block, target block) that may hold a neighbour; ``levels`` from the blocks up, ``fan`` nodes below each."""
    group = [*keys, "q_block"]
    q = _prefixed(q_boxes, keys, "q_")

    def measured(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("__near", box_min_d2("q_", "t_", coords)).withColumn(
            "__far", box_max_d2("q_", "t_", coords)
        )

    def nodes(level: DataFrame) -> DataFrame:
        return _prefixed(level, [*keys, "__node"], "t_")

    # At most ``fan`` nodes per group at the top of the tree; a group with very many query blocks is dealt out.
    pairs = _prune(measured(salted_join(q, nodes(levels[-1]), list(keys), ["q_block"], hot=about.hot[1])), group, need)
    for level in reversed(levels[:-1]):
        parents = pairs.select(*group, *[c for c in q.columns if c not in group], F.col("__node").alias("__up"))
        children = nodes(level).withColumn("__up", F.floor(F.col("__node") / fan).cast("bigint"))
        pairs = _prune(measured(parents.join(children, [*keys, "__up"]).drop("__up")), group, need)
    return pairs.select(
        *group,
        F.col("__node").alias("t_block"),
        "q_n",
        "t_n",
        "__seed",
        *[f"t_{s}_{c}" for c in coords for s in ("lo", "hi")],
    )


def knn_join(
    queries: DataFrame,
    targets: DataFrame,
    k: int,
    keys: Sequence[str] = ("case_id",),
    query_id: str = "leaf_id",
    target_id: str = "point_id",
    coords: Sequence[str] = ("x", "y", "z"),
    payload: Sequence[str] = (),
    exclude_same_id: bool = False,
    block_rows: int = BLOCK_ROWS,
    rank_name: str = "rank",
    neighbour_name: str | None = None,
    carry: Sequence[str] = (),
    about: Profile | None = None,
    blocks: QueryBlocks | None = None,
    query_curve: bool = False,
    tree: TargetTree | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """The ``k`` nearest targets of every query within the same ``keys``.

    Returns keys, ``query_id``, rank from 1, the neighbour's id, ``dist`` and the
    neighbour's ``payload`` columns, and the query's own columns named by ``carry``, which
    follow from its id. Groups with fewer than ``k`` targets give what exists. ``about``
    reuses the profile of (targets, queries) at least as large and as wide as these, and
    ``blocks`` the blocks of these queries or of more; then ``queries`` only names the columns,
    and ``carry`` can name coordinates. With ``query_curve`` the queries have been put on a curve before (``with_curve``), with
    ``tree`` the targets have; neither is sorted again then. Groups with at most ``group_rows`` rows on either side, by
    default ``GROUP_ROWS`` unless smaller blocks are asked for, are compared whole.
    """
    keys, coords = list(keys), list(coords)
    neighbour = neighbour_name or (f"nbr_{target_id}" if target_id == query_id else target_id)
    place = [CURVE] if query_curve else []
    q_in = queries.select(*keys, F.col(query_id).alias("__q"), *coords, *[c for c in carry if c not in (*keys, *coords, *place)], *place)
    t_in = targets.select(
        *keys, F.col(target_id).alias("__t"), *coords, *[F.col(c).alias(f"p_{c}") for c in payload], *([CURVE] if tree else [])
    )
    if about is None:
        about = profile(t_in, q_in, keys, coords, hot_row_limit(queries.sparkSession))
    carried = [f"q_{c}" for c in carry if c not in keys]
    if group_rows is None:
        group_rows = GROUP_ROWS if block_rows >= BLOCK_ROWS else 0
    group_rows = min(group_rows, hot_row_limit(queries.sparkSession))
    ready = blocks is not None or query_curve or tree is not None
    plain = all(isinstance(t.schema[c].dataType, (T.DoubleType, T.FloatType)) for t in (q_in, t_in) for c in coords)
    whole = None
    if about.largest[0] > block_rows and group_rows > block_rows and plain and not ready:
        itself = queries is targets and exclude_same_id and query_id == target_id and not payload
        q_in, t_in, whole = _small_groups(q_in, t_in, keys, coords, payload, carried, k, exclude_same_id, itself, group_rows, about)
    if q_in is None:
        ranked_rows = whole
    else:
        ranked_rows = _searched(q_in, t_in, k, keys, coords, payload, carried, exclude_same_id, block_rows, about, blocks, query_curve, tree)
        if whole is not None:
            ranked_rows = ranked_rows.select(*whole.columns).unionByName(whole)
    extra = [F.col(f"t_p_{c}").alias(c) for c in payload]
    extra += [F.col(c).alias(c[2:]) for c in carried]
    return ranked_rows.select(
        *keys,
        F.col("__q").alias(query_id),
        F.col("__rank").cast("bigint").alias(rank_name),
        F.col("t___t").alias(neighbour),
        F.sqrt("__d2").alias("dist"),
        *extra,
    )


def _small_groups(
    q_in: DataFrame, t_in: DataFrame, keys: list[str], coords: list[str], payload: Sequence[str], carried: list[str], k: int,
    exclude_same_id: bool, itself: bool, group_rows: int, about: Profile,
) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """What is left to search of both sides, None if nothing is, and the nearest rows of the small groups, None if there are none."""
    work = about.work
    q_left, t_left = None, None
    if max(about.largest) > group_rows:
        sides = [df.select(*keys, F.lit(i).alias("__side")) for i, df in enumerate((q_in, t_in))]
        counts = [F.count_if(F.col("__side") == i).alias(f"__n{i}") for i in (0, 1)]
        sizes = sides[0].unionAll(sides[1]).groupBy(*keys).agg(*counts)
        pairs = F.col("__n0").cast("double") * F.col("__n1")
        fits = F.greatest("__n0", "__n1") <= group_rows
        work = sizes.agg(F.sum(F.when(fits, pairs)).alias("work")).first()["work"] or 0
        if not work:
            return q_in, t_in, None
        large = materialize(sizes.filter(~fits).select(*keys), "large")
        q_left, t_left = (df.join(large, keys, "left_semi") for df in (q_in, t_in))
        q_in, t_in = (df.join(large, keys, "left_anti") for df in (q_in, t_in))
    q_side = _prefixed(q_in, keys, "q_")
    if itself:
        q_side = q_side.withColumn("t___t", F.col("q___q"))
    found = nearest_in_groups(
        q_side, None if itself else _prefixed(t_in, keys, "t_"), k, keys, coords, [f"t_p_{c}" for c in payload], carried, exclude_same_id, work
    )
    return q_left, t_left, found


def _searched(
    q_in: DataFrame, t_in: DataFrame, k: int, keys: list[str], coords: list[str], payload: Sequence[str], carried: list[str],
    exclude_same_id: bool, block_rows: int, about: Profile, blocks: QueryBlocks | None, query_curve: bool, tree: TargetTree | None,
) -> DataFrame:
    """The nearest rows by joins: of small groups all targets, else those in the blocks nearby."""
    d2 = squared_sum([F.col(f"t_{c}") - F.col(f"q_{c}") for c in coords])
    if about.largest[0] <= block_rows:
        # Every group's targets fit one block: nothing to search, each query meets one block.
        q_side, t_side = _prefixed(q_in, [*keys, "__q"], "q_"), _prefixed(t_in, keys, "t_")
        tasks = partitions_for(q_in.sparkSession, about.work)
        met = salted_join(q_side, t_side, keys, ["__q"], hot=about.hot[1], keep_salt="__part", partitions=tasks)
        met = met.withColumn("__d2", d2)
        # Without hot groups the part number is a constant and adds nothing to the keys.
        per_query = [*keys, "__part", "__q"] if about.hot[1] else [*keys, "__q"]
    else:
        need = k + 1 if exclude_same_id else k
        met = _met_in_blocks(q_in, t_in, need, keys, coords, block_rows, about, d2, blocks, query_curve, tree)
        per_query = [*keys, "__q"]
    if exclude_same_id:
        met = met.filter(F.col("__q") != F.col("t___t"))

    if k == 1:
        best = met.groupBy(*per_query).agg(
            F.min(F.struct("__d2", "t___t", *[f"t_p_{c}" for c in payload])).alias("__b"), *[F.first(c).alias(c) for c in carried]
        ).select(*per_query, *carried, "__b.*")
        return best.withColumn("__rank", F.lit(1))
    nearest = W.partitionBy(*per_query).orderBy("__d2", "t___t")
    return met.withColumn("__rank", F.row_number().over(nearest)).filter(F.col("__rank") <= k)


def _met_in_blocks(
    q_in: DataFrame, t_in: DataFrame, need: int, keys: list[str], coords: list[str], block_rows: int, about: Profile, d2: Column,
    blocks: QueryBlocks | None, query_curve: bool, tree: TargetTree | None,
) -> DataFrame:
    """Query rows next to every target that can be among their ``need`` nearest."""
    t_size, q_size = block_sizes(need, about)
    t_size = min(t_size, block_rows)
    if blocks is None:
        blocks = block_queries(q_in, keys, coords, q_size, about, query_curve)
    if tree is None:
        t_rows = materialize(assign_blocks(t_in, keys, "__t", coords, t_size, about, 0), "targets")
        t_boxes = boxes(t_rows.withColumnRenamed("block", "__node"), [*keys, "__node"], coords)
        levels, fan = _levels(_drop_spare_copies(t_boxes, keys, coords, need), keys, coords, max(about.largest[0] - 1, 0) // t_size), FANOUT
    else:
        first = tree.start(t_size)
        t_size, fan = LEAST_BLOCK * TREE_STEP**first, TREE_STEP**STRIDE
        t_rows = t_in.withColumn("block", block_of(t_size)).drop(CURVE)
        levels = [_drop_spare_copies(tree.levels[first], keys, coords, need), *tree.levels[first + STRIDE:: STRIDE]]
    pairs = materialize(_candidate_blocks(blocks.boxes, levels, keys, coords, need, fan, about), "pairs")
    q_side = _prefixed(blocks.rows.withColumnRenamed("block", "q_block"), [*keys, "q_block", "__q"], "q_")
    t_side = _prefixed(t_rows.withColumnRenamed("block", "t_block"), [*keys, "t_block"], "t_")
    block, target, query = [*keys, "q_block"], [*keys, "t_block"], [*keys, "__q"]
    asked = max(hot_row_limit(q_in.sparkSession) // t_size, 1)
    spark = q_in.sparkSession

    # A real distance for each query: its need-th row in the blocks that hold enough rows nearby.
    seeds = pairs.filter("__seed").select(*block, "t_block", "q_n", "t_n")
    work = seeds.agg(F.sum(F.col("q_n").cast("double") * F.col("t_n")).alias("met")).first()["met"] or 0
    tasks = partitions_for(spark, work)
    near = (
        salted_join(seeds.drop("q_n", "t_n"), t_side.select(*target, "t___t", *[f"t_{c}" for c in coords]), target, ["q_block"], hot_rows=asked)
        .repartition(tasks, *block)
        .join(q_side.select(*block, "__q", *[f"q_{c}" for c in coords]).repartition(tasks, *block), block)
        .withColumn("__d2", d2)
    )
    if need == 1:
        bound = near.groupBy(*block, "__q").agg(F.min("__d2").alias("__bound"))
    else:
        w = W.partitionBy(*block, "__q").orderBy("__d2")
        bound = near.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= need).groupBy(*block, "__q").agg(
            F.when(F.count(F.lit(1)) >= need, F.max("__d2")).alias("__bound")
        )
    point_gap = squared_sum([
        F.greatest(F.col(f"t_lo_{c}") - F.col(f"q_{c}"), F.lit(0.0), F.col(f"q_{c}") - F.col(f"t_hi_{c}"))
        for c in coords
    ])
    within = F.col("__bound").isNull() | (point_gap <= F.col("__bound"))
    bounded = q_side.repartition(tasks, *block).join(bound, [*block, "__q"])
    wanted = materialize(
        bounded.join(pairs.drop("q_n", "__seed").repartition(tasks, *block), block).filter(within)
        .drop("q_block", *[f"t_{s}_{c}" for c in coords for s in ("lo", "hi")]),
        "wanted",
    )
    # A target block near very many queries is repeated for parts of them.
    work = wanted.agg(F.sum("t_n").alias("met")).first()["met"] or 0
    met = salted_join(wanted.drop("t_n"), t_side, target, ["__q"], hot_rows=hot_row_limit(spark), partitions=partitions_for(spark, work))
    return met.withColumn("__d2", d2).filter(F.col("__bound").isNull() | (F.col("__d2") <= F.col("__bound"))).drop("t_block", "__bound")
