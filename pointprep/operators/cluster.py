"""Density clustering and binned k-means over all cases at once."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pointprep.functions.rng import uniform
from pointprep.plans.blocks import CURVE, Profile, box_max_d2, box_min_d2, boxes, profile, squared_sum
from pointprep.plans.components import connected_components
from pointprep.plans.grouped import GROUP_ROWS, dbscan_in_groups, kmeans_in_groups, split_by_size
from pointprep.plans.knn import QueryBlocks, block_queries, block_sizes, knn_join
from pointprep.plans.salt import salted_join
from pointprep.plans.skew import hot_from_counts, hot_groups, hot_row_limit, ranked
from pointprep.session import discard, materialize, scratch_path

DIRECT_PAIRS = 65_536


def _offsets(reach: int, dims: int) -> list[tuple[int, ...]]:
    return list(itertools.product(range(-reach, reach + 1), repeat=dims))


def _shift_array(offsets: Sequence[tuple[int, ...]], cells: Sequence[str]):
    return F.array(*[
        F.struct(*[(F.col(c) + F.lit(o).cast("bigint")).alias(c) for c, o in zip(cells, off)]) for off in offsets
    ])


def dbscan(
    points: DataFrame,
    eps: float,
    min_samples: int,
    key: str = "case_id",
    row_id: str = "point_id",
    coords: Sequence[str] = ("x", "y"),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Cluster label per point: the lowest core id of its cluster, NULL for noise.

    Groups with at most ``group_rows`` points are clustered whole in a task, so that their points are shuffled once; larger ones go
    by cells. A border point joins the neighbour with the lowest label. A point that lacks a coordinate is noise.
    """
    coords = list(coords)
    named = points.select(key, F.col(row_id).alias("id"), *coords)
    small, large = split_by_size(named, [key], min(group_rows, hot_row_limit(points.sparkSession)))
    parts = []
    if small is not None:
        parts.append(dbscan_in_groups(small, eps, min_samples, key, coords))
    if large is not None or small is None:
        rows = named if large is None else large
        lacking = F.lit(False)
        for c in coords:
            lacking = lacking | F.col(c).isNull() | F.isnan(c)
        none = rows.filter(lacking).select(key, "id", F.lit(None).cast(rows.schema["id"].dataType).alias("label"), F.lit(False).alias("is_core"))
        parts += [_dbscan_by_cells(rows.filter(~lacking), eps, min_samples, key, coords), none]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("id", row_id)


def _dbscan_by_cells(points: DataFrame, eps: float, min_samples: int, key: str, coords: list[str]) -> DataFrame:
    """Clusters of large groups.

    Space is cut into cells so small that all points of one cell are neighbours. A
    cell with ``min_samples`` points is core throughout without comparing any pair;
    only the few points of thin cells count their neighbours. Clusters are the
    connected components of core cells, a graph of bounded degree, so dense regions
    do not multiply the work.
    """
    dims = len(coords)
    eps2 = eps * eps
    side = eps / math.sqrt(dims) * (1.0 - 1e-9)
    cells = [f"__c{i}" for i in range(dims)]
    grid = [f"__g{i}" for i in range(dims)]
    offsets = _offsets(math.ceil(math.sqrt(dims)), dims)

    placed = points.select(
        key, "id", *coords,
        *[F.floor(F.col(c) / F.lit(side)).cast("bigint").alias(cell) for c, cell in zip(coords, cells)],
        # A coarser grid for looking around: within eps there is only the next cell each way.
        *[F.floor(F.col(c) / F.lit(eps)).cast("bigint").alias(cell) for c, cell in zip(coords, grid)],
    )
    # A cell may hold a large share of all points; the joins on cells below deal those out.
    cell = [key, *cells]
    spot = [key, *grid]
    limit = hot_row_limit(points.sparkSession)
    crowded_spots = hot_groups(placed, spot, limit)
    # A cell lies in a few spots, so without crowded spots no cell is much above the limit.
    crowded = hot_groups(placed, cell, limit) if crowded_spots else []
    sizes = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    placed = materialize(salted_join(placed, sizes, cell, ["id"], hot=crowded), "cells")
    thin = placed.filter(F.col("__n") < min_samples)

    def around(df: DataFrame) -> DataFrame:
        """Rows of thin cells, once per spot within reach."""
        return df.select(
            key, F.col("id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in coords],
            F.explode(_shift_array(_offsets(1, dims), grid)).alias("__at"),
        ).select(key, "__id", *[f"__{c}" for c in coords], *[F.col(f"__at.{c}").alias(c) for c in grid])

    gap = squared_sum([F.col(c) - F.col(f"__{c}") for c in coords])
    # Fewer than min_samples rows per thin cell, so a crowded spot next to it is read a bounded number of times.
    counted = (
        salted_join(placed.select(key, "id", *coords, *grid), around(thin), spot, ["id"], hot=crowded_spots).filter(gap <= eps2)
        .groupBy(key, F.col("__id").alias("id")).agg(F.count(F.lit(1)).alias("__near"))
    )
    thin_core = counted.filter(F.col("__near") >= min_samples).select(key, "id")
    core = placed.filter(F.col("__n") >= min_samples).select(key, "id", *coords, *cells, *grid).unionByName(
        thin.join(thin_core, [key, "id"], "left_semi").select(key, "id", *coords, *cells, *grid)
    )
    core = materialize(core, "core")
    core_cells = boxes(core, [key, *cells], coords)
    nodes = materialize(
        core.groupBy(key, *cells).agg(F.min("id").alias("node")).join(core_cells, [key, *cells]), "nodes"
    )
    links = _core_links(core, nodes, eps2, key, coords, cells, offsets, crowded)
    labels = connected_components(nodes.select(key, "node"), links, key)

    labelled = nodes.select(key, *cells, "node").join(labels, [key, "node"]).select(key, *cells, "label")
    in_core = salted_join(core, labelled, cell, ["id"], hot=crowded)
    rest = thin.join(core.select(key, "id"), [key, "id"], "left_anti")
    border = (
        salted_join(in_core.select(key, "label", *coords, *grid, "id"), around(rest), spot, ["id"], hot=crowded_spots)
        .filter(gap <= eps2)
        .groupBy(key, F.col("__id").alias("id")).agg(F.min("label").alias("label"))
    )
    others = rest.select(key, "id").join(border, [key, "id"], "left")
    return (
        in_core.select(key, "id", "label", F.lit(True).alias("is_core"))
        .unionByName(others.select(key, "id", "label", F.lit(False).alias("is_core")))
    )


def _core_links(core, nodes, eps2, key, coords, cells, offsets, crowded) -> DataFrame:
    """Pairs of core cells with a core point each that lie within reach.

    Most pairs are settled by their boxes. The others compare points where that is
    little work, and are cut into smaller boxes where it is not.
    """
    half = [o for o in offsets if o > tuple(0 for _ in o)]
    left = nodes.select(
        key, F.col("node").alias("src"), F.col("n").alias("__na"),
        *[F.col(f"{s}_{c}").alias(f"a_{s}_{c}") for c in coords for s in ("lo", "hi")],
        F.explode(_shift_array(half, cells)).alias("__at"),
    ).select("*", *[F.col(f"__at.{c}").alias(c) for c in cells]).drop("__at")
    right = nodes.select(
        key, *cells, F.col("node").alias("dst"), F.col("n").alias("__nb"),
        *[F.col(f"{s}_{c}").alias(f"b_{s}_{c}") for c in coords for s in ("lo", "hi")],
    )
    pairs = left.join(right, [key, *cells]).filter(box_min_d2("a_", "b_", coords) <= eps2)
    pairs = materialize(
        pairs.select(
            key, "src", "dst", (box_max_d2("a_", "b_", coords) <= eps2).alias("__sure"),
            (F.col("__na") * F.col("__nb")).alias("__work"),
        ),
        "pairs",
    )
    sure = pairs.filter("__sure").select(key, "src", "dst")
    open_pairs = pairs.filter(~F.col("__sure"))
    named = salted_join(core, nodes.select(key, *cells, "node"), [key, *cells], ["id"], hot=crowded).select(
        key, "node", "id", *coords
    )
    near = squared_sum([F.col(f"a_{c}") - F.col(f"b_{c}") for c in coords])

    def side(prefix: str, column: str) -> DataFrame:
        return named.select(
            key, F.col("node").alias(column), F.col("id").alias(f"{prefix}id"), *[F.col(c).alias(f"{prefix}{c}") for c in coords]
        )

    small = open_pairs.filter(F.col("__work") <= DIRECT_PAIRS).select(key, "src", "dst")
    direct = (
        small.join(side("a_", "src"), [key, "src"]).join(side("b_", "dst"), [key, "dst"])
        .filter(near <= eps2).select(key, "src", "dst").distinct()
    )
    links = sure.unionByName(direct)
    large = open_pairs.filter(F.col("__work") > DIRECT_PAIRS).select(key, "src", "dst")
    if large.isEmpty():
        return links
    return links.unionByName(_links_of_crowded(large, named, eps2, key, coords))


#: Splits of a cell along each axis from one level to the next.
SPLIT = 4


def _links_of_crowded(large: DataFrame, named: DataFrame, eps2: float, key: str, coords: Sequence[str]) -> DataFrame:
    """Those of the ``large`` pairs of cells that have a point each within reach.

    Both cells are cut into ever smaller boxes, and only pairs of boxes that may hold such points go on: one whose far corners are
    within reach links its cells at once, and all their other boxes are dropped; few points in both are compared one by one. A
    box that holds one position has no doubt left, so this ends for any number of copies.
    """
    ends = large.select(key, F.col("src").alias("node")).unionAll(large.select(key, F.col("dst").alias("node"))).distinct()
    points = materialize(named.join(ends, [key, "node"], "left_semi"), "crowded")
    grid = [f"__g{i}" for i in range(len(coords))]
    side = math.sqrt(eps2 / len(coords))
    near = squared_sum([F.col(f"a_{c}") - F.col(f"b_{c}") for c in coords])
    pair = [key, "src", "dst"]
    open_pairs, linked, level = large, None, 0
    while True:
        level += 1
        size = side / float(SPLIT**level)
        placed = points.withColumns({g: F.floor(F.col(c) / F.lit(size)).cast("bigint") for g, c in zip(grid, coords)})
        cut = boxes(placed, [key, "node", *grid], coords)

        def child(prefix: str, end: str) -> DataFrame:
            up = [F.floor(F.col(g) / SPLIT).cast("bigint").alias(f"{prefix}up{g}") for g in grid] if level > 1 else []
            return cut.select(
                key, F.col("node").alias(end), *up, *[F.col(g).alias(f"{prefix}{g}") for g in grid], F.col("n").alias(f"{prefix}n"),
                *[F.col(f"{s}_{c}").alias(f"{prefix}{s}_{c}") for c in coords for s in ("lo", "hi")],
            )

        at = lambda prefix, end: [key, end, *([f"{prefix}up{g}" for g in grid] if level > 1 else [])]
        met = open_pairs.join(child("a_", "src"), at("a_", "src")).join(child("b_", "dst"), at("b_", "dst"))
        met = materialize(
            met.filter(box_min_d2("a_", "b_", coords) <= eps2).select(
                *pair, *[f"{p}{g}" for p in ("a_", "b_") for g in grid], (box_max_d2("a_", "b_", coords) <= eps2).alias("__sure"),
                ((F.col("a_n") * F.col("b_n") > DIRECT_PAIRS) & ~(_one_position("a_", coords) & _one_position("b_", coords))).alias("__many"),
            ),
            "boxes",
        )
        sure = met.filter("__sure").select(*pair).distinct()
        rest = met.filter(~F.col("__sure")).join(sure, pair, "left_anti")

        def side_of(prefix: str, end: str) -> DataFrame:
            return placed.select(
                key, F.col("node").alias(end), *[F.col(g).alias(f"{prefix}{g}") for g in grid], *[F.col(c).alias(f"{prefix}{c}") for c in coords]
            )

        few = rest.filter(~F.col("__many"))
        compared = few.join(side_of("a_", "src"), [key, "src", *[f"a_{g}" for g in grid]]).join(
            side_of("b_", "dst"), [key, "dst", *[f"b_{g}" for g in grid]]
        ).filter(near <= eps2).select(*pair).distinct()
        found = materialize(sure.unionByName(compared), "linked")
        linked = found if linked is None else linked.unionByName(found)
        open_pairs = rest.filter("__many").join(found, pair, "left_anti").select(
            *pair, *[F.col(f"{p}{g}").alias(f"{p}up{g}") for p in ("a_", "b_") for g in grid]
        )
        if open_pairs.isEmpty():
            return linked.distinct()


def _one_position(prefix: str, coords: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in coords:
        same = same & (F.col(f"{prefix}lo_{c}") == F.col(f"{prefix}hi_{c}"))
    return same


def dbscan_count(labels: DataFrame, cases: DataFrame, key: str = "case_id", row_id: str = "point_id") -> DataFrame:
    """Clusters per case, zero included; a cluster is counted at the point that names it."""
    roots = labels.filter(F.col("label") == F.col(row_id)).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return cases.select(key).distinct().join(roots, key, "left").select(
        key, F.coalesce("__n", F.lit(0).cast("bigint")).alias("n_clusters")
    )


def seed_centroids(points: DataFrame, allocation: DataFrame, keys: Sequence[str] = ("case_id", "bin"),
                   row_id: str = "point_id", coords: Sequence[str] = ("x", "y", "z"), seed: int | str = 42,
                   hot_rows: int | None = None) -> DataFrame:
    """``alloc`` distinct points per group in hash order as first centroids."""
    limit = hot_rows if hot_rows is not None else hot_row_limit(points.sparkSession)
    crowded = hot_from_counts(allocation, keys, "n", limit)
    sized = salted_join(points.select(*keys, row_id, *coords), allocation.select(*keys, "alloc"), keys, [row_id], hot=crowded)
    drawn = sized.withColumn("__u", uniform("seed", seed, *[F.col(k) for k in keys], F.col(row_id)))
    first = ranked(drawn, keys, ["__u", row_id], "__pos", limit="alloc", hot_rows=limit, hot=crowded)
    return first.select(*keys, (F.col("__pos") - 1).alias("cluster"), *coords)


def lloyd_step(points: DataFrame, centroids: DataFrame, keys: Sequence[str] = ("case_id", "bin"),
               row_id: str = "point_id", coords: Sequence[str] = ("x", "y", "z"), about: Profile | None = None,
               blocks: QueryBlocks | None = None) -> DataFrame:
    """One round: assign points to the nearest centroid of their group, then average.

    Returns the centroids with ``n`` points, ``cost`` (summed squared distances) and
    ``moved``; a centroid without points stays where it is. ``blocks`` hands in the points'
    blocks, which do not change from round to round.
    """
    keys, coords = list(keys), list(coords)
    near = knn_join(points, centroids, 1, keys, row_id, "cluster", coords, carry=coords, about=about, blocks=blocks)
    means = near.groupBy(*keys, "cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("dist") * F.col("dist")).alias("cost"),
        *[F.avg(c).alias(f"__{c}") for c in coords],
    )
    both = centroids.select(*keys, "cluster", *coords).join(means, [*keys, "cluster"], "left")
    new = {c: F.coalesce(f"__{c}", c) for c in coords}
    moved = F.sqrt(squared_sum([new[c] - F.col(c) for c in coords]))
    return both.select(
        *keys, "cluster", *[new[c].alias(c) for c in coords],
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("cost", F.lit(0.0)).alias("cost"), moved.alias("moved"),
    )


#: Blocks of a group that lies scattered on a curve are so many times longer.
CURVE_SHARE = 4
#: Relative slack of bounds, far above the rounding of a few hundred additions.
BOUND_SLACK = 1e-9


#: The points of a case that go through all their rounds in one task.
KMEANS_ROWS = 2_048


def binned_kmeans(points: DataFrame, allocation: DataFrame, keys: Sequence[str] = ("case_id", "bin"),
                  row_id: str = "point_id", coords: Sequence[str] = ("x", "y", "z"), max_iter: int = 30,
                  tol: float = 1e-3, seed: int | str = 42, on_curve: bool = False) -> DataFrame:
    """``alloc`` centroids per group; groups with no more points than slots keep their points.

    Groups whose centroids moved at most ``tol`` are finished and leave the loop. Each point carries the distance to
    its centroid and a lower bound of the distance to every other one, which falls by the largest move of its group in a round;
    while its own distance is below that bound nothing can change for it, and only the other points search again.
    With ``on_curve`` the points know their place on the curve of a larger group, which serves for these groups too.
    Values of the first key with at most ``KMEANS_ROWS`` points go through all rounds in one task instead.
    """
    keys, coords = list(keys), list(coords)
    spark = points.sparkSession
    limit = hot_row_limit(spark)
    place = [CURVE] if on_curve else []
    points = materialize(points.select(*keys, row_id, *coords, *place), "points")
    state = materialize(seed_centroids(points, allocation, keys, row_id, coords, seed), "centroids")
    # A group with as many slots as points is settled by its seeds.
    active = allocation.filter(F.col("n") > F.col("alloc")).select(*keys)
    done = state.join(active, keys, "left_anti")
    state = state.join(active, keys, "left_semi")
    small, large = split_by_size(points.join(active, keys, "left_semi").select(*keys, row_id, *coords, *place), keys[:1], min(KMEANS_ROWS, limit))
    if small is not None:
        # Kept rows of these cases meet their seeds; those of larger ones go through the rounds below.
        done = done.unionByName(kmeans_in_groups(small, state, keys, coords, max_iter, tol).select(*done.columns))
    if large is None:
        return done
    if small is not None:
        points = materialize(large, "points")
        cases = points.select(*keys).distinct()
        state, active = state.join(cases, keys, "left_semi"), active.join(cases, keys, "left_semi")
    # Centroids stay inside the hull of their points and groups only leave, so one profile serves all rounds.
    about = profile(state, points, keys, coords, limit)
    # Points never move: they are put in order and written once, whatever the rounds.
    q_in = points.join(active, keys, "left_semi").select(*keys, F.col(row_id).alias("__q"), *coords, *place)
    # A group has some of the rows of its curve, so its blocks are drawn larger there.
    size = block_sizes(2, about)[1] * (CURVE_SHARE if on_curve else 1)
    blocks = block_queries(q_in, keys, coords, size, about, on_curve)

    def nearest_two(rows: DataFrame, targets: DataFrame) -> DataFrame:
        """Centroid, its distance ``ub`` and that of the second ``lb`` of each row; rows know their block as ``home``."""
        ordered = QueryBlocks(
            rows.withColumn("block", F.col("home")).withColumnRenamed(row_id, "__q"),
            blocks.boxes.join(rows.select(*keys, F.col("home").alias("block")).distinct(), [*keys, "block"], "left_semi"), blocks.size,
        )
        near = knn_join(rows, targets, 2, keys, row_id, "cluster", coords, carry=[*coords, "home"], about=about, blocks=ordered)
        second = F.when(F.count(F.lit(1)) > 1, F.max("dist")).otherwise(F.lit(float("inf")))
        return near.groupBy(*keys, row_id).agg(
            F.min_by("cluster", "rank").alias("cluster"), F.min("dist").alias("ub"), second.alias("lb"),
            *[F.first(c).alias(c) for c in (*coords, "home")],
        )

    def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    every = blocks.rows.withColumnsRenamed({"__q": row_id, "block": "home"})
    bounds, path = written(nearest_two(every, state), "bounds")
    stages = [path]
    settled = scratch_path(spark, "settled")
    done.write.parquet(settled)
    for step in range(max_iter):
        means = bounds.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"__{c}") for c in coords])
        new = {c: F.coalesce(f"__{c}", c) for c in coords}
        moved, at = written(
            state.join(means, [*keys, "cluster"], "left").select(
                *keys, "cluster", F.coalesce("n", F.lit(0)).alias("n"), *[new[c].alias(c) for c in coords],
                F.sqrt(squared_sum([new[c] - F.col(c) for c in coords])).alias("moved"),
            ),
            "lloyd",
        )
        most = moved.groupBy(*keys).agg(F.max("moved").alias("most")).filter(F.col("most") > tol)
        if step + 1 == max_iter:
            most = most.limit(0)
        placed = moved.select(*keys, "cluster", *coords)
        placed.join(most, keys, "left_anti").write.mode("append").parquet(settled)
        if most.isEmpty():
            break
        state = placed.join(most, keys, "left_semi")
        # Points of groups that have settled find no partner here.
        own = moved.join(most, keys).select(*keys, "cluster", "most", "n", *[F.col(c).alias(f"__{c}") for c in coords])
        hot = hot_from_counts(own, [*keys, "cluster"], "n", limit)
        judged = salted_join(bounds, own.drop("n"), [*keys, "cluster"], [row_id], hot=hot).withColumns({
            "ub": F.sqrt(squared_sum([F.col(c) - F.col(f"__{c}") for c in coords])), "lb": F.col("lb") - F.col("most"),
        })
        unsure = F.col("ub") * (1.0 + BOUND_SLACK) >= F.col("lb") * (1.0 - BOUND_SLACK)
        judged, kept_at = written(judged.withColumn("unsure", unsure).drop("most", *[f"__{c}" for c in coords]), "judged")
        found, found_at = written(
            nearest_two(judged.filter("unsure").select(*keys, row_id, *coords, "home"), state), "searched"
        )
        bounds = judged.filter("not unsure").drop("unsure").unionByName(found)
        for old in stages:
            discard(spark, old)
        stages = [at, kept_at, found_at]
    return spark.read.parquet(settled)
