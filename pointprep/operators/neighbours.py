"""Operators on neighbour edges: statistics, pools, interpolation and attention keys.

Edge tables are long: one row per (case, leaf, rank). All grouping here is by leaf,
whose edge count is the fixed number of neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pointprep.functions.encode import REGISTER_TOKENS, ROTARY_BASE, ROTARY_DIMS, rotary_angles
from pointprep.functions.rng import uniform
from pointprep.functions.scalar import magnitude
from pointprep.plans.knn import TargetTree, knn_join, target_tree
from pointprep.plans.salt import salted_join

STAT_NAMES = (
    "cov_xx", "cov_yy", "cov_zz", "cov_xy", "cov_xz", "cov_yz",
    "dist_mean", "dist_std", "dist_skew", "density", "com_dist",
    "sdf_min", "sdf_max", "sdf_range", "dir_x", "dir_y", "dir_z",
    "angular_span", "curv_mean_avg", "curv_gauss_avg", "surf_ratio",
)


def nearest_centroid(points: DataFrame, leaves: DataFrame, key: str = "case_id", point_id: str = "point_id",
                     leaf_id: str = "leaf_id", carry: Sequence[str] = (), on_curve: bool = False,
                     tree: TargetTree | None = None) -> DataFrame:
    """Leaf of every point: its nearest centroid, the lower id on a tie. Keeps the point's position and ``carry``."""
    near = knn_join(points, leaves, 1, [key], point_id, leaf_id, carry=("x", "y", "z", *carry), query_curve=on_curve, tree=tree)
    return near.select(key, point_id, leaf_id, "dist", "x", "y", "z", *carry)


def surface_gradient(points: DataFrame, gradient: Sequence[str], key: str = "case_id", point_id: str = "point_id",
                     surface: str = "is_surface", on_curve: bool = False) -> DataFrame:
    """Surface points with distance zero and the gradient of the nearest volume point."""
    flag = F.col(surface)
    volume = points.filter(~flag)
    near = knn_join(
        points.filter(flag), volume, 1, [key], point_id, point_id, payload=gradient, neighbour_name="volume_id",
        query_curve=on_curve, tree=target_tree(volume, [key], ["x", "y", "z"]) if on_curve else None,
    )
    return near.select(key, point_id, "volume_id", F.lit(0.0).alias("sdf"), *gradient)


def nearest_attributes(edges: DataFrame) -> DataFrame:
    """Attributes at the centroid are those of its first neighbour: no second search."""
    return edges.filter(F.col("rank") == 1)


def leaf_stats(edges: DataFrame, leaves: DataFrame, k: int, key: str = "case_id", leaf_id: str = "leaf_id",
               curv_mean: str = "curv_mean", curv_gauss: str = "curv_gauss") -> DataFrame:
    """The 21 neighbourhood statistics per leaf as named columns, plus ``k_found``.

    ``edges`` carries the neighbour's x, y, z, sdf, curvatures and is_surface. The
    first pass gives the mean and deviation of the distance, the second the rest, so
    the skewness does not suffer from subtracting large moments.
    """
    centres = leaves.select(key, leaf_id, *[F.col(c).alias(f"c{c}") for c in "xyz"])
    rel = edges.join(centres, [key, leaf_id])
    for c in "xyz":
        rel = rel.withColumn(f"r{c}", F.col(c) - F.col(f"c{c}"))
    rel = rel.withColumn("d", magnitude("rx", "ry", "rz"))
    leaf = W.partitionBy(key, leaf_id)
    rel = rel.withColumn("dm", F.avg("d").over(leaf)).withColumn("ds", F.stddev_pop("d").over(leaf))
    z = (F.col("d") - F.col("dm")) / F.greatest(F.col("ds"), F.lit(1e-8))
    unit = lambda c: F.col(f"r{c}") / F.greatest(F.col("d"), F.lit(1e-8))
    grouped = rel.groupBy(key, leaf_id).agg(
        F.count(F.lit(1)).alias("k_found"),
        *[F.first(f"c{c}").alias(f"c{c}") for c in "xyz"],
        *[F.avg(F.col(f"r{a}") * F.col(f"r{b}")).alias(f"cov_{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")],
        F.avg("d").alias("dist_mean"),
        F.first("ds").alias("dist_std"),
        F.avg(z * z * z).alias("dist_skew"),
        *[F.min(c).alias(f"lo_{c}") for c in "xyz"],
        *[F.max(c).alias(f"hi_{c}") for c in "xyz"],
        F.min("sdf").alias("sdf_min"),
        F.max("sdf").alias("sdf_max"),
        *[F.avg(unit(c)).alias(f"dir_{c}") for c in "xyz"],
        F.avg(curv_mean).alias("curv_mean_avg"),
        F.avg(curv_gauss).alias("curv_gauss_avg"),
        (F.count_if("is_surface") / F.lit(float(k))).alias("surf_ratio"),
    )
    dm = F.greatest(F.col("dist_mean"), F.lit(1e-8))
    ball = F.lit(4.0 / 3.0 * math.pi) * dm * dm * dm
    to_box = [F.col(f"c{c}") - (F.col(f"lo_{c}") + F.col(f"hi_{c}")) * 0.5 for c in "xyz"]
    full = grouped.withColumns({
        "density": F.log1p(F.lit(float(k)) / ball),
        "com_dist": magnitude(*to_box),
        "sdf_range": F.col("sdf_max") - F.col("sdf_min"),
        "angular_span": F.lit(1.0) - magnitude("dir_x", "dir_y", "dir_z"),
    })
    return full.select(key, leaf_id, "k_found", *STAT_NAMES)


def neighbour_pool(edges: DataFrame, leaves: DataFrame, features: Sequence[str], key: str = "case_id",
                   leaf_id: str = "leaf_id", scale: float = 1.0) -> DataFrame:
    """Per leaf the neighbours in rank order: relative position, then ``features``."""
    centres = leaves.select(key, leaf_id, *[F.col(c).alias(f"c{c}") for c in "xyz"])
    vector = F.array(
        *[(F.col(c) - F.col(f"c{c}")) / F.lit(scale) for c in "xyz"], *[F.col(f).cast("double") for f in features]
    )
    return (
        edges.join(centres, [key, leaf_id])
        .groupBy(key, leaf_id)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", vector.alias("v")))), lambda e: e["v"]).alias("pool"))
    )


def neighbour_draw(edges: DataFrame, draws: int, pool_size: int, epoch: int, key: str = "case_id",
                   leaf_id: str = "leaf_id", neighbour: str = "point_id") -> DataFrame:
    """``draws`` neighbours per leaf with replacement, out of ``pool_size`` ranks.

    Where a leaf has fewer neighbours the draw is over those it has.
    """
    pools = edges.filter(F.col("rank") <= pool_size).groupBy(key, leaf_id).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", neighbour))), lambda e: e[neighbour]).alias("__pool")
    )
    slots = pools.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws - 1).cast("bigint"))))
    u = uniform("draw", F.col(key), epoch, F.col(leaf_id), F.col("draw"))
    pick = F.floor(u * F.size("__pool")).cast("int") + 1
    return slots.select(key, leaf_id, "draw", pick.cast("bigint").alias("rank"), F.element_at("__pool", pick).alias(neighbour))


def idw_weights(
    queries: DataFrame,
    leaf_edges: DataFrame,
    leaves: DataFrame,
    k: int = 8,
    key: str = "case_id",
    query_id: str = "point_id",
    leaf_id: str = "leaf_id",
    include_self: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """The ``k`` nearest of a query's candidate leaves with normalised inverse-distance weights.

    Candidates are the neighbours of the query's own leaf. They are one bounded array
    per leaf, so every query row is finished where it lies, without another shuffle.
    Leaves with very many queries are spread over several tasks.
    """
    nbr = f"nbr_{leaf_id}"
    cand = leaf_edges.select(key, leaf_id, nbr)
    if include_self:
        cand = cand.unionByName(leaves.select(key, leaf_id, F.col(leaf_id).alias(nbr)))
    where = leaves.select(key, F.col(leaf_id).alias(nbr), *[F.col(c).alias(f"c{c}") for c in "xyz"])
    packed = cand.join(where, [key, nbr]).groupBy(key, leaf_id).agg(
        F.collect_list(F.struct(F.col(nbr).alias("id"), "cx", "cy", "cz")).alias("__cand")
    )
    rows = salted_join(queries.select(key, query_id, leaf_id, "x", "y", "z"), packed, [key, leaf_id], [query_id], hot_rows=hot_rows)

    def d2(c: Column) -> Column:
        dx, dy, dz = F.col("x") - c["cx"], F.col("y") - c["cy"], F.col("z") - c["cz"]
        return dx * dx + dy * dy + dz * dz

    nearest = F.slice(F.array_sort(F.transform("__cand", lambda c: F.struct(d2(c).alias("d2"), c["id"].alias("id")))), 1, k)
    rows = rows.withColumn("__near", nearest).withColumn(
        "__raw", F.transform("__near", lambda e: F.lit(1.0) / (F.sqrt(e["d2"]) + F.lit(1e-8)))
    )
    total = F.aggregate("__raw", F.lit(0.0), lambda acc, w: acc + w)
    rows = rows.withColumn("__total", total).select(
        key, query_id, "__raw", "__total", F.posexplode("__near").alias("__i", "__e")
    )
    return rows.select(
        key,
        query_id,
        (F.col("__i") + 1).cast("bigint").alias("rank"),
        F.col("__e.id").alias(leaf_id),
        (F.element_at("__raw", F.col("__i") + 1) / F.col("__total")).alias("weight"),
    )


def idw_interpolate(weights: DataFrame, features: DataFrame, names: Sequence[str], key: str = "case_id",
                    query_id: str = "point_id", leaf_id: str = "leaf_id", hot_rows: int | None = None) -> DataFrame:
    """Weighted sum of leaf features per query; partial sums shrink each query before the shuffle."""
    joined = salted_join(weights, features.select(key, leaf_id, *names), [key, leaf_id], [query_id], hot_rows=hot_rows)
    return joined.groupBy(key, query_id).agg(*[F.sum(F.col("weight") * F.col(n)).alias(n) for n in names])


def _leaf_counts(leaves: DataFrame, key: str) -> DataFrame:
    return leaves.groupBy(key).agg(F.count(F.lit(1)).alias("n_leaves"))


#: Steps of the walk that fills up random keys; the product exceeds any number of leaves.
STEPS = (1_000_003, 1_000_033, 1_000_037, 1_000_039)


def _leaf_slots(leaves: DataFrame, n: int, kind: str, value: Column, key: str, leaf_id: str) -> DataFrame:
    """``n`` keys of one kind for every leaf, with ``value`` from its leaf, slot and ``n_leaves``."""
    sized = leaves.select(key, leaf_id).join(_leaf_counts(leaves, key), key)
    slots = sized.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    return slots.select(key, leaf_id, F.lit(kind).alias("kind"), "slot", value.cast("bigint").alias("key_id"))


def fixed_keys(leaf_edges: DataFrame, leaves: DataFrame, n_register: int = REGISTER_TOKENS, key: str = "case_id", leaf_id: str = "leaf_id") -> DataFrame:
    """The attention keys that no epoch changes: a leaf's neighbours and the register tokens, which follow the leaves."""
    local = leaf_edges.select(
        key, leaf_id, F.lit("local").alias("kind"), (F.col("rank") - 1).alias("slot"), F.col(f"nbr_{leaf_id}").alias("key_id")
    )
    return local.unionByName(_leaf_slots(leaves, n_register, "register", F.col("n_leaves") + F.col("slot"), key, leaf_id))


def graph_edges(
    leaf_edges: DataFrame,
    leaves: DataFrame,
    n_random: int = 32,
    n_register: int = 16,
    epoch: int = 0,
    key: str = "case_id",
    leaf_id: str = "leaf_id",
) -> DataFrame:
    """Attention keys per leaf: its neighbours, the register tokens, random leaves.

    Random keys may repeat a neighbour. Leaf ids run from 0 to n_leaves - 1 and the
    register tokens follow.
    """
    u = uniform("key", F.col(key), epoch, F.col(leaf_id), F.col("slot"))
    chance = _leaf_slots(leaves, n_random, "random", F.floor(u * F.col("n_leaves")), key, leaf_id)
    return fixed_keys(leaf_edges, leaves, n_register, key, leaf_id).unionByName(chance)


def random_edges_excluding(
    leaf_edges: DataFrame,
    leaves: DataFrame,
    n_random: int = 32,
    spare: int = 32,
    epoch: int = 0,
    key: str = "case_id",
    leaf_id: str = "leaf_id",
) -> DataFrame:
    """``n_random`` distinct random keys per leaf that are not its neighbours, or all there are.

    Hashed draws come first. What repeats and neighbours cost is filled up from a walk through all
    leaves: from a hashed start in steps of a prime that does not divide their number, so it
    meets no leaf twice and n_random more steps than the leaf has neighbours suffice.
    """
    sized = leaves.select(key, leaf_id).join(_leaf_counts(leaves, key), key)
    slots = sized.withColumn(
        "slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_random + spare - 1).cast("bigint")))
    )
    u = uniform("other", F.col(key), epoch, F.col(leaf_id), F.col("slot"))
    drawn = slots.withColumn("key_id", F.floor(u * F.col("n_leaves")).cast("bigint"))
    local = leaf_edges.select(key, leaf_id, F.col(f"nbr_{leaf_id}").alias("key_id"))
    owned = local.groupBy(key, leaf_id).agg(F.count(F.lit(1)).alias("__own"))
    step = F.element_at(F.filter(F.array(*[F.lit(p) for p in STEPS]), lambda p: F.col("n_leaves") % p != 0), 1)
    start = F.floor(uniform("fill", F.col(key), epoch, F.col(leaf_id)) * F.col("n_leaves"))
    steps = F.least(F.col("n_leaves"), F.coalesce("__own", F.lit(0)) + n_random)
    walk = (
        sized.join(owned, [key, leaf_id], "left")
        .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), steps.cast("bigint") - 1)))
        .select(
            key, leaf_id, (F.col("slot") + n_random + spare).alias("slot"),
            F.pmod(start + F.col("slot") * step, F.col("n_leaves")).cast("bigint").alias("key_id"),
        )
    )
    once = drawn.select(key, leaf_id, "slot", "key_id").unionByName(walk).groupBy(key, leaf_id, "key_id").agg(F.min("slot").alias("__first"))
    order = W.partitionBy(key, leaf_id).orderBy("__first")
    return (
        once.join(local, [key, leaf_id, "key_id"], "left_anti")
        .withColumn("slot", (F.row_number().over(order) - 1).cast("bigint"))
        .filter(F.col("slot") < n_random)
        .select(key, leaf_id, "slot", "key_id")
    )


def block_adjacency(edges: DataFrame, leaves: DataFrame, n_register: int = 16, block: int = 128,
                    key: str = "case_id", leaf_id: str = "leaf_id") -> DataFrame:
    """Distinct (query block, key block) pairs; blocks that touch register tokens link to all.

    The output is long, one row per pair, with ``n_keys`` pairs per query block.
    """
    of = lambda c: F.floor(F.col(c) / F.lit(block)).cast("bigint")
    seen = edges.select(key, of(leaf_id).alias("q_block"), of("key_id").alias("k_block")).distinct()
    sizes = _leaf_counts(leaves, key).select(
        key,
        F.floor(F.col("n_leaves") / block).cast("bigint").alias("__reg"),
        F.ceil((F.col("n_leaves") + n_register) / block).cast("bigint").alias("__all"),
    )
    zero = F.lit(0).cast("bigint")
    whole = sizes.withColumn("__i", F.explode(F.sequence(zero, F.col("__all") - 1))).withColumn(
        "__r", F.explode(F.sequence(F.col("__reg"), F.col("__all") - 1))
    )
    rows = whole.select(key, F.col("__r").alias("q_block"), F.col("__i").alias("k_block"))
    cols = whole.select(key, F.col("__i").alias("q_block"), F.col("__r").alias("k_block"))
    pairs = seen.unionByName(rows).unionByName(cols).distinct()
    return pairs.withColumn("n_keys", F.count(F.lit(1)).over(W.partitionBy(key, "q_block")))


def with_stratum_scale(leaves: DataFrame, axis_scales: DataFrame, stratum: str = "sub_bin", name: str = "axis_scale") -> DataFrame:
    """Leaves with the scales of their stratum as one array in the order of the axes; NULL for an unknown stratum."""
    # One row per stratum.
    packed = axis_scales.groupBy(stratum).agg(F.sort_array(F.collect_list(F.struct("axis", "scale"))).alias("__s"))
    packed = packed.select(F.col(stratum).alias("__r"), F.transform("__s", lambda s: s["scale"]).alias(name))
    return leaves.join(F.broadcast(packed), F.col(stratum) == F.col("__r"), "left").drop("__r")


def rotary_features(leaves: DataFrame, scale: Sequence[Column | float], dims: Sequence[int] = ROTARY_DIMS,
                    base: float = ROTARY_BASE, registers: int = REGISTER_TOKENS, divisor: float = 1.0,
                    key: str = "case_id", leaf_id: str = "leaf_id") -> DataFrame:
    """Cosine and sine arrays per leaf, then the register tokens with the identity rotation.

    ``scale`` has a number or a column of the leaves for each axis, so every case can turn by its own stratum's.
    """
    angles = rotary_angles([F.col(c) / F.lit(divisor) for c in "xyz"], scale, dims, base)
    turned = leaves.select(key, leaf_id, angles.alias("__a")).select(
        key, leaf_id, F.transform("__a", lambda a: F.cos(a)).alias("cos_v"), F.transform("__a", lambda a: F.sin(a)).alias("sin_v")
    )
    half = sum(dims) // 2
    still = _leaf_counts(leaves, key).withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(registers - 1))))
    return turned.unionByName(still.select(
        key,
        (F.col("n_leaves") + F.col("__t")).cast("bigint").alias(leaf_id),
        F.array_repeat(F.lit(1.0), half).alias("cos_v"),
        F.array_repeat(F.lit(0.0), half).alias("sin_v"),
    ))
