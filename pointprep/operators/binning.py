"""Distance bins and the distribution of leaf slots over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pointprep.functions.rng import uniform
from pointprep.functions.scalar import bin_weights, sdf_bin
from pointprep.plans.salt import salted_join
from pointprep.plans.skew import hot_from_counts, hot_row_limit, ranked

BINS = 15
ALPHA = 0.65


def with_bins(points: DataFrame, sdf: str = "sdf", name: str = "bin", edges: Sequence[float] | None = None) -> DataFrame:
    return points.withColumn(name, sdf_bin(sdf, edges).cast("bigint"))


def bin_counts(binned: DataFrame, keys: Sequence[str] = ("case_id",), name: str = "bin") -> DataFrame:
    return binned.filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n"))


def bin_allocation(
    counts: DataFrame, slots: Column | int, key: str = "case_id", bins: int = BINS, alpha: float = ALPHA
) -> DataFrame:
    """Share ``slots`` over the populated bins of a case by count / (1 + bin)^alpha.

    Every populated bin gets at least one slot. What rounding leaves over goes to the
    heaviest bin; what rounding took too much is removed from the lightest bins that
    have more than one. ``feasible`` is false where populated bins exceed the slots.
    """
    slots = slots if isinstance(slots, Column) else F.lit(slots)
    case = W.partitionBy(key)  # at most ``bins`` rows
    weight = F.element_at(F.array(*[F.lit(w) for w in bin_weights(bins, alpha)]), F.col("bin").cast("int") + 1)
    df = counts.withColumn("slots", slots.cast("bigint")).withColumn("wc", weight * F.col("n"))
    # Summed in bin order so that the floor below does not depend on row order.
    in_order = F.sort_array(F.collect_list(F.struct("bin", "wc")).over(case))
    df = df.withColumn("total", F.aggregate(in_order, F.lit(0.0), lambda acc, e: acc + e["wc"]))
    base = F.floor(F.col("slots") * F.col("wc") / F.col("total")).cast("bigint")
    df = df.withColumn("base", F.greatest(base, F.lit(1).cast("bigint")))
    df = df.withColumn("left_over", F.col("slots") - F.sum("base").over(case))
    heavy_first = W.partitionBy(key).orderBy(F.col("wc").desc(), "bin")
    light_first = W.partitionBy(key).orderBy("wc", "bin")
    spare = F.col("base") - 1
    spared = F.coalesce(F.sum(spare).over(light_first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    gain = F.when((F.col("left_over") > 0) & (F.row_number().over(heavy_first) == 1), F.col("left_over")).otherwise(0)
    loss = F.when(
        F.col("left_over") < 0, F.greatest(F.lit(0), F.least(spare, -F.col("left_over") - spared))
    ).otherwise(0)
    return df.select(
        key,
        "bin",
        "n",
        "slots",
        (F.col("base") + gain - loss).cast("bigint").alias("alloc"),
        (F.count(F.lit(1)).over(case) <= F.col("slots")).alias("feasible"),
    )


def oversample_fill(
    points: DataFrame,
    allocation: DataFrame,
    key: str = "case_id",
    point_id: str = "point_id",
    seed: int | str = 42,
    hot_rows: int | None = None,
) -> DataFrame:
    """For bins with fewer points than slots: all points, then picks with replacement.

    Returns one row per slot with ``slot`` from 0 and the point placed there. Only
    short bins enter, so a group never exceeds its slot count.
    """
    short = allocation.filter(F.col("n") < F.col("alloc")).select(key, "bin", "n", "alloc")
    limit = hot_rows if hot_rows is not None else hot_row_limit(points.sparkSession)
    # Crowded bins have no short rows to meet, but their points would all go to one task.
    crowded = hot_from_counts(allocation, [key, "bin"], "n", limit)
    inside = salted_join(points, short, [key, "bin"], [point_id], hot=crowded)
    numbered = ranked(inside, [key, "bin"], [point_id], "__pos", hot_rows=limit, hot=crowded).withColumn(
        "slot", F.col("__pos") - 1
    )
    own = numbered.select(key, "bin", "slot", point_id, F.lit(False).alias("is_copy"))
    pick = F.floor(uniform("fill", seed, F.col(key), F.col("bin"), F.col("slot")) * F.col("n")).cast("bigint")
    extra = short.withColumn("slot", F.explode(F.sequence(F.col("n"), F.col("alloc") - 1))).withColumn("__pos", pick + 1)
    copies = extra.join(numbered.select(key, "bin", "__pos", point_id), [key, "bin", "__pos"]).select(
        key, "bin", "slot", point_id, F.lit(True).alias("is_copy")
    )
    return own.unionByName(copies)
