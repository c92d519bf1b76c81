"""Prediction errors, roll-ups and horizontal slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pointprep.functions.scalar import as_col
from pointprep.plans.select import percentiles
from pointprep.plans.skew import ranked

# Fixed values
SLICE_HEIGHTS = (1.5, 5.0, 10.0, 20.0, 40.0, 80.0, 120.0)
SLICE_TOLERANCES = (0.5, 0.5, 1.0, 1.0, 2.0, 2.0, 3.0)
SLICE_MIN_POINTS = 10


def _norm(c: Column) -> Column:
    return F.sqrt(F.sum(c * c))


def rel_l2(preds: DataFrame, keys: Sequence[str], pred: str = "pred", target: str = "target") -> DataFrame:
    """Relative L2 error; over several channels at once it is that of the flattened vector."""
    diff = F.col(pred) - F.col(target)
    return preds.groupBy(*keys).agg(
        (_norm(diff) / F.greatest(_norm(F.col(target)), F.lit(1e-12))).alias("rel_l2"),
    )


def rel_l2_mean(metrics: DataFrame, key: str = "case_id", value: str = "rel_l2") -> DataFrame:
    return metrics.groupBy(key).agg(F.avg(value).alias("mean_rel_l2"))


def masked_mse(preds: DataFrame, keys: Sequence[str], surface: Column, valid: Column, volume_channels: int = 1,
               surface_channels: int = 1, pred: str = "pred", target: str = "target") -> DataFrame:
    """Mean squared error of each head over the valid rows that belong to it.

    The channel counts say over how many long-form rows one slot is spread.
    """
    sq = F.pow(F.col(pred) - F.col(target), F.lit(2.0))

    def head(rows: Column, channels: int) -> Column:
        n = F.count_if(rows)
        return F.coalesce(F.sum(F.when(rows, sq)), F.lit(0.0)) / F.greatest(n, F.lit(channels))

    return preds.groupBy(*keys).agg(
        head(valid & ~surface, volume_channels).alias("vol_mse"),
        head(valid & surface, surface_channels).alias("surf_mse"),
    )


def curve_mse(preds: DataFrame, surface: Column, key: str = "case_id", pred: str = "pred", target: str = "target") -> DataFrame:
    """Mean squared error per head and case, averaged over cases."""
    sq = F.pow(F.col(pred) - F.col(target), F.lit(2.0))
    per_case = preds.groupBy(key).agg(
        F.coalesce(F.avg(F.when(~surface, sq)), F.lit(0.0)).alias("v"),
        F.coalesce(F.avg(F.when(surface, sq)), F.lit(0.0)).alias("s"),
    )
    return per_case.agg(
        F.coalesce(F.avg("v"), F.lit(0.0)).alias("vol_mse"),
        F.coalesce(F.avg("s"), F.lit(0.0)).alias("surf_mse"),
        F.coalesce(F.avg(F.col("v") + F.col("s")), F.lit(0.0)).alias("total_mse"),
    )


def weighted_mean(partials: DataFrame, keys: Sequence[str], mean: str = "mean", n: str = "n") -> DataFrame:
    """Global mean from partial means and their counts."""
    return partials.groupBy(*keys).agg(
        (F.sum(F.col(mean) * F.col(n)) / F.greatest(F.sum(n).cast("double"), F.lit(1.0))).alias("mean"),
        F.sum(n).cast("bigint").alias("n"),
    )


def metric_summary(metrics: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Mean, population deviation, minimum and maximum per metric, and the mean of means."""
    per_metric = metrics.groupBy(F.col(metric).alias("metric")).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    overall = per_metric.agg(F.avg("mean").alias("mean")).select(
        F.lit("overall").alias("metric"),
        "mean",
        *[F.lit(None).cast("double").alias(c) for c in ("std", "min", "max")],
    )
    return per_metric.unionByName(overall)


def median_case(metrics: DataFrame, key: str = "case_id", value: str = "mean_rel_l2", hot_rows: int | None = None) -> DataFrame:
    """The case at place n div 2 when ordered by error; equal errors go by key."""
    rows = metrics.withColumn("__all", F.lit(1))
    total = rows.groupBy("__all").agg(F.floor(F.count(F.lit(1)) / 2).alias("__half"))
    placed = ranked(rows, ["__all"], [value, key], "__pos", hot_rows=hot_rows)
    return (
        placed.join(F.broadcast(total), "__all")
        .filter(F.col("__pos") == F.col("__half") + 1)
        .select(*metrics.columns)
    )


def slice_stats(
    points: DataFrame,
    fields: dict[str, tuple[Column | str, Column | str]],
    keys: Sequence[str] = ("case_id",),
    z: str = "z",
    heights: Sequence[float] = SLICE_HEIGHTS,
    tolerances: Sequence[float] = SLICE_TOLERANCES,
    min_points: int = SLICE_MIN_POINTS,
    hot_rows: int | None = None,
) -> DataFrame:
    """Colour limits per horizontal slice and field; ``fields`` maps name to (target, prediction).

    A point belongs to every slice whose height it meets. The slices are a short
    literal list, so membership is a filter on an array and needs no join. The points are read twice.
    """
    slices = F.array(*[
        F.struct(F.lit(float(h)).alias("height"), F.lit(float(t)).alias("tol")) for h, t in zip(heights, tolerances)
    ])
    hit = F.filter(slices, lambda s: F.abs(F.col(z) - s["height"]) <= s["tol"])
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("field"),
            as_col(t).alias("target"),
            F.abs(as_col(p) - as_col(t)).alias("error"),
        )
        for name, (t, p) in fields.items()
    ])
    long = (
        points.select(*keys, F.explode(hit).alias("s"), entries.alias("f"))
        .select(*keys, F.col("s.height").alias("height"), F.explode("f").alias("f"))
        .select(*keys, "height", "f.*")
    )
    group = [*keys, "height", "field"]
    limits = percentiles(long, group, {"lo": ("target", 0.005), "hi": ("target", 0.995), "e": ("error", 0.995)}, hot_rows)
    flat = F.abs(F.col("hi") - F.col("lo")) < 1e-10
    return limits.filter(F.col("n") >= min_points).select(
        *group,
        "n",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("vmin"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("vmax"),
        F.when(F.col("e") < 1e-10, F.lit(1.0)).otherwise(F.col("e")).alias("emax"),
    )
