"""Per-case indicators and train-only normalisation statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pointprep.functions.scalar import LEAVES_PER_STRATUM, log_abs, nan_to_null, standardise, unstandardise
from pointprep.plans.select import percentiles

VOLUME_FIELDS = {"Ux": "ux", "Uy": "uy", "Uz": "uz", "p_vol": "p", "nut_nondim": "nut"}
SURFACE_FIELDS = {"p_surf": "p", "wss_x": "wss_x", "wss_y": "wss_y", "wss_z": "wss_z"}


def indicator_columns(
    surface: Column, volume_fields: Mapping[str, str], surface_fields: Mapping[str, str], log_field: str | None
) -> list[Column]:
    """Aggregates for the 19 indicators; NaN is ignored, deviations are population ones."""
    aggs = []
    for fields, rows in ((volume_fields, ~surface), (surface_fields, surface)):
        for name, column in fields.items():
            value = F.when(rows, nan_to_null(column))
            aggs.append(F.avg(value).alias(f"{name}_mean"))
            aggs.append(F.stddev_pop(value).alias(f"{name}_std"))
    if log_field:
        logged = F.when(~surface, log_abs(nan_to_null(log_field)))
        logged = F.when(F.col(log_field).isNotNull() & ~F.isnan(log_field), logged)
        aggs.append(F.stddev_pop(logged).alias("log_nut_std"))
    return aggs


def indicator_names(
    volume_fields: Mapping[str, str] = VOLUME_FIELDS, surface_fields: Mapping[str, str] = SURFACE_FIELDS
) -> list[str]:
    names = [f"{n}_{s}" for n in [*volume_fields, *surface_fields] for s in ("mean", "std")]
    return names + ["log_nut_std"]


def case_stats(
    points: DataFrame,
    key: str = "case_id",
    surface: str = "is_surface",
    volume_fields: Mapping[str, str] = VOLUME_FIELDS,
    surface_fields: Mapping[str, str] = SURFACE_FIELDS,
    log_field: str | None = "nut",
) -> DataFrame:
    """One row per case: counts per kind and all indicators, from one pass."""
    flag = F.col(surface)
    return points.groupBy(key).agg(
        F.count_if(~flag).alias("n_volume"),
        F.count_if(flag).alias("n_surface"),
        *indicator_columns(flag, volume_fields, surface_fields, log_field),
    )


def _long(row: DataFrame, channels: Sequence[str], parts: Mapping[str, str]) -> DataFrame:
    """Turn one wide row of ``{channel}__{part}`` into one row per channel."""
    entries = [
        F.struct(F.lit(c).alias("channel"), *[F.col(f"{c}__{p}").cast(t).alias(p) for p, t in parts.items()])
        for c in channels
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def sufficient_stats(df: DataFrame, channels: Mapping[str, Column | str]) -> DataFrame:
    """Count, sum and sum of squares per channel; these merge by addition."""
    aggs = []
    for name, c in channels.items():
        c = nan_to_null(c)
        aggs += [
            F.count(c).alias(f"{name}__n"),
            F.sum(c).alias(f"{name}__total"),
            F.sum(c * c).alias(f"{name}__total_sq"),
        ]
    return _long(df.agg(*aggs), list(channels), {"n": "bigint", "total": "double", "total_sq": "double"})


def norm_stats(df: DataFrame, channels: Mapping[str, Column | str]) -> DataFrame:
    """Count, mean and population deviation per channel.

    Spark merges central moments between tasks, so there is none of the cancellation
    that the difference of squares has.
    """
    aggs = []
    for name, c in channels.items():
        c = nan_to_null(c)
        aggs += [
            F.count(c).alias(f"{name}__n"),
            F.avg(c).alias(f"{name}__mean"),
            F.stddev_pop(c).alias(f"{name}__std"),
        ]
    return _long(df.agg(*aggs), list(channels), {"n": "bigint", "mean": "double", "std": "double"})


def stats_lookup(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """Channel statistics on the driver: one row per channel of a fixed schema."""
    return {r["channel"]: (r["mean"], r["std"]) for r in stats.select("channel", "mean", "std").collect()}


def zscore_apply(df: DataFrame, stats: Mapping[str, tuple[float, float]], columns: Mapping[str, str] | None = None) -> DataFrame:
    """Standardise columns; ``columns`` maps column to channel where they differ.

    The statistics enter as literals, so this is a projection without any join.
    """
    columns = columns or {c: c for c in stats if c in df.columns}
    return df.withColumns({c: standardise(c, *stats[ch]) for c, ch in columns.items()})


def denormalize(df: DataFrame, stats: Mapping[str, tuple[float, float]], columns: Mapping[str, str] | None = None) -> DataFrame:
    columns = columns or {c: c for c in stats if c in df.columns}
    return df.withColumns({c: unstandardise(c, *stats[ch]) for c, ch in columns.items()})


def axis_scale(
    centroids: DataFrame,
    axes: Sequence[str] = ("x", "y", "z"),
    leaves: Mapping[str, int] = LEAVES_PER_STRATUM,
    low: float = 0.05,
    high: float = 0.95,
    hot_rows: int | None = None,
) -> DataFrame:
    """Scale per stratum and axis: cube root of the leaf count times the relative extent."""
    entries = [F.struct(F.lit(i).alias("axis_no"), F.lit(a).alias("axis"), F.col(a).alias("v")) for i, a in enumerate(axes)]
    long = centroids.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    spans = percentiles(long, ["axis_no", "axis"], {"p_low": ("v", low), "p_high": ("v", high)}, hot_rows)
    spans = spans.withColumn("extent", F.greatest(F.col("p_high") - F.col("p_low"), F.lit(1e-8)))
    one = spans.agg(
        F.array_sort(F.collect_list(F.struct("axis_no", "axis", "extent"))).alias("axes"),
    )
    product = F.aggregate("axes", F.lit(1.0), lambda acc, e: acc * e["extent"])
    geo = F.greatest(F.pow(product, F.lit(1.0 / 3.0)), F.lit(1e-8))
    strata = F.array(*[F.struct(F.lit(s).alias("sub_bin"), F.lit(float(n)).alias("leaves")) for s, n in leaves.items()])
    return (
        one.withColumn("geo", geo)
        .withColumn("s", F.explode(strata))
        .withColumn("a", F.explode("axes"))
        .select(
            F.col("s.sub_bin").alias("sub_bin"),
            F.col("a.axis").alias("axis"),
            (F.pow(F.col("s.leaves"), F.lit(1.0 / 3.0)) * F.col("a.extent") / F.col("geo")).alias("scale"),
        )
    )


def vector_mean(df: DataFrame, keys: Sequence[str], vector: str, name: str = "mean_vector") -> DataFrame:
    """Element-wise mean of equally long vectors; sums combine before the shuffle."""
    cells = df.select(*keys, F.posexplode(vector).alias("pos", "v"))
    means = cells.groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias(name)
    )
