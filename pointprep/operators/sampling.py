"""Sampling without replacement, slot layouts and the curriculum draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pointprep.functions.rng import gumbel, uniform
from pointprep.functions.scalar import STRATA, curriculum_count, curriculum_temperature, query_split
from pointprep.plans.select import ACCURACY, SHARES, near_bounds, threshold
from pointprep.plans.skew import hot_row_limit, ranked
from pointprep.session import materialize


def gumbel_topk(
    points: DataFrame,
    log_weight: Column,
    k: int | str,
    epoch: int = 0,
    key: str = "case_id",
    row_id: str = "point_id",
    name: str = "rn",
    hot_rows: int | None = None,
) -> DataFrame:
    """Weighted sample of ``k`` rows per case without replacement, heaviest key first."""
    noisy = gumbel(log_weight, uniform("gumbel", F.col(key), epoch, F.col(row_id)))
    keyed = points.withColumn("__neg", -noisy)
    return ranked(keyed, [key], ["__neg", row_id], name, limit=k, hot_rows=hot_rows).drop("__neg")


def uniform_sample(
    points: DataFrame,
    k: int | str,
    epoch: int = 0,
    keys: Sequence[str] = ("case_id",),
    row_id: str = "point_id",
    salt: str = "uniform",
    name: str = "rn",
    hot_rows: int | None = None,
) -> DataFrame:
    """``k`` rows per group without replacement, all equally likely."""
    drawn = points.withColumn("__u", uniform(salt, *[F.col(c) for c in keys], epoch, F.col(row_id)))
    return ranked(drawn, list(keys), ["__u", row_id], name, limit=k, hot_rows=hot_rows).drop("__u")


def query_slots(
    points: DataFrame,
    log_weight: Column,
    n_query: int,
    epoch: int = 0,
    key: str = "case_id",
    surface: str = "is_surface",
    row_id: str = "point_id",
    hot_rows: int | None = None,
) -> DataFrame:
    """Slots 0..n_query-1 per case: weighted volume rows, uniform surface rows, padding.

    Padding slots have no point and ``valid`` false, so all cases have equal length. The points are read twice:
    once for counts and sketches of the draws, once for the rows that the sketches let through.
    """
    flag = F.col(surface)
    n_vol, n_surf = query_split("__nv", "__ns", n_query)
    # A volume row sorts by its weighted draw, a surface row by a plain one; the least sort keys are taken.
    draw = F.when(F.col("__surf"), uniform("surface", F.col(key), epoch, F.col(row_id))).otherwise(
        -gumbel(F.col("__lw"), uniform("gumbel", F.col(key), epoch, F.col(row_id)))
    )
    drawn = points.select(key, row_id, flag.alias("__surf"), log_weight.alias("__lw")).withColumn("__by", draw).drop("__lw")
    sketch = lambda of: F.percentile_approx(F.when(of, F.col("__by")), SHARES, ACCURACY)
    sized = drawn.groupBy(key).agg(
        F.count_if(~F.col("__surf")).alias("__nv"), F.count_if("__surf").alias("__ns"),
        sketch(~F.col("__surf")).alias("__kv"), sketch(F.col("__surf")).alias("__ks"),
    ).withColumns({"__qv": n_vol, "__qs": n_surf})
    # One row per case: how many rows of each kind, and a sort key that enough of them do not exceed.
    counts = materialize(sized.select(
        key, (F.col("__nv") + F.col("__ns")).alias("__all"), "__qv", "__qs",
        threshold(F.col("__kv"), F.col("__nv"), F.col("__qv")).alias("__tv"),
        threshold(F.col("__ks"), F.col("__ns"), F.col("__qs")).alias("__ts"),
    ), "counts")
    limit = hot_rows if hot_rows is not None else hot_row_limit(points.sparkSession)
    quota = F.when(F.col("__surf"), F.col("__qs")).otherwise(F.col("__qv"))
    bound = F.when(F.col("__surf"), F.col("__ts")).otherwise(F.col("__tv"))
    # What passes is a few times the wanted number of rows, so one window per case and kind is enough.
    close = near_bounds(drawn, counts, [key], [row_id], "__all", limit).filter(bound.isNull() | (F.col("__by") <= bound))
    place = F.row_number().over(W.partitionBy(key, "__surf").orderBy("__by", row_id)).cast("bigint")
    best = close.withColumn("__rn", place).filter(F.col("__rn") <= quota)
    slot = F.when(F.col("__surf"), F.col("__qv")).otherwise(F.lit(0)) + F.col("__rn") - 1
    taken = best.select(
        key, slot.cast("bigint").alias("slot"), row_id, F.col("__surf").alias("is_surf"), F.lit(True).alias("valid")
    )
    used = F.col("__qv") + F.col("__qs")
    padding = (
        counts.filter(used < n_query)
        .withColumn("slot", F.explode(F.sequence(used, F.lit(n_query - 1).cast("bigint"))))
        .select(
            key,
            "slot",
            F.lit(None).cast(points.schema[row_id].dataType).alias(row_id),
            F.lit(False).alias("is_surf"),
            F.lit(False).alias("valid"),
        )
    )
    return taken.unionByName(padding)


def curriculum_counts(
    cases: DataFrame,
    epoch: int,
    total_epochs: int = 400,
    start: float = 3.0,
    end: float = 1.0,
    stratum: str = "sub_bin",
    strata: Sequence[str] = STRATA,
    floor_ratio: float = 0.3,
    floor_min: int = 3,
) -> DataFrame:
    """How many cases of each stratum an epoch uses."""
    order = F.array(*[F.lit(s) for s in strata])
    counted = cases.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    index = (F.array_position(order, F.col(stratum)) - 1).cast("bigint")
    taken = curriculum_count(
        "n",
        "stratum_index",
        len(strata),
        curriculum_temperature(epoch, total_epochs, start, end),
        floor_ratio,
        floor_min,
    )
    return counted.withColumn("stratum_index", index).filter("stratum_index >= 0").withColumn("n_take", taken)


def curriculum_sample(
    cases: DataFrame,
    epoch: int,
    total_epochs: int = 400,
    start: float = 3.0,
    end: float = 1.0,
    stratum: str = "sub_bin",
    key: str = "case_id",
    strata: Sequence[str] = STRATA,
    hot_rows: int | None = None,
) -> DataFrame:
    """The epoch's cases, drawn uniformly within each stratum."""
    counts = curriculum_counts(cases, epoch, total_epochs, start, end, stratum, strata)
    # One row per stratum.
    sized = cases.join(F.broadcast(counts.select(stratum, "n_take")), stratum)
    return uniform_sample(sized, "n_take", epoch, [stratum], key, "curriculum", "draw", hot_rows)
