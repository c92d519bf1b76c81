"""Robust outlier removal over the case table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pointprep.functions.scalar import nan_to_null
from pointprep.plans.skew import exact_percentiles, hot_row_limit

# Fixed values
MAD_SCALE = 1.4826
MAD_FLOOR = 1e-10
CONCORDANCE = 5.0
EXTREME = 8.0


def mad_scores(stats: DataFrame, indicators: Sequence[str], key: str = "case_id", hot_rows: int | None = None) -> DataFrame:
    """Distance from the median in scaled median deviations, one row per case and indicator."""
    long = stats.select(key, *[nan_to_null(c).alias(c) for c in indicators]).unpivot(
        key, list(indicators), "indicator", "value"
    )
    # Every indicator has one row per case, so one count tells whether any is a hot group.
    limit = hot_rows if hot_rows is not None else hot_row_limit(stats.sparkSession)
    hot = [] if stats.count() <= limit else None
    # One row per indicator: a fixed, small table.
    mid = exact_percentiles(long, ["indicator"], "value", {"med": 0.5}, hot_rows, hot)
    off = long.join(F.broadcast(mid), "indicator").withColumn("dev", F.abs(F.col("value") - F.col("med")))
    spread = exact_percentiles(off, ["indicator"], "dev", {"mad": 0.5}, hot_rows, hot)
    scaled = F.greatest(F.lit(MAD_SCALE) * F.col("mad"), F.lit(MAD_FLOOR))
    return off.join(F.broadcast(spread), "indicator").select(
        key, "indicator", "value", "med", (F.col("dev") / scaled).alias("z_mad")
    )


def field_of(indicator: Column | str) -> Column:
    return F.regexp_replace(indicator, "_(mean|std)$", "")


def mad_outliers(scores: DataFrame, key: str = "case_id", field: Column | None = None) -> DataFrame:
    """Verdict per case: two fields beyond 5, or any indicator beyond 8.

    Fields come from the indicator name unless ``field`` maps them differently.
    """
    field = field_of("indicator") if field is None else field
    z = F.col("z_mad")
    verdict = scores.groupBy(key).agg(
        F.size(F.collect_set(F.when(z > CONCORDANCE, field))).cast("bigint").alias("n_fields"),
        F.coalesce(F.bool_or(z > EXTREME), F.lit(False)).alias("extreme"),
        F.array_sort(
            F.collect_list(F.when(z > CONCORDANCE, F.struct("indicator", F.col("z_mad").alias("z_mad"))))
        ).alias("hits"),
    )
    rule = (
        F.when(F.col("n_fields") >= 2, "concordance_2").when(F.col("extreme"), "extreme_single").otherwise("normal")
    )
    return verdict.withColumn("rule", rule).withColumn("is_anomaly", F.col("rule") != "normal").drop("extreme")


def drop_flagged(cases: DataFrame, verdicts: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases not flagged; a case without a verdict stays."""
    return cases.join(verdicts.filter("is_anomaly").select(key), key, "left_anti")


def rule_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter("is_anomaly").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
