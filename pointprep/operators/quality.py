"""Data-quality reports. Each returns a table of findings; none stops the run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from pointprep.functions.scalar import STRATA
from pointprep.plans.skew import ranked
from pointprep.schema import FEATURE_GROUPS, FORBIDDEN_LEFTOVER

# How far a standardised column may stray
ZSCORE_MEAN_MAX = 2.0
ZSCORE_STD_MIN = 0.1
ZSCORE_STD_MAX = 5.0


def idw_check(weights: DataFrame, tolerance: float = 0.01, query_id: str = "point_id", key: str = "case_id") -> DataFrame:
    """Queries whose weights do not add up to one."""
    sums = weights.groupBy(key, query_id).agg(F.sum("weight").alias("s"))
    return sums.agg(
        F.count(F.lit(1)).alias("n_queries"), F.count_if(F.abs(F.col("s") - 1.0) > tolerance).alias("n_off")
    )


def contract_issues(df: DataFrame, required: Sequence[str] | StructType, forbidden: Sequence[str] = FORBIDDEN_LEFTOVER) -> DataFrame:
    """Missing or mistyped required columns are failures, leftovers are warnings."""
    have = {f.name: f.dataType for f in df.schema}
    if isinstance(required, StructType):
        need = {f.name: f.dataType for f in required}
    else:
        need = {c: None for c in required}
    found = [("missing_column", c, "failure") for c in need if c not in have]
    found += [("wrong_type", c, "failure") for c, t in need.items() if t is not None and c in have and have[c] != t]
    found += [("leftover_column", c, "warning") for c in forbidden if c in have]
    return df.sparkSession.createDataFrame(found, "check string, item string, level string")


def contract_report(df: DataFrame, required: StructType, forbidden: Sequence[str] = FORBIDDEN_LEFTOVER) -> DataFrame:
    """Every required column and every leftover, with what is wrong with it and how many of its values are missing.

    ``problem`` is missing_column, wrong_type (failures), leftover_column (a warning), missing_values where all are, or NULL.
    """
    have = {f.name: f.dataType for f in df.schema}
    named = [c for c in [*required.names, *forbidden] if c in have]
    rows = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(f"__null_{c}") for c in named])

    def entry(c: str, problem: str | None) -> Column:
        nulls = F.col(f"__null_{c}") if c in have else F.col("__rows")
        all_gone = (nulls == F.col("__rows")) & (F.col("__rows") > 0)
        said = F.lit(problem) if problem else F.when(all_gone, "missing_values")
        return F.struct(F.lit(c).alias("item"), said.alias("problem"), nulls.alias("n_missing"))

    def judge(c: str, wanted) -> str | None:
        return "missing_column" if c not in have else "wrong_type" if have[c] != wanted else None

    entries = [entry(f.name, judge(f.name, f.dataType)) for f in required] + [entry(c, "leftover_column") for c in forbidden if c in have]
    return rows.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def zscore_sanity(df: DataFrame, columns: Sequence[str], key: str = "case_id") -> DataFrame:
    """Mean and deviation of standardised columns per case, with the flag for odd ones. Checks every case."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s")]
    wide = df.groupBy(key).agg(*aggs)
    entries = [
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__m").alias("mean"), F.col(f"{c}__s").alias("std")) for c in columns
    ]
    long = wide.select(key, F.explode(F.array(*entries)).alias("e")).select(key, "e.*")
    odd = (F.abs("mean") > ZSCORE_MEAN_MAX) | (F.col("std") < ZSCORE_STD_MIN) | (F.col("std") > ZSCORE_STD_MAX)
    return long.withColumn("odd", odd)


def stats_missing(names: DataFrame, column: str = "name", groups: Sequence[str] = tuple(FEATURE_GROUPS),
                  strata: Sequence[str] = STRATA) -> DataFrame:
    """Expected statistics (mean and deviation per group, a scale per stratum) that are absent."""
    expected = [f"{g}_{s}" for g in groups for s in ("mean", "std")] + [f"scale:{s}" for s in strata]
    wanted = names.sparkSession.range(1).select(F.explode(F.array(*[F.lit(e) for e in expected])).alias(column))
    return wanted.join(names.select(column).distinct(), column, "left_anti")


def missing_entries(manifest: DataFrame, present: DataFrame, key: str = "case_id", first: int = 5,
                    hot_rows: int | None = None) -> DataFrame:
    """Per split: entries, how many have no rows, and the first few of those."""
    absent = manifest.join(present.select(key).distinct(), key, "left_anti")
    totals = manifest.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    gone = absent.groupBy("split").agg(F.count(F.lit(1)).alias("n_missing"))
    some = ranked(absent.select("split", key), ["split"], [key], "__pos", limit=first, hot_rows=hot_rows)
    named = some.groupBy("split").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(key)), lambda c: c.cast("string"))).alias("first_missing")
    )
    return (
        totals.join(gone, "split", "left")
        .join(named, "split", "left")
        .select(
            "split", "n", F.coalesce("n_missing", F.lit(0).cast("bigint")).alias("n_missing"),
            F.coalesce("first_missing", F.lit("")).alias("first_missing"),
        )
    )


def manifest_issues(manifest: DataFrame, key: str = "case_id", expected_source: str | None = None,
                    source: str = "source") -> DataFrame:
    """Findings on a manifest: empty splits, nameless or repeated entries, unknown strata, other source path."""
    expected = ("train", "val", "test")
    counts = manifest.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(key).isNull()).alias("nameless"),
        F.count_if(~F.coalesce(F.col("sub_bin"), F.lit("unknown")).isin(list(STRATA))).alias("unknown"),
    )
    listed = manifest.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in expected])).alias("split"))
    per_split = listed.join(counts, "split", "left")
    zero = F.lit(0).cast("bigint")
    finding = lambda check, level, n: F.struct(
        F.lit(check).alias("check"), F.lit(level).alias("level"), F.coalesce(n, zero).alias("n")
    )
    rows = per_split.select(
        F.col("split").alias("item"),
        F.explode(F.array(
            finding("empty_split", "warning", F.when(F.coalesce("n", zero) == 0, F.lit(1).cast("bigint"))),
            finding("nameless_entry", "failure", F.col("nameless")),
            finding("unknown_stratum", "warning", F.col("unknown")),
        )).alias("e"),
    ).select("item", "e.*")
    twice = manifest.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    repeated = twice.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("all").alias("item"), F.lit("repeated_entry").alias("check"), F.lit("failure").alias("level"), "n"
    )
    out = rows.unionByName(repeated)
    if expected_source is not None:
        other = manifest.agg(F.count_if(F.col(source) != expected_source).alias("n")).select(
            F.lit("all").alias("item"), F.lit("other_source").alias("check"), F.lit("warning").alias("level"), "n"
        )
        out = out.unionByName(other)
    return out.filter(F.col("n") > 0)


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, NULLs, NaNs, infinities, minimum and maximum per column in one pass."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        ok = ~F.isnan(v) & (F.abs(v) != float("inf"))
        aggs += [
            F.count_if(v.isNull()).alias(f"{c}__n_null"),
            F.count_if(F.isnan(v)).alias(f"{c}__n_nan"),
            F.count_if(F.abs(v) == float("inf")).alias(f"{c}__n_inf"),
            F.min(F.when(ok, v)).alias(f"{c}__low"),
            F.max(F.when(ok, v)).alias(f"{c}__high"),
        ]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    entries = [
        F.struct(
            F.lit(c).alias("column_name"), F.col("n"),
            *[F.col(f"{c}__{p}").alias(p) for p in ("n_null", "n_nan", "n_inf", "low", "high")],
        )
        for c in columns
    ]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def pred_coverage(preds: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with both sides, and with one side only."""
    p = preds.select(*keys).withColumn("__p", F.lit(1))
    t = targets.select(*keys).withColumn("__t", F.lit(1))
    both = p.join(t, list(keys), "full_outer")
    has_p, has_t = F.col("__p").isNotNull(), F.col("__t").isNotNull()
    return both.agg(
        F.count_if(has_p & has_t).alias("n_both"),
        F.count_if(has_p & ~has_t).alias("n_pred_only"),
        F.count_if(~has_p & has_t).alias("n_target_only"),
    )


def dq_status(*issues: DataFrame) -> DataFrame:
    """Roll issue tables (column ``level``) up: 1 with failures, else 2 with warnings, else 0."""
    levels = issues[0].select("level")
    for other in issues[1:]:
        levels = levels.unionByName(other.select("level"))
    return levels.agg(
        F.count_if(F.col("level") == "failure").alias("failures"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
    ).withColumn(
        "status", F.when(F.col("failures") > 0, 1).when(F.col("warnings") > 0, 2).otherwise(0).cast("bigint")
    )
