"""Strata, fixed-count splits and the manifest's bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pointprep.functions.rng import uniform
from pointprep.functions.scalar import STRATA, range_label
from pointprep.plans.skew import ranked


def add_strata(cases: DataFrame, key: str = "case_id", size: str = "n_volume", count: str = "n_buildings",
               hot_rows: int | None = None) -> DataFrame:
    """Add ``range`` and ``sub_bin``: within a range the smaller half by ``size`` is easy."""
    labelled = cases.withColumn("range", range_label(count))
    totals = labelled.groupBy("range").agg(F.count(F.lit(1)).alias("__total"))
    placed = ranked(labelled, ["range"], [size, key], "__pos", hot_rows=hot_rows)
    # One row per range label, of which there are five.
    half = F.floor(F.col("__total") / 2)
    return (
        placed.join(F.broadcast(totals), "range")
        .withColumn(
            "sub_bin",
            F.concat_ws("_", "range", F.when(F.col("__pos") <= half, F.lit("easy")).otherwise(F.lit("hard"))),
        )
        .drop("__pos", "__total")
    )


def range_thresholds(cases: DataFrame, size: str = "n_volume") -> DataFrame:
    """Largest easy size per range, or the only size where a range has one case."""
    easy = F.max(F.when(F.col("sub_bin").endswith("_easy"), F.col(size)))
    return cases.groupBy("range").agg(F.coalesce(easy, F.min(size)).cast("bigint").alias("threshold"))


def stratified_split(
    cases: DataFrame,
    n_train: int = 70,
    n_val: int = 5,
    n_test: int = 5,
    seed: int | str = 42,
    key: str = "case_id",
    stratum: str = "sub_bin",
    hot_rows: int | None = None,
) -> DataFrame:
    """Fixed counts per stratum without replacement; a shortage falls on test, then val."""
    drawn = cases.withColumn("__u", uniform("split", seed, F.col(key)))
    take = n_train + n_val + n_test
    placed = ranked(drawn, [stratum], ["__u", key], "__pos", limit=take, hot_rows=hot_rows)
    split = (
        F.when(F.col("__pos") <= n_train, "train").when(F.col("__pos") <= n_train + n_val, "val").otherwise("test")
    )
    return placed.withColumn("split", split).drop("__u", "__pos")


def size_summary(cases: DataFrame, columns: list[str], key: str = "case_id", hot_rows: int | None = None) -> DataFrame:
    """Minimum, maximum and upper median (element n div 2 in order) per column."""
    long = cases.select(key, *[F.col(c).cast("bigint").alias(c) for c in columns]).unpivot(
        key, columns, "measure", "value"
    )
    ends = long.groupBy("measure").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    placed = ranked(long, ["measure"], ["value", key], "__pos", hot_rows=hot_rows)
    # One row per measure.
    return (
        placed.join(F.broadcast(ends), "measure")
        .filter(F.col("__pos") == F.floor(F.col("n") / 2) + 1)
        .select("measure", "n", "min", "max", F.col("value").alias("median"))
    )


def undersupplied(
    cases: DataFrame, n_train: int, n_val: int, n_test: int, stratum: str = "sub_bin", strata: tuple[str, ...] = STRATA
) -> DataFrame:
    """Strata, empty ones included, with fewer cases than asked for, and what each split then gets."""
    n = F.col("available")
    lit = lambda v: F.lit(v).cast("bigint")
    got = lambda asked, before: F.greatest(lit(0), F.least(lit(asked), n - lit(before)))
    need = n_train + n_val + n_test
    every = F.explode(F.array(*[F.lit(s) for s in strata]))
    listed = cases.sparkSession.range(1).select(every.alias(stratum))
    counts = cases.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    return (
        listed.join(counts, stratum, "left")
        .withColumn("available", F.coalesce("__n", lit(0)))
        .filter(n < need)
        .select(
            stratum,
            "available",
            lit(need).alias("requested"),
            got(n_train, 0).alias("got_train"),
            got(n_val, n_train).alias("got_val"),
            got(n_test, n_train + n_val).alias("got_test"),
        )
    )


def manifest_counts(verdicts: DataFrame, stratified: DataFrame, split: DataFrame, load_errors: DataFrame | None = None) -> DataFrame:
    """Counters of a manifest in long form: pool per stratum, rows per split, scanned and dropped.

    With ``load_errors``, a row per case that could not be read, these are counted as failed and as scanned.
    """
    pool = stratified.groupBy(F.col("sub_bin").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    parts = split.groupBy(F.col("split").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    judged = verdicts.select("is_anomaly", F.lit(False).alias("__failed"))
    if load_errors is not None:
        judged = judged.unionByName(load_errors.select(F.lit(False).alias("is_anomaly"), F.lit(True).alias("__failed")))
    counters = {"dropped": F.count_if("is_anomaly"), "scanned": F.count(F.lit(1))}
    if load_errors is not None:
        counters["load_failed"] = F.count_if("__failed")
    totals = judged.agg(*[c.alias(n) for n, c in counters.items()]).unpivot([], list(counters), "name", "n")
    tagged = [df.select(F.lit(k).alias("kind"), "name", "n") for k, df in (("pool", pool), ("split", parts), ("total", totals))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
