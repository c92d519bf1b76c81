"""Reading cases: scans, defaults, unions, load checks and the file inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pointprep.plans.skew import ranked


def scan_cases(spark: SparkSession, path: str, schema: StructType, cases: Sequence[str] | None = None,
               skip_corrupt: bool = False) -> DataFrame:
    """Read a case table; a list of cases prunes partitions or row groups."""
    reader = spark.read.schema(schema)
    if skip_corrupt:
        reader = reader.option("ignoreCorruptFiles", "true")
    df = reader.parquet(path)
    return df if cases is None else df.filter(F.col("case_id").isin(list(cases)))


def with_default(df: DataFrame, column: str, value) -> DataFrame:
    """A default for missing values, and for the whole column where a case lacks it."""
    if column not in df.columns:
        return df.withColumn(column, F.lit(value))
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def flip_distance(df: DataFrame, sdf: str, grad: str, parts: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Turn the stored sign of the distance and its gradient."""
    return df.withColumns({
        sdf: -F.col(sdf),
        grad: F.struct(*[(-F.col(f"{grad}.{p}")).alias(p) for p in parts]),
    })


def union_points(volume: DataFrame, surface: DataFrame, tag: str = "is_surface") -> DataFrame:
    """Volume and surface rows in one table; fields one kind lacks become NULL."""
    return volume.withColumn(tag, F.lit(False)).unionByName(
        surface.withColumn(tag, F.lit(True)), allowMissingColumns=True
    )


def judge_cases(points: DataFrame, key: str, surface: str, sdf: str, max_range: float) -> DataFrame:
    """One row per case with the first reason to reject it, or NULL."""
    bad: Column = F.col(sdf).isNull() | F.isnan(sdf) | (F.col(sdf) >= max_range)
    counted = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(surface).alias("n_surface"), F.count_if(bad).alias("n_bad")
    )
    reason = (
        F.when(F.col("n_surface") == 0, "no_surface")
        .when(F.col("n_surface") == F.col("n_rows"), "no_volume")
        .when(F.col("n_bad") > 0, "sdf_out_of_range")
    )
    return counted.withColumn("reason", reason)


def load_report(judged: DataFrame, key: str, first: int = 10, hot_rows: int | None = None) -> DataFrame:
    """Cases per outcome, with the ids of the first few rejected ones."""
    counts = judged.groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    rejected = judged.filter(F.col("reason").isNotNull()).select(key, "reason")
    listed = ranked(rejected, ["reason"], [key], "__pos", limit=first, hot_rows=hot_rows)
    named = listed.groupBy("reason").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(key)), lambda c: c.cast("string"))).alias("first_cases")
    )
    return counts.join(named, "reason", "left").withColumn("first_cases", F.coalesce("first_cases", F.lit("")))


def unreadable_files(spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet") -> DataFrame:
    """Files of a folder that give no row when corrupt files are skipped, with a reason.

    ``scan_cases`` with ``skip_corrupt`` leaves them out; this is their error table.
    """
    there = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    read = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("pathGlobFilter", pattern).parquet(path)
    seen = read.select(F.input_file_name().alias("path")).distinct()
    # Both name the same files, one with and one without the empty authority of a local path.
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    return there.withColumn("path", plain).join(seen.withColumn("path", plain), "path", "left_anti").withColumn("reason", F.lit("unreadable_or_empty"))
