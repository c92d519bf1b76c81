"""Statistics that grow as cases arrive.

Both results are sums of mergeable moments, so any arrival order gives the batch
result. There is no event time and nothing is late; outlier removal stays a batch
step because its medians need all cases.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pointprep.operators import stats
from pointprep.session import scratch_path


#: Batches after which their rows are merged.
COMPACT_BATCHES = 20


def case_stream(spark: SparkSession, path: str, schema: StructType, pattern: str | None = None,
                files_per_trigger: int = 100) -> DataFrame:
    """Files of a folder as a stream, a bounded number at a time."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def norm_stats(stream: DataFrame, channels: Mapping[str, str]) -> DataFrame:
    return stats.norm_stats(stream, channels)


def case_stats(stream: DataFrame, **options) -> DataFrame:
    return stats.case_stats(stream, **options)


def run_complete(result: DataFrame, spark: SparkSession, label: str = "stream", checkpoint: str | None = None) -> DataFrame:
    """Process what is available and return the result table.

    For results of a fixed, small size: each batch replaces the table. The folder of a
    batch is overwritten on retry, so a repeated batch does no harm. With a ``checkpoint`` the
    table lies beside the state, so a run without news returns what the last one did.
    """
    target = f"{checkpoint}/{label}-table" if checkpoint else scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite").parquet(target)

    _drain(result.writeStream.outputMode("complete").foreachBatch(write), _state(spark, checkpoint))
    if not _exists(spark, target):
        return spark.createDataFrame([], result.schema)
    return spark.read.parquet(target).drop("__batch")


def run_updates(result: DataFrame, spark: SparkSession, key: str, label: str = "stream", checkpoint: str | None = None) -> DataFrame:
    """Process what is available; only rows that changed in a batch are written.

    The table is the newest row of each key, so the work per batch follows the keys it
    touched and not the number of keys seen so far. With a ``checkpoint`` the batches lie beside the
    state and later runs add to them; after COMPACT_BATCHES they are merged into one.
    """
    target = f"{checkpoint}/{label}-table" if checkpoint else scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    _drain(result.writeStream.outputMode("update").foreachBatch(write), _state(spark, checkpoint))
    if not _exists(spark, target):
        return spark.createDataFrame([], result.schema)
    rows = spark.read.option("basePath", target).parquet(target)
    values = [c for c in rows.columns if c not in (key, "batch")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("e")).select(key, "e.*")
    batches = sorted(r["batch"] for r in rows.select("batch").distinct().collect())
    if len(batches) > COMPACT_BATCHES:
        # The merged rows are added to the newest batch before the others go: reading in between finds equal rows.
        merged = f"{target}/batch={batches[-1]}"
        staged = scratch_path(spark, label)
        newest.write.parquet(staged)
        spark.read.parquet(staged).write.mode("append").parquet(merged)
        for b in batches[:-1]:
            _remove(spark, f"{target}/batch={b}")
        rows = spark.read.option("basePath", target).parquet(target)
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("e")).select(key, "e.*")
    return newest


def _state(spark: SparkSession, checkpoint: str | None) -> str:
    return f"{checkpoint}/state" if checkpoint else scratch_path(spark, "state")


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, files = _path(spark, path)
    return files.exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    at, files = _path(spark, path)
    files.delete(at, True)


def _drain(writer, checkpoint: str) -> None:
    running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
