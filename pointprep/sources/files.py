"""Sinks and sources for manifests, statistics, metrics and prepared cases."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from pointprep.schema import FEATURE_GROUPS
from pointprep.session import materialize

MANIFEST_COLUMNS = ("case_name", "sub_bin", "n_buildings", "n_volume", "n_surface")


def reuse_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Read a table written earlier, or compute, write and read it.

    Only a folder whose writer has finished is reused; what a job that died left is replaced.
    """
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def reuse_unchanged(
    spark: SparkSession, path: str, rows: DataFrame, parameters: dict[str, object], compute: Callable[[DataFrame], DataFrame], key: str = "case_id"
) -> DataFrame:
    """Features of every case of ``rows``, computed anew only where the case or the parameters have changed.

    A case's fingerprint is its number of rows and the sum of their hashes, so it takes one pass with map-side sums, and
    a hash of the parameters. ``compute`` gets the rows of changed cases; what it returns is added to ``path`` as a new
    generation. The list of cases with fingerprint and generation is written last and under its own number, so a job that
    dies leaves the state before. Returns the features with the ``generation`` that made them; cases that ``rows`` lacks are left out.
    """
    columns = [c for c in sorted(rows.columns) if c != key]
    setting = repr(sorted((k, repr(v)) for k, v in parameters.items()))
    # Null fields hash like absent ones, so which are null is hashed too.
    hashed = F.xxhash64(F.lit(setting), *columns, *[F.col(c).isNull() for c in columns])
    prints = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(hashed.cast("decimal(20,0)")).alias("print"))
    known, last = _known_cases(spark, path)
    now = prints if known is None else prints.join(known.withColumnsRenamed({"n": "__n", "print": "__print"}), key, "left")
    same = F.lit(False) if known is None else F.col("generation").isNotNull() & (F.col("n") == F.col("__n")) & (F.col("print") == F.col("__print"))
    number = last + 1
    state = now.select(
        key, "n", "print", F.when(same, F.col("generation") if known is not None else F.lit(0)).otherwise(F.lit(number)).cast("int").alias("generation")
    )
    state = materialize(state, "state")
    changed = state.filter(F.col("generation") == number).select(key)
    if not changed.isEmpty():
        compute(rows.join(changed, key, "left_semi")).write.mode("overwrite").parquet(f"{path}/rows/generation={number}")
        state.write.mode("overwrite").parquet(f"{path}/cases/state={number}")
    made = spark.read.option("mergeSchema", "true").parquet(f"{path}/rows")
    return made.join(state.select(key, "generation"), [key, "generation"], "left_semi")


def _known_cases(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The newest finished list of cases, and its number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/cases/state=*/_SUCCESS")
    found = pattern.getFileSystem(conf).globStatus(pattern) or []
    numbers = [int(f.getPath().getParent().getName().split("=")[1]) for f in found]
    if not numbers:
        return None, 0
    return spark.read.parquet(f"{path}/cases/state={max(numbers)}"), max(numbers)


def write_batches(rows: DataFrame, path: str, order: Sequence[str] = ("seq", "pos", "slot"), shard: str = "shard", files_per_shard: int = 8) -> None:
    """Rows laid out in the order in which a shard's batches are read.

    Ranges of (shard, order) are dealt to files and sorted inside them, so a batch is one run of rows in one file or in two
    neighbours, and Parquet's minima and maxima lead a reader of one batch to it.
    """
    n = max(1, rows.select(shard).distinct().count()) * files_per_shard
    rows.repartitionByRange(n, shard, *order).sortWithinPartitions(shard, *order).write.mode("overwrite").parquet(path)


def read_batch(spark: SparkSession, path: str, shard: int, seq: int) -> DataFrame:
    """The rows of one batch; the filter reaches the row groups."""
    return spark.read.parquet(path).filter((F.col("shard") == shard) & (F.col("seq") == seq))


def write_manifest_document(facts: DataFrame, path: str) -> None:
    """Counters and parameters (section, name, value) as one JSON object of objects; a few dozen entries by schema."""
    inner = facts.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("name", "value"))).alias("e"))
    text = F.to_json(F.map_from_entries("e"))
    line = inner.agg(F.concat_ws(", ", F.sort_array(F.collect_list(F.concat(F.lit('"'), "section", F.lit('": '), text)))).alias("t"))
    line.select(F.concat(F.lit("{"), "t", F.lit("}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_manifest_facts(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, string>>").alias("m"))
    return doc.select(F.explode("m").alias("section", "e")).select("section", F.explode("e").alias("name", "value"))


def write_manifest(split: DataFrame, path: str, key: str = "case_id", summary: DataFrame | None = None, facts: DataFrame | None = None) -> None:
    """One JSON line per entry under its split, and the counters and the document of ``facts`` beside them."""
    if facts is not None:
        write_manifest_document(facts, f"{path}/document")
    rows = split.withColumn("case_name", F.col(key).cast("string")).select("split", *MANIFEST_COLUMNS)
    rows.write.mode("overwrite").partitionBy("split").json(f"{path}/splits")
    if summary is not None:
        summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "case_name string, sub_bin string, n_buildings bigint, n_volume bigint, n_surface bigint, split string"
    return spark.read.schema(schema).json(f"{path}/splits")


def read_manifest_document(spark: SparkSession, path: str) -> DataFrame:
    """A manifest kept as one JSON document; an entry is an object or a bare case name.

    The document lists selected cases only, some hundred entries per split.
    """
    doc = spark.read.schema("splits map<string, array<string>>").option("multiLine", "true").json(path)
    entries = doc.select(F.explode("splits").alias("split", "list")).select("split", F.explode("list").alias("e"))
    fields = F.from_json("e", "case_name string, sub_bin string, n_buildings bigint, n_volume bigint, n_surface bigint")
    is_object = F.ltrim("e").startswith("{")
    return entries.withColumn("o", F.when(is_object, fields)).select(
        F.coalesce("o.case_name", "e").alias("case_name"),
        F.coalesce("o.sub_bin", F.lit("unknown")).alias("sub_bin"),
        "o.n_buildings", "o.n_volume", "o.n_surface", "split",
    )


def write_norm_stats(stats: DataFrame, path: str, scales: DataFrame | None = None) -> None:
    """One JSON object of ``{group}_mean`` and ``{group}_std``; single channels become plain numbers.

    ``stats`` has feature, channel, mean and std: 39 rows by schema, written as one line.
    """
    parts = ["mean", "std"]
    grouped = stats.groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("channel", *parts))).alias("rows")
    )

    def text(part: str):
        values = F.transform("rows", lambda e: e[part])
        shown = F.when(F.size("rows") == 1, F.element_at(values, 1).cast("string")).otherwise(F.to_json(values))
        return F.concat(F.lit('"'), "feature", F.lit(f'_{part}": '), shown)

    lines = grouped.select(F.explode(F.array(*[text(p) for p in parts])).alias("t"))
    if scales is not None:
        # One entry per stratum with its three axes.
        per = scales.groupBy("sub_bin").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("axis", "scale"))), lambda e: e["scale"]).alias("v")
        )
        inner = per.agg(F.concat_ws(", ", F.array_sort(F.collect_list(
            F.concat(F.lit('"'), "sub_bin", F.lit('": '), F.to_json("v"))
        ))).alias("t"))
        lines = lines.unionByName(inner.select(F.concat(F.lit('"rope_scales": {'), "t", F.lit("}")).alias("t")))
    line = lines.agg(F.concat(F.lit("{"), F.concat_ws(", ", F.array_sort(F.collect_list("t"))), F.lit("}")).alias("value"))
    line.coalesce(1).write.mode("overwrite").text(path)


def read_norm_stats(spark: SparkSession, path: str) -> DataFrame:
    """Feature, channel, mean and std of a statistics document."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("m"))
    pairs = raw.select(F.explode("m").alias("name", "text")).filter(F.col("name").rlike("_(mean|std)$"))
    is_list = F.ltrim("text").startswith("[")
    values = F.when(is_list, F.from_json("text", "array<double>")).otherwise(
        F.array(F.when(~is_list, F.col("text")).cast("double"))
    )
    long = pairs.select(
        F.regexp_replace("name", "_(mean|std)$", "").alias("feature"),
        F.regexp_extract("name", "_(mean|std)$", 1).alias("part"),
        F.posexplode(values).alias("channel", "v"),
    )
    return long.groupBy("feature", F.col("channel").cast("bigint").alias("channel")).agg(
        F.max(F.when(F.col("part") == "mean", F.col("v"))).alias("mean"),
        F.max(F.when(F.col("part") == "std", F.col("v"))).alias("std"),
    )


def read_axis_scales(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    doc = raw.select(F.from_json("value", "rope_scales map<string, array<double>>").alias("d"))
    rows = doc.select(F.explode("d.rope_scales").alias("sub_bin", "v")).select("sub_bin", F.posexplode("v").alias("i", "scale"))
    axes = F.array(*[F.lit(a) for a in "xyz"])
    return rows.select("sub_bin", F.element_at(axes, F.col("i") + 1).alias("axis"), "scale")


def split_channels(stats: DataFrame, groups: dict[str, int] = FEATURE_GROUPS) -> DataFrame:
    """Turn channel names like ``vol_3`` into group and channel number."""
    name = F.col("channel")
    numbered = name.rlike("_[0-9]+$")
    return stats.select(
        F.when(numbered, F.regexp_replace(name, "_[0-9]+$", "")).otherwise(name).alias("feature"),
        F.when(numbered, F.regexp_extract(name, "_([0-9]+)$", 1)).otherwise(F.lit("0")).cast("bigint").alias("channel"),
        *[c for c in stats.columns if c != "channel"],
    ).filter(F.col("feature").isin(list(groups)))


def write_prepared(cases: DataFrame, path: str, partition: str = "split") -> None:
    """Prepared rows by split; a rerun replaces only the splits it brings."""
    cases.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON lines; columns that start with an underscore are working data and stay out."""
    keep: Sequence[str] = [c for c in metrics.columns if not c.startswith("_")]
    metrics.select(*keep).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
