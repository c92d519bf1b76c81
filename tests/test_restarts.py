"""Streams that are started again, torn caches, refilled keys and ranges far above the limit."""

from pyspark.sql import functions as F

from pointprep.operators.neighbours import random_edges_excluding
from pointprep.plans.skew import ranked
from pointprep.session import scratch_path
from pointprep.sources.files import reuse_or_compute
from pointprep.sources.tables import unreadable_files
from pointprep.streaming import incremental


def test_streams_add_up_over_runs(spark, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT_BATCHES", 2)
    source, state = scratch_path(spark, "source"), scratch_path(spark, "held")
    schema = spark.range(1).select("id", F.lit(1.0).alias("v")).schema

    def run():
        rows = incremental.case_stream(spark, source, schema, files_per_trigger=1)
        table = rows.groupBy("id").agg(F.sum("v").alias("v"))
        total = rows.agg(F.sum("v").alias("v"))
        per = incremental.run_updates(table, spark, "id", checkpoint=f"{state}/a")
        whole = incremental.run_complete(total, spark, checkpoint=f"{state}/b")
        return {r["id"]: r["v"] for r in per.collect()}, whole.first()["v"]

    want = {}
    for news in ([1, 2], [3], [], [2, 4], [1]):
        if news:
            spark.createDataFrame([(i, float(i)) for i in news], schema).coalesce(1).write.mode("append").parquet(source)
        for i in news:
            want[i] = want.get(i, 0.0) + i
        assert run() == (want, sum(want.values()))


def test_torn_cache_is_replaced(spark):
    path = scratch_path(spark, "cache")
    spark.range(3).write.parquet(f"{path}/half")
    spark.sparkContext._jvm.java.io.File(path.removeprefix("file:")).mkdirs()
    assert reuse_or_compute(spark, path, lambda: spark.range(5).toDF("id")).count() == 5
    assert reuse_or_compute(spark, path, lambda: spark.range(9).toDF("id")).count() == 5


def test_unreadable_files_are_named(spark, tmp_path):
    good, bad = tmp_path / "t" / "good.parquet", tmp_path / "t" / "bad.parquet"
    rows = spark.range(4).toDF("id")
    rows.toPandas().to_parquet(tmp_path / "x.parquet")
    good.parent.mkdir()
    good.write_bytes((tmp_path / "x.parquet").read_bytes())
    bad.write_bytes(b"not a table")
    found = unreadable_files(spark, str(good.parent), rows.schema).collect()
    assert [r["path"].endswith("bad.parquet") for r in found] == [True]


def test_every_leaf_gets_its_random_keys(spark):
    leaves = spark.range(12).select(F.lit(7).cast("bigint").alias("case_id"), F.col("id").alias("leaf_id"))
    local = leaves.select("case_id", "leaf_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("i")).select(
        "case_id", "leaf_id", F.pmod(F.col("leaf_id") + F.col("i"), F.lit(12)).alias("nbr_leaf_id")
    )
    got = {}
    for r in random_edges_excluding(local, leaves, n_random=5, spare=0).collect():
        got.setdefault(r["leaf_id"], []).append((r["slot"], r["key_id"]))
    for leaf in range(12):
        slots, keys = zip(*sorted(got[leaf]))
        assert slots == tuple(range(5)) and len(set(keys)) == 5
        assert not set(keys) & {(leaf + i) % 12 for i in range(1, 7)}
    # Where fewer are left, all of them come.
    assert random_edges_excluding(local, leaves, n_random=9, spare=2).count() == 12 * 6


def test_a_group_a_thousand_times_the_limit(spark):
    rows = spark.range(20_000).select(
        F.lit("g").alias("k"), F.when(F.col("id") < 9_000, 5.0).otherwise(F.rand(3)).alias("v"), F.col("id").cast("double").alias("t")
    )
    out = ranked(rows, ["k"], ["v", "t"], "n", hot_rows=20)
    plan = sorted((r["v"], r["t"], r["n"]) for r in out.collect())
    assert [n for _, _, n in plan] == list(range(1, 20_001))
