"""Features made anew only where something changed, and rows laid out as batches."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pointprep.operators import batching
from pointprep.sources import files


def test_only_changed_cases_are_made_anew(spark, tmp_path):
    path = str(tmp_path / "store")
    made = []

    def make(rows):
        out = rows.groupBy("case_id").agg(F.sum("v").alias("total"))
        made.append({r["case_id"] for r in out.select("case_id").collect()})
        return out

    def table(rows):
        return spark.createDataFrame(rows, "case_id int, id int, v double, w string").repartition(3)

    first = [(c, i, float(i), None) for c in range(5) for i in range(3)]
    a = files.reuse_unchanged(spark, path, table(first), {"k": 1}, make)
    assert {tuple(r) for r in a.select("case_id", "total", "generation").collect()} == {(c, 3.0, 1) for c in range(5)}
    # Nothing changed, whatever the order: nothing is computed.
    files.reuse_unchanged(spark, path, table(first[::-1]), {"k": 1}, make)
    assert made == [{0, 1, 2, 3, 4}]
    # A value, a repeated row, a new case, a null for a value; a case that is gone.
    second = [r for r in first if r[0] != 4] + [(1, 2, 2.0, None), (7, 0, 1.0, "x")]
    second[0] = (0, 0, 10.0, None)
    second[6] = (2, 0, 0.0, "y")
    b = files.reuse_unchanged(spark, path, table(second), {"k": 1}, make)
    assert made[1] == {0, 1, 2, 7}
    got = {r["case_id"]: (r["total"], r["generation"]) for r in b.collect()}
    assert got == {0: (13.0, 2), 1: (5.0, 2), 2: (3.0, 2), 3: (3.0, 1), 7: (1.0, 2)}
    # Other parameters change every case.
    files.reuse_unchanged(spark, path, table(second), {"k": 2}, make)
    assert made[2] == {0, 1, 2, 3, 7}


def test_a_job_that_dies_leaves_the_state_before(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, 1.0), (2, 2.0)], "case_id int, v double")
    files.reuse_unchanged(spark, path, rows, {}, lambda r: r)

    def dies(r):
        raise RuntimeError("lost")

    try:
        files.reuse_unchanged(spark, path, rows.withColumn("v", F.col("v") * 2), {}, dies)
    except RuntimeError:
        pass
    again = files.reuse_unchanged(spark, path, rows.withColumn("v", F.col("v") * 2), {}, lambda r: r)
    assert {tuple(r) for r in again.select("case_id", "v", "generation").collect()} == {(1, 2.0, 2), (2, 4.0, 2)}


def test_a_batch_is_one_run_of_rows(spark, tmp_path):
    cases = spark.range(40).select(F.col("id").alias("case_id"), F.when(F.col("id") % 3 == 0, "0-19_easy").otherwise("60-79_hard").alias("sub_bin"))
    placed = batching.batches(batching.shards(cases, 2).select("shard", "sub_bin", "case_id"), epoch=1)
    slots = spark.range(40 * 25).select((F.col("id") % 40).alias("case_id"), F.floor(F.col("id") / 40).alias("slot"), (F.col("id") * 7).alias("point_id"))
    path = tmp_path / "batches"
    files.write_batches(batching.collate_rows(placed, slots), str(path), files_per_shard=3)
    parts = [pq.read_table(p).select(["shard", "seq", "pos", "slot"]).to_pylist() for p in sorted(path.glob("part-*"))]
    rows = [tuple(r.values()) for part in parts for r in part]
    assert len(parts) > 3 and rows == sorted(rows)
    assert len(rows) == placed.count() * 25
    one = files.read_batch(spark, str(path), 1, 2)
    want = placed.filter("shard = 1 and seq = 2").count() * 25
    assert one.count() == want and "PushedFilters" in one._jdf.queryExecution().toString()
