"""Sampling, determinism, sinks, streams and plans."""

import json

import pytest
from pyspark.sql import functions as F

from pointprep.functions import scalar as S
from pointprep.functions.rng import uniform
from pointprep.operators import quality, sampling, stats, strata
from pointprep.registry import QUERIES
from pointprep.registry.fixtures import points
from pointprep.sources import files, tables
from pointprep.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_uniform_is_inside_and_layout_free(spark):
    df = spark.range(5000).withColumn("u", uniform("s", 3, F.col("id")))
    a = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.countDistinct("u")).first()
    assert 0 < a[0] and a[1] < 1 and a[2] == pytest.approx(0.5, abs=0.02) and a[3] == 5000
    b = spark.range(5000).repartition(7).withColumn("u", uniform("s", 3, F.col("id")))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, b.collect()))


def test_gumbel_sample(spark):
    n = 400
    df = spark.range(n).select(F.lit("a").alias("case_id"), F.col("id").alias("point_id"), F.when(F.col("id") < 200, 9.0).otherwise(1.0).alias("w"))
    heavy = 0
    for epoch in range(4):
        got = sampling.gumbel_topk(df, F.log("w"), 100, epoch).collect()
        ids = [r["point_id"] for r in got]
        assert len(ids) == len(set(ids)) == 100
        heavy += sum(i < 200 for i in ids)
    assert heavy > 4 * 70
    again = sampling.gumbel_topk(df.repartition(6), F.log("w"), 100, 3, hot_rows=30).collect()
    assert sorted((r["point_id"], r["rn"]) for r in again) == sorted((r["point_id"], r["rn"]) for r in got)


def test_query_slots_fill_every_slot(spark):
    out = sampling.query_slots(points(spark, SF), S.log_sample_weight("sdf"), 60, hot_rows=20)
    per_case = out.groupBy("case_id").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert {(r["n"], r["d"], r["m"]) for r in per_case} == {(60, 60, 59)}
    real = out.filter("valid")
    assert real.count() == real.select("point_id").distinct().count()


def test_manifest_round_trip(spark, tmp_path):
    rows = [(i, "0-19_easy", 3, 10, 5, "train" if i % 2 else "val") for i in range(6)]
    df = spark.createDataFrame(rows, "case_id bigint, sub_bin string, n_buildings bigint, n_volume bigint, n_surface bigint, split string")
    files.write_manifest(df, str(tmp_path / "m"), summary=strata.size_summary(df, ["n_volume"]))
    back = files.read_manifest(spark, str(tmp_path / "m"))
    assert {(r["case_name"], r["split"]) for r in back.collect()} == {(str(r[0]), r[5]) for r in rows}


def test_manifest_document_takes_objects_and_names(spark, tmp_path):
    doc = {"splits": {"train": [{"case_name": "a", "sub_bin": "0-19_hard", "n_volume": 4}, "b"], "test": ["c"]}, "seed": 1}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(doc, indent=1))
    got = {tuple(r) for r in files.read_manifest_document(spark, str(path)).select("case_name", "sub_bin", "n_volume", "split").collect()}
    assert got == {("a", "0-19_hard", 4, "train"), ("b", "unknown", None, "train"), ("c", "unknown", None, "test")}


def test_norm_stats_document(spark, tmp_path):
    df = spark.createDataFrame([("vol", c, 1.5 * c, 2.0 + c) for c in range(5)] + [("pt_sdf", 0, -3.25, 0.1)], "feature string, channel bigint, mean double, std double")
    scales = spark.createDataFrame([("0-19_easy", a, i + 0.5) for i, a in enumerate("xyz")], "sub_bin string, axis string, scale double")
    files.write_norm_stats(df, str(tmp_path / "n"), scales)
    text = json.loads(next((tmp_path / "n").glob("part-*")).read_text())
    assert text["pt_sdf_mean"] == -3.25 and text["vol_std"] == [2.0, 3.0, 4.0, 5.0, 6.0]
    assert text["rope_scales"] == {"0-19_easy": [0.5, 1.5, 2.5]}
    back = files.read_norm_stats(spark, str(tmp_path / "n"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, files.read_axis_scales(spark, str(tmp_path / "n")).collect())) == sorted(map(tuple, scales.collect()))


def test_channel_names_become_groups(spark):
    df = spark.createDataFrame([("vol_3", 1.0), ("pt_sdf", 2.0), ("other", 3.0)], "channel string, mean double")
    got = {tuple(r) for r in files.split_channels(df).collect()}
    assert got == {("vol", 3, 1.0), ("pt_sdf", 0, 2.0)}


def test_prepared_sink_replaces_only_its_splits(spark, tmp_path):
    path = str(tmp_path / "c")
    files.write_prepared(spark.createDataFrame([(1, "train"), (2, "val")], "id int, split string"), path)
    files.write_prepared(spark.createDataFrame([(3, "val")], "id int, split string"), path)
    assert {tuple(r) for r in spark.read.parquet(path).select("id", "split").collect()} == {(1, "train"), (3, "val")}


def test_metrics_leave_out_working_columns(spark, tmp_path):
    files.write_metrics(spark.createDataFrame([("a", 0.5, 9)], "case_id string, m double, _raw int"), str(tmp_path / "j"))
    assert files.read_metrics(spark, str(tmp_path / "j"), "case_id string, m double, _raw int").first()["_raw"] is None


def test_reuse_or_compute(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.reuse_or_compute(spark, str(tmp_path / "f"), compute).count() == 3
    assert len(calls) == 1


def test_contract(spark):
    df = spark.createDataFrame([(1, 2.0)], "leaf_stats int, original_sdf_volume double")
    got = {(r["check"], r["item"], r["level"]) for r in quality.contract_issues(df, ["leaf_stats", "leaf_sdf"]).collect()}
    assert got == {("missing_column", "leaf_sdf", "failure"), ("leftover_column", "original_sdf_volume", "warning")}
    status = quality.dq_status(quality.contract_issues(df, ["leaf_stats", "leaf_sdf"])).first()
    assert (status["failures"], status["warnings"], status["status"]) == (1, 1, 1)


def test_union_and_default(spark):
    v = spark.createDataFrame([(1, 2.0)], "id int, ux double")
    s = spark.createDataFrame([(2, 3.0)], "id int, area double")
    u = tables.with_default(tables.union_points(v, s), "area", 1.0)
    assert {(r["id"], r["is_surface"], r["area"]) for r in u.collect()} == {(1, False, 1.0), (2, True, 3.0)}


def test_corrupt_file_is_skipped_only_on_request(spark, tmp_path):
    folder = tmp_path / "t"
    spark.createDataFrame([("a", 1)], "case_id string, v int").write.parquet(str(folder))
    (folder / "bad.parquet").write_bytes(b"no parquet")
    schema = spark.createDataFrame([], "case_id string, v int").schema
    assert tables.scan_cases(spark, str(folder), schema, skip_corrupt=True).count() == 1
    with pytest.raises(Exception):
        tables.scan_cases(spark, str(folder), schema).count()


def test_stream_equals_batch_over_several_arrivals(spark, tmp_path):
    folder = str(tmp_path / "in")
    p = points(spark, SF).repartition(5)
    p.write.parquet(folder)
    stream = incremental.case_stream(spark, folder, p.schema, files_per_trigger=1)
    got = incremental.run_updates(incremental.case_stats(stream), spark, "case_id")
    want = stats.case_stats(points(spark, SF))
    a = {r["case_id"]: r for r in got.collect()}
    for r in want.collect():
        for c in want.columns:
            assert a[r["case_id"]][c] == pytest.approx(r[c])
    norm = incremental.run_complete(incremental.norm_stats(incremental.case_stream(spark, folder, p.schema, files_per_trigger=2), {"ux": "ux"}), spark)
    assert norm.first()["mean"] == pytest.approx(p.agg(F.avg("ux")).first()[0])


def plan(df):
    return df._jdf.queryExecution().toString()


def test_top_k_limits_before_the_shuffle(spark):
    text = plan(QUERIES["gumbel_topk"](spark, SF))
    assert text.count("WindowGroupLimit") >= 2


def test_scan_is_pruned_and_filter_pushed(spark):
    text = plan(points(spark, SF).filter("point_id > 5").select("case_id", "x"))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in text
    assert "GreaterThan(event_id,5)" in text


@pytest.mark.parametrize("name", ["knn_points", "nearest_centroid", "slice_stats", "ray_distance", "zscore_apply", "curvature", "oversample_fill"])
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
