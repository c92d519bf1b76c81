"""Fixed inputs with known results."""

import math

import pytest
from pyspark.sql import functions as F

from pointprep.functions import scalar as S
from pointprep.operators import batching, binning, metrics, outliers, sampling, stats, strata


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_bins(spark):
    got = column(spark, [-5.0, 0.0, 6.25, 371.875, 1099.9, 1100.0, float("nan"), None], S.sdf_bin("v"))
    assert got == [0, 0, 1, 14, 14, None, None, None]
    assert S.sdf_bin_edges()[:3] == [6.25, 15.625, 28.125] and len(S.sdf_bin_edges()) == 14


def test_weights(spark):
    got = column(spark, [-4.0, -1.0, 0.0, 1.5, 2.0, 5.0, 50.0, 80.0, 1000.0], S.sample_weight("v"))
    assert got == pytest.approx([0.05, 6, 6, 8, 8, 6, 3, 0.5, 0.1])


def test_range_labels(spark):
    got = column(spark, [0.0, 19.0, 20.0, 59.0, 79.0, 80.0, 500.0], S.range_label(F.col("v")))
    assert got == ["0-19", "0-19", "20-39", "40-59", "60-79", "80-123", "80-123"]


def allocate(spark, counts, slots):
    rows = [("a", b, n) for b, n in enumerate(counts) if n]
    out = binning.bin_allocation(spark.createDataFrame(rows, "case_id string, bin bigint, n bigint"), slots).collect()
    return {r["bin"]: r["alloc"] for r in out}, {r["feasible"] for r in out}


@pytest.mark.parametrize("counts,slots", [
    ([1000, 500, 20, 1], 40), ([5, 5, 5, 5, 5], 23), ([10**6] + [1] * 14, 16), ([3] * 15, 15), ([1, 0, 0, 900], 7),
])
def test_allocation_adds_up(spark, counts, slots):
    alloc, feasible = allocate(spark, counts, slots)
    assert sum(alloc.values()) == slots and min(alloc.values()) >= 1 and feasible == {True}


def test_allocation_infeasible_is_reported(spark):
    alloc, feasible = allocate(spark, [10] * 6, 4)
    assert feasible == {False} and set(alloc.values()) == {1}


def mad(spark, rows, names):
    df = spark.createDataFrame(rows, "case_id string, " + ", ".join(f"{n} double" for n in names))
    return {r["case_id"]: r for r in outliers.mad_outliers(outliers.mad_scores(df, names)).collect()}


def test_constant_indicator_with_one_stray(spark):
    got = mad(spark, [(f"c{i}", 1.0) for i in range(10)] + [("odd", 1.0 + 1e-6)], ["u_mean"])
    assert got["odd"]["rule"] == "extreme_single" and got["c0"]["rule"] == "normal"


def test_two_fields_are_needed_between_five_and_eight(spark):
    base = [(f"c{i}", float(i), float(i), float(i)) for i in range(-10, 11)]
    step = 1.4826 * 39.0  # six to eight scaled deviations out
    got = mad(spark, base + [("two", step, 0.0, step), ("one", step, step, 0.0)], ["u_mean", "u_std", "w_mean"])
    assert got["two"]["rule"] == "concordance_2" and got["two"]["n_fields"] == 2
    assert got["one"]["rule"] == "normal" and got["one"]["n_fields"] == 1
    assert [h["indicator"] for h in got["two"]["hits"]] == ["u_mean", "w_mean"]


def test_nan_does_not_disable_an_indicator(spark):
    rows = [(f"c{i}", float(i)) for i in range(20)] + [("nan", float("nan")), ("far", 1e6)]
    got = mad(spark, rows, ["u_mean"])
    assert got["far"]["is_anomaly"] and not got["nan"]["is_anomaly"]


@pytest.mark.parametrize("n,easy", [(1, 0), (2, 1), (3, 1)])
def test_half_split(spark, n, easy):
    df = spark.createDataFrame([(i, 100 + i, 10) for i in range(n)], "case_id bigint, n_volume bigint, n_buildings bigint")
    assert strata.add_strata(df).filter("sub_bin = '0-19_easy'").count() == easy


def test_split_shortage(spark):
    sizes = {"s60": 60, "s72": 72, "s80": 80, "s100": 100}
    df = spark.createDataFrame([(1000 * j + i, s) for j, (s, n) in enumerate(sizes.items()) for i in range(n)], "case_id bigint, sub_bin string")
    got = {(r[0], r[1]): r[2] for r in strata.stratified_split(df).groupBy("sub_bin", "split").count().collect()}
    want = {"s60": (60, 0, 0), "s72": (70, 2, 0), "s80": (70, 5, 5), "s100": (70, 5, 5)}
    for s, counts in want.items():
        assert tuple(got.get((s, k), 0) for k in ("train", "val", "test")) == counts
    report = {r["sub_bin"]: r for r in strata.undersupplied(df, 70, 5, 5, strata=tuple(sizes)).collect()}
    assert set(report) == {"s60", "s72"} and report["s72"]["got_val"] == 2 and report["s72"]["got_test"] == 0


def test_curriculum(spark):
    df = spark.createDataFrame([(s, i) for s in S.STRATA for i in range(70)], "sub_bin string, case_id bigint")
    got = {r["sub_bin"]: r["n_take"] for r in sampling.curriculum_counts(df, 0, 400).collect()}
    assert got["0-19_easy"] == 70 and got["80-123_hard"] == 21


def test_batches_pad_with_first(spark):
    df = spark.createDataFrame([(0, "0-19_easy", i) for i in range(5)], "shard bigint, sub_bin string, case_id bigint")
    rows = batching.batches(df, 1).orderBy("batch", "pos").collect()
    assert len(rows) == 8 and {r["batch"] for r in rows} == {0, 1}
    second = [r["case_id"] for r in rows if r["batch"] == 1]
    assert second[1:] == [rows[0]["case_id"]] * 3
    assert sorted({r["case_id"] for r in rows}) == list(range(5))


def test_relative_error_of_zero_target(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 1.0, 0.0)], "case_id string, pred double, target double")
    assert math.isfinite(metrics.rel_l2(df, ["case_id"]).first()["rel_l2"])


def test_slices_need_ten_points(spark, hot):
    rows = [("a", 1.5, float(i), float(i) + 1) for i in range(9)] + [("a", 5.0, 2.0, 2.0) for _ in range(10)]
    df = spark.createDataFrame(rows, "case_id string, z double, t double, q double")
    for limit in (10**6, 3):
        got = metrics.slice_stats(df, {"f": ("t", "q")}, hot_rows=limit).collect()
        assert [(r["height"], r["n"], r["vmin"], r["vmax"], r["emax"]) for r in got] == [(5.0, 10, 1.5, 2.5, 1.0)]


def test_query_split_is_clamped(spark):
    df = spark.createDataFrame([(10, 5), (1000, 0), (0, 50)], "nv bigint, ns bigint")
    vol, surf = S.query_split("nv", "ns", 100)
    assert [tuple(r) for r in df.select(vol, surf).collect()] == [(10, 5), (100, 0), (0, 50)]


def test_zscore_and_back_is_identity(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(50)], "a double, b double")
    look = stats.stats_lookup(stats.norm_stats(df, {"a": "a", "b": "b"}))
    assert look["b"] == (7.0, 0.0)
    back = stats.denormalize(stats.zscore_apply(df, look), look)
    assert [r["a"] for r in back.collect()] == pytest.approx([float(i) for i in range(50)])


def test_masked_mse_counts_slots(spark):
    rows = [("a", 1.0, 0.0, False, True)] * 2 + [("a", 3.0, 0.0, True, True), ("a", 9.0, 0.0, True, False)]
    df = spark.createDataFrame(rows, "case_id string, pred double, target double, s boolean, v boolean")
    got = metrics.masked_mse(df, ["case_id"], F.col("s"), F.col("v"), volume_channels=5).first()
    assert got["vol_mse"] == pytest.approx(2 / 5) and got["surf_mse"] == pytest.approx(9.0)
