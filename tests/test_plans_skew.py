"""Ranks, percentiles and joins whose groups are treated as heavy."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from pointprep.plans.salt import salted_join
from pointprep.plans.skew import exact_percentiles, ranked


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = []
    for i in range(3000):
        g = "hot" if i % 3 else f"g{i % 7}"
        # a third of the heavy group shares one value
        v = 1.5 if rnd.random() < 0.34 else round(rnd.expovariate(0.1), 3)
        data.append((g, v, i))
    return spark.createDataFrame(data, "g string, v double, id bigint").repartition(5).cache()


def as_set(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("limit", [None, 1, 40, 900])
def test_rank_equals_plain_window(rows, limit):
    plain = rows.withColumn("rn", F.row_number().over(W.partitionBy("g").orderBy("v", "id")).cast("bigint"))
    if limit:
        plain = plain.filter(F.col("rn") <= limit)
    got = ranked(rows, ["g"], ["v", "id"], limit=limit, hot_rows=50)
    assert as_set(got.select("g", "v", "id", "rn")) == as_set(plain.select("g", "v", "id", "rn"))


def test_rank_limit_by_column(rows):
    sized = rows.withColumn("k", F.when(F.col("g") == "hot", 700).otherwise(2))
    counts = {r["g"]: r["count"] for r in ranked(sized, ["g"], ["v", "id"], limit="k", hot_rows=50).groupBy("g").count().collect()}
    assert counts.pop("hot") == 700
    assert set(counts.values()) == {2}


def test_hot_window_is_cut(rows):
    plan = ranked(rows, ["g"], ["v", "id"], hot_rows=50)._jdf.queryExecution().toString()
    assert "__b0" in plan and "__b1" in plan


@pytest.mark.parametrize("hot_rows", [10, 100, 10**6])
def test_percentiles_equal_numpy(rows, hot_rows):
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.995, "e": 1.0}
    got = {r["g"]: r for r in exact_percentiles(rows, ["g"], "v", probs, hot_rows).collect()}
    pdf = rows.toPandas()
    for g, part in pdf.groupby("g"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.percentile(part["v"], p * 100), abs=1e-9)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, rows, how):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("g1", 3)], "g string, w bigint")
    want = rows.join(right, "g", how)
    got = salted_join(rows, right, ["g"], ["id"], how, hot_rows=50)
    assert as_set(got.select("g", "v", "id", "w").fillna(-1)) == as_set(want.select("g", "v", "id", "w").fillna(-1))


@pytest.mark.parametrize("values", [
    [2**60 + 1] * 300,
    [2**60 + i % 64 for i in range(3000)],
    [None] * 250 + [2**60 + 1] * 250 + [-(2**62)],
], ids=["equal", "within 64", "nulls"])
def test_integers_beyond_doubles(spark, values):
    rows = spark.createDataFrame([("g", v, i) for i, v in enumerate(values)], "g string, v bigint, id bigint").repartition(3)
    got = {r["id"]: r["rn"] for r in ranked(rows, ["g"], ["v", "id"], hot_rows=30).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert got == {i: n + 1 for n, i in enumerate(order)}


def test_copies_of_one_large_number_a_hundred_times_the_limit(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("g"), F.lit(2**60 + 3).alias("v"), "id")
    got = ranked(rows, ["g"], ["v", "id"], hot_rows=200)
    assert got.filter(F.col("rn") != F.col("id") + 1).isEmpty() and got.count() == 20_000
