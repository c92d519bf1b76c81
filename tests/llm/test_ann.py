import numpy as np
from pyspark.sql import functions as F

from pointprep.llm import ann

SF = "/root/testdata/sf0.001"


def brute(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, x in rows:
        if q % 100 == 0:
            found = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in rows if i != q)
            out[q] = found[:k]
    return out


def test_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in table.collect()], 10)
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q, found in got.items():
        exact = {i: d for d, i in brute([(r, v) for r, v in [(x["vec_id"], x["embedding"]) for x in table.collect()]], 10**6)[q]} if q == 0 else None
        assert found == sorted(found) and len(found) == 10
        if exact:
            assert all(abs(exact[i] - d) < 1e-12 for d, i in found)


def test_odd_vectors_ties_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [1.0]), (100, [1.0, 0.25]), (200, None), (9, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x"))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100), (0, 2, 1), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest(table.filter("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_copies_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_CHUNK", 2)
    monkeypatch.setattr(ann, "ROW_BLOCK", 7)
    rows = [(i, [0.6, 0.8, 0.0]) for i in range(450)] + [(i, [float(i), 1.0, 2.0]) for i in range(450, 460)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {0, 100, 200, 300, 400}
    assert got[0] == list(range(1, 11)) and got[100] == list(range(10))
