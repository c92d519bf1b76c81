"""The nearest-neighbour join against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointprep.plans import knn
from pointprep.plans.knn import knn_join


def brute(q, t, k, exclude=False):
    out = set()
    for case, qid, *qp in q:
        near = sorted(
            (sum((a - b) ** 2 for a, b in zip(qp, tp)), tid)
            for c, tid, *tp in t
            if c == case and not (exclude and tid == qid)
        )[:k]
        out |= {(case, qid, i + 1, tid) for i, (_, tid) in enumerate(near)}
    return out


def cloud(n, seed, cases=2, copies=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        case = "big" if i % 3 else f"c{i % cases}"
        scale = 0.01 if i % 2 else 50.0  # one dense spot in a wide space
        rows.append((case, i, *[float(v) for v in np.round(rng.normal(0, scale, 3), 4)]))
    rows += [("big", n + i, 7.0, 7.0, 7.0) for i in range(copies)]
    return rows


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"case_id string, {name} bigint, x double, y double, z double").repartition(3)


@pytest.mark.parametrize("k,block_rows,fanout,hot_rows", [
    (5, 256, 32, 10**6), (1, 256, 32, 30), (5, 8, 2, 10**6), (1, 8, 3, 30), (5, 1, 4, 40),
])
def test_equals_brute_force(spark, monkeypatch, hot, k, block_rows, fanout, hot_rows):
    monkeypatch.setattr(knn, "FANOUT", fanout)
    hot(hot_rows)
    q, t = cloud(60, 1), cloud(240, 2, copies=60)
    q += [("big", 900, 7.0, 7.0, 7.0), ("big", 901, 6.9, 7.0, 7.1), ("alone", 902, 0.0, 0.0, 0.0)]
    got = knn_join(frame(spark, q, "leaf_id"), frame(spark, t, "point_id"), k, block_rows=block_rows)
    assert {(r[0], r[1], r[2], r[3]) for r in got.collect()} == brute(q, t, k)


@pytest.mark.parametrize("block_rows", [256, 4])
def test_self_join_leaves_out_self_not_its_copies(spark, block_rows):
    rows = cloud(50, 3, copies=12)
    df = frame(spark, rows, "leaf_id")
    got = knn_join(df, df, 4, query_id="leaf_id", target_id="leaf_id", exclude_same_id=True, block_rows=block_rows)
    assert {(r[0], r[1], r[2], r[3]) for r in got.collect()} == brute(rows, rows, 4, exclude=True)


def test_payload_coordinates_and_order_do_not_matter(spark):
    q, t = cloud(30, 4), cloud(90, 5)
    a = knn_join(frame(spark, q, "leaf_id"), frame(spark, t, "point_id"), 3, payload=["x"], block_rows=8)
    b = knn_join(frame(spark, q[::-1], "leaf_id").repartition(7), frame(spark, t[::-1], "point_id"), 3, payload=["x"], block_rows=8)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    at = {(r[0], r[1]): r[2] for r in t}
    assert all(r["x"] == at[r["case_id"], r["point_id"]] for r in a.collect())


def test_no_cross_join_and_no_extra_shuffle_of_pairs(spark):
    big = spark.range(5000).select(
        F.lit("a").alias("case_id"), F.col("id").alias("point_id"), *[F.rand(i).alias(c) for i, c in enumerate("xyz")]
    )
    out = knn_join(big.withColumnRenamed("point_id", "leaf_id"), big, 4, block_rows=64)
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("k,n_targets,n_queries", [(1, 3_000, 20_000), (64, 40_000, 800)])
def test_few_of_all_pairs_are_formed(spark, monkeypatch, k, n_targets, n_queries):
    formed = []
    plain = knn.partitions_for
    monkeypatch.setattr(knn, "partitions_for", lambda s, rows: (formed.append(rows), plain(s, rows))[1])

    def uniform(n, name, seed):
        return knn.materialize(spark.range(n).select(
            F.lit("a").alias("case_id"), F.col("id").alias(name), *[F.rand(seed + i).alias(c) for i, c in enumerate("xyz")]
        ))

    out = knn_join(uniform(n_queries, "leaf_id", 1), uniform(n_targets, "point_id", 9), k)
    assert out.count() == k * n_queries
    assert sum(formed) < 0.05 * n_targets * n_queries


@pytest.mark.parametrize("k,block_rows,hot_rows", [(5, 4, 10**6), (1, 2, 40), (30, 16, 10**6)])
def test_trees_and_curves_of_larger_clouds_give_the_same(spark, hot, k, block_rows, hot_rows):
    """Both sides are parts of clouds that were put on their curves before."""
    from pointprep.plans.blocks import with_curve
    from pointprep.plans.knn import target_tree

    hot(hot_rows)
    q, t = cloud(120, 11), cloud(900, 12, copies=90)
    queries = with_curve(frame(spark, q, "leaf_id"), ["case_id"], "leaf_id", list("xyz")).filter("leaf_id % 3 <> 1")
    targets = with_curve(frame(spark, t, "point_id"), ["case_id"], "point_id", list("xyz")).filter("point_id % 4 <> 2")
    tree = target_tree(targets, ["case_id"], list("xyz"))
    got = knn_join(queries, targets, k, block_rows=block_rows, query_curve=True, tree=tree)
    want = brute([r for r in q if r[1] % 3 != 1], [r for r in t if r[1] % 4 != 2], k)
    assert {(r[0], r[1], r[2], r[3]) for r in got.collect()} == want


def grouped_rows(groups, size, seed):
    rng = np.random.default_rng(seed)
    # Coarse coordinates, so that many distances tie.
    return [(f"g{g}", g * 10_000 + i, *map(float, rng.integers(0, 6, 3))) for g in range(groups) for i in range(size + 40 * g)]


@pytest.mark.parametrize("exclude", [False, True])
@pytest.mark.parametrize("group_rows", [None, 400])
def test_groups_of_some_hundred_rows_write_no_blocks(spark, monkeypatch, exclude, group_rows):
    """Before, candidate pairs and wanted blocks of every query were written, whatever the groups' size."""
    written = []
    plain = knn.materialize
    monkeypatch.setattr(knn, "materialize", lambda df, label: (written.append(label), plain(df, label))[1])
    rows = grouped_rows(4, 300, 7)
    t = frame(spark, rows, "id")
    q = t if exclude else frame(spark, rows[::9], "id")
    got = knn_join(q, t, 3, query_id="id", target_id="id", neighbour_name="other", exclude_same_id=exclude, group_rows=group_rows,
                   payload=[] if exclude else ["x"])
    assert {(r[0], r[1], r[2], r[3]) for r in got.collect()} == brute(rows if exclude else rows[::9], rows, 3, exclude)
    # With a low limit the larger of the groups are searched as before.
    assert ("wanted" in written) == (group_rows is not None)


def test_null_keys_and_null_coordinates_in_small_groups(spark):
    rows = [("a", i, float(i), 0.0, 0.0) for i in range(300)] + [(None, 900, 0.0, 0.0, 0.0), (None, 901, 0.0, 0.0, 0.0), ("a", 902, None, 0.0, 0.0)]
    df = frame(spark, rows, "id")
    got = knn_join(df, df, 2, query_id="id", target_id="id", neighbour_name="other", exclude_same_id=True).collect()
    assert len(got) == 602 and all(r["case_id"] == "a" for r in got)
    assert all(r["other"] != 902 for r in got if r["id"] != 902)
