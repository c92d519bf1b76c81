import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointprep.operators import cluster, mesh
from pointprep.operators.binning import bin_allocation
from pointprep.plans.components import connected_components


def brute_dbscan(rows, eps, need):
    n = len(rows)
    near = [[j for j in range(n) if rows[i][0] == rows[j][0] and math.dist(rows[i][2:], rows[j][2:]) <= eps] for i in range(n)]
    core = {i for i in range(n) if len(near[i]) >= need}
    label = {}
    for i in sorted(core, key=lambda i: rows[i][1]):
        if i in label:
            continue
        todo, label[i] = [i], rows[i][1]
        while todo:
            for j in near[todo.pop()]:
                if j in core and j not in label:
                    label[j] = rows[i][1]
                    todo.append(j)
    out = {}
    for i in range(n):
        if i in core:
            out[rows[i][:2]] = (label[i], True)
        else:
            around = [label[j] for j in near[i] if j in core]
            out[rows[i][:2]] = (min(around) if around else None, False)
    return out


def blobs(seed):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for case in ("a", "b"):
        for cx, cy, n, s in ((0, 0, 40, 0.6), (12, 1, 15, 0.8), (5, 9, 60, 3.0), (30, 30, 25, 0.05)):
            for _ in range(n):
                rows.append((case, i, round(float(rng.normal(cx, s)), 3), round(float(rng.normal(cy, s)), 3)))
                i += 1
    return rows


@pytest.mark.parametrize("direct,hot_rows", [(65_536, 10**6), (0, 10**6), (65_536, 8)])
def test_dbscan_equals_brute_force(spark, monkeypatch, hot, direct, hot_rows):
    monkeypatch.setattr(cluster, "DIRECT_PAIRS", direct)
    hot(hot_rows)
    rows = blobs(3)
    df = spark.createDataFrame(rows, "case_id string, point_id bigint, x double, y double").repartition(3)
    got = {(r["case_id"], r["point_id"]): (r["label"], r["is_core"]) for r in cluster.dbscan(df, 1.5, 5).collect()}
    assert got == brute_dbscan(rows, 1.5, 5)


def test_two_blobs_three_strays_and_a_small_group(spark):
    rows = [("a", i, i * 0.01, 0.0) for i in range(12)] + [("a", 20 + i, 100 + i * 0.01, 0.0) for i in range(15)]
    rows += [("a", 50 + i, 500.0 * (i + 1), 900.0) for i in range(3)] + [("a", 60 + i, 300 + i * 0.01, 0.0) for i in range(9)]
    rows += [("b", 100, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "case_id string, point_id bigint, x double, y double")
    labels = cluster.dbscan(df, 5.0, 10)
    assert {tuple(r) for r in cluster.dbscan_count(labels, df).collect()} == {("a", 2), ("b", 0)}


def test_long_chain_is_one_component(spark):
    n = 300
    nodes = spark.range(n).select(F.lit("a").alias("case_id"), F.col("id").alias("node"))
    edges = spark.range(n - 1).select(F.lit("a").alias("case_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["label"] for r in connected_components(nodes, edges).collect()} == {0}


def test_kmeans_improves_and_keeps_counts(spark):
    rng = np.random.default_rng(1)
    rows = [("a", i % 2, i, *map(float, rng.normal(0, 5, 3))) for i in range(120)]
    p = spark.createDataFrame(rows, "case_id string, bin bigint, point_id bigint, x double, y double, z double")
    counts = p.groupBy("case_id", "bin").agg(F.count("*").alias("n"))
    alloc = bin_allocation(counts, 10)
    assert sum(r["alloc"] for r in alloc.collect()) == 10
    seeds = cluster.seed_centroids(p, alloc)
    one = cluster.lloyd_step(p, seeds)
    two = cluster.lloyd_step(p, one.select("case_id", "bin", "cluster", "x", "y", "z"))
    cost = [d.agg(F.sum("cost")).first()[0] for d in (one, two)]
    assert cost[1] <= cost[0] + 1e-9
    assert one.agg(F.sum("n")).first()[0] == 120
    out = cluster.binned_kmeans(p, alloc, max_iter=20)
    want = {(r["case_id"], r["bin"]): r["alloc"] for r in alloc.collect()}
    assert {(r[0], r[1]): r[2] for r in out.groupBy("case_id", "bin").count().collect()} == want
    # a further round moves nothing: the loop stopped at a fixed point
    again = cluster.lloyd_step(p, out.select("case_id", "bin", "cluster", "x", "y", "z"))
    assert again.agg(F.max("moved")).first()[0] <= 1e-2


CUBE = [(i, float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)]
TRIANGLES = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]


def cube(spark, size=1.0, at=(0.0, 0.0, 0.0)):
    v = spark.createDataFrame(
        [("a", i, *[c * size + o for c, o in zip(p, at)]) for i, *p in CUBE], "case_id string, vertex_id bigint, x double, y double, z double"
    )
    f = spark.createDataFrame([("a", i, *t) for i, t in enumerate(TRIANGLES)], "case_id string, face_id bigint, v0 bigint, v1 bigint, v2 bigint")
    return v, f


def test_cube_curvature(spark, hot):
    v, f = cube(spark)
    for rows in (10**6, 3):
        hot(rows)
        got = mesh.vertex_curvature(v, f).collect()
        assert len(got) == 8
        assert all(r["curv_gauss"] == pytest.approx(math.pi / 2) for r in got)
        assert sum(r["curv_gauss"] for r in got) == pytest.approx(4 * math.pi)
        # three unit edges bent by a right angle meet at a corner, all convex
        assert all(r["curv_mean"] == pytest.approx(0.5 * 3 * math.pi / 2) for r in got)


@pytest.mark.parametrize("cell", [0.5, 4.0, 64.0])
def test_ray_hits_box_and_misses_elsewhere(spark, cell):
    v, f = cube(spark, 10.0, (20.0, -5.0, -5.0))
    origin = spark.createDataFrame([("a", 1, 0.0, 0.1, 0.2)], "case_id string, leaf_id bigint, x double, y double, z double")
    got = {r["dir"]: r for r in mesh.ray_distance(origin, v, f, base_cell=cell).collect()}
    assert len(got) == 16
    assert got[0]["dist"] == pytest.approx(20.0) and got[0]["feature"] == pytest.approx(1 - math.exp(-0.4))
    assert got[8]["dist"] is None and got[8]["feature"] == 1.0
    vec = mesh.ray_vector(mesh.ray_distance(origin, v, f)).first()["pbd"]
    assert len(vec) == 16 and vec[8] == 1.0


@pytest.mark.parametrize("group_rows,cells", [(4_096, False), (145, True), (0, True)])
def test_dbscan_of_small_groups_writes_no_cells(spark, monkeypatch, group_rows, cells):
    """Before, cells, links and rounds of labels were written for groups of any size."""
    written = []
    plain = cluster.materialize
    monkeypatch.setattr(cluster, "materialize", lambda df, label: (written.append(label), plain(df, label))[1])
    rows = blobs(4) + [("c", 900 + i, *p) for i, (_, _, *p) in enumerate(blobs(5)[:150])]
    df = spark.createDataFrame([*rows, ("c", 1200, None, 0.0), ("a", 1201, float("nan"), 0.0)], "case_id string, point_id bigint, x double, y double").repartition(3)
    got = {(r["case_id"], r["point_id"]): (r["label"], r["is_core"]) for r in cluster.dbscan(df, 1.5, 5, group_rows=group_rows).collect()}
    assert got == brute_dbscan(rows, 1.5, 5) | {("c", 1200): (None, False), ("a", 1201): (None, False)}
    assert ("cells" in written) == cells


def test_rays_and_corners_are_dealt_by_their_number(spark, monkeypatch):
    """Before, a small file left all exploded rows to the one task that read it: corners were sorted there, rays sent to it whole."""
    from pointprep.plans import blocks

    monkeypatch.setattr(blocks, "TASK_ROWS", 8)
    v, f = cube(spark, 10.0, (20.0, -5.0, -5.0))
    corners = mesh._corners(f.coalesce(1), v.coalesce(1), "case_id", "face_id", "vertex_id")
    plan = corners._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "BroadcastHashJoin" not in plan
    assert "REPARTITION_BY_NUM" in plan
    origin = spark.createDataFrame([("a", i, 0.0, 0.1 * i, 0.2) for i in range(6)], "case_id string, leaf_id bigint, x double, y double, z double").coalesce(1)
    hits = [r for r in mesh.ray_distance(origin, v, f).collect() if r["dir"] == 0]
    assert len(hits) == 6 and all(r["dist"] == pytest.approx(20.0) for r in hits)
