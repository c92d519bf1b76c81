"""k-means with bounds against plain Lloyd rounds, and how many points search again."""

import numpy as np
from pyspark.sql import functions as F

from pointprep.operators import cluster


def plain(points, seeds, max_iter, tol):
    c = seeds.copy()
    for _ in range(max_iter):
        d = ((points[:, None, :] - c[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        new = np.array([points[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        moved = np.sqrt(((new - c) ** 2).sum(axis=1)).max()
        c = new
        if moved <= tol:
            break
    return c


def test_equals_plain_rounds_and_few_points_search(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.uniform(0, 100, (30, 3))
    rows = []
    for g, n in ((0, 3000), (1, 800)):
        xyz = centres[rng.integers(0, 30, n)] + rng.normal(0, 2, (n, 3))
        rows += [("c", g, g * 10_000 + i, *map(float, p)) for i, p in enumerate(xyz)]
    rows += [("c", 2, 90_000 + i, float(i), 0.0, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "case_id string, bin int, point_id bigint, x double, y double, z double").repartition(3)
    alloc = spark.createDataFrame([("c", 0, 3000, 30), ("c", 1, 800, 12), ("c", 2, 3, 3)], "case_id string, bin int, n bigint, alloc bigint")
    searched = []
    join = cluster.knn_join
    monkeypatch.setattr(cluster, "knn_join", lambda q, *a, **k: (searched.append(q.count()), join(q, *a, **k))[1])
    got = cluster.binned_kmeans(df, alloc, max_iter=25, tol=1e-6).collect()
    assert len(got) == 45
    seeds = cluster.seed_centroids(df, alloc).collect()
    for g in (0, 1):
        p = np.array([r[3:] for r in rows if r[1] == g])
        s = np.array([[r["x"], r["y"], r["z"]] for r in sorted((r for r in seeds if r["bin"] == g), key=lambda r: r["cluster"])])
        c = np.array([[r["x"], r["y"], r["z"]] for r in sorted((r for r in got if r["bin"] == g), key=lambda r: r["cluster"])])
        assert np.allclose(c, plain(p, s, 25, 1e-6), atol=1e-9)
    # All points search once, later ones only while they lie between two centroids.
    assert searched[0] == 3800 and len(searched) >= 5
    assert sum(searched[1:]) < 0.35 * 3800 * (len(searched) - 1)


def test_points_on_a_curve_of_their_case(spark):
    from pointprep.plans.blocks import with_curve

    df = spark.range(4000).select(
        F.lit("c").alias("case_id"), (F.col("id") % 3).cast("int").alias("bin"), F.col("id").alias("point_id"), *[(F.rand(i) * 50).alias(c) for i, c in enumerate("xyz")]
    )
    df = cluster.materialize(df, "points")
    alloc = df.groupBy("case_id", "bin").agg(F.count("*").alias("n"), F.lit(300).cast("bigint").alias("alloc"))
    a = cluster.binned_kmeans(df, alloc, max_iter=3)
    b = cluster.binned_kmeans(with_curve(df, ["case_id"], "point_id", list("xyz")), alloc, max_iter=3, on_curve=True)
    rounded = lambda d: sorted((r["bin"], r["cluster"], *(round(r[c], 9) for c in "xyz")) for r in d.collect())
    assert rounded(a) == rounded(b)


def test_small_cases_need_no_rounds_of_jobs(spark, monkeypatch):
    """Before, every round searched and wrote anew, whatever the size of the cases."""
    searched = []
    join = cluster.knn_join
    monkeypatch.setattr(cluster, "knn_join", lambda q, *a, **k: (searched.append(1), join(q, *a, **k))[1])
    rows = spark.range(900).select(
        F.when(F.col("id") < 600, "a").otherwise("b").alias("case_id"), (F.col("id") % 2).cast("int").alias("bin"), F.col("id").alias("point_id"),
        *[(F.rand(i) * 50).alias(c) for i, c in enumerate("xyz")],
    )
    rows = cluster.materialize(rows, "points")
    alloc = rows.groupBy("case_id", "bin").agg(F.count("*").alias("n"), F.lit(7).cast("bigint").alias("alloc"))
    rounded = lambda d: sorted((r["case_id"], r["bin"], r["cluster"], *(round(r[c], 9) for c in "xyz")) for r in d.collect())
    whole = rounded(cluster.binned_kmeans(rows, alloc, max_iter=3))
    assert not searched and len(whole) == 28
    monkeypatch.setattr(cluster, "KMEANS_ROWS", 400)
    assert rounded(cluster.binned_kmeans(rows, alloc, max_iter=3)) == whole
    assert searched
