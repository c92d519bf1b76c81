"""Selection by rank in two passes, and samples that read their input twice."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from pointprep.functions import scalar as S
from pointprep.operators import metrics, sampling
from pointprep.plans import select
from pointprep.plans.select import percentiles

WANTED = {"lo": ("v", 0.005), "mid": ("v", 0.5), "hi": ("v", 0.995), "least": ("w", 0.0), "most": ("w", 1.0), "odd": ("w", 0.123)}


def reads(df, path):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 2000)
    return df._jdf.queryExecution().executedPlan().toString().count(path)


@pytest.mark.parametrize("hot_rows,groups", [(10**6, 10**6), (50, 0)])
def test_small_groups_equal_the_builtin(spark, monkeypatch, hot_rows, groups):
    monkeypatch.setattr(select, "BROADCAST_ROWS", groups)
    rnd = random.Random(1)
    rows = [(None if i % 41 == 0 else i % 5, rnd.choice([1.5, rnd.gauss(0, 1)]), None if i % 7 == 0 else i * 0.1) for i in range(2000)]
    rows += [(9, None, 1.0), (8, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g int, v double, w double").repartition(4)
    got = {r["g"]: r for r in percentiles(df, ["g"], WANTED, hot_rows).collect()}
    want = {r["g"]: r for r in df.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile(c, p).alias(w) for w, (c, p) in WANTED.items()]).collect()}
    if groups:
        assert got == want
    else:  # a shuffled join leaves out null keys
        assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in want.items() if k is not None}


@pytest.mark.parametrize("shape", ["normal", "copies", "wide"])
def test_bounds_hold_and_few_rows_lie_between(spark, monkeypatch, shape):
    n = 120_000
    base = spark.range(n).select((F.col("id") % 3).alias("g"), F.randn(3).alias("v"), F.col("id").cast("double").alias("w"))
    if shape == "copies":
        base = base.withColumn("v", F.when(F.col("w") % 5 < 2, 0.25).otherwise(F.round("v", 2)))
    if shape == "wide":
        base = base.withColumn("v", F.signum("v") * F.exp(F.abs("v") * 150))
    df = select.materialize(base, "rows")
    met = []
    plain = select._selected
    monkeypatch.setattr(select, "_selected", lambda rows, *a: (met.append(rows), plain(rows, *a))[1])
    got = {r["g"]: r for r in percentiles(df, ["g"], WANTED, whole_rows=1000).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        for w, (c, p) in WANTED.items():
            assert got[g][w] == pytest.approx(np.percentile(part[c], p * 100), rel=1e-12, abs=1e-12), (g, w)
    between = met[0].filter("v >= __lo_mid and v <= __hi_mid").select("g", "v").distinct().count()
    assert between < 0.01 * n


def test_slices_read_their_points_twice(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "points_in")
    spark.range(5000).select(
        F.lit(1).alias("case_id"), F.rand(1).alias("a"), F.rand(2).alias("b"), (F.rand(3) * 20).alias("z")
    ).write.parquet(path)
    seen = []
    plain = select.materialize
    monkeypatch.setattr(select, "materialize", lambda df, label: (seen.append(reads(df, "points_in")), plain(df, label))[1])
    out = metrics.slice_stats(spark.read.parquet(path), {"f": ("a", "b"), "g": ("b", "a")})
    assert out.count() == 8 and seen == [1] and reads(out, "points_in") == 1


@pytest.mark.parametrize("whole_rows", [select.WHOLE_ROWS, 100])
def test_query_slots_read_their_points_twice_and_equal_windows(spark, tmp_path, monkeypatch, whole_rows):
    monkeypatch.setattr(select, "WHOLE_ROWS", whole_rows)
    path = str(tmp_path / "points_in")
    spark.range(9000).select(
        (F.col("id") % 7 % 3).alias("case_id"), F.col("id").alias("point_id"), (F.rand(5) < 0.3).alias("is_surface"), (F.rand(1) * 60 - 5).alias("sdf")
    ).write.parquet(path)
    points = spark.read.parquet(path)
    seen = []
    plain = sampling.materialize
    monkeypatch.setattr(sampling, "materialize", lambda df, label: (seen.append(reads(df, "points_in")), plain(df, label))[1])
    got = sampling.query_slots(points, S.log_sample_weight("sdf"), 60, epoch=2)
    assert seen == [1] and reads(got, "points_in") == 1
    volume = sampling.gumbel_topk(points.filter("not is_surface"), S.log_sample_weight("sdf"), 60, 2)
    surface = sampling.uniform_sample(points.filter("is_surface"), 60, 2, salt="surface")
    n_vol, n_surf = S.query_split("nv", "ns", 60)
    counts = points.groupBy("case_id").agg(F.count_if(~F.col("is_surface")).alias("nv"), F.count_if("is_surface").alias("ns"))
    counts = counts.select("case_id", n_vol.alias("qv"), n_surf.alias("qs"))
    want = {(r[0], r[1] - 1, r[2]) for r in volume.join(counts, "case_id").filter("rn <= qv").select("case_id", "rn", "point_id").collect()}
    want |= {(r[0], r[1] - 1, r[2]) for r in surface.join(counts, "case_id").filter("rn <= qs").select("case_id", F.col("rn") + F.col("qv"), "point_id").collect()}
    assert {(r["case_id"], r["slot"], r["point_id"]) for r in got.filter("valid").collect()} == want


def test_few_rows_pass_a_threshold(spark):
    n, need = 300_000, 40
    df = spark.range(n).select(F.rand(9).alias("u"))
    t = df.agg(select.threshold(F.percentile_approx("u", select.SHARES, select.ACCURACY), F.count(F.lit(1)), F.lit(need)).alias("t")).first()["t"]
    passed = df.filter(F.col("u") <= t).count()
    assert need <= passed < 8 * need + n * 4 / select.ACCURACY


def test_walls_do_not_meet_more_rays_for_being_tall(spark, monkeypatch):
    """10^5 narrow, tall triangles in rows: a ray meets the few in its way."""
    from pointprep.operators import mesh

    n = 50_000
    ids = spark.range(n)
    x, y = (F.col("id") % 250) * 2.0, F.floor(F.col("id") / 250) * 2.0
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(z).alias("z")) for i, (dx, z) in enumerate([(0.0, 0.0), (0.5, 0.0), (0.5, 120.0), (0.0, 120.0)])])).alias("c")
    vertices = ids.select("id", corners).select(
        F.lit(1).alias("case_id"), (F.col("id") * 4 + F.col("c.i")).alias("vertex_id"), (x + F.col("c.dx")).alias("x"), y.alias("y"), F.col("c.z").alias("z")
    )
    faces = ids.select("id", F.explode(F.array(F.struct(F.lit(0).alias("f"), F.lit(1).alias("b"), F.lit(2).alias("c")), F.struct(F.lit(1).alias("f"), F.lit(2).alias("b"), F.lit(3).alias("c")))).alias("t")).select(
        F.lit(1).alias("case_id"), (F.col("id") * 2 + F.col("t.f")).alias("face_id"), (F.col("id") * 4).alias("v0"), (F.col("id") * 4 + F.col("t.b")).alias("v1"), (F.col("id") * 4 + F.col("t.c")).alias("v2")
    )
    origins = spark.range(30).select(F.lit(1).alias("case_id"), F.col("id").alias("leaf_id"), (F.col("id") * 13.7 + 0.2).alias("x"), (F.col("id") * 11.3 + 0.9).alias("y"), F.lit(30.0).alias("z"))
    met = []
    plain = mesh.salted_join
    monkeypatch.setattr(mesh, "salted_join", lambda *a, **k: (met.append(plain(*a, **k)), met[-1])[1])
    out = mesh.ray_distance(origins, vertices, faces, n_directions=4)
    assert out.filter("dist is not null").count() > 10
    # Some 200 rows of walls stand in a ray's way, two triangles each, beside one cell's width on either side.
    assert met[-1].count() < 30 * 4 * 200 * 2 * 4
