"""The three jobs end to end on a small synthetic city."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointprep.operators import neighbours, quality
from pointprep.plans import workflows
from pointprep.schema import FEATURE_GROUPS
from pointprep.sources.files import split_channels

TRIANGLES = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]


@pytest.fixture(scope="module")
def city(spark):
    rng = np.random.default_rng(0)
    points, vertices, faces, centers = [], [], [], []
    for c in range(6):
        case = f"case{c}"
        for i in range(80):
            surface = i % 4 == 0
            x, y, z = (float(v) for v in np.round(rng.uniform(0, 60, 3), 3))
            f = [float(v) for v in rng.normal(1 + (100 if c == 5 else 0), 1, 8)]
            sdf = None if surface else -float(np.round(rng.uniform(0, 40), 3))
            grad = [None] * 3 if surface else [float(v) for v in rng.normal(0, 1, 3)]
            points.append((case, i, surface, x, y, z, sdf, *grad, *f, 2.0 if surface else None))
        for b in range(2):
            for v in range(8):
                vertices.append((case, b * 8 + v, 20.0 + 30 * b + 5 * (v & 1), 20.0 + 5 * (v >> 1 & 1), 30.0 * (v >> 2 & 1)))
            for i, t in enumerate(TRIANGLES):
                faces.append((case, b * 12 + i, *[b * 8 + v for v in t]))
                centers.append((case, b * 12 + i, 20.0 + 30 * b + i * 0.1, 20.0, 10.0))
    fields = "ux double, uy double, uz double, p double, nut double, wss_x double, wss_y double, wss_z double"
    return (
        spark.createDataFrame(points, f"case_id string, point_id bigint, is_surface boolean, x double, y double, z double, sdf double, gx double, gy double, gz double, {fields}, area double"),
        spark.createDataFrame(vertices, "case_id string, vertex_id bigint, x double, y double, z double"),
        spark.createDataFrame(faces, "case_id string, face_id bigint, v0 bigint, v1 bigint, v2 bigint"),
        spark.createDataFrame(centers, "case_id string, face_id bigint, x double, y double, z double"),
    )


def test_curate_featurise_sample_evaluate(spark, city):
    points, vertices, faces, centers = city
    numbered = points.withColumn("case_id", F.regexp_extract("case_id", "([0-9]+)", 1).cast("bigint"))
    tables = [d.withColumn("case_id", F.regexp_extract("case_id", "([0-9]+)", 1).cast("bigint")) for d in (vertices, faces, centers)]
    manifest, strata, verdicts, dropped = workflows.curate(numbered, tables[2], n_train=2, n_val=1, n_test=1)
    assert {r["case_id"] for r in verdicts.filter("is_anomaly").collect()} == {5}
    assert {r["n_buildings"] for r in strata.collect()} == {2}
    assert [tuple(r) for r in dropped.collect()] == [(5, "anomaly", "concordance_2", 80)]
    assert manifest.count() == 5 and {r["sub_bin"] for r in manifest.collect()} == {"0-19_easy", "0-19_hard"}

    out = workflows.featurise(
        numbered, tables[0], tables[1], manifest, k_points=8, k_leaves=4, slots=F.lit(12), max_iter=3, n_query=40
    )
    leaves = out.leaves.collect()
    per_case = {}
    for r in leaves:
        per_case.setdefault(r["case_id"], set()).add(r["leaf_id"])
        assert len(r["aggregate"]) == 46 and all(v is not None for v in r["aggregate"])
    assert set(map(frozenset, per_case.values())) == {frozenset(range(12))} and len(per_case) == 5
    assert out.points.count() == 400 and out.points.filter("leaf_id is null or sdf is null").count() == 0
    assert out.leaf_points.groupBy("case_id", "leaf_id").count().select("count").distinct().collect()[0][0] == 8
    groups = {r["feature"]: r["n"] for r in split_channels(out.norm_stats).groupBy("feature").agg(F.count("*").alias("n")).collect()}
    assert groups == FEATURE_GROUPS
    assert out.axis_scales.count() == 30
    assert {len(r["pool"]) for r in out.pools.collect()} == {8}
    # surface rows have distance zero before standardising, so they share one value
    assert out.points.filter("is_surface").select("sdf").distinct().count() == 1
    odd = quality.zscore_sanity(out.points.withColumn("case_id", F.lit(0)), ["sdf", "gx", "y_ux"]).filter("odd")
    assert odd.count() == 0

    queries = workflows.draw_queries(out, 60, epoch=1)
    assert queries.groupBy("case_id").count().select("count").distinct().collect()[0][0] == 60
    weights = neighbours.idw_weights(
        out.points.select("case_id", "point_id", "leaf_id", "x", "y", "z"), out.leaf_leaves, out.leaves.select("case_id", "leaf_id", "x", "y", "z"), 3
    )
    assert quality.idw_check(weights).first()["n_off"] == 0

    exact = out.points.filter("not is_surface").select(
        "case_id", "point_id", F.lit("vol_3").alias("channel"), F.col("y_p_train").alias("pred_z"), F.col("y_p_train").alias("target_z")
    )
    physical, errors, summary, median = workflows.evaluate(exact, numbered, out.norm_stats, {"vol_3": "p_vol"})
    joined = physical.join(numbered.select("case_id", "point_id", "p"), ["case_id", "point_id"])
    assert joined.agg(F.max(F.abs(F.col("pred") - F.col("p")))).first()[0] < 1e-9
    assert errors.agg(F.max("rel_l2")).first()[0] == 0.0
    assert median.count() == 1 and {r["metric"] for r in summary.collect()} == {"p_vol", "overall"}


def test_no_case_is_lost_in_silence(spark, city):
    points, vertices, faces, _ = city
    number = lambda d: d.withColumn("case_id", F.regexp_extract("case_id", "([0-9]+)", 1).cast("bigint"))
    points, vertices, faces = number(points), number(vertices), number(faces)
    far = (F.col("case_id") == 3) & (F.col("point_id") % 4 == 1)
    points = points.filter("case_id != 1 or is_surface").withColumn("sdf", F.when(far, -2000.0).otherwise(F.col("sdf")))
    manifest = spark.createDataFrame([(c, "0-19_easy", "train") for c in (0, 1, 2, 3, 9)], "case_id bigint, sub_bin string, split string")
    out = workflows.featurise(
        points, vertices.filter("case_id != 2"), faces.filter("case_id != 2"), manifest, k_points=4, k_leaves=2, slots=F.lit(8), max_iter=2, n_query=10
    )
    rejects = {(r["case_id"], r["stage"], r["reason"]): r["n"] for r in out.rejects.collect()}
    assert rejects == {
        (1, "case", "no_volume"): 20, (2, "case", "no_mesh"): 80, (9, "case", "no_points"): 0, (3, "rows", "distance_out_of_range"): 20,
    }
    kept = out.points.groupBy("case_id").count().collect()
    assert {r["case_id"]: r["count"] for r in kept} == {0: 80, 3: 80}
    assert sum(r["count"] for r in kept) + sum(n for (_, s, _), n in rejects.items() if s == "case") == points.filter("case_id in (0, 1, 2, 3)").count()


def test_featurise_sorts_each_cloud_once(spark, city, monkeypatch):
    """Points and leaves are put on their curves, the vertices are sorted for one search, and no search sorts anything else."""
    from pointprep.plans import blocks, knn

    points, vertices, faces, _ = city
    manifest = spark.createDataFrame([(f"case{c}", "0-19_easy" if c % 2 else "60-79_hard", "train") for c in range(4)], "case_id string, sub_bin string, split string")
    monkeypatch.setattr(knn, "BLOCK_ROWS", 4)
    monkeypatch.setattr(knn.knn_join, "__defaults__", tuple(4 if d == 256 else d for d in knn.knn_join.__defaults__))
    sorts = []
    plain = blocks.ranked
    monkeypatch.setattr(blocks, "ranked", lambda df, *a, **k: (sorts.append(df.columns), plain(df, *a, **k))[1])
    out = workflows.featurise(points, vertices, faces, manifest, k_points=8, k_leaves=4, slots=F.lit(12), max_iter=3, n_query=40)
    rows = out.leaf_points.count()
    assert rows == 4 * 12 * 8
    by_target = sorted("vertex" if "curv_mean" in " ".join(c) and "__t" in c else "bins" if "bin" in c and "cluster" not in c and "__t" not in c else "leaf_id" if "leaf_id" in c else "centres" if "__t" in c else "point_id" for c in sorts)
    assert by_target.count("point_id") == 1 and by_target.count("leaf_id") == 1 and by_target.count("vertex") == 1
    # Only the k-means centres, which move, are sorted for every round.
    assert set(by_target) <= {"point_id", "leaf_id", "vertex", "centres"}


def test_rotary_features_and_fixed_keys(spark, city):
    points, vertices, faces, _ = city
    manifest = spark.createDataFrame([(f"case{c}", "0-19_easy" if c % 2 else "60-79_hard", "train") for c in range(4)], "case_id string, sub_bin string, split string")
    out = workflows.featurise(points, vertices, faces, manifest, k_points=8, k_leaves=4, slots=F.lit(12), max_iter=3, n_query=40)
    scales = {}
    for r in out.axis_scales.collect():
        scales.setdefault(r["sub_bin"], {})[r["axis"]] = r["scale"]
    place = {(r["case_id"], r["leaf_id"]): [r["x"], r["y"], r["z"]] for r in out.leaves.collect()}
    rows = {(r["case_id"], r["leaf_id"]): r for r in out.rotary.collect()}
    assert len(rows) == 4 * (12 + 16)
    for (case, leaf), r in rows.items():
        if leaf >= 12:
            assert r["cos_v"] == [1.0] * 32 and r["sin_v"] == [0.0] * 32
            continue
        s = scales["0-19_easy" if int(case[-1]) % 2 else "60-79_hard"]
        want = [
            p / 550.0 * 100.0 ** (-2.0 * i / d) * s[a] for p, a, d in zip(place[case, leaf], "xyz", (22, 22, 20)) for i in range(d // 2)
        ]
        assert np.allclose(r["cos_v"], np.cos(want)) and np.allclose(r["sin_v"], np.sin(want))
    keys = out.fixed_keys.groupBy("case_id", "leaf_id", "kind").count().collect()
    assert {(r["kind"], r["count"]) for r in keys} == {("local", 4), ("register", 16)}
    assert out.fixed_keys.filter("kind = 'register'").agg(F.min("key_id"), F.max("key_id")).first()[:] == (12, 27)


def test_a_folder_with_an_unreadable_case(spark, city, tmp_path):
    from pointprep.sources import files

    points, _, _, centers = city
    for c in range(6):
        points.filter(F.col("case_id") == f"case{c}").coalesce(1).write.parquet(str(tmp_path / "in" / f"case{c}"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for c in range(6):
        part = next((tmp_path / "in" / f"case{c}").glob("part-*.parquet"))
        data = part.read_bytes()
        (flat / f"case{c}.parquet").write_bytes(data if c != 2 else data[:40] + b"broken")
    chosen, placed, verdicts, rejects, facts = workflows.curate_folder(spark, str(flat), points.schema, centers, n_train=2, n_val=1, n_test=1, seed=7)
    assert [tuple(r)[:3] for r in rejects.filter("stage = 'load'").collect()] == [("case2", "load", "unreadable_or_empty")]
    files.write_manifest(chosen, str(tmp_path / "manifest"), facts=facts)
    back = {(r["section"], r["name"]): r["value"] for r in files.read_manifest_facts(spark, str(tmp_path / "manifest" / "document")).collect()}
    assert back["total", "load_failed"] == "1" and back["total", "scanned"] == "6" and back["total", "rows"] == "400"
    assert back["parameter", "seed"] == "7" and back["parameter", "eps"] == "5.0" and back["parameter", "min_samples"] == "10"
    assert back["n_volume", "median"] == "60" and placed.count() == chosen.count() + placed.count() - chosen.count()
