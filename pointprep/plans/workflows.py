"""The three jobs a user runs: curate cases, featurise them, evaluate predictions.

Each takes and returns tables keyed by case, for all cases at once. A stage is
written once where several later stages read it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from inspect import Parameter, signature

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from pointprep.functions import scalar as S
from pointprep.functions.encode import leaf_vector
from pointprep.operators import batching, binning, cluster, mesh, metrics, neighbours, outliers, sampling, stats, strata
from pointprep.plans.blocks import CURVE, with_curve
from pointprep.plans.knn import knn_join, target_tree
from pointprep.session import materialize
from pointprep.sources.tables import scan_cases, unreadable_files, with_default

#: Cases in a list that is sent to every task.
CASE_LIST = 1_000_000
TARGETS = {"vol_0": "ux", "vol_1": "uy", "vol_2": "uz", "vol_3": "p_train", "vol_4": "nut"}
POINT_INPUTS = {
    "pt_sdf": "sdf", "pt_sdfg_0": "gx", "pt_sdfg_1": "gy", "pt_sdfg_2": "gz", "pt_cm": "curv_mean", "pt_cg": "curv_gauss",
}
LEAF_INPUTS = {
    "leaf_sdf": "sdf", "leaf_sdfg_0": "gx", "leaf_sdfg_1": "gy", "leaf_sdfg_2": "gz",
    "leaf_cm": "curv_mean", "leaf_cg": "curv_gauss",
    **{f"leaf_stats_{i}": name for i, name in enumerate(neighbours.STAT_NAMES)},
}


def curate(
    points: DataFrame,
    face_centers: DataFrame,
    eps: float = 5.0,
    min_samples: int = 10,
    n_train: int = 70,
    n_val: int = 5,
    n_test: int = 5,
    seed: int = 42,
    drop_anomalies: bool = True,
    load_errors: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(manifest, all strata, verdicts, rejects): buildings per case are clusters of its face centres.

    ``rejects`` has case_id, stage, reason and n rows for every case that does not get into the strata:
    anomalies, and cases of ``load_errors`` (case_id and reason).
    """
    table = materialize(stats.case_stats(points), "cases")
    buildings = cluster.dbscan_count(
        cluster.dbscan(face_centers, eps, min_samples, row_id="face_id"), table, row_id="face_id"
    ).withColumnRenamed("n_clusters", "n_buildings")
    verdicts = materialize(outliers.mad_outliers(outliers.mad_scores(table, stats.indicator_names())), "verdicts")
    kept = outliers.drop_flagged(table, verdicts) if drop_anomalies else table
    counted = materialize(kept.select("case_id", "n_volume", "n_surface").join(buildings, "case_id"), "kept")
    placed = materialize(strata.add_strata(counted), "strata")
    chosen = strata.stratified_split(placed, n_train, n_val, n_test, seed)
    n = (F.col("n_volume") + F.col("n_surface")).alias("n")
    dropped = table.join(placed.select("case_id"), "case_id", "left_anti").join(verdicts.select("case_id", "rule"), "case_id", "left")
    rejects = dropped.select("case_id", F.lit("anomaly").alias("stage"), F.col("rule").alias("reason"), n)
    if load_errors is not None:
        rejects = rejects.unionByName(load_errors.select("case_id", F.lit("load").alias("stage"), "reason", F.lit(0).cast("bigint").alias("n")))
    return chosen, placed, verdicts, rejects


@dataclass(frozen=True)
class Prepared:
    points: DataFrame
    leaves: DataFrame
    leaf_points: DataFrame
    leaf_leaves: DataFrame
    norm_stats: DataFrame
    axis_scales: DataFrame
    pools: DataFrame
    query_counts: DataFrame
    rejects: DataFrame
    rotary: DataFrame
    fixed_keys: DataFrame


def judge_features(points: DataFrame, vertices: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every case of the manifest with its rows ``n`` and the reason why no features can be made, or NULL."""
    rows = points.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_surface")).alias("__volume"))
    meshes = vertices.select("case_id", F.lit(True).alias("__mesh")).distinct()
    reason = (
        F.when(F.col("n").isNull(), "no_points").when(F.col("__volume") == 0, "no_volume").when(F.col("__mesh").isNull(), "no_mesh")
    )
    return manifest.select("case_id").distinct().join(rows, "case_id", "left").join(meshes, "case_id", "left").select(
        "case_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), reason.alias("reason")
    )


def of_cases(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows of the listed cases; a short list goes to the rows, so that these are not shuffled."""
    listed = cases.select("case_id").distinct()
    return rows.join(F.broadcast(listed) if listed.count() <= CASE_LIST else listed, "case_id", "left_semi")


def clean_points(points: DataFrame, vertices: DataFrame, faces: DataFrame, g: float = S.GRAVITY, on_curve: bool = False) -> DataFrame:
    """Stored sign turned, surface distance and gradient filled, curvature attached, pressure detrended.

    Expects sdf, gx, gy, gz as stored, and NULL or anything on surface rows. Every row comes out: what a
    case without volume rows or without vertices lacks is NULL.
    """
    grad = ["gx", "gy", "gz"]
    turned = points.withColumns({c: -F.col(c) for c in ("sdf", *grad)})
    volume = turned.filter(~F.col("is_surface"))
    near = neighbours.surface_gradient(turned, grad, on_curve=on_curve)
    surface = turned.filter("is_surface").drop("sdf", *grad).join(near.drop("volume_id"), ["case_id", "point_id"], "left")
    both = with_default(volume.unionByName(surface), "area", 1.0)
    curv = materialize(mesh.vertex_curvature(vertices, faces), "curvature")
    at = mesh.point_curvature(points, vertices, curv, on_curve=on_curve).select("case_id", "point_id", "curv_mean", "curv_gauss")
    return both.join(at, ["case_id", "point_id"], "left").withColumn("p_train", S.detrend("p", "z", g))


def curate_folder(
    spark: SparkSession, path: str, schema: StructType, face_centers: DataFrame, case_of: Column | None = None, **options
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """``curate`` over a folder of Parquet files, which finds the unreadable ones itself.

    ``case_of`` gives a file's case from its ``path``, by default its name up to the first dot. A case all of whose files
    are unreadable or empty is a load error. Returns what ``curate`` does and the manifest's counters and
    parameters as (section, name, value); rows are counted in the pass that makes the case table.
    """
    name = F.regexp_extract("path", r"([^/.]+)[^/]*$", 1) if case_of is None else case_of
    seen = Observation("load")
    points = scan_cases(spark, path, schema, skip_corrupt=True).observe(seen, F.count(F.lit(1)).alias("rows"))
    failed = unreadable_files(spark, path, schema).select(name.cast(schema["case_id"].dataType).alias("case_id"), "reason").distinct()
    errors = materialize(failed.join(points.select("case_id").distinct(), "case_id", "left_anti"), "load_errors")
    # The observed pass comes last, so its numbers are those of the case table.
    found = curate(points, face_centers, load_errors=errors, **options)
    return *found, manifest_facts(*found[:3], errors, rows=seen.get["rows"], **options)


def manifest_facts(
    chosen: DataFrame, placed: DataFrame, verdicts: DataFrame, errors: DataFrame | None = None, rows: int | None = None, **options
) -> DataFrame:
    """Counters and parameters of a manifest as (section, name, value), value as text.

    ``options`` are those that ``curate`` was called with; the others count with their defaults.
    """
    spark = chosen.sparkSession
    defaults = {k: p.default for k, p in signature(curate).parameters.items() if p.default is not Parameter.empty and k != "load_errors"}
    used = defaults | options
    counts = strata.manifest_counts(verdicts, placed, chosen, errors).select(
        F.col("kind").alias("section"), "name", F.col("n").cast("string").alias("value")
    )
    sizes = strata.size_summary(placed, ["n_buildings", "n_volume", "n_surface"])
    parts = [sizes.select(F.col("measure").alias("section"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in ("min", "max", "median")]
    told = [("parameter", k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in used.items()]
    if rows is not None:
        told.append(("total", "rows", str(rows)))
    # A handful of parameters.
    out = counts.unionByName(spark.createDataFrame(told, "section string, name string, value string"))
    for part in parts:
        out = out.unionByName(part)
    return out


def featurise(
    points: DataFrame,
    vertices: DataFrame,
    faces: DataFrame,
    manifest: DataFrame,
    k_points: int = 256,
    k_leaves: int = 64,
    slots: Column | None = None,
    alpha: float = binning.ALPHA,
    max_iter: int = 30,
    n_query: int = 125_000,
    coord_max: float = S.COORD_MAX,
) -> Prepared:
    """All features of the manifest's cases; statistics come from its train split only.

    ``slots`` is the leaf count per case, by default that of the case's stratum. Nothing is lost in
    silence: ``rejects`` has case_id, stage, reason and n rows. A case without points, volume rows,
    vertices, usable distances or with more populated bins than slots is left out whole; rows whose
    distance lies in no bin are counted, stay in the points and only make no leaves.
    """
    judged = materialize(judge_features(points, vertices, manifest), "judged")
    chosen = batching.stratum_params(manifest.select("case_id", "sub_bin", "split"))
    slot_count = F.col("leaves") if slots is None else slots
    xyz = ["x", "y", "z"]
    # Each cloud is put on a curve once; all searches, k-means included, read their blocks off it.
    raw = with_curve(of_cases(points, judged.filter("reason is null")), ["case_id"], "point_id", xyz)
    cloud = materialize(clean_points(raw, vertices, faces, on_curve=True), "cloud")

    marked = materialize(binning.with_bins(cloud), "binned")
    counts = binning.bin_counts(marked).join(chosen.select("case_id", "leaves"), "case_id")
    alloc = materialize(binning.bin_allocation(counts, slot_count, alpha=alpha), "allocation")
    unbinned = marked.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bin").isNull()).alias("__out"))
    fits = alloc.groupBy("case_id").agg(F.min("feasible").alias("__fits"))
    later = materialize(unbinned.join(fits, "case_id", "left").select(
        "case_id", "n", "__out", F.when(F.col("__fits").isNull(), "no_usable_distance").when(~F.col("__fits"), "infeasible_slots").alias("reason")
    ), "later")
    rejects = judged.filter("reason is not null").select("case_id", F.lit("case").alias("stage"), "reason", "n").unionByName(
        later.filter("reason is not null").select("case_id", F.lit("case").alias("stage"), "reason", "n")
    ).unionByName(
        later.filter("reason is null and __out > 0").select(
            "case_id", F.lit("rows").alias("stage"), F.lit("distance_out_of_range").alias("reason"), F.col("__out").alias("n")
        )
    )
    good = later.filter("reason is null").select("case_id")
    chosen, alloc = of_cases(chosen, good), of_cases(alloc, good)
    marked = of_cases(marked, good)
    cloud, binned = marked.drop("bin"), marked.filter(F.col("bin").isNotNull())
    leaves = with_curve(_leaves(binned, alloc, max_iter), ["case_id"], "leaf_id", xyz)
    leaf_tree = target_tree(leaves, ["case_id"], xyz)

    payload = ["x", "y", "z", "sdf", "gx", "gy", "gz", "curv_mean", "curv_gauss", "is_surface"]
    edges = materialize(
        knn_join(leaves, cloud, k_points, payload=payload, query_curve=True, tree=target_tree(cloud, ["case_id"], xyz)), "leaf_points"
    )
    around = materialize(
        knn_join(
            leaves, leaves, k_leaves, query_id="leaf_id", target_id="leaf_id", exclude_same_id=True, query_curve=True, tree=leaf_tree
        ),
        "leaf_leaves",
    )
    at = neighbours.nearest_attributes(edges).select("case_id", "leaf_id", *payload[3:9])
    rays = mesh.ray_vector(mesh.ray_distance(leaves, vertices, faces))
    by_leaf = ["case_id", "leaf_id"]
    features = materialize(
        leaves.drop(CURVE).join(neighbours.leaf_stats(edges, leaves, k_points), by_leaf)
        .join(at, by_leaf)
        .join(rays, by_leaf),
        "features",
    )
    rest = [c for c in cloud.columns if c not in ("case_id", "point_id", *xyz, CURVE)]
    located = neighbours.nearest_centroid(cloud, leaves, carry=rest, on_curve=True, tree=leaf_tree).drop("dist")

    train = chosen.filter("split = 'train'").select("case_id")
    train_points = of_cases(cloud, train)
    train_leaves = of_cases(features, train)
    volume = F.col("is_surface") == False  # noqa: E712
    point_channels = {c: F.when(volume, F.col(v)) for c, v in TARGETS.items()}
    point_channels["surf"] = F.when(~volume, F.col("p_train"))
    point_channels |= {c: F.col(v) for c, v in POINT_INPUTS.items()}
    norms = materialize(
        stats.norm_stats(train_points, point_channels).unionByName(
            stats.norm_stats(train_leaves, {c: F.col(v) for c, v in LEAF_INPUTS.items()})
        ),
        "norms",
    )
    scales = stats.axis_scale(train_leaves.select(*[(F.col(c) / coord_max).alias(c) for c in "xyz"]))
    look = stats.stats_lookup(norms)

    weighted = located.withColumn("log_weight", F.when(volume, S.log_sample_weight("sdf")))
    inputs = {v: c for c, v in POINT_INPUTS.items()}
    final_points = stats.zscore_apply(weighted, look, inputs).withColumns({
        f"y_{v}": F.when(volume, S.standardise(v, *look[c])) for c, v in TARGETS.items()
    } | {"y_surf": F.when(~volume, S.standardise("p_train", *look["surf"]))})
    final_points = final_points.withColumns({f"{c}_norm": F.col(c) / coord_max for c in "xyz"})
    final_leaves = stats.zscore_apply(features, look, {v: c for c, v in LEAF_INPUTS.items()}).withColumns(
        {f"{c}_norm": F.col(c) / coord_max for c in "xyz"}
    )
    final_leaves = final_leaves.withColumn("aggregate", leaf_vector(
        F.array(*neighbours.STAT_NAMES), F.col("sdf"), [F.col(c) for c in ("gx", "gy", "gz")], F.col("curv_mean"),
        F.col("curv_gauss"), [F.col(f"{c}_norm") for c in "xyz"], F.col("pbd"),
    ))
    pool_edges = stats.zscore_apply(edges, look, inputs)
    pools = neighbours.neighbour_pool(pool_edges, leaves, ["sdf", "gx", "gy", "gz", "is_surface", "curv_mean", "curv_gauss"], scale=coord_max)
    n_vol, n_surf = S.query_split("__nv", "__ns", n_query)
    per_case = cloud.groupBy("case_id").agg(F.count_if(volume).alias("__nv"), F.count_if(~volume).alias("__ns")).select(
        "case_id", n_vol.alias("n_query_vol"), n_surf.alias("n_query_surf")
    )
    # Every case turns by the scales of its own stratum.
    strata_of = chosen.select("case_id", "sub_bin")
    plain = leaves.select("case_id", "leaf_id", *xyz)
    scaled = neighbours.with_stratum_scale(plain.join(strata_of, "case_id"), materialize(scales, "scales"))
    rotary = neighbours.rotary_features(scaled, [F.col("axis_scale")[i] for i in range(3)], divisor=coord_max)
    keys = neighbours.fixed_keys(around, plain)
    return Prepared(final_points, final_leaves, edges, around, norms, scales, pools, per_case, rejects, rotary, keys)


def _leaves(binned: DataFrame, alloc: DataFrame, max_iter: int) -> DataFrame:
    """Leaves of every case, numbered from 0: k-means centres, or the points themselves in short bins."""
    coords = ["x", "y", "z"]
    pts = binned.select("case_id", "bin", "point_id", *coords, CURVE)
    full = alloc.filter(F.col("n") >= F.col("alloc"))
    centres = cluster.binned_kmeans(pts, full, max_iter=max_iter, on_curve=True).select("case_id", "bin", F.col("cluster").alias("slot"), *coords)
    filled = binning.oversample_fill(pts, alloc).select("case_id", "bin", "slot", "point_id")
    own = filled.join(pts.select("case_id", "point_id", *coords), ["case_id", "point_id"]).select("case_id", "bin", "slot", *coords)
    # The slots of a bin follow those of the bins below it, so a prefix sum over bins numbers the leaves.
    below = alloc.alias("a").join(alloc.select("case_id", F.col("bin").alias("__b"), F.col("alloc").alias("__n")), "case_id").groupBy(
        "case_id", "bin"
    ).agg(F.coalesce(F.sum(F.when(F.col("__b") < F.col("bin"), F.col("__n"))), F.lit(0)).alias("__before"))
    return centres.unionByName(own).join(below, ["case_id", "bin"]).select(
        "case_id", (F.col("__before") + F.col("slot")).cast("bigint").alias("leaf_id"), F.col("bin").alias("bin_id"), *coords
    )


def draw_queries(prepared: Prepared, n_query: int, epoch: int) -> DataFrame:
    """The epoch's slots of every case with the sampled point's inputs and targets; zeros where a slot is padding."""
    slots = sampling.query_slots(prepared.points, F.col("log_weight"), n_query, epoch)
    wanted = ["x_norm", "y_norm", "z_norm", "sdf", "gx", "gy", "gz", "y_ux", "y_uy", "y_uz", "y_p_train", "y_nut", "y_surf"]
    rows = slots.join(prepared.points.select("case_id", "point_id", "leaf_id", *wanted), ["case_id", "point_id"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in wanted} | {"leaf_id": F.coalesce("leaf_id", F.lit(0).cast("bigint"))})


def evaluate(
    predictions: DataFrame,
    points: DataFrame,
    norm_stats: DataFrame,
    channels: Mapping[str, str],
    pressure: Sequence[str] = ("vol_3", "surf"),
    g: float = S.GRAVITY,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(physical rows, per-case errors, summary, median case) from standardised predictions.

    ``predictions`` has case_id, point_id, channel, pred_z and target_z; ``points`` the
    physical z; ``channels`` maps channel to field name; the pressure channels get
    their hydrostatic part back.
    """
    z = points.select("case_id", "point_id", F.col("z").alias("__z"))
    rows = predictions.join(z, ["case_id", "point_id"])
    # One row per channel.
    rows = rows.join(F.broadcast(norm_stats.select("channel", "mean", "std")), "channel")
    lift = F.when(F.col("channel").isin(list(pressure)), F.lit(g) * F.col("__z")).otherwise(F.lit(0.0))
    physical = rows.select(
        "case_id", "point_id",
        S.lookup("channel", dict(channels), "other").alias("field"),
        (S.unstandardise("pred_z", F.col("mean"), F.col("std")) - lift).alias("pred"),
        (S.unstandardise("target_z", F.col("mean"), F.col("std")) - lift).alias("target"),
    )
    errors = materialize(metrics.rel_l2(physical, ["case_id", "field"]), "errors")
    summary = metrics.metric_summary(errors, "field", "rel_l2")
    per_case = materialize(metrics.rel_l2_mean(errors), "per_case")
    return physical, errors, summary, metrics.median_case(per_case)
