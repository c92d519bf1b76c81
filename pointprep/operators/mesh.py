"""Mesh curvature and ray distances."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pointprep.functions.scalar import clip
from pointprep.plans.blocks import tasks_for
from pointprep.plans.knn import knn_join
from pointprep.plans.salt import salted_join
from pointprep.plans.skew import BROADCAST_ROWS
from pointprep.session import materialize

# Fixed values
MEAN_CLIP = 100.0
GAUSS_CLIP = 1000.0
DIRECTIONS = 16
RAY_SCALE = 50.0
MIN_HIT = 0.0
MIN_LEVEL = -8
EDGE_SLACK = 1e-9


def _corners(faces: DataFrame, vertices: DataFrame, key: str, face_id: str, vertex_id: str) -> DataFrame:
    """One row per face with its corner ids and coordinates.

    Corners meet their vertex one row each; a vertex many faces share is spread. Tasks are dealt by the number of corners.
    """
    tasks = tasks_for(3 * faces.count())
    corner = faces.select(
        key, face_id, F.posexplode(F.array("v0", "v1", "v2")).alias("__i", vertex_id)
    )
    at = salted_join(
        corner, vertices.select(key, vertex_id, "x", "y", "z").hint("merge"), [key, vertex_id], [face_id], partitions=tasks
    ).repartition(tasks, key, face_id)
    # Single numbers, which a hash aggregate takes; structures would be sorted.
    picked = [F.max(F.when(F.col("__i") == i, F.col(c))).alias(f"__{i}{c}") for i in range(3) for c in (vertex_id, *"xyz")]
    return at.groupBy(key, face_id).agg(*picked).select(key, face_id, *[
        F.struct(F.col(f"__{i}{vertex_id}").alias("id"), *[F.col(f"__{i}{c}").alias(c) for c in "xyz"]).alias(f"p{i}") for i in range(3)
    ])


def _minus(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in "xyz"]


def _dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _angle(a: Sequence[Column], b: Sequence[Column]) -> Column:
    size = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(size > 0, F.acos(clip(_dot(a, b) / size, -1.0, 1.0))).otherwise(F.lit(0.0))


def vertex_curvature(vertices: DataFrame, faces: DataFrame, key: str = "case_id", face_id: str = "face_id",
                     vertex_id: str = "vertex_id") -> DataFrame:
    """Curvature per vertex, clipped.

    ``curv_gauss`` is the angle defect. ``curv_mean`` is half the sum over the incident
    edges of length times signed dihedral angle, positive where the edge is convex;
    edges count with their full length.
    """
    tri = _corners(faces, vertices, key, face_id, vertex_id)
    spokes = [(_minus(f"p{(i + 1) % 3}", f"p{i}"), _minus(f"p{(i + 2) % 3}", f"p{i}")) for i in range(3)]
    angles = tri.select(key, F.explode(F.array(*[
        F.struct(F.col(f"p{i}.id").alias(vertex_id), _angle(*spokes[i]).alias("angle")) for i in range(3)
    ])).alias("e")).select(key, "e.*")
    gauss = angles.groupBy(key, vertex_id).agg((F.lit(2.0 * math.pi) - F.sum("angle")).alias("gauss"))

    n = _cross(_minus("p1", "p0"), _minus("p2", "p0"))
    flat = tri.select(
        key, face_id, "p0", "p1", "p2", F.struct(*[c.alias(a) for c, a in zip(n, "xyz")]).alias("normal")
    )
    sides = []
    for i in range(3):
        a, b, c = f"p{i}", f"p{(i + 1) % 3}", f"p{(i + 2) % 3}"
        low = F.col(f"{a}.id") < F.col(f"{b}.id")
        sides.append(F.struct(
            F.when(low, F.col(a)).otherwise(F.col(b)).alias("lo"),
            F.when(low, F.col(b)).otherwise(F.col(a)).alias("hi"),
            F.col(c).alias("apex"),
        ))
    edges = flat.select(key, face_id, "normal", F.explode(F.array(*sides)).alias("e")).select(
        key, face_id, "normal", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"), F.col("e.apex").alias("apex"),
        F.col("e.lo.id").alias("lo_id"), F.col("e.hi.id").alias("hi_id"),
    )
    # The two faces of an edge meet in one aggregate; no face is joined with another.
    shared = edges.groupBy(key, "lo_id", "hi_id").agg(
        F.count(F.lit(1)).alias("__faces"),
        F.min_by("normal", face_id).alias("n1"),
        F.max_by("normal", face_id).alias("n2"),
        F.max_by("apex", face_id).alias("apex2"),
        F.first("lo").alias("lo"),
        F.first("hi").alias("hi"),
    ).filter(F.col("__faces") == 2)
    vec = lambda s: [F.col(f"{s}.{c}") for c in "xyz"]
    bend = _angle(vec("n1"), vec("n2"))
    side = _dot(vec("n1"), _minus("apex2", "lo"))
    span = _minus("hi", "lo")
    length = F.sqrt(_dot(span, span))
    signed = F.when(side <= 0, length * bend).otherwise(-length * bend)
    ends = shared.select(key, signed.alias("w"), F.explode(F.array("lo_id", "hi_id")).alias(vertex_id))
    mean = ends.groupBy(key, vertex_id).agg((F.sum("w") * 0.5).alias("mean"))
    return (
        gauss.join(mean, [key, vertex_id], "left")
        .select(
            key, vertex_id,
            clip(F.coalesce("mean", F.lit(0.0)), -MEAN_CLIP, MEAN_CLIP).alias("curv_mean"),
            clip("gauss", -GAUSS_CLIP, GAUSS_CLIP).alias("curv_gauss"),
        )
    )


def point_curvature(points: DataFrame, vertices: DataFrame, curvature: DataFrame, key: str = "case_id",
                    point_id: str = "point_id", vertex_id: str = "vertex_id", on_curve: bool = False) -> DataFrame:
    """Curvature of the nearest vertex for every point."""
    # A vertex no face uses has no angle defect of its own: a full turn of 2 pi.
    with_curv = vertices.join(curvature, [key, vertex_id], "left").withColumns({
        "curv_mean": F.coalesce("curv_mean", F.lit(0.0)),
        "curv_gauss": F.coalesce("curv_gauss", F.lit(2.0 * math.pi)),
    })
    near = knn_join(points, with_curv, 1, [key], point_id, vertex_id, payload=["curv_mean", "curv_gauss"], query_curve=on_curve)
    return near.select(key, point_id, vertex_id, "curv_mean", "curv_gauss")


def directions(n: int = DIRECTIONS) -> list[tuple[int, float, float]]:
    """Horizontal unit directions, evenly spaced from the x axis."""
    return [(i, math.cos(2.0 * math.pi * i / n), math.sin(2.0 * math.pi * i / n)) for i in range(n)]


def ray_distance(
    origins: DataFrame,
    vertices: DataFrame,
    faces: DataFrame,
    key: str = "case_id",
    origin_id: str = "leaf_id",
    face_id: str = "face_id",
    vertex_id: str = "vertex_id",
    n_directions: int = DIRECTIONS,
    scale: float = RAY_SCALE,
    base_cell: float = 4.0,
) -> DataFrame:
    """Nearest hit of each horizontal ray as 1 - exp(-t / scale); 1 for a miss.

    Turned so that a direction runs along one axis, a ray is a point in the plane of
    the other two. Triangles are filed there by their box in a grid whose cell grows
    with the triangle along either axis, so each lies in at most four cells, and a ray looks up one cell
    per grid size that occurs. Only triangles that stand in a ray's way meet it.
    """
    dirs = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("dir"), F.lit(c).alias("dx"), F.lit(s).alias("dy"))
        for i, c, s in directions(n_directions)
    ])
    tri = _corners(faces, vertices, key, face_id, vertex_id).withColumn("d", F.explode(dirs))
    dx, dy = F.col("d.dx"), F.col("d.dy")
    across = lambda p: F.col(f"{p}.y") * dx - F.col(f"{p}.x") * dy
    corners = ("p0", "p1", "p2")
    tri = tri.select(
        key, face_id, F.col("d.dir").alias("dir"), *corners,
        (F.least(*[across(p) for p in corners]) - EDGE_SLACK).alias("v_lo"),
        (F.greatest(*[across(p) for p in corners]) + EDGE_SLACK).alias("v_hi"),
        F.least(*[F.col(f"{p}.z") for p in corners]).alias("z_lo"),
        F.greatest(*[F.col(f"{p}.z") for p in corners]).alias("z_hi"),
    )
    def level(low: str, high: str) -> Column:
        return F.greatest(
            F.lit(MIN_LEVEL), F.ceil(F.log2(F.greatest(F.col(high) - F.col(low), F.lit(1e-9)) / F.lit(base_cell))).cast("int")
        )

    # Either axis has its own level, so a tall narrow wall lies in tall narrow cells.
    tri = tri.withColumns({"lv": level("v_lo", "v_hi"), "lz": level("z_lo", "z_hi")})
    at = lambda c, lev: F.floor(c / (F.lit(base_cell) * F.pow(F.lit(2.0), F.col(lev)))).cast("bigint")
    tri = tri.withColumn("cv", F.explode(F.sequence(at(F.col("v_lo"), "lv"), at(F.col("v_hi"), "lv")))).withColumn(
        "cz", F.explode(F.sequence(at(F.col("z_lo"), "lz"), at(F.col("z_hi"), "lz")))
    )
    # Grid sizes that occur per case and direction: a handful of rows each.
    used = materialize(tri.groupBy(key, "dir").agg(F.collect_set(F.struct("lv", "lz")).alias("__used")), "used")
    n_rays = origins.count() * n_directions
    sizes = used.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("__used")).alias("most")).first()
    rays = (
        origins.repartition(tasks_for(n_rays)).select(key, F.col(origin_id).alias("__o"), "x", "y", "z", F.explode(dirs).alias("d"))
        .select(key, "__o", "x", "y", "z", F.col("d.dir").alias("dir"), F.col("d.dx").alias("dx"), F.col("d.dy").alias("dy"))
        .join(F.broadcast(used) if sizes["n"] <= BROADCAST_ROWS else used.hint("merge"), [key, "dir"])
        .withColumn("v", F.col("y") * F.col("dx") - F.col("x") * F.col("dy"))
        .select("*", F.explode("__used").alias("__l")).select("*", "__l.lv", "__l.lz").drop("__used", "__l")
        .withColumn("cv", at(F.col("v"), "lv"))
        .withColumn("cz", at(F.col("z"), "lz"))
    )
    # A triangle lies in two cells for either axis at most, and seldom in all four.
    tasks = tasks_for(n_directions * 3 * faces.count() + n_rays * (sizes["most"] or 1))
    met = salted_join(rays, tri.hint("merge"), [key, "dir", "lv", "lz", "cv", "cz"], ["__o"], partitions=tasks).filter(
        (F.col("v") >= F.col("v_lo")) & (F.col("v") <= F.col("v_hi")) & (F.col("z") >= F.col("z_lo")) & (F.col("z") <= F.col("z_hi"))
    )
    # Ray and triangle by barycentric coordinates (Moeller and Trumbore).
    e1, e2 = _minus("p1", "p0"), _minus("p2", "p0")
    d = [F.col("dx"), F.col("dy"), F.lit(0.0)]
    h = _cross(d, e2)
    det = F.when(F.abs(_dot(e1, h)) > 1e-12, _dot(e1, h))  # NULL: the ray runs along the triangle
    s = [F.col(c) - F.col(f"p0.{c}") for c in "xyz"]
    u = _dot(s, h) / det
    q = _cross(s, e1)
    v = _dot(d, q) / det
    t = _dot(e2, q) / det
    hit = det.isNotNull() & (u >= 0) & (v >= 0) & (u + v <= 1.0) & (t >= MIN_HIT)
    nearest = met.withColumn("t", F.when(hit, t)).groupBy(key, "__o", "dir").agg(F.min("t").alias("t"))
    every = origins.select(key, F.col(origin_id).alias("__o"), F.explode(dirs).alias("d")).select(key, "__o", F.col("d.dir").alias("dir"))
    return every.repartition(tasks_for(n_rays), key, "__o", "dir").join(nearest.hint("merge"), [key, "__o", "dir"], "left").select(
        key, F.col("__o").alias(origin_id), "dir", F.col("t").alias("dist"),
        F.coalesce(F.lit(1.0) - F.exp(-F.col("t") / F.lit(scale)), F.lit(1.0)).alias("feature"),
    )


def ray_vector(rays: DataFrame, key: str = "case_id", origin_id: str = "leaf_id") -> DataFrame:
    """The features of all directions as one array per origin."""
    return rays.groupBy(key, origin_id).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dir", "feature"))), lambda e: e["feature"]).alias("pbd")
    )
