"""Clustering and mesh queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointprep.operators import cluster as C
from pointprep.operators import mesh
from pointprep.registry.core import query
from pointprep.registry.fixtures import R, U, big, define, points, r, sql, table
from pointprep.registry.sampling import allocation, binned
from pointprep.session import materialize

EPS, MIN_SAMPLES = 4.0, 4

define("f_pairs", f"""select a.case_id, a.point_id a, b.point_id b from f_points a join f_points b on a.case_id = b.case_id
    where (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= {EPS * EPS}e0""")
define("f_core", f"select case_id, a from f_pairs group by 1, 2 having count(*) >= {MIN_SAMPLES}")
define("f_links", """select p.case_id, p.a, p.b from f_pairs p join f_core c on p.case_id = c.case_id and p.a = c.a
    join f_core d on p.case_id = d.case_id and p.b = d.a""")
define("f_reach", """select case_id, a, a as b from f_core
    union select r.case_id, r.a, l.b from f_reach r join f_links l on r.case_id = l.case_id and r.b = l.a""")
define("f_label", "select case_id, a, min(b) as label from f_reach group by 1, 2")
define("f_dbscan", """select p.case_id, p.point_id, coalesce(l.label, b.label) as label, l.a is not null as is_core from f_points p
    left join f_label l on l.case_id = p.case_id and l.a = p.point_id
    left join (select q.case_id, q.a, min(c.label) as label from f_pairs q join f_label c on q.case_id = c.case_id and q.b = c.a group by 1, 2) b
      on b.case_id = p.case_id and b.a = p.point_id""")


@query("dbscan_labels", sql("select case_id, point_id, label, is_core from f_dbscan", recursive=True))
def dbscan_labels(spark, sf_dir):
    return C.dbscan(points(spark, sf_dir), EPS, MIN_SAMPLES).select("case_id", "point_id", "label", "is_core")


@query("dbscan_count", sql(f"select case_id, {big('count(distinct label)')} n_clusters from f_dbscan group by 1", recursive=True))
def dbscan_count(spark, sf_dir):
    p = points(spark, sf_dir)
    return C.dbscan_count(C.dbscan(p, EPS, MIN_SAMPLES), p)


define("f_seed", f"""select case_id, bin, {big('rn - 1')} as cluster, x, y, z from (
    select p.case_id, p.bin, x, y, z, alloc, row_number() over (partition by p.case_id, p.bin
      order by {U("'seed'", "'42'", "p.case_id", "p.bin", "point_id")}, point_id) rn
    from f_binned p join f_alloc s on p.case_id = s.case_id and p.bin = s.bin) where rn <= alloc""")
define("f_lloyd", """select case_id, bin, cluster, count(*) n, avg(x) x, avg(y) y, avg(z) z, sum(sqrt(d2)*sqrt(d2)) cost from (
    select p.case_id, p.bin, s.cluster, p.x, p.y, p.z, d2, row_number() over (partition by p.point_id order by d2, s.cluster) rn
    from f_binned p join f_seed s on p.case_id = s.case_id and p.bin = s.bin,
      lateral (select ((s.x-p.x)*(s.x-p.x) + (s.y-p.y)*(s.y-p.y)) + (s.z-p.z)*(s.z-p.z) as d2)) where rn = 1 group by 1, 2, 3""")


@query("lloyd_step", sql(f"""select s.case_id, s.bin, s.cluster, {R('coalesce(l.x, s.x)')} x, {R('coalesce(l.y, s.y)')} y,
    {R('coalesce(l.z, s.z)')} z, {big('coalesce(l.n, 0)')} n, {R('coalesce(l.cost, 0e0)')} "cost",
    {R('coalesce(sqrt((l.x-s.x)*(l.x-s.x) + (l.y-s.y)*(l.y-s.y) + (l.z-s.z)*(l.z-s.z)), 0e0)')} moved
    from f_seed s left join f_lloyd l on s.case_id = l.case_id and s.bin = l.bin and s.cluster = l.cluster"""))
def lloyd_step(spark, sf_dir):
    p = binned(spark, sf_dir).select("case_id", "bin", "point_id", "x", "y", "z")
    seeds = materialize(C.seed_centroids(p, allocation(spark, sf_dir)), "seeds")
    out = C.lloyd_step(p, seeds)
    return out.select("case_id", "bin", "cluster", *[r(c).alias(c) for c in "xyz"], "n", r("cost").alias("cost"), r("moved").alias("moved"))


ROUNDS = 3
define("f_c0", "select s.* from f_seed s join f_alloc a on s.case_id = a.case_id and s.bin = a.bin where a.n > a.alloc")
for _i in range(1, ROUNDS + 1):
    define(f"f_near{_i}", f"""select case_id, bin, cluster, avg(x) x, avg(y) y, avg(z) z from (
        select p.case_id, p.bin, s.cluster, p.x, p.y, p.z, row_number() over (partition by p.point_id order by
          ((s.x-p.x)*(s.x-p.x) + (s.y-p.y)*(s.y-p.y)) + (s.z-p.z)*(s.z-p.z), s.cluster) rn
        from f_binned p join f_c{_i - 1} s on p.case_id = s.case_id and p.bin = s.bin) where rn = 1 group by 1, 2, 3""")
    define(f"f_c{_i}", f"""select s.case_id, s.bin, s.cluster, coalesce(m.x, s.x) x, coalesce(m.y, s.y) y, coalesce(m.z, s.z) z
        from f_c{_i - 1} s left join f_near{_i} m on s.case_id = m.case_id and s.bin = m.bin and s.cluster = m.cluster""")


@query("kmeans_rounds", sql(f"""select case_id, bin, cluster, {R('x')} x, {R('y')} y, {R('z')} z from f_c{ROUNDS}
    union all select s.case_id, s.bin, s.cluster, {R('s.x')}, {R('s.y')}, {R('s.z')}
    from f_seed s join f_alloc a on s.case_id = a.case_id and s.bin = a.bin where a.n <= a.alloc"""))
def kmeans_rounds(spark, sf_dir):
    """A fixed number of rounds: a group leaves early only once nothing moves at all."""
    p = binned(spark, sf_dir).select("case_id", "bin", "point_id", "x", "y", "z")
    out = C.binned_kmeans(p, materialize(allocation(spark, sf_dir), "allocation"), max_iter=ROUNDS, tol=0.0)
    return out.select("case_id", "bin", "cluster", *[r(c).alias(c) for c in "xyz"])


MAX_ROUNDS, TOL = 30, 1e-3
define("f_k0", "select *, true as going from f_c0")
for _i in range(1, MAX_ROUNDS + 1):
    define(f"f_kn{_i}", f"""select case_id, bin, cluster, avg(x) x, avg(y) y, avg(z) z from (
        select p.case_id, p.bin, s.cluster, p.x, p.y, p.z, row_number() over (partition by p.point_id order by
          ((s.x-p.x)*(s.x-p.x) + (s.y-p.y)*(s.y-p.y)) + (s.z-p.z)*(s.z-p.z), s.cluster) rn
        from f_binned p join f_k{_i - 1} s on p.case_id = s.case_id and p.bin = s.bin and s.going) where rn = 1 group by 1, 2, 3""")
    define(f"f_k{_i}", f"""select case_id, bin, cluster, x, y, z, coalesce(max(moved) over (partition by case_id, bin), 0e0) > {TOL!r}e0 as going from (
        select s.case_id, s.bin, s.cluster, coalesce(m.x, s.x) x, coalesce(m.y, s.y) y, coalesce(m.z, s.z) z,
          sqrt((m.x-s.x)*(m.x-s.x) + (m.y-s.y)*(m.y-s.y) + (m.z-s.z)*(m.z-s.z)) moved
        from f_k{_i - 1} s left join f_kn{_i} m on s.case_id = m.case_id and s.bin = m.bin and s.cluster = m.cluster)""")


@query("binned_kmeans", sql(f"""select case_id, bin, cluster, {R('x')} x, {R('y')} y, {R('z')} z from f_k{MAX_ROUNDS}
    union all select s.case_id, s.bin, s.cluster, {R('s.x')}, {R('s.y')}, {R('s.z')}
    from f_seed s join f_alloc a on s.case_id = a.case_id and s.bin = a.bin where a.n <= a.alloc"""))
def binned_kmeans(spark, sf_dir):
    p = binned(spark, sf_dir).select("case_id", "bin", "point_id", "x", "y", "z")
    out = C.binned_kmeans(p, materialize(allocation(spark, sf_dir), "allocation"), max_iter=MAX_ROUNDS, tol=TOL)
    return out.select("case_id", "bin", "cluster", *[r(c).alias(c) for c in "xyz"])


CUBE_CORNERS = range(8)
# The 12 triangles of a box, by corner number
CUBE_FACES = (
    (0, 0, 2, 1), (1, 1, 2, 3), (2, 4, 5, 6), (3, 5, 7, 6), (4, 0, 1, 4), (5, 1, 5, 4),
    (6, 2, 6, 3), (7, 3, 6, 7), (8, 0, 4, 2), (9, 2, 4, 6), (10, 1, 3, 5), (11, 3, 7, 5),
)
_VERTEX = {
    "case_id": "s_nationkey",
    "vertex_id": "s_suppkey*8 + v",
    "x": "cast(s_suppkey % 10 as double)*40e0 + (case when (v & 1) <> 0 then 10e0 else -10e0 end)",
    "y": "floor(s_suppkey/10e0)*40e0 + (case when (v & 2) <> 0 then 10e0 else -10e0 end)",
    "z": "case when (v & 4) <> 0 then 10e0 + abs(s_acctbal)/500e0 else 0e0 end",
}
_FACE = {
    "case_id": "s_nationkey",
    "face_id": "s_suppkey*12 + i",
    "v0": "s_suppkey*8 + a",
    "v1": "s_suppkey*8 + b",
    "v2": "s_suppkey*8 + c",
}
_ORIGIN = {
    "case_id": "s_nationkey",
    "leaf_id": "s_suppkey",
    "x": "cast(s_suppkey % 10 as double)*40e0 + 20.37e0",
    "y": "floor(s_suppkey/10e0)*40e0 + 0.29e0",
    "z": "5e0",
}


def _list(spec: dict[str, str]) -> list[str]:
    return [f"{e} as {n}" for n, e in spec.items()]


def vertices(spark, sf_dir):
    corners = F.explode(F.array(*[F.lit(v) for v in CUBE_CORNERS])).alias("v")
    return table(spark, sf_dir, "supplier").select("*", corners).selectExpr(*_list(_VERTEX))


def faces(spark, sf_dir):
    tri = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(f, "iabc")]) for f in CUBE_FACES])
    return table(spark, sf_dir, "supplier").select("*", F.explode(tri).alias("f")).select("*", "f.*").selectExpr(*_list(_FACE))


def ray_origins(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(*_list(_ORIGIN))


define("f_vertices", f"select {', '.join(_list(_VERTEX))} from supplier, (values {', '.join(f'({v})' for v in CUBE_CORNERS)}) b(v)")
define("f_faces", f"select {', '.join(_list(_FACE))} from supplier, (values {', '.join(map(str, CUBE_FACES))}) f(i, a, b, c)")
define("f_origins", f"select {', '.join(_list(_ORIGIN))} from supplier")
define("f_tri", """select f.case_id, f.face_id, f.v0, f.v1, f.v2, a.x ax, a.y ay, a.z az, b.x bx, b.y by_, b.z bz, c.x cx, c.y cy, c.z cz
    from f_faces f join f_vertices a on f.case_id = a.case_id and f.v0 = a.vertex_id
    join f_vertices b on f.case_id = b.case_id and f.v1 = b.vertex_id join f_vertices c on f.case_id = c.case_id and f.v2 = c.vertex_id""")
define("f_norm3", """select *, (by_-ay)*(cz-az) - (bz-az)*(cy-ay) nx, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) ny, (bx-ax)*(cy-ay) - (by_-ay)*(cx-ax) nz from f_tri""")


def _ang(u: str, v: str) -> str:
    d = [f"({u[0]}{c} - {u[1]}{c})" for c in ("x", "y", "z")]
    e = [f"({v[0]}{c} - {v[1]}{c})" for c in ("x", "y", "z")]
    d, e = [[t.replace("by", "by_") for t in side] for side in (d, e)]
    dot = " + ".join(f"{p}*{q}" for p, q in zip(d, e))
    dd = " + ".join(f"{p}*{p}" for p in d)
    ee = " + ".join(f"{p}*{p}" for p in e)
    return f"acos(greatest(-1e0, least(1e0, ({dot}) / (sqrt({dd})*sqrt({ee})))))"


_SIDES = " union all ".join(
    f"select case_id, face_id, nx, ny, nz, least({p}, {q}) lo, greatest({p}, {q}) hi, {apex} apex from f_norm3"
    for p, q, apex in (("v0", "v1", "v2"), ("v1", "v2", "v0"), ("v2", "v0", "v1"))
)
define("f_side", _SIDES)
define("f_bend", """select e.case_id, e.lo, e.hi,
      sqrt(pow(h.x-l.x,2e0)+pow(h.y-l.y,2e0)+pow(h.z-l.z,2e0)) *
      acos(greatest(-1e0, least(1e0, (e.nx*g.nx+e.ny*g.ny+e.nz*g.nz)/(sqrt(e.nx*e.nx+e.ny*e.ny+e.nz*e.nz)*sqrt(g.nx*g.nx+g.ny*g.ny+g.nz*g.nz))))) *
      case when e.nx*(p.x-l.x)+e.ny*(p.y-l.y)+e.nz*(p.z-l.z) <= 0e0 then 1e0 else -1e0 end w
    from f_side e join f_side g on e.case_id = g.case_id and e.lo = g.lo and e.hi = g.hi and e.face_id < g.face_id
    join f_vertices l on l.case_id = e.case_id and l.vertex_id = e.lo join f_vertices h on h.case_id = e.case_id and h.vertex_id = e.hi
    join f_vertices p on p.case_id = e.case_id and p.vertex_id = g.apex""")
define("f_curv", f"""select g.case_id, g.vertex_id, greatest(-100e0, least(100e0, coalesce(m.mean, 0e0))) curv_mean,
      greatest(-1000e0, least(1000e0, g.gauss)) curv_gauss
    from (select case_id, vertex_id, 2e0*pi() - sum(angle) gauss from (
        select case_id, v0 vertex_id, {_ang('ba', 'ca')} angle from f_tri union all
        select case_id, v1, {_ang('cb', 'ab')} from f_tri union all select case_id, v2, {_ang('ac', 'bc')} from f_tri) group by 1, 2) g
    left join (select case_id, vertex_id, sum(w)/2e0 mean from (
        select case_id, lo vertex_id, w from f_bend union all select case_id, hi, w from f_bend) group by 1, 2) m
      on g.case_id = m.case_id and g.vertex_id = m.vertex_id""")


@query("curvature", sql(f"select {big('case_id')} case_id, vertex_id, {R('curv_mean', 4)} curv_mean, {R('curv_gauss')} curv_gauss from f_curv"))
def curvature(spark, sf_dir):
    out = mesh.vertex_curvature(vertices(spark, sf_dir), faces(spark, sf_dir))
    return out.select(F.col("case_id").cast("bigint"), "vertex_id", r("curv_mean", 4).alias("curv_mean"), r("curv_gauss").alias("curv_gauss"))


@query("point_curvature", sql(f"""select {big('case_id')} case_id, leaf_id, vertex_id, {R('curv_mean', 4)} curv_mean from (
    select o.case_id, o.leaf_id, v.vertex_id, c.curv_mean, row_number() over (partition by o.leaf_id
      order by ((v.x-o.x)*(v.x-o.x) + (v.y-o.y)*(v.y-o.y)) + (v.z-o.z)*(v.z-o.z), v.vertex_id) rn
    from f_origins o join f_vertices v on o.case_id = v.case_id join f_curv c on c.case_id = v.case_id and c.vertex_id = v.vertex_id) where rn = 1"""))
def point_curvature(spark, sf_dir):
    v = vertices(spark, sf_dir)
    curv = materialize(mesh.vertex_curvature(v, faces(spark, sf_dir)), "curvature")
    out = mesh.point_curvature(ray_origins(spark, sf_dir), v, curv, point_id="leaf_id")
    return out.select(F.col("case_id").cast("bigint"), "leaf_id", "vertex_id", r("curv_mean", 4).alias("curv_mean"))


_DIRS = ", ".join(f"({i}, {c!r}e0, {s!r}e0)" if "e" not in repr(c) + repr(s) else f"({i}, cast('{c!r}' as double), cast('{s!r}' as double))" for i, c, s in mesh.directions())
HITS = f"""select case_id, leaf_id, dir, min(t) t from (
    select *, (e2x*qx + e2y*qy + e2z*qz)/det t, (sx*hx + sy*hy + sz*hz)/det u, (dx*qx + dy*qy)/det v from (
      select *, sy*e1z - sz*e1y qx, sz*e1x - sx*e1z qy, sx*e1y - sy*e1x qz, e1x*hx + e1y*hy + e1z*hz det from (
        select *, dy*e2z hx, -dx*e2z hy, dx*e2y - dy*e2x hz from (
          select o.case_id, o.leaf_id, d.dir, d.dx, d.dy, bx-ax e1x, by_-ay e1y, bz-az e1z, cx-ax e2x, cy-ay e2y, cz-az e2z, o.x-ax sx, o.y-ay sy, o.z-az sz
          from {{origins}} o join f_tri t on o.case_id = t.case_id, (values {_DIRS}) d(dir, dx, dy)))) where abs(det) > 1e-12)
    where u >= 0 and v >= 0 and u + v <= 1 and t >= 0 group by 1, 2, 3"""
define("f_hits", HITS.format(origins="f_origins"))


@query("ray_distance", sql(f"""select {big('o.case_id')} case_id, o.leaf_id, {big('d.dir')} dir, {R('h.t')} dist, {R('coalesce(1e0 - exp(-h.t/50e0), 1e0)')} feature
    from f_origins o cross join (values {_DIRS}) d(dir, dx, dy) left join f_hits h on h.case_id = o.case_id and h.leaf_id = o.leaf_id and h.dir = d.dir"""))
def ray_distance(spark, sf_dir):
    out = mesh.ray_distance(ray_origins(spark, sf_dir), vertices(spark, sf_dir), faces(spark, sf_dir))
    return out.select(F.col("case_id").cast("bigint"), "leaf_id", "dir", r("dist").alias("dist"), r("feature").alias("feature"))
