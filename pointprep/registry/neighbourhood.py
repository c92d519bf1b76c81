"""Nearest-neighbour joins and what is built on their edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointprep.functions import encode
from pointprep.operators import mesh, neighbours as N
from pointprep.plans.knn import knn_join
from pointprep.registry.core import query
from pointprep.registry.fixtures import R, U, big, define, leaves, points, r, sql, table
from pointprep.registry.curation import stratified, train_leaves
from pointprep.registry.shapes import HITS, faces, vertices
from pointprep.operators.stats import axis_scale
from pointprep.session import materialize

K, K_SELF, K_IDW = 8, 4, 3
N_RANDOM, N_REGISTER, BLOCK = 3, 2, 4
REGISTERS = encode.REGISTER_TOKENS

define("f_cloud", "select *, ux as curv_mean, uy as curv_gauss from f_points")
define("f_knn", f"""select * from (
    select l.case_id, l.leaf_id, p.point_id, d2, row_number() over (partition by l.case_id, l.leaf_id order by d2, p.point_id) as "rank"
    from f_leaves l join (select * from f_points) p on l.case_id = p.case_id,
      lateral (select ((p.x-l.x)*(p.x-l.x) + (p.y-l.y)*(p.y-l.y)) + (p.z-l.z)*(p.z-l.z) as d2))
    where "rank" <= {K}""")
define("f_self", f"""select * from (
    select a.case_id, a.leaf_id, b.leaf_id as nbr_leaf_id, d2, row_number() over (partition by a.case_id, a.leaf_id order by d2, b.leaf_id) as "rank"
    from f_leaves a join f_leaves b on a.case_id = b.case_id and a.leaf_id <> b.leaf_id,
      lateral (select ((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y)) + (b.z-a.z)*(b.z-a.z) as d2))
    where "rank" <= {K_SELF}""")
define("f_near", """select * from (
    select p.case_id, p.point_id, l.leaf_id, d2, p.x, p.y, p.z, row_number() over (partition by p.point_id order by d2, l.leaf_id) as rn
    from f_points p join f_leaves l on l.case_id = p.case_id,
      lateral (select ((l.x-p.x)*(l.x-p.x) + (l.y-p.y)*(l.y-p.y)) + (l.z-p.z)*(l.z-p.z) as d2))
    where rn = 1""")
define("f_edge", """select e.*, p.x, p.y, p.z, p.sdf, p.gx, p.gy, p.gz, p.curv_mean, p.curv_gauss, p.is_surface
    from f_knn e join f_cloud p on e.point_id = p.point_id""")


define("f_leafhits", HITS.format(origins="f_leaves"))
define("f_leafrays", "select case_id, leaf_id, " + ", ".join(
    f"1e0 - exp(-max(t) filter (where dir = {i})/50e0) as d{i}" for i in range(mesh.DIRECTIONS)
) + " from f_leafhits group by 1, 2")


def cloud(spark, sf_dir):
    return points(spark, sf_dir).withColumn("curv_mean", F.col("ux")).withColumn("curv_gauss", F.col("uy"))


def edges(spark, sf_dir, payload=()):
    return knn_join(leaves(spark, sf_dir), cloud(spark, sf_dir), K, payload=payload)


def self_edges(spark, sf_dir):
    table = materialize(leaves(spark, sf_dir), "leaves")
    return knn_join(table, table, K_SELF, query_id="leaf_id", target_id="leaf_id", exclude_same_id=True)


@query("knn_points", sql(f"""select case_id, leaf_id, "rank", point_id, {R('sqrt(d2)')} dist from f_knn"""))
def knn_points(spark, sf_dir):
    """Small blocks, so that every case needs the block search."""
    out = knn_join(leaves(spark, sf_dir), cloud(spark, sf_dir), K, block_rows=16)
    return out.select("case_id", "leaf_id", "rank", "point_id", r("dist").alias("dist"))


LINES = {
    "case_id": "l_suppkey",
    "row_id": "((l_orderkey*8 + l_linenumber)*20001 + l_partkey)*1001 + l_suppkey",
    "x": "l_extendedprice/1e3",
    "y": "l_quantity",
    "z": "l_discount*1e2",
}
define("f_lines", "select " + ", ".join(f"{e} as {n}" for n, e in LINES.items()) + " from lineitem")


@query("knn_large_groups", sql(f"""select case_id, row_id, "rank", other, {R('sqrt(d2)')} dist from (
    select a.case_id, a.row_id, b.row_id as other, d2, row_number() over (partition by a.row_id order by d2, b.row_id) as "rank"
    from f_lines a join f_lines b on a.case_id = b.case_id and a.row_id <> b.row_id,
      lateral (select ((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y)) + (b.z-a.z)*(b.z-a.z) as d2)) where "rank" <= 3"""))
def knn_large_groups(spark, sf_dir):
    """Some hundred rows per supplier: the block search with its default sizes."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in LINES.items()])
    out = knn_join(rows, rows, 3, query_id="row_id", target_id="row_id", exclude_same_id=True, neighbour_name="other")
    return out.select("case_id", "row_id", "rank", "other", r("dist").alias("dist"))


@query("knn_self", sql(f"""select case_id, leaf_id, "rank", nbr_leaf_id, {R('sqrt(d2)')} dist from f_self"""))
def knn_self(spark, sf_dir):
    return self_edges(spark, sf_dir).select("case_id", "leaf_id", "rank", "nbr_leaf_id", r("dist").alias("dist"))


@query("nearest_centroid", sql(f"select case_id, point_id, leaf_id, {R('sqrt(d2)')} dist from f_near"))
def nearest_centroid(spark, sf_dir):
    out = N.nearest_centroid(points(spark, sf_dir), leaves(spark, sf_dir))
    return out.select("case_id", "point_id", "leaf_id", r("dist").alias("dist"))


@query("surface_gradient", sql(f"""select case_id, point_id, volume_id, 0e0 as sdf, {R('gx')} gx, {R('gy')} gy, {R('gz')} gz from (
    select s.case_id, s.point_id, v.point_id as volume_id, v.gx, v.gy, v.gz, row_number() over (partition by s.point_id
      order by ((v.x-s.x)*(v.x-s.x) + (v.y-s.y)*(v.y-s.y)) + (v.z-s.z)*(v.z-s.z), v.point_id) rn
    from f_points s join f_points v on s.case_id = v.case_id where s.is_surface and not v.is_surface) where rn = 1"""))
def surface_gradient(spark, sf_dir):
    out = N.surface_gradient(points(spark, sf_dir), ["gx", "gy", "gz"])
    return out.select("case_id", "point_id", "volume_id", "sdf", *[r(c).alias(c) for c in ("gx", "gy", "gz")])


@query("centroid_attrs", sql(f"""select case_id, leaf_id, {R('sdf')} sdf, {R('gx')} gx, {R('gy')} gy, {R('gz')} gz, {R('curv_mean')} curv_mean, {R('curv_gauss')} curv_gauss
    from f_edge where "rank" = 1"""))
def centroid_attrs(spark, sf_dir):
    cols = ["sdf", "gx", "gy", "gz", "curv_mean", "curv_gauss"]
    out = N.nearest_attributes(edges(spark, sf_dir, cols))
    return out.select("case_id", "leaf_id", *[r(c).alias(c) for c in cols])


EDGE_COLS = ["x", "y", "z", "sdf", "curv_mean", "curv_gauss", "is_surface"]


def _stats_sql() -> str:
    return f"""select case_id, leaf_id, {big('count(*)')} k_found,
      avg(rx*rx) cov_xx, avg(ry*ry) cov_yy, avg(rz*rz) cov_zz, avg(rx*ry) cov_xy, avg(rx*rz) cov_xz, avg(ry*rz) cov_yz,
      avg(d) dist_mean, max(ds) dist_std, avg(pow((d-dm)/greatest(ds,1e-8), 3e0)) dist_skew,
      ln(1e0 + {K}e0/(4e0/3e0*pi()*pow(greatest(avg(d),1e-8),3e0))) density,
      sqrt(pow(max(cx)-(min(x)+max(x))/2e0,2e0)+pow(max(cy)-(min(y)+max(y))/2e0,2e0)+pow(max(cz)-(min(z)+max(z))/2e0,2e0)) com_dist,
      min(sdf) sdf_min, max(sdf) sdf_max, max(sdf)-min(sdf) sdf_range,
      avg(rx/greatest(d,1e-8)) dir_x, avg(ry/greatest(d,1e-8)) dir_y, avg(rz/greatest(d,1e-8)) dir_z,
      1e0 - sqrt(pow(avg(rx/greatest(d,1e-8)),2e0)+pow(avg(ry/greatest(d,1e-8)),2e0)+pow(avg(rz/greatest(d,1e-8)),2e0)) angular_span,
      avg(curv_mean) curv_mean_avg, avg(curv_gauss) curv_gauss_avg, count(*) filter (where is_surface)/{K}e0 surf_ratio
    from (select *, avg(d) over w dm, stddev_pop(d) over w ds from (
        select e.*, l.x cx, l.y cy, l.z cz, e.x-l.x rx, e.y-l.y ry, e.z-l.z rz, sqrt(d2) d
        from f_edge e join f_leaves l on e.case_id = l.case_id and e.leaf_id = l.leaf_id)
      window w as (partition by case_id, leaf_id))
    group by case_id, leaf_id"""


define("f_leafstats", _stats_sql())


@query("leaf_stats", sql(f"select case_id, leaf_id, k_found, {', '.join(f'{R(n, 5)} as {n}' for n in N.STAT_NAMES)} from f_leafstats"))
def leaf_stats(spark, sf_dir):
    out = N.leaf_stats(edges(spark, sf_dir, EDGE_COLS), leaves(spark, sf_dir), K)
    return out.select("case_id", "leaf_id", "k_found", *[r(n, 5).alias(n) for n in N.STAT_NAMES])


@query("leaf_aggregate", sql(f"""select s.case_id, s.leaf_id, {big('i - 1')} pos, {R('v[i]', 5)} value from (
    select s.case_id, s.leaf_id, [{', '.join('s.' + n for n in N.STAT_NAMES)}, e.sdf, e.gx, e.gy, e.gz, e.curv_mean, e.curv_gauss,
      l.x/550e0, l.y/550e0, l.z/550e0, {', '.join(f"coalesce(h.d{i}, 1e0)" for i in range(mesh.DIRECTIONS))}] v
    from f_leafstats s join f_edge e on s.case_id = e.case_id and s.leaf_id = e.leaf_id and e."rank" = 1
    join f_leaves l on s.case_id = l.case_id and s.leaf_id = l.leaf_id
    left join f_leafrays h on h.case_id = s.case_id and h.leaf_id = s.leaf_id) s, range(1, 47) g(i)"""))
def leaf_aggregate(spark, sf_dir):
    """Rays look at the buildings of the case with the same number; where there is none they all miss."""
    cols = [*EDGE_COLS, "gx", "gy", "gz"]
    e = materialize(edges(spark, sf_dir, cols), "edges")
    table = leaves(spark, sf_dir)
    stat = N.leaf_stats(e, table, K)
    at = N.nearest_attributes(e).select("case_id", "leaf_id", "sdf", "gx", "gy", "gz", "curv_mean", "curv_gauss")
    rays = mesh.ray_vector(mesh.ray_distance(table, vertices(spark, sf_dir), faces(spark, sf_dir)))
    joined = stat.join(at, ["case_id", "leaf_id"]).join(table, ["case_id", "leaf_id"]).join(rays, ["case_id", "leaf_id"])
    vector = encode.leaf_vector(
        F.array(*N.STAT_NAMES), F.col("sdf"), [F.col(c) for c in ("gx", "gy", "gz")], F.col("curv_mean"),
        F.col("curv_gauss"), [F.col(c) / 550.0 for c in "xyz"], F.col("pbd"),
    )
    out = joined.select("case_id", "leaf_id", F.posexplode(vector).alias("pos", "value"))
    return out.select("case_id", "leaf_id", F.col("pos").cast("bigint").alias("pos"), r("value", 5).alias("value"))


POOL = ["sdf", "gx", "gy", "gz", "is_surface", "curv_mean", "curv_gauss"]


@query("neighbour_pool", sql(f"""select e.case_id, e.leaf_id, {big('"rank" - 1')} slot,
    {', '.join(f"{R(f'(e.{a}-l.{a})/550e0')} as rel_{a}" for a in 'xyz')}, {', '.join(f"{R(f'cast(cast(e.is_surface as int) as double)' if c == 'is_surface' else f'e.{c}')} as {c}" for c in POOL)}
    from f_edge e join f_leaves l on e.case_id = l.case_id and e.leaf_id = l.leaf_id"""))
def neighbour_pool(spark, sf_dir):
    e = edges(spark, sf_dir, ["x", "y", "z", *POOL])
    pool = N.neighbour_pool(e, leaves(spark, sf_dir), POOL, scale=550.0)
    out = pool.select("case_id", "leaf_id", F.posexplode("pool").alias("slot", "v"))
    names = ["rel_x", "rel_y", "rel_z", *POOL]
    return out.select(
        "case_id", "leaf_id", F.col("slot").cast("bigint").alias("slot"), *[r(F.col("v")[i]).alias(n) for i, n in enumerate(names)]
    )


@query("neighbour_draw", sql(f"""select d.case_id, d.leaf_id, {big('d.draw')} draw, {big('d.pick')} "rank", e.point_id from (
    select case_id, leaf_id, g.i as draw, cast(floor({U("'draw'", "case_id", "'3'", "leaf_id", "g.i")} * n) as bigint) + 1 pick
    from (select case_id, leaf_id, count(*) n from f_knn group by 1, 2), range(0, 5) g(i)) d
    join f_knn e on e.case_id = d.case_id and e.leaf_id = d.leaf_id and e."rank" = d.pick"""))
def neighbour_draw(spark, sf_dir):
    return N.neighbour_draw(edges(spark, sf_dir), 5, K, epoch=3)


define("f_idw", f"""select case_id, point_id, "rank", leaf_id, w / sum(w) over (partition by point_id) as weight from (
    select q.case_id, q.point_id, s.nbr_leaf_id as leaf_id, 1e0/(sqrt(e2)+1e-8) w, row_number() over (partition by q.point_id order by e2, s.nbr_leaf_id) as "rank"
    from f_near q join (select case_id, leaf_id, nbr_leaf_id from f_self) s on q.case_id = s.case_id and q.leaf_id = s.leaf_id
    join f_leaves l on l.case_id = s.case_id and l.leaf_id = s.nbr_leaf_id,
      lateral (select ((q.x-l.x)*(q.x-l.x) + (q.y-l.y)*(q.y-l.y)) + (q.z-l.z)*(q.z-l.z) as e2))
    where "rank" <= {K_IDW}""")


def idw(spark, sf_dir):
    table = materialize(leaves(spark, sf_dir), "leaves")
    near = materialize(N.nearest_centroid(points(spark, sf_dir), table), "near")
    around = knn_join(table, table, K_SELF, query_id="leaf_id", target_id="leaf_id", exclude_same_id=True)
    return N.idw_weights(near, around, table, K_IDW)


@query("idw_weights", sql(f"""select case_id, point_id, "rank", leaf_id, {R('weight')} weight from f_idw"""))
def idw_weights(spark, sf_dir):
    return idw(spark, sf_dir).select("case_id", "point_id", "rank", "leaf_id", r("weight").alias("weight"))


@query("idw_interpolate", sql(f"""select w.case_id, w.point_id, {R('sum(w.weight*l.x)')} x, {R('sum(w.weight*l.y)')} y, {R('sum(w.weight*l.z)')} z
    from f_idw w join f_leaves l on w.case_id = l.case_id and w.leaf_id = l.leaf_id group by 1, 2"""))
def idw_interpolate(spark, sf_dir):
    out = N.idw_interpolate(materialize(idw(spark, sf_dir), "weights"), leaves(spark, sf_dir), ["x", "y", "z"])
    return out.select("case_id", "point_id", *[r(c).alias(c) for c in "xyz"])


@query("idw_check", sql(f"""select {big('count(*)')} n_queries, {big('count(*) filter (where abs(s - 1e0) > 1e-2)')} n_off
    from (select point_id, sum(weight) s from f_idw group by 1)"""))
def idw_check(spark, sf_dir):
    from pointprep.operators.quality import idw_check as check

    return check(idw(spark, sf_dir))


_LEAFN = "select l.case_id, l.leaf_id, c.n from f_leaves l join (select case_id, count(*) n from f_leaves group by 1) c on l.case_id = c.case_id"
define("f_leafn", _LEAFN)
define("f_graph", f"""select case_id, leaf_id, 'local' as kind, {big('"rank" - 1')} slot, nbr_leaf_id as key_id from f_self
    union all select case_id, leaf_id, 'register', {big('g.i')}, {big('n + g.i')} from f_leafn, range(0, {N_REGISTER}) g(i)
    union all select case_id, leaf_id, 'random', {big('g.i')}, cast(floor({U("'key'", "case_id", "'2'", "leaf_id", "g.i")} * n) as bigint)
      from f_leafn, range(0, {N_RANDOM}) g(i)""")


def graph(spark, sf_dir):
    return N.graph_edges(self_edges(spark, sf_dir), leaves(spark, sf_dir), N_RANDOM, N_REGISTER, epoch=2)


@query("graph_edges", sql("select case_id, leaf_id, kind, slot, key_id from f_graph"))
def graph_edges(spark, sf_dir):
    return graph(spark, sf_dir)


@query("graph_edges_excl", sql(f"""select case_id, leaf_id, {big('rn - 1')} slot, key_id from (
    select c.*, row_number() over (partition by case_id, leaf_id order by first_slot) rn from (
      select case_id, leaf_id, key_id, min(i) first_slot from (
        select case_id, leaf_id, g.i, cast(floor({U("'other'", "case_id", "'2'", "leaf_id", "g.i")} * n) as bigint) key_id
        from f_leafn, range(0, {N_RANDOM + 8}) g(i)
        union all select l.case_id, l.leaf_id, g.i + {N_RANDOM + 8},
          cast((floor({U("'fill'", "l.case_id", "'2'", "l.leaf_id")} * n) + g.i * {N.STEPS[0]}) as bigint) % n
        from f_leafn l, range(0, 1000) g(i) where g.i < n) group by 1, 2, 3) c
    where not exists (select 1 from f_self s where s.case_id = c.case_id and s.leaf_id = c.leaf_id and s.nbr_leaf_id = c.key_id))
    where rn <= {N_RANDOM}"""))
def graph_edges_excl(spark, sf_dir):
    return N.random_edges_excluding(self_edges(spark, sf_dir), leaves(spark, sf_dir), N_RANDOM, 8, epoch=2)


@query("block_adjacency", sql(f"""select case_id, {big('q_block')} q_block, {big('k_block')} k_block, {big('count(*) over (partition by case_id, q_block)')} n_keys from (
    select case_id, leaf_id // {BLOCK} q_block, key_id // {BLOCK} k_block from f_graph
    union select case_id, r.i, a.i from (select case_id, count(*) n from f_leaves group by 1) c, range(0, 40) r(i), range(0, 40) a(i)
      where r.i >= n // {BLOCK} and r.i < (n + {N_REGISTER} + {BLOCK - 1}) // {BLOCK} and a.i < (n + {N_REGISTER} + {BLOCK - 1}) // {BLOCK}
    union select case_id, a.i, r.i from (select case_id, count(*) n from f_leaves group by 1) c, range(0, 40) r(i), range(0, 40) a(i)
      where r.i >= n // {BLOCK} and r.i < (n + {N_REGISTER} + {BLOCK - 1}) // {BLOCK} and a.i < (n + {N_REGISTER} + {BLOCK - 1}) // {BLOCK})"""))
def block_adjacency(spark, sf_dir):
    return N.block_adjacency(graph(spark, sf_dir), leaves(spark, sf_dir), N_REGISTER, BLOCK)


_PAIRS = [(a, f"{1.0 / encode.ROTARY_BASE ** (2.0 * i / d)!r}") for a, d in zip("xyz", encode.ROTARY_DIMS) for i in range(d // 2)]
_ROPE = ", ".join(f"(l.{a}/550e0) * cast('{w}' as double) * s{a}" for a, w in _PAIRS)


@query("rope_features", sql(f"""select case_id, leaf_id, {big('i - 1')} pos, {R('cos(v[i])')} cos_v, {R('sin(v[i])')} sin_v from (
      select l.case_id, l.leaf_id, [{_ROPE}] v from f_leaves l join f_strata c on l.case_id = c.case_id join
        (select sub_bin, max(scale) filter (where axis = 'x') sx, max(scale) filter (where axis = 'y') sy, max(scale) filter (where axis = 'z') sz
         from f_scale group by 1) k on k.sub_bin = c.sub_bin), range(1, {len(_PAIRS) + 1}) g(i)
    union all select case_id, {big('n + t.i')}, {big('g.i - 1')}, 1e0, 0e0
      from (select l.case_id, count(*) n from f_leaves l join f_strata c on l.case_id = c.case_id group by 1), range(0, {REGISTERS}) t(i), range(1, {len(_PAIRS) + 1}) g(i)"""))
def rope_features(spark, sf_dir):
    """Each case turns by the scales of its own stratum."""
    table = leaves(spark, sf_dir).join(stratified(spark, sf_dir).select("case_id", "sub_bin"), "case_id")
    scaled = N.with_stratum_scale(table, axis_scale(train_leaves(spark, sf_dir)))
    out = N.rotary_features(scaled, [F.col("axis_scale")[i] for i in range(3)], registers=REGISTERS, divisor=550.0)
    wide = out.select("case_id", "leaf_id", F.posexplode(F.arrays_zip("cos_v", "sin_v")).alias("pos", "e"))
    return wide.select("case_id", "leaf_id", F.col("pos").cast("bigint").alias("pos"), r("e.cos_v").alias("cos_v"), r("e.sin_v").alias("sin_v"))
