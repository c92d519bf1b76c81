"""Scans and row-wise operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pointprep.functions import encode, scalar as S
from pointprep.operators import batching, binning, sampling as sampling_ops
from pointprep.registry.core import query
from pointprep.registry.fixtures import R, big, points, predictions, r, sql, table
from pointprep.sources import tables

MAX_RANGE = 220.0


@query("scan_points", sql(f"""
    select {big('case_id')} case_id, {big('point_id')} point_id, is_surface, {R('x')} x, {R('y')} y, {R('z')} z,
           {R('coalesce(area, 1e0)')} area
    from f_points"""))
def scan_points(spark, sf_dir):
    p = tables.with_default(points(spark, sf_dir), "area", 1.0)
    return p.select("case_id", "point_id", "is_surface", r("x").alias("x"), r("y").alias("y"), r("z").alias("z"), r("area").alias("area"))


@query("union_points", sql(f"""
    select case_id, point_id, false as is_surface, {R('x')} x, {R('sdf')} sdf from f_points where not is_surface
    union all
    select case_id, point_id, true, {R('x')}, 0e0 from f_points where is_surface"""))
def union_points(spark, sf_dir):
    p = points(spark, sf_dir)
    u = tables.union_points(
        p.filter(~F.col("is_surface")).select("case_id", "point_id", "x", "sdf"),
        p.filter("is_surface").select("case_id", "point_id", "x"),
    )
    return u.select("case_id", "point_id", "is_surface", r("x").alias("x"), r(F.coalesce("sdf", F.lit(0.0))).alias("sdf"))


@query("load_report", sql(f"""
    with per_case as (
      select case_id, count(*) as n_rows, sum(case when is_surface then 1 else 0 end) as n_surface,
             sum(case when sdf >= {MAX_RANGE}e0 or isnan(sdf) or sdf is null then 1 else 0 end) as n_bad
      from f_points group by 1),
    judged as (
      select case_id, case when n_surface = 0 then 'no_surface' when n_surface = n_rows then 'no_volume'
                           when n_bad > 0 then 'sdf_out_of_range' end as reason from per_case),
    numbered as (select *, row_number() over (partition by reason order by case_id) rn from judged)
    select coalesce(reason, 'good') as reason, {big('count(*)')} as n,
           case when reason is null then '' else string_agg(cast(case_id as varchar), ',' order by case_id) filter (where rn <= 10) end as first_cases
    from numbered group by reason"""))
def load_report(spark, sf_dir):
    judged = tables.judge_cases(points(spark, sf_dir), "case_id", "is_surface", "sdf", MAX_RANGE)
    return tables.load_report(judged, "case_id")


@query("sdf_fix", sql(f"""
    select point_id, {R('-sdf_raw')} sdf, {R('-gx_raw')} gx, {R('-gy_raw')} gy, {R('-gz_raw')} gz
    from f_points where not is_surface"""))
def sdf_fix(spark, sf_dir):
    p = points(spark, sf_dir).filter(~F.col("is_surface"))
    p = p.withColumn("grad", F.struct(*[F.col(f"g{c}_raw").alias(c) for c in "xyz"]))
    p = tables.flip_distance(p, "sdf_raw", "grad", ("x", "y", "z"))
    return p.select("point_id", r("sdf_raw").alias("sdf"), *[r(f"grad.{c}").alias(f"g{c}") for c in "xyz"])


@query("coord_norm", sql(f"""
    select point_id, {R('x/550e0')} x, {R('y/550e0')} y, {R('z/550e0')} z, {R('(x/550e0)*550e0')} x_back from f_points"""))
def coord_norm(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select(
        "point_id",
        *[r(F.col(c) / S.COORD_MAX).alias(c) for c in "xyz"],
        r(F.col("x") / S.COORD_MAX * S.COORD_MAX).alias("x_back"),
    )


@query("detrend", sql(f"""
    select point_id, {R('p + 9.81e0*z')} p_train, {R('p + 9.81e0*z - 9.81e0*z')} p_back from f_points"""))
def detrend(spark, sf_dir):
    trained = S.detrend("p", "z")
    return points(spark, sf_dir).select("point_id", r(trained).alias("p_train"), r(S.retrend(trained, "z")).alias("p_back"))


@query("range_label", sql(f"""
    select case_id, {big('n')} n, case when n <= 19 then '0-19' when n <= 39 then '20-39' when n <= 59 then '40-59'
         when n <= 79 then '60-79' else '80-123' end as "range"
    from (select case_id, count(*) n from f_points group by 1)"""))
def range_label(spark, sf_dir):
    return (
        points(spark, sf_dir).groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).withColumn("range", S.range_label("n"))
    )


EDGES = S.sdf_bin_edges()
BIN_SQL = (
    "case when sdf is null or isnan(sdf) or sdf >= 1100e0 then null "
    + " ".join(f"when sdf < {e!r}e0 then {i}" for i, e in enumerate(EDGES))
    + f" else {len(EDGES)} end"
)


@query("sdf_bins", sql(f"select point_id, {R('sdf')} sdf, {big(BIN_SQL)} as bin from f_points"))
def sdf_bins(spark, sf_dir):
    return binning.with_bins(points(spark, sf_dir)).select("point_id", r("sdf").alias("sdf"), "bin")


WEIGHT_SQL = (
    "case when sdf < -3e0 then 5e-2 when sdf < 0e0 then 6e0 when sdf < 1.5e0 then 6e0 + 2e0*sdf/1.5e0 "
    "when sdf < 2.5e0 then 8e0 when sdf < 5e0 then 8e0 - 2e0*(sdf-2.5e0)/2.5e0 "
    "when sdf < 50e0 then 6e0 - 3e0*(sdf-5e0)/45e0 when sdf < 80e0 then 3e0 - 2.5e0*(sdf-50e0)/30e0 "
    "else greatest(5e-1 - 3e-1*(sdf-80e0)/300e0, 1e-1) end"
)


@query("sample_weight", sql(f"""
    select point_id, {R(WEIGHT_SQL)} w, {R(f'ln(greatest({WEIGHT_SQL}, 1e-10))')} log_w from f_points"""))
def sample_weight(spark, sf_dir):
    return points(spark, sf_dir).select(
        "point_id", r(S.sample_weight("sdf")).alias("w"), r(S.log_sample_weight("sdf")).alias("log_w")
    )


@query("stratum_params", sql(f"""
    select case_id, sub_bin, {big('''case sub_bin when '0-19_easy' then 8192 when '0-19_hard' then 16384
      when '20-39_easy' then 24576 when '20-39_hard' then 32768 when '40-59_easy' then 40960
      when '40-59_hard' then 49152 when '60-79_easy' then 57344 when '60-79_hard' then 65536
      when '80-123_easy' then 73728 when '80-123_hard' then 81920 else 40960 end''')} leaves,
      {big('''case sub_bin when '0-19_easy' then 4 when '0-19_hard' then 4
      when '20-39_easy' then 4 when '20-39_hard' then 4 when '40-59_easy' then 2
      when '40-59_hard' then 2 when '60-79_easy' then 2 else 1 end''')} batch_size
    from (select case_id, case when n < 50 then 'unknown' when n <= 59 then '40-59_easy' when n <= 79 then '60-79_hard' else '80-123_easy' end sub_bin
          from (select case_id, count(*) n from f_points group by 1))"""))
def stratum_params(spark, sf_dir):
    cases = points(spark, sf_dir).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    stratum = F.when(n < 50, "unknown").when(n <= 59, "40-59_easy").when(n <= 79, "60-79_hard").otherwise("80-123_easy")
    return batching.stratum_params(cases.select("case_id", stratum.alias("sub_bin")))


@query("query_counts", sql(f"""
    select case_id, {big('least(t - s, nv)')} n_query_vol, {big('s')} n_query_surf from (
      select case_id, nv, t, least(ns, cast(floor(t * ns / (ns + nv/2e0)) as bigint)) s
      from (select case_id, 40e0 t, sum(case when is_surface then 0 else 1 end) nv, sum(case when is_surface then 1 else 0 end) ns
            from f_points group by 1))"""))
def query_counts(spark, sf_dir):
    counts = points(spark, sf_dir).groupBy("case_id").agg(
        F.count_if(~F.col("is_surface")).alias("nv"), F.count_if("is_surface").alias("ns")
    )
    n_vol, n_surf = S.query_split("nv", "ns", 40)
    return counts.select("case_id", n_vol.alias("n_query_vol"), n_surf.alias("n_query_surf"))


FOURIER = ["ux", "uy", "uz", "p", "gx", "gy", "gz"]
FREQS = 10
_WAVES = [f"{c}/1e2" for c in FOURIER] + [
    f"{fn}({c}/1e2 * {(2.0**k * math.pi)!r}e0)" for c in FOURIER for fn in ("sin", "cos") for k in range(FREQS)
]


@query("fourier_features", sql(f"select point_id, {', '.join(f'{R(w)} as f{i}' for i, w in enumerate(_WAVES))} from f_points"))
def fourier_features(spark, sf_dir):
    p = points(spark, sf_dir).select("point_id", *[(F.col(c) / 100.0).alias(c) for c in FOURIER])
    wide = p.select("point_id", encode.fourier(FOURIER, FREQS).alias("v"))
    return wide.select("point_id", *[r(F.col("v")[i]).alias(f"f{i}") for i in range(len(_WAVES))])


@query("vector_mean", f"""
    select label, {big('i - 1')} pos, {R('avg(cast(embedding[i] as double))')} mean
    from (select cast(label as bigint) as label, embedding, unnest(range(1, len(embedding)+1)) i from embeddings) group by 1, 2""")
def vector_mean(spark, sf_dir):
    from pointprep.operators.stats import vector_mean as mean_of

    e = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("bigint"))
    out = mean_of(e, ["label"], "embedding").select("label", F.posexplode("mean_vector").alias("pos", "mean"))
    return out.select("label", F.col("pos").cast("bigint").alias("pos"), r("mean").alias("mean"))
