"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pointprep.operators import quality as Q
from pointprep.operators import stats
from pointprep.functions.scalar import STRATA
from pointprep.registry.core import query
from pointprep.registry.curation import CHANNELS, _joined, manifest_rows, stratified, train_points
from pointprep.registry.fixtures import R, big, points, r, sql, table
from pointprep.schema import POINT_FEATURES, POINTS

ZCOLS = ["ux", "uy", "p"]


@query("zscore_sanity", sql(f"""
    with z as (select t.case_id, {', '.join(f'(t.{c} - n_{c}.mean)/greatest(n_{c}.std, 1e-8) as {c}' for c in ZCOLS)} from f_points t {_joined(ZCOLS)}),
    l as ({' union all '.join(f"select case_id, '{c}' as feature, avg({c}) m, stddev_pop({c}) s from z group by 1" for c in ZCOLS)})
    select case_id, feature, {R('m', 5)} mean, {R('s', 5)} std, abs(m) > 2e0 or s < 1e-1 or s > 5e0 as odd from l"""))
def zscore_sanity(spark, sf_dir):
    lookup = stats.stats_lookup(stats.norm_stats(train_points(spark, sf_dir), {c: c for c in ZCOLS}))
    z = stats.zscore_apply(points(spark, sf_dir).select("case_id", *ZCOLS), lookup)
    return Q.zscore_sanity(z, ZCOLS).select("case_id", "feature", r("mean", 5).alias("mean"), r("std", 5).alias("std"), "odd")


_NAMES = " union all ".join(f"select distinct event_type || '_{s}' as name from events" for s in ("mean", "std"))
_SB = ", ".join(f"('{s}')" for s in STRATA)


@query("stats_missing", sql(f"""
    select name from (select g || s as name from (select distinct event_type g from events union select 'missing_group') a, (values ('_mean'), ('_std')) b(s)
      union select 'scale:' || v.sb from (values {_SB}) v(sb)) where name not in
      (select event_type || '_mean' from events union select event_type || '_std' from events where value > 0
       union select 'scale:' || sub_bin from f_strata)"""))
def stats_missing(spark, sf_dir):
    """Expected groups are the event types and one that does not occur; scales exist for populated strata."""
    e = table(spark, sf_dir, "events").select("event_type", "value")
    found = e.groupBy("event_type").agg(F.count_if(F.col("value") > 0).alias("n"))
    names = found.select(F.explode(F.array(
        F.concat("event_type", F.lit("_mean")), F.when(F.col("n") > 0, F.concat("event_type", F.lit("_std")))
    )).alias("name")).filter("name is not null")
    scales = stratified(spark, sf_dir).select(F.concat(F.lit("scale:"), "sub_bin").alias("name")).distinct()
    groups = [row["event_type"] for row in found.select("event_type").collect()] + ["missing_group"]
    return Q.stats_missing(names.unionByName(scales), groups=groups)


@query("missing_entries", sql(f"""
    with present as (select distinct case_id from f_points where sdf > 60e0),
    gone as (select *, row_number() over (partition by split order by case_id) rn from f_split_all s
             where not exists (select 1 from present p where p.case_id = s.case_id))
    select t.split, {big('t.n')} n, {big('coalesce(g.n, 0)')} n_missing, coalesce(g.firsts, '') first_missing
    from (select split, count(*) n from f_split_all group by 1) t left join
      (select split, count(*) n, string_agg(cast(case_id as varchar), ',' order by case_id) filter (where rn <= 5) firsts from gone group by 1) g on t.split = g.split
    """.replace("f_split_all", "f_split").replace("*, row_number()", "s.split, s.case_id, row_number()")))
def missing_entries(spark, sf_dir):
    """Cases of the manifest without any far point."""
    far = points(spark, sf_dir).filter("sdf > 60")
    return Q.missing_entries(manifest_rows(spark, sf_dir).select("case_id", "split"), far)


@query("manifest_issues", sql(f"""
    with m as (select case_id, split, case when n_surface <= n_volume then sub_bin else 'other' end sub_bin from f_split)
    select v.split as item, 'unknown_stratum' as "check", 'warning' as level, {big("count(*)")} n from (values ('train'), ('val'), ('test')) v(split)
      join m on m.split = v.split where m.sub_bin = 'other' group by 1
    union all select v.split, 'empty_split', 'warning', 1 from (values ('train'), ('val'), ('test')) v(split) where not exists (select 1 from m where m.split = v.split)"""))
def manifest_issues(spark, sf_dir):
    odd = F.when(F.col("n_surface") <= F.col("n_volume"), F.col("sub_bin")).otherwise(F.lit("other"))
    return Q.manifest_issues(manifest_rows(spark, sf_dir).withColumn("sub_bin", odd)).select("item", "check", "level", "n")


PROFILE = ["x", "y", "z", "area", "nut"]
# Readings that have gone wrong.
_ODD = "case when y < 3e0 then cast('NaN' as double) when y > 98e0 then cast('Infinity' as double) else nut end"


@query("column_profile", sql(" union all ".join(
    f"""select '{c}' as column_name, {big('count(*)')} n, {big(f'count(*) filter (where {c} is null)')} n_null, {big(f'count(*) filter (where isnan({c}))')} n_nan,
        {big(f'count(*) filter (where isinf({c}))')} n_inf, {R(f'min({c}) filter (where isfinite({c}))')} low, {R(f'max({c}) filter (where isfinite({c}))')} high from (select x, y, z, area, {_ODD} nut from f_points)""" for c in PROFILE)))
def column_profile(spark, sf_dir):
    out = Q.column_profile(points(spark, sf_dir).withColumn("nut", F.expr(_ODD)), PROFILE)
    return out.select("column_name", "n", "n_null", "n_nan", "n_inf", r("low").alias("low"), r("high").alias("high"))


@query("dq_status", sql(f"""
    with warn as (select (select count(distinct split) from f_split where n_surface > n_volume)
        + (select count(*) from (values ('train'), ('val'), ('test')) v(split) where v.split not in (select split from f_split)) n),
    odd as (select count(*) n from (select case_id from f_points group by 1 having max(sdf) >= 220e0))
    select {big('odd.n')} failures, {big('warn.n')} warnings, {big('case when odd.n > 0 then 1 when warn.n > 0 then 2 else 0 end')} status from warn, odd"""))
def dq_status(spark, sf_dir):
    from pointprep.sources.tables import judge_cases

    odd = F.when(F.col("n_surface") <= F.col("n_volume"), F.col("sub_bin")).otherwise(F.lit("other"))
    warnings = Q.manifest_issues(manifest_rows(spark, sf_dir).withColumn("sub_bin", odd))
    judged = judge_cases(points(spark, sf_dir), "case_id", "is_surface", "sdf", 220.0)
    failures = judged.filter("reason = 'sdf_out_of_range'").withColumn("level", F.lit("failure"))
    return Q.dq_status(warnings, failures)


_REQUIRED = ["case_id", "point_id", "is_surface", "x", "y", "z", "sdf", "area", "curv_mean", "ghost"]


@query("contract", sql(f"""
    with c as (select *, case_id % 2 = 0 as original_sdf_volume, cast(null as double) as curv_mean from f_points)
    select 'case_id' as item, 'wrong_type' as problem, {big('count(*) filter (where case_id is null)')} n_missing from c
    {" ".join(f"union all select '{n}', null, {big(f'count(*) filter (where {n} is null)')} from c" for n in ("point_id", "is_surface", "x", "y", "z", "sdf", "area"))}
    union all select 'curv_mean', 'missing_values', {big('count(*)')} from c
    union all select 'ghost', 'missing_column', {big('count(*)')} from c
    union all select 'original_sdf_volume', 'leftover_column', {big('count(*) filter (where original_sdf_volume is null)')} from c"""))
def contract(spark, sf_dir):
    """The points against their required columns: numbers where names are asked for, an empty, an absent and a leftover column."""
    have = points(spark, sf_dir).withColumns({"original_sdf_volume": F.col("case_id") % 2 == 0, "curv_mean": F.lit(None).cast("double")})
    need = [f for f in (*POINTS, *POINT_FEATURES) if f.name in _REQUIRED] + [StructField("ghost", DoubleType())]
    return Q.contract_report(have, StructType(need))
