"""Sinks and sources: results written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointprep.operators import metrics, stats, strata
from pointprep.plans import workflows
from pointprep.registry.core import query
from pointprep.registry.curation import CHANNELS, N_TEST, N_TRAIN, N_VAL, manifest_rows, stratified, train_points, verdicts
from pointprep.registry.evaluation import per_channel
from pointprep.registry.fixtures import R, U, big, define, points, r, sql, table
from pointprep.registry.shapes import EPS, MIN_SAMPLES
from pointprep.session import scratch_path
from pointprep.sources import files


@query("manifest_files", sql("""select cast(case_id as varchar) as case_name, sub_bin, n_buildings, n_volume, n_surface, split from f_split"""))
def manifest_files(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    files.write_manifest(manifest_rows(spark, sf_dir), path)
    return files.read_manifest(spark, path)


@query("norm_stats_file", sql(f"""select channel as feature, {big(0)} as channel, {R('mean')} mean, {R('std')} std from f_norm"""))
def norm_stats_file(spark, sf_dir):
    path = scratch_path(spark, "norms")
    norms = stats.norm_stats(train_points(spark, sf_dir), CHANNELS)
    files.write_norm_stats(norms.select(F.col("channel").alias("feature"), F.lit(0).cast("bigint").alias("channel"), "mean", "std"), path)
    back = files.read_norm_stats(spark, path)
    return back.select("feature", "channel", r("mean").alias("mean"), r("std").alias("std"))


@query("metrics_files", sql(f"select case_id, {R('mean_rel_l2')} mean_rel_l2 from f_relmean"))
def metrics_files(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    files.write_metrics(metrics.rel_l2_mean(per_channel(spark, sf_dir)).withColumn("_rows", F.lit(1)), path)
    back = files.read_metrics(spark, path, "case_id bigint, mean_rel_l2 double")
    return back.select("case_id", r("mean_rel_l2").alias("mean_rel_l2"))


@query("prepared_files", sql(f"""select p.case_id, p.point_id, s.split, {R('x')} x from f_points p join f_split s on p.case_id = s.case_id"""))
def prepared_files(spark, sf_dir):
    path = scratch_path(spark, "prepared")
    split = manifest_rows(spark, sf_dir).select("case_id", "split")
    files.write_prepared(points(spark, sf_dir).select("case_id", "point_id", "x").join(split, "case_id"), path)
    return spark.read.parquet(path).select("case_id", "point_id", "split", r("x").alias("x"))


define("f_built", """select s.case_id, s.n_volume, s.n_surface, count(distinct d.label) n_buildings from f_stats s
    join f_verdict v on s.case_id = v.case_id and v.rule = 'normal' left join f_dbscan d on d.case_id = s.case_id group by 1, 2, 3""")
define("f_built_strata", """select *, "range" || case when row_number() over (partition by "range" order by n_volume, case_id)
      <= count(*) over (partition by "range") // 2 then '_easy' else '_hard' end as sub_bin
    from (select *, case when n_buildings <= 19 then '0-19' when n_buildings <= 39 then '20-39' when n_buildings <= 59 then '40-59'
      when n_buildings <= 79 then '60-79' else '80-123' end as "range" from f_built)""")


@query("curated_cases", sql(f"""select case_id, sub_bin, {big('n_buildings')} n_buildings, n_volume, n_surface,
      case when rn <= {N_TRAIN} then 'train' when rn <= {N_TRAIN + N_VAL} then 'val' else 'test' end as split
    from (select *, row_number() over (partition by sub_bin order by {U("'split'", "'42'", "case_id")}, case_id) rn from f_built_strata)
    where rn <= {N_TRAIN + N_VAL + N_TEST}""", recursive=True))
def curated_cases(spark, sf_dir):
    """The curation job with clusters of the points' own XY as buildings."""
    p = points(spark, sf_dir)
    centres = p.select("case_id", F.col("point_id").alias("face_id"), "x", "y")
    chosen, _, _, _ = workflows.curate(p, centres, EPS, MIN_SAMPLES, N_TRAIN, N_VAL, N_TEST)
    return chosen.select("case_id", "sub_bin", "n_buildings", "n_volume", "n_surface", "split")


BAD_CASE = "case_id % 13 = 4"
define("f_unread", "select c_custkey as case_id from customer where not exists (select 1 from orders where o_custkey = c_custkey)")


@query("manifest_document", sql(f"""
    with kept as (select s.* from f_stats s join f_verdict v on s.case_id = v.case_id and v.rule = 'normal'),
    facts as (
      select 'total' as section, 'scanned' as name, {big('count(*)')} v from (select case_id from f_verdict union all select case_id from f_unread)
      union all select 'total', 'load_failed', {big('count(*)')} from f_unread
      union all select 'total', 'dropped', {big('count(*)')} from f_verdict where rule <> 'normal'
      union all select 'pool', sub_bin, {big('count(*)')} from f_strata group by 2
      union all select 'split', split, {big('count(*)')} from f_split group by 2
      union all select 'n_volume', 'min', {big('min(n_volume)')} from kept
      union all select 'n_volume', 'max', {big('max(n_volume)')} from kept
      union all select 'n_volume', 'median', {big('list(n_volume order by n_volume)[count(*)//2 + 1]')} from kept)
    select section, name, cast(v as varchar) as value from facts
    union all select * from (values ('parameter', 'seed', '42'), ('parameter', 'eps', '{EPS}'), ('parameter', 'n_train', '{N_TRAIN}')) p(section, name, value)"""))
def manifest_document(spark, sf_dir):
    """Customers without orders stand in for cases that cannot be read; a part of the document is shown."""
    flagged, placed = verdicts(spark, sf_dir), stratified(spark, sf_dir)
    chosen = strata.stratified_split(placed, N_TRAIN, N_VAL, N_TEST)
    errors = unread(spark, sf_dir)
    facts = workflows.manifest_facts(chosen, placed, flagged, errors, eps=EPS, min_samples=MIN_SAMPLES, n_train=N_TRAIN, n_val=N_VAL, n_test=N_TEST)
    path = scratch_path(spark, "document")
    files.write_manifest_document(facts, path)
    shown = F.col("section").isin("total", "pool", "split", "n_volume") | F.col("name").isin("seed", "eps", "n_train")
    return files.read_manifest_facts(spark, path).filter(shown)


def unread(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select(
        F.col("c_custkey").alias("case_id"), F.lit("unreadable_or_empty").alias("reason")
    )


@query("feature_reuse", sql(f"""select case_id, {big('count(*)')} n, {R('avg(x)')} x, cast(case when {BAD_CASE} then 2 else 1 end as integer) as generation
    from f_points group by 1"""))
def feature_reuse(spark, sf_dir):
    """Features of all cases, then again after a thirteenth of the cases has got other values: only these are made anew."""
    path = scratch_path(spark, "reuse")
    now = points(spark, sf_dir).select("case_id", "point_id", "x")
    before = now.withColumn("x", F.when(F.expr(BAD_CASE), F.col("x") + 1.0).otherwise(F.col("x")))

    def make(rows):
        return rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"))

    files.reuse_unchanged(spark, path, before, {"k": 1}, make)
    out = files.reuse_unchanged(spark, path, now, {"k": 1}, make)
    return out.select("case_id", "n", r("x").alias("x"), "generation")
