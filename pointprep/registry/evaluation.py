"""Prediction errors and their roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointprep.functions.scalar import magnitude
from pointprep.operators import metrics as M
from pointprep.operators import quality
from pointprep.registry.core import query
from pointprep.registry.fixtures import R, big, define, points, predictions, r, sql, table
from pointprep.session import materialize

define("f_rel", """select case_id, channel, sqrt(sum(pow(pred - target, 2e0))) / greatest(sqrt(sum(pow(target, 2e0))), 1e-12) rel_l2
    from f_pred group by 1, 2""")
define("f_relmean", "select case_id, avg(rel_l2) mean_rel_l2 from f_rel group by 1")


def per_channel(spark, sf_dir):
    return M.rel_l2(predictions(spark, sf_dir), ["case_id", "channel"])


@query("rel_l2", sql(f"select case_id, channel, {R('rel_l2')} rel_l2 from f_rel"))
def rel_l2(spark, sf_dir):
    return per_channel(spark, sf_dir).withColumn("rel_l2", r("rel_l2"))


@query("rel_l2_vector", sql(f"""select case_id, {R('sqrt(sum(pow(pred - target, 2e0))) / greatest(sqrt(sum(pow(target, 2e0))), 1e-12)')} rel_l2
    from f_pred group by 1"""))
def rel_l2_vector(spark, sf_dir):
    return M.rel_l2(predictions(spark, sf_dir), ["case_id"]).withColumn("rel_l2", r("rel_l2"))


@query("rel_l2_mean", sql(f"select case_id, {R('mean_rel_l2')} mean_rel_l2 from f_relmean"))
def rel_l2_mean(spark, sf_dir):
    return M.rel_l2_mean(per_channel(spark, sf_dir)).withColumn("mean_rel_l2", r("mean_rel_l2"))


SQ = "pow((pred - target)/1e4, 2e0)"


def scaled(spark, sf_dir):
    return predictions(spark, sf_dir).withColumns({"pred": F.col("pred") / 1e4, "target": F.col("target") / 1e4})


@query("masked_mse", sql(f"""select case_id,
    {R("coalesce(sum(pow(pred/1e4 - target/1e4, 2e0)) filter (where ok and not is_surf), 0e0) / greatest(count(*) filter (where ok and not is_surf), 1)")} vol_mse,
    {R("coalesce(sum(pow(pred/1e4 - target/1e4, 2e0)) filter (where ok and is_surf), 0e0) / greatest(count(*) filter (where ok and is_surf), 1)")} surf_mse
    from (select *, z <= 40e0 as ok from f_pred) group by 1"""))
def masked_mse(spark, sf_dir):
    out = M.masked_mse(scaled(spark, sf_dir), ["case_id"], F.col("is_surf"), F.col("z") <= 40.0)
    return out.select("case_id", r("vol_mse").alias("vol_mse"), r("surf_mse").alias("surf_mse"))


@query("curve_mse", sql(f"""select {R('avg(v)')} vol_mse, {R('avg(s)')} surf_mse, {R('avg(v + s)')} total_mse from (
    select case_id, coalesce(avg(pow(pred/1e4 - target/1e4, 2e0)) filter (where not is_surf), 0e0) v,
           coalesce(avg(pow(pred/1e4 - target/1e4, 2e0)) filter (where is_surf), 0e0) s from f_pred group by 1)"""))
def curve_mse(spark, sf_dir):
    out = M.curve_mse(scaled(spark, sf_dir), F.col("is_surf"))
    return out.select(*[r(c).alias(c) for c in out.columns])


@query("weighted_mean", sql(f"""select channel, {R('sum(m*n)/greatest(cast(sum(n) as double), 1e0)')} mean, {big('sum(n)')} n
    from (select channel, case_id, avg(pred) m, count(*) n from f_pred group by 1, 2) group by 1"""))
def weighted_mean(spark, sf_dir):
    parts = predictions(spark, sf_dir).groupBy("channel", "case_id").agg(F.avg("pred").alias("mean"), F.count(F.lit(1)).alias("n"))
    return M.weighted_mean(parts, ["channel"]).withColumn("mean", r("mean"))


@query("metric_summary", sql(f"""
    with m as (select channel as metric, avg(rel_l2) mean, stddev_pop(rel_l2) std, min(rel_l2) mn, max(rel_l2) mx from f_rel group by 1)
    select metric, {R('mean')} mean, {R('std')} std, {R('mn')} as "min", {R('mx')} as "max" from m
    union all select 'overall', {R('avg(mean)')}, null, null, null from m"""))
def metric_summary(spark, sf_dir):
    out = M.metric_summary(per_channel(spark, sf_dir), "channel", "rel_l2")
    return out.select("metric", *[r(c).alias(c) for c in ("mean", "std", "min", "max")])


@query("median_case", sql(f"""select case_id, {R('mean_rel_l2')} mean_rel_l2 from (
    select *, row_number() over (order by mean_rel_l2, case_id) rn, count(*) over () n from f_relmean) where rn = n // 2 + 1"""))
def median_case(spark, sf_dir):
    per_case = materialize(M.rel_l2_mean(per_channel(spark, sf_dir)), "metrics")
    return M.median_case(per_case).withColumn("mean_rel_l2", r("mean_rel_l2"))


HEIGHTS, TOLS = (3.0, 9.0, 15.0, 21.0), (3.0, 3.0, 3.0, 3.0)
_SL = ", ".join(f"({h}e0, {t}e0)" for h, t in zip(HEIGHTS, TOLS))


@query("slice_stats", sql(f"""
    select case_id, height, field, {big('n')} n, {R('case when abs(hi - lo) < 1e-10 then lo - 5e-1 else lo end')} vmin,
      {R('case when abs(hi - lo) < 1e-10 then hi + 5e-1 else hi end')} vmax, {R('case when e < 1e-10 then 1e0 else e end')} emax
    from (select case_id, height, field, count(*) n, quantile_cont(t, 0.005e0) lo, quantile_cont(t, 0.995e0) hi, quantile_cont(abs(q - t), 0.995e0) e from (
        select case_id, h height, 'velocity' field, sqrt(ux*ux+uy*uy+uz*uz) t, sqrt(wss_x*wss_x+wss_y*wss_y+wss_z*wss_z) q
          from f_points, (values {_SL}) v(h, tol) where abs(z - h) <= tol
        union all select case_id, h, 'pressure', p, nut*1e1 from f_points, (values {_SL}) v(h, tol) where abs(z - h) <= tol)
      group by 1, 2, 3) where n >= 10"""))
def slice_stats(spark, sf_dir):
    fields = {
        "velocity": (magnitude("ux", "uy", "uz"), magnitude("wss_x", "wss_y", "wss_z")),
        "pressure": (F.col("p"), F.col("nut") * 10.0),
    }
    out = M.slice_stats(points(spark, sf_dir), fields, heights=HEIGHTS, tolerances=TOLS)
    return out.select("case_id", "height", "field", "n", *[r(c).alias(c) for c in ("vmin", "vmax", "emax")])


@query("pred_coverage", sql(f"""
    select {big('count(*) filter (where p and t)')} n_both, {big('count(*) filter (where p and not t)')} n_pred_only,
           {big('count(*) filter (where t and not p)')} n_target_only
    from (select a.id is not null p, b.id is not null t
          from (select distinct o_custkey id from orders where o_orderstatus = 'F') a full outer join (select c_custkey id from customer where c_acctbal > 0) b on a.id = b.id)"""))
def pred_coverage(spark, sf_dir):
    """Customers with finished orders stand in for predictions, those with a positive balance for targets."""
    ordered = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct()
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return quality.pred_coverage(ordered, known, ["id"])
