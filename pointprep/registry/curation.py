"""Case statistics, outliers, strata and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointprep.operators import outliers, stats, strata
from pointprep.functions.scalar import LEAVES_PER_STRATUM, STRATA
from pointprep.registry.core import query
from pointprep.registry.fixtures import R, U, big, define, leaves, points, r, sql
from pointprep.session import materialize

NAMES = stats.indicator_names()
N_TRAIN, N_VAL, N_TEST = 20, 5, 5


def _indicator_sql() -> str:
    out = []
    for fields, rows in ((stats.VOLUME_FIELDS, "not is_surface"), (stats.SURFACE_FIELDS, "is_surface")):
        for name, column in fields.items():
            out.append(f"avg(case when {rows} then {column} end) as {name}_mean")
            out.append(f"stddev_pop(case when {rows} then {column} end) as {name}_std")
    out.append("stddev_pop(case when not is_surface then ln(greatest(abs(nut), 1e-30)) end) as log_nut_std")
    return ", ".join(out)


define("f_stats", f"""select case_id, cast(count(*) filter (where not is_surface) as bigint) n_volume,
    cast(count(*) filter (where is_surface) as bigint) n_surface, {_indicator_sql()} from f_points group by case_id""")
define("f_long", " union all ".join(f"select case_id, '{n}' as indicator, {n} as value from f_stats" for n in NAMES))
define("f_dev", """select l.*, m.med, abs(l.value - m.med) dev from f_long l
    join (select indicator, median(value) med from f_long group by 1) m on l.indicator = m.indicator""")
define("f_mad", """select d.case_id, d.indicator, d.value, d.med, d.dev / greatest(1.4826e0 * s.mad, 1e-10) z_mad
    from f_dev d join (select indicator, median(dev) mad from f_dev group by 1) s on d.indicator = s.indicator""")
define("f_verdict", """select case_id, n_fields, hits, case when n_fields >= 2 then 'concordance_2' when extreme then 'extreme_single'
      else 'normal' end as rule from (
        select case_id, count(distinct case when z_mad > 5e0 then regexp_replace(indicator, '_(mean|std)$', '') end) n_fields,
               bool_or(z_mad > 8e0) extreme,
               coalesce(string_agg(indicator, ',' order by indicator) filter (where z_mad > 5e0), '') hits
        from f_mad group by case_id)""")
define("f_kept", "select s.*, s.n_volume + s.n_surface as n_buildings from f_stats s join f_verdict v on s.case_id = v.case_id where v.rule = 'normal'")
define("f_strata", """select *, "range" || case when row_number() over (partition by "range" order by n_volume, case_id)
      <= count(*) over (partition by "range") // 2 then '_easy' else '_hard' end as sub_bin
    from (select *, case when n_buildings <= 19 then '0-19' when n_buildings <= 39 then '20-39' when n_buildings <= 59 then '40-59'
      when n_buildings <= 79 then '60-79' else '80-123' end as "range" from f_kept)""")
define("f_split", f"""select *, case when rn <= {N_TRAIN} then 'train' when rn <= {N_TRAIN + N_VAL} then 'val' else 'test' end as split
    from (select *, row_number() over (partition by sub_bin order by u, case_id) rn from
      (select *, {U("'split'", "'42'", "case_id")} u from f_strata)) where rn <= {N_TRAIN + N_VAL + N_TEST}""")


def cases(spark, sf_dir):
    """The case table, written once: medians, strata and splits all read it."""
    return materialize(stats.case_stats(points(spark, sf_dir)), "cases")


def verdicts(spark, sf_dir):
    return outliers.mad_outliers(outliers.mad_scores(cases(spark, sf_dir), NAMES))


def kept(spark, sf_dir):
    """Kept cases; the number of points stands in for the number of buildings."""
    table = cases(spark, sf_dir)
    flagged = outliers.mad_outliers(outliers.mad_scores(table, NAMES))
    left = outliers.drop_flagged(table, flagged).select("case_id", "n_volume", "n_surface")
    return materialize(left.withColumn("n_buildings", F.col("n_volume") + F.col("n_surface")), "kept")


def stratified(spark, sf_dir):
    return materialize(strata.add_strata(kept(spark, sf_dir)), "strata")


def manifest_rows(spark, sf_dir):
    return strata.stratified_split(stratified(spark, sf_dir), N_TRAIN, N_VAL, N_TEST)


@query("case_stats", sql(f"select case_id, n_volume, n_surface, {', '.join(f'{R(n)} as {n}' for n in NAMES)} from f_stats"))
def case_stats(spark, sf_dir):
    table = stats.case_stats(points(spark, sf_dir))
    return table.select("case_id", "n_volume", "n_surface", *[r(n).alias(n) for n in NAMES])


@query("mad_scores", sql(f"select case_id, indicator, {R('z_mad', 4)} z_mad from f_mad"))
def mad_scores(spark, sf_dir):
    scores = outliers.mad_scores(cases(spark, sf_dir), NAMES)
    return scores.select("case_id", "indicator", r("z_mad", 4).alias("z_mad"))


@query("mad_outliers", sql(f"select case_id, {big('n_fields')} n_fields, hits, rule, rule <> 'normal' as is_anomaly from f_verdict"))
def mad_outliers(spark, sf_dir):
    hits = F.concat_ws(",", F.transform("hits", lambda h: h["indicator"]))
    return verdicts(spark, sf_dir).select("case_id", "n_fields", hits.alias("hits"), "rule", "is_anomaly")


@query("mad_filter", sql("select case_id, n_volume, n_surface from f_kept"))
def mad_filter(spark, sf_dir):
    return kept(spark, sf_dir).select("case_id", "n_volume", "n_surface")


@query("rule_counts", sql(f"select rule, {big('count(*)')} n from f_verdict where rule <> 'normal' group by 1"))
def rule_counts(spark, sf_dir):
    return outliers.rule_counts(verdicts(spark, sf_dir))


@query("strata", sql("""select case_id, "range", sub_bin from f_strata"""))
def strata_query(spark, sf_dir):
    return stratified(spark, sf_dir).select("case_id", "range", "sub_bin")


@query("range_thresholds", sql(f"""select "range", {big("coalesce(max(n_volume) filter (where sub_bin like '%easy'), min(n_volume))")} threshold
    from f_strata group by 1"""))
def range_thresholds(spark, sf_dir):
    return strata.range_thresholds(stratified(spark, sf_dir))


@query("stratified_split", sql("select case_id, sub_bin, split from f_split"))
def stratified_split(spark, sf_dir):
    return manifest_rows(spark, sf_dir).select("case_id", "sub_bin", "split")


@query("manifest", sql("select case_id, sub_bin, n_buildings, n_volume, n_surface, split from f_split order by split, case_id"))
def manifest(spark, sf_dir):
    return (
        manifest_rows(spark, sf_dir)
        .select("case_id", "sub_bin", "n_buildings", "n_volume", "n_surface", "split")
        .orderBy("split", "case_id")
    )


def _summary_sql() -> str:
    return " union all ".join(
        f"""select '{m}' as measure, {big('count(*)')} n, {big(f'min({m})')} as "min", {big(f'max({m})')} as "max",
            {big(f'list({m} order by {m})[count(*)//2 + 1]')} as median from f_kept"""
        for m in ("n_buildings", "n_volume", "n_surface")
    )


@query("manifest_summary", sql(_summary_sql()))
def manifest_summary(spark, sf_dir):
    return strata.size_summary(kept(spark, sf_dir), ["n_buildings", "n_volume", "n_surface"])


@query("manifest_counts", sql(f"""
    select 'pool' as kind, sub_bin as name, {big('count(*)')} n from f_strata group by 2
    union all select 'split', split, {big('count(*)')} from f_split group by 2
    union all select 'total', 'dropped', {big("count(*) filter (where rule <> 'normal')")} from f_verdict
    union all select 'total', 'scanned', {big('count(*)')} from f_verdict"""))
def manifest_counts(spark, sf_dir):
    flagged = verdicts(spark, sf_dir)
    placed = stratified(spark, sf_dir)
    return strata.manifest_counts(flagged, placed, strata.stratified_split(placed, N_TRAIN, N_VAL, N_TEST))


_NEED = N_TRAIN + N_VAL + N_TEST
_LIST = ", ".join(f"('{s}')" for s in STRATA)


@query("undersupplied", sql(f"""
    select sub_bin, {big('available')} available, {big(_NEED)} requested,
      {big(f'least(available, {N_TRAIN})')} got_train,
      {big(f'greatest(0, least({N_VAL}, available - {N_TRAIN}))')} got_val,
      {big(f'greatest(0, least({N_TEST}, available - {N_TRAIN + N_VAL}))')} got_test
    from (select v.sub_bin, count(s.case_id) available from (values {_LIST}) v(sub_bin)
          left join f_strata s on s.sub_bin = v.sub_bin group by 1)
    where available < {_NEED}"""))
def undersupplied(spark, sf_dir):
    return strata.undersupplied(stratified(spark, sf_dir), N_TRAIN, N_VAL, N_TEST)


CHANNELS = {c: c for c in ("ux", "uy", "uz", "p", "nut", "sdf", "gx", "gy", "gz")}
define("f_train", "select p.* from f_points p join f_split s on p.case_id = s.case_id where s.split = 'train'")


def train_points(spark, sf_dir):
    train = manifest_rows(spark, sf_dir).filter("split = 'train'").select("case_id")
    return points(spark, sf_dir).join(train, "case_id", "left_semi")


@query("suff_stats", sql(" union all ".join(
    f"select '{c}' as channel, {big(f'count({c})')} n, {R(f'sum({c})', 3)} total, {R(f'sum({c}*{c})', 2)} total_sq from f_train"
    for c in CHANNELS)))
def suff_stats(spark, sf_dir):
    out = stats.sufficient_stats(train_points(spark, sf_dir), CHANNELS)
    return out.select("channel", "n", r("total", 3).alias("total"), r("total_sq", 2).alias("total_sq"))


NORM_SQL = " union all ".join(
    f"select '{c}' as channel, {big(f'count({c})')} n, avg({c}) mean, stddev_pop({c}) std from f_train" for c in CHANNELS
)
define("f_norm", NORM_SQL)


@query("norm_stats", sql(f"select channel, n, {R('mean')} mean, {R('std')} std from f_norm"))
def norm_stats(spark, sf_dir):
    out = stats.norm_stats(train_points(spark, sf_dir), CHANNELS)
    return out.select("channel", "n", r("mean").alias("mean"), r("std").alias("std"))


def _joined(columns: list[str]) -> str:
    return " ".join(f"join f_norm n_{c} on n_{c}.channel = '{c}'" for c in columns)


ZCOLS = list(CHANNELS)
FLOW = ["ux", "uy", "uz", "p", "nut"]


@query("zscore_apply", sql(f"""select point_id, {', '.join(f'{R(f"(t.{c} - n_{c}.mean)/greatest(n_{c}.std, 1e-8)", 5)} as {c}' for c in ZCOLS)}
    from f_points t {_joined(ZCOLS)}"""))
def zscore_apply(spark, sf_dir):
    lookup = stats.stats_lookup(stats.norm_stats(train_points(spark, sf_dir), {c: c for c in ZCOLS}))
    out = stats.zscore_apply(points(spark, sf_dir).select("point_id", *ZCOLS), lookup)
    return out.select("point_id", *[r(c, 5).alias(c) for c in ZCOLS])


@query("denormalize", sql(f"""select point_id, {', '.join(
    f"{R(f't.{c}*n_{c}.std + n_{c}.mean' + (' - 9.81e0*t.z' if c == 'p' else ''), 5)} as {c}" for c in FLOW)}
    from f_points t {_joined(FLOW)}"""))
def denormalize(spark, sf_dir):
    from pointprep.functions.scalar import retrend

    lookup = stats.stats_lookup(stats.norm_stats(train_points(spark, sf_dir), {c: c for c in FLOW}))
    out = stats.denormalize(points(spark, sf_dir).select("point_id", *FLOW, "z"), lookup).withColumn("p", retrend("p", "z"))
    return out.select("point_id", *[r(c, 5).alias(c) for c in FLOW])


_EXT = ", ".join(f"greatest(quantile_cont({a}, 0.95e0) - quantile_cont({a}, 0.05e0), 1e-8) e{a}" for a in "xyz")
define("f_trainleaves", "select l.* from f_leaves l join f_split s on l.case_id = s.case_id where s.split = 'train'")
define("f_extent", f"select {_EXT} from f_trainleaves")
_LV = ", ".join(f"('{s}', {n}e0)" for s, n in LEAVES_PER_STRATUM.items())
define("f_scale", " union all ".join(
    f"""select sub_bin, '{a}' as axis, pow(leaves, 1e0/3e0) * e{a} / greatest(pow(ex*ey*ez, 1e0/3e0), 1e-8) as scale
        from f_extent, (values {_LV}) v(sub_bin, leaves)""" for a in "xyz"))


def train_leaves(spark, sf_dir):
    train = manifest_rows(spark, sf_dir).filter("split = 'train'").select("case_id")
    return leaves(spark, sf_dir).join(train, "case_id", "left_semi")


@query("axis_scale", sql(f"select sub_bin, axis, {R('scale')} scale from f_scale"))
def axis_scale(spark, sf_dir):
    return stats.axis_scale(train_leaves(spark, sf_dir)).select("sub_bin", "axis", r("scale").alias("scale"))
