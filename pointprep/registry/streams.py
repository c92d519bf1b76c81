"""Streaming queries; their checks are those of the batch results."""

from __future__ import annotations

from pointprep.registry.core import query
from pointprep.registry.curation import NAMES
from pointprep.registry.fixtures import POINT_BASE, POINT_FIELDS, R, _exprs, big, r, sql, table
from pointprep.streaming import incremental

CHANNELS = {c: c for c in ("ux", "uy", "uz", "p", "nut")}


def stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    raw = incremental.case_stream(spark, sf_dir, schema, "events.parquet")
    return raw.selectExpr(*_exprs(POINT_BASE)).selectExpr("*", *_exprs(POINT_FIELDS))


@query("stream_norm_stats", sql(" union all ".join(
    f"select '{c}' as channel, {big(f'count({c})')} n, {R(f'avg({c})')} mean, {R(f'stddev_pop({c})')} std from f_points" for c in CHANNELS)))
def stream_norm_stats(spark, sf_dir):
    out = incremental.run_complete(incremental.norm_stats(stream(spark, sf_dir), CHANNELS), spark)
    return out.select("channel", "n", r("mean").alias("mean"), r("std").alias("std"))


@query("stream_case_stats", sql(f"select case_id, n_volume, n_surface, {', '.join(f'{R(n)} as {n}' for n in NAMES)} from f_stats"))
def stream_case_stats(spark, sf_dir):
    out = incremental.run_updates(incremental.case_stats(stream(spark, sf_dir)), spark, "case_id")
    return out.select("case_id", "n_volume", "n_surface", *[r(n).alias(n) for n in NAMES])
