"""Bins, samples, shards and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointprep.functions import scalar as S
from pointprep.operators import batching, binning, sampling
from pointprep.registry.core import query
from pointprep.registry.curation import manifest_rows, stratified
from pointprep.registry.fixtures import CTES, R, U, big, define, points, r, sql
from pointprep.registry.scalars import BIN_SQL, WEIGHT_SQL
from pointprep.session import materialize, scratch_path
from pointprep.sources.files import write_batches

SLOTS = 24
SLOTS_MANY = 96
K = 10
N_QUERY = 40
WORLD = 3
EPOCH = 5

define("f_binned", f"select *, {big(BIN_SQL)} as bin from f_points")
define("f_counts", "select case_id, bin, cast(count(*) as bigint) n from f_binned where bin is not null group by 1, 2")
_W = ", ".join(f"{w!r}e0" for w in S.bin_weights(binning.BINS, binning.ALPHA))


def _alloc_sql(slots: int) -> str:
    return f"""select case_id, bin, n, {slots} as slots, populated <= {slots} as feasible,
      base + case when d > 0 and heavy = 1 then d else 0 end
           - case when d < 0 then greatest(0, least(base - 1, -d - before)) else 0 end as alloc
    from (select *, {slots} - sum(base) over (partition by case_id) d,
            row_number() over (partition by case_id order by wc desc, bin) heavy,
            coalesce(sum(base - 1) over (partition by case_id order by wc, bin rows between unbounded preceding and 1 preceding), 0) before,
            count(*) over (partition by case_id) populated
          from (select *, greatest(cast(floor({slots} * wc / total) as bigint), 1) base
                from (select *, sum(wc) over (partition by case_id order by bin rows between unbounded preceding and unbounded following) total
                      from (select *, n * [{_W}][bin + 1] wc from f_counts))))"""


define("f_alloc", _alloc_sql(SLOTS))
define("f_alloc_many", _alloc_sql(SLOTS_MANY))


def binned(spark, sf_dir):
    return binning.with_bins(points(spark, sf_dir))


def allocation(spark, sf_dir, slots=SLOTS):
    return binning.bin_allocation(binning.bin_counts(binned(spark, sf_dir)), slots)


@query("bin_counts", sql("select case_id, bin, n from f_counts"))
def bin_counts(spark, sf_dir):
    return binning.bin_counts(binned(spark, sf_dir))


@query("bin_allocation", sql(f"select case_id, bin, n, {big('slots')} slots, {big('alloc')} alloc, feasible from f_alloc"))
def bin_allocation(spark, sf_dir):
    return allocation(spark, sf_dir)


@query("oversample_fill", sql(f"""
    with short as (select case_id, bin, n, cast(alloc as bigint) alloc from f_alloc_many where n < alloc),
    own as (select p.case_id, p.bin, row_number() over (partition by p.case_id, p.bin order by point_id) - 1 as slot, point_id
            from f_binned p join short s on p.case_id = s.case_id and p.bin = s.bin)
    select case_id, bin, slot, point_id, false as is_copy from own
    union all
    select e.case_id, e.bin, e.slot, o.point_id, true from (
      select case_id, bin, slot, cast(floor({U("'fill'", "'42'", "case_id", "bin", "slot")} * n) as bigint) pick
      from (select *, unnest(range(n, alloc)) as slot from short)) e
    join own o on o.case_id = e.case_id and o.bin = e.bin and o.slot = e.pick"""))
def oversample_fill(spark, sf_dir):
    return binning.oversample_fill(binned(spark, sf_dir), allocation(spark, sf_dir, SLOTS_MANY))


define("f_vol", f"""select case_id, point_id, row_number() over (partition by case_id order by g desc, point_id) rn from (
    select case_id, point_id, ln(greatest({WEIGHT_SQL}, 1e-10)) - ln(-ln({U("'gumbel'", "case_id", f"'{EPOCH}'", "point_id")})) g
    from f_points where not is_surface)""")
define("f_surf", f"""select case_id, point_id, row_number() over (partition by case_id order by u, point_id) rn from (
    select case_id, point_id, {U("'surface'", "case_id", f"'{EPOCH}'", "point_id")} u from f_points where is_surface)""")


@query("gumbel_topk", sql(f"select case_id, point_id, rn from f_vol where rn <= {K}"))
def gumbel_topk(spark, sf_dir):
    volume = points(spark, sf_dir).filter(~F.col("is_surface"))
    out = sampling.gumbel_topk(volume, S.log_sample_weight("sdf"), K, EPOCH)
    return out.select("case_id", "point_id", "rn")


@query("uniform_sample", sql(f"""select case_id, point_id, rn from (
    select case_id, point_id, row_number() over (partition by case_id order by u, point_id) rn from (
      select case_id, point_id, {U("'uniform'", "case_id", f"'{EPOCH}'", "point_id")} u from f_points)) where rn <= {K}"""))
def uniform_sample(spark, sf_dir):
    return sampling.uniform_sample(points(spark, sf_dir), K, EPOCH).select("case_id", "point_id", "rn")


@query("query_slots", sql(f"""
    with q as (select case_id, least({N_QUERY} - s, nv) qv, s qs from (
      select case_id, nv, least(ns, cast(floor({N_QUERY}e0 * ns / (ns + nv/2e0)) as bigint)) s from (
        select case_id, count(*) filter (where not is_surface) nv, count(*) filter (where is_surface) ns from f_points group by 1)))
    select v.case_id, {big('rn - 1')} slot, point_id, false is_surf, true as "valid" from f_vol v join q on v.case_id = q.case_id where rn <= qv
    union all select v.case_id, {big('qv + rn - 1')}, point_id, true, true from f_surf v join q on v.case_id = q.case_id where rn <= qs
    union all select case_id, {big('s')}, null, false, false from (select case_id, unnest(range(qv + qs, {N_QUERY})) s from q)"""))
def query_slots(spark, sf_dir):
    return sampling.query_slots(points(spark, sf_dir), S.log_sample_weight("sdf"), N_QUERY, EPOCH)


_STRATA = ", ".join(f"('{s}', {i})" for i, s in enumerate(S.STRATA))
_T = S.curriculum_temperature(EPOCH, 10)
define("f_curriculum", f"""select sub_bin, n, i as stratum_index,
      least(n, greatest(greatest(3, cast(ceil(3e-1 * n) as bigint)), cast(round_even(n * exp(-(i / 9e0) * {_T!r}e0), 0) as bigint))) n_take
    from (select sub_bin, count(*) n from f_strata group by 1) join (values {_STRATA}) v(s, i) on s = sub_bin""")


@query("curriculum_counts", sql(f"select sub_bin, {big('n')} n, {big('stratum_index')} stratum_index, {big('n_take')} n_take from f_curriculum"))
def curriculum_counts(spark, sf_dir):
    return sampling.curriculum_counts(stratified(spark, sf_dir), EPOCH, 10)


@query("curriculum_sample", sql(f"""select sub_bin, case_id, draw from (
    select s.sub_bin, s.case_id, n_take, row_number() over (partition by s.sub_bin order by {U("'curriculum'", "s.sub_bin", f"'{EPOCH}'", "s.case_id")}, s.case_id) draw
    from f_strata s join f_curriculum c on s.sub_bin = c.sub_bin) where draw <= n_take"""))
def curriculum_sample(spark, sf_dir):
    return sampling.curriculum_sample(stratified(spark, sf_dir), EPOCH, 10).select("sub_bin", "case_id", "draw")


define("f_shards", f"""select sub_bin, case_id, {big(f'(row_number() over (partition by sub_bin order by case_id) - 1) % {WORLD}')} shard from f_strata""")
_PAR = ", ".join(f"('{s}', {S.LEAVES_PER_STRATUM[s]}, {S.BATCH_PER_STRATUM[s]})" for s in S.STRATA)
define("f_placed", f"""select *, row_number() over (partition by shard, sub_bin order by u, case_id) - 1 i, count(*) over (partition by shard, sub_bin) n from (
    select shard, sub_bin, case_id, leaves, b, {U("'batch'", f"'{EPOCH}'", "shard", "case_id")} u
    from f_shards join (values {_PAR}) v(s, leaves, b) on s = sub_bin)""")
define("f_slots", """select shard, sub_bin, i // b as batch, i % b as pos, case_id, false as is_fill from f_placed
    union all select shard, sub_bin, n // b, g, case_id, true from (select *, unnest(range(n % b, b)) g from f_placed where i = 0 and n % b > 0)""")
define("f_order", f"""select shard, sub_bin, batch, row_number() over (partition by shard order by by_u, tie_u) - 1 as seq from (
    select shard, sub_bin, batch, {U("'order'", f"'{EPOCH}'", "shard", "sub_bin", "batch")} by_u, {U("'tie'", "sub_bin", "batch")} tie_u
    from (select distinct shard, sub_bin, batch from f_slots))""")


def sharded(spark, sf_dir):
    return materialize(batching.shards(stratified(spark, sf_dir), WORLD).select("shard", "sub_bin", "case_id"), "shards")


@query("shards", sql("select sub_bin, case_id, shard from f_shards"))
def shards(spark, sf_dir):
    return batching.shards(stratified(spark, sf_dir), WORLD).select("sub_bin", "case_id", "shard")


@query("batches", sql(f"""select s.shard, s.sub_bin, {big('s.batch')} batch, {big('pos')} pos, case_id, is_fill, {big('seq')} seq
    from f_slots s join f_order o on s.shard = o.shard and s.sub_bin = o.sub_bin and s.batch = o.batch"""))
def batches(spark, sf_dir):
    out = batching.batches(sharded(spark, sf_dir), EPOCH)
    return out.select("shard", "sub_bin", "batch", "pos", "case_id", "is_fill", "seq")


@query("batches_first_epoch", sql(f"""
    with placed as (select *, row_number() over (partition by shard, sub_bin order by u, case_id) - 1 i, count(*) over (partition by shard, sub_bin) n from (
      select shard, sub_bin, case_id, leaves, b, {U("'batch'", "'0'", "shard", "case_id")} u
      from f_shards join (values {_PAR}) v(s, leaves, b) on s = sub_bin)),
    slots as (select shard, sub_bin, leaves, i // b as batch, i % b as pos, case_id, false as is_fill from placed
      union all select shard, sub_bin, leaves, n // b, g, case_id, true from (select *, unnest(range(n % b, b)) g from placed where i = 0 and n % b > 0)),
    seqs as (select shard, sub_bin, batch, row_number() over (partition by shard order by leaves, {U("'tie'", 'sub_bin', 'batch')}) - 1 as seq
      from (select distinct shard, sub_bin, leaves, batch from slots))
    select s.shard, s.sub_bin, {big('leaves')} leaves, {big('s.batch')} batch, {big('pos')} pos, case_id, is_fill, {big('seq')} seq
    from slots s join seqs o on s.shard = o.shard and s.sub_bin = o.sub_bin and s.batch = o.batch"""))
def batches_first_epoch(spark, sf_dir):
    out = batching.batches(sharded(spark, sf_dir), 0)
    return out.select("shard", "sub_bin", "leaves", "batch", "pos", "case_id", "is_fill", "seq")


@query("steps_per_epoch", sql(f"""select {big('greatest(coalesce(sum((n + b - 1) // b), 0), 1)')} steps
    from (select sub_bin, count(*) n from f_strata group by 1) join (values {_PAR}) v(s, leaves, b) on s = sub_bin"""))
def steps_per_epoch(spark, sf_dir):
    return batching.steps_per_epoch(stratified(spark, sf_dir))


@query("shard_padding", sql(f"""select shard, {big('step')} step, {big('step % n')} seq from (
    select shard, n, unnest(range(0, max(n) over ())) step from (select shard, count(*) n from f_order group by 1))"""))
def shard_padding(spark, sf_dir):
    return batching.shard_padding(batching.batches(sharded(spark, sf_dir), EPOCH))


define("f_queue", f"""select v.case_id, {big('rn - 1')} slot, point_id, false is_surf, true as ok from f_vol v join f_quota q on v.case_id = q.case_id where rn <= qv
    union all select v.case_id, {big('qv + rn - 1')}, point_id, true, true from f_surf v join f_quota q on v.case_id = q.case_id where rn <= qs
    union all select case_id, {big('s')}, null, false, false from (select case_id, unnest(range(qv + qs, {N_QUERY})) s from f_quota)""")
define("f_quota", f"""select case_id, least({N_QUERY} - s, nv) qv, s qs from (
      select case_id, nv, least(ns, cast(floor({N_QUERY}e0 * ns / (ns + nv/2e0)) as bigint)) s from (
        select case_id, count(*) filter (where not is_surface) nv, count(*) filter (where is_surface) ns from f_points group by 1))""")
CTES["f_queue"] = CTES.pop("f_queue")


@query("batch_rows", sql(f"""select s.shard, {big('seq')} seq, {big('pos')} pos, is_fill, q.case_id, slot, point_id, is_surf, ok as "valid"
    from f_slots s join f_order o on s.shard = o.shard and s.sub_bin = o.sub_bin and s.batch = o.batch join f_queue q on q.case_id = s.case_id"""))
def batch_rows(spark, sf_dir):
    """The slot rows of every batch, written in reading order and read back."""
    slots = sampling.query_slots(points(spark, sf_dir), S.log_sample_weight("sdf"), N_QUERY, EPOCH)
    path = scratch_path(spark, "batches")
    write_batches(batching.collate_rows(batching.batches(sharded(spark, sf_dir), EPOCH), slots), path)
    return spark.read.parquet(path).select("shard", "seq", "pos", "is_fill", "case_id", "slot", "point_id", "is_surf", "valid")


@query("collate", sql(f"""select s.shard, s.sub_bin, {big('s.batch')} batch, {big('max(seq)')} seq, string_agg(cast(case_id as varchar), ',' order by pos) cases
    from f_slots s join f_order o on s.shard = o.shard and s.sub_bin = o.sub_bin and s.batch = o.batch group by 1, 2, s.batch"""))
def collate(spark, sf_dir):
    out = batching.collate(batching.batches(sharded(spark, sf_dir), EPOCH))
    joined = F.concat_ws(",", F.transform("cases", lambda c: c.cast("string")))
    return out.select("shard", "sub_bin", "batch", "seq", joined.alias("cases"))
