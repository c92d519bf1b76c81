"""Shards and batches of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from pointprep.functions.rng import uniform
from pointprep.functions.scalar import (
    BATCH_PER_STRATUM,
    DEFAULT_BATCH,
    DEFAULT_LEAVES,
    LEAVES_PER_STRATUM,
    lookup,
)
from pointprep.plans.salt import salted_join
from pointprep.plans.skew import ranked


def stratum_params(cases: DataFrame, stratum: str = "sub_bin") -> DataFrame:
    """Add leaf count and batch size of each stratum; unknown strata get the defaults."""
    return cases.withColumns({
        "leaves": lookup(stratum, LEAVES_PER_STRATUM, DEFAULT_LEAVES).cast("bigint"),
        "batch_size": lookup(stratum, BATCH_PER_STRATUM, DEFAULT_BATCH).cast("bigint"),
    })


def shards(cases: DataFrame, world: int, stratum: str = "sub_bin", key: str = "case_id",
           hot_rows: int | None = None) -> DataFrame:
    """Deal the cases of each stratum, in key order, round-robin over ``world`` shards."""
    placed = ranked(cases, [stratum], [key], "__pos", hot_rows=hot_rows)
    return placed.withColumn("shard", F.pmod(F.col("__pos") - 1, F.lit(world)).cast("bigint")).drop("__pos")


def batches(cases: DataFrame, epoch: int, stratum: str = "sub_bin", key: str = "case_id",
            hot_rows: int | None = None) -> DataFrame:
    """Batches within (shard, stratum), the last one filled up with the first case of the shuffle.

    One row per batch slot: shard, stratum, batch number, position, case and the
    batch's place ``seq`` in its shard: by leaf count in epoch 0, shuffled later.
    """
    group = ["shard", stratum]
    drawn = stratum_params(cases.select("shard", stratum, key), stratum).withColumn(
        "__u", uniform("batch", epoch, F.col("shard"), F.col(key))
    )
    placed = ranked(drawn, group, ["__u", key], "__pos", hot_rows=hot_rows).withColumn("__i", F.col("__pos") - 1)
    size = F.col("batch_size")
    real = placed.select(
        *group,
        "leaves",
        "batch_size",
        F.floor(F.col("__i") / size).cast("bigint").alias("batch"),
        F.pmod(F.col("__i"), size).alias("pos"),
        key,
        F.lit(False).alias("is_fill"),
    )
    # One row per shard and stratum: its size and its first case.
    ends = placed.groupBy(*group, "leaves", "batch_size").agg(
        F.count(F.lit(1)).alias("__n"), F.min_by(key, "__pos").alias(key)
    )
    used = F.pmod(F.col("__n"), size)
    fill = (
        ends.filter(used > 0)
        .withColumn("pos", F.explode(F.sequence(used, size - 1)))
        .select(
            *group,
            "leaves",
            "batch_size",
            F.floor(F.col("__n") / size).cast("bigint").alias("batch"),
            "pos",
            key,
            F.lit(True).alias("is_fill"),
        )
    )
    slots = real.unionByName(fill)
    # Batch order from one row per batch.
    per_batch = ends.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("__n") / size).cast("bigint") - 1)))
    by = F.col("leaves").cast("double") if epoch == 0 else uniform("order", epoch, F.col("shard"), F.col(stratum), F.col("batch"))
    order = per_batch.select("shard", stratum, "batch", by.alias("__by"), uniform("tie", F.col(stratum), F.col("batch")).alias("__tie"))
    seq = ranked(order, ["shard"], ["__by", "__tie"], "__seq", hot_rows=hot_rows)
    seq = seq.select("shard", stratum, "batch", (F.col("__seq") - 1).alias("seq"))
    return slots.join(seq, ["shard", stratum, "batch"])


def steps_per_epoch(cases: DataFrame, stratum: str = "sub_bin") -> DataFrame:
    """Batches in an epoch, at least one."""
    counted = stratum_params(cases.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")), stratum)
    total = F.sum(F.ceil(F.col("n") / F.col("batch_size")))
    return counted.agg(F.greatest(F.coalesce(total, F.lit(0)), F.lit(1)).cast("bigint").alias("steps"))


def shard_padding(batch_rows: DataFrame) -> DataFrame:
    """Repeat each shard's batches in a cycle up to the longest shard's count."""
    per_shard = batch_rows.groupBy("shard").agg((F.max("seq") + 1).alias("n"))
    everyone = W.partitionBy(F.lit(1))  # one row per shard, a number the caller sets
    steps = per_shard.withColumn("__max", F.max("n").over(everyone)).withColumn(
        "step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__max") - 1))
    )
    return steps.select("shard", "step", F.pmod("step", "n").alias("seq"))


def collate_rows(batch_rows: DataFrame, slots: DataFrame, key: str = "case_id", slot: str = "slot") -> DataFrame:
    """Every slot row of every batch place: the rows of a batch, stacked by place and then slot.

    A case that fills up a batch a second time brings its rows again. ``slots`` has equally many rows per case, so
    a batch is a full block; rows of a case with very many slots are dealt over several tasks.
    """
    places = batch_rows.select("shard", "seq", "pos", "is_fill", key)
    return salted_join(slots, places, [key], [slot])


def collate(batch_rows: DataFrame, stratum: str = "sub_bin", key: str = "case_id") -> DataFrame:
    """One row per batch with its cases in slot order; a batch is a handful of rows."""
    return batch_rows.groupBy("shard", stratum, "batch", "seq").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", key))), lambda e: e[key]).alias("cases")
    )
