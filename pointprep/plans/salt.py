"""Equi-join whose left side may have a few very heavy keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from pointprep.plans.skew import _broadcast_left, hot_groups, hot_row_limit


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    hot_rows: int | None = None,
    hot: list | None = None,
    keep_salt: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Inner or left join that spreads heavy left keys over several tasks.

    Rows of a heavy key are dealt into parts by a hash of the ``spread`` columns, and
    the right rows of that key, and only that key, are repeated once per part. ``hot``
    hands in heavy keys that are already known. ``keep_salt`` names the part number in
    the output, so that work per left row can go on in the same partitions, of which
    ``partitions`` fixes the number.
    """
    on = list(on)
    limit = hot_rows if hot_rows is not None else hot_row_limit(left.sparkSession)
    if hot is None:
        hot = hot_groups(left, on, limit)
    if not hot:
        if partitions:
            left, right = left.repartition(partitions, *on), right.repartition(partitions, *on)
        joined = left.join(right, on, how)
        return joined.withColumn(keep_salt, F.lit(0)) if keep_salt else joined
    parts = left.sparkSession.createDataFrame(
        [(*[r[k] for k in on], -(-r["__n"] // limit) + 1) for r in hot],
        T.StructType([T.StructField(k, left.schema[k].dataType) for k in on] + [T.StructField("__parts", T.IntegerType())]),
    )
    l2 = _broadcast_left(left, parts, on).withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    l2 = l2.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.col("__parts")).cast("int")).drop("__parts")
    r2 = _broadcast_left(right, parts, on).withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    r2 = r2.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    if partitions:
        l2, r2 = l2.repartition(partitions, *on, "__salt"), r2.repartition(partitions, *on, "__salt")
    joined = l2.join(r2, [*on, "__salt"], how)
    return joined.withColumnRenamed("__salt", keep_salt) if keep_salt else joined.drop("__salt")
