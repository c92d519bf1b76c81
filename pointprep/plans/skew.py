"""Exact ranks and percentiles whose groups may be arbitrarily large.

A plain ``row_number() over (partition by g order by v)`` sends each group to one
task. Groups above a row threshold are cut here into value ranges first, so the
window runs per (group, range) and a prefix sum over range counts restores the
global rank. Groups below the threshold use the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

HOT_ROWS_CONF = "pointprep.hotRows"
DEFAULT_HOT_ROWS = 1_000_000
#: Ranges that one round cuts a group into; rounds go on until ranges are small enough.
MAX_RANGES = 200
#: Rows of a table about hot groups that are sent to every task; a longer one is joined by key.
BROADCAST_ROWS = 1_000_000
#: Sampled rows for each split value.
_SAMPLES_PER_SPLIT = 20


def hot_row_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int) -> list:
    """The groups above ``hot_rows``: at most one for every ``hot_rows`` rows of the table."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return hot_from_counts(sizes, keys, "__n", hot_rows)


def hot_from_counts(counts: DataFrame, keys: Sequence[str], n: str, hot_rows: int) -> list:
    """The same list from a table that already holds the group sizes."""
    return (
        counts.filter(F.col(n) > hot_rows)
        .select(*keys, F.col(n).alias("__n"))
        .collect()
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for key in keys:
        cond = cond & left[key].eqNullSafe(right[key])
    return cond


def _broadcast_left(df: DataFrame, small: DataFrame, keys: Sequence[str], rows: int = 0) -> DataFrame:
    renamed = small.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in small.columns if c not in keys],
    )
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return df.join(_small(renamed, rows), cond, "left").drop(*[f"__r_{k}" for k in keys])


def _range_column(df: DataFrame, keys: list[str], value: str, hot: list, hot_rows: int, name: str) -> DataFrame:
    """Add range number ``name``: odd = rows equal to a split value (or null), even = rows between splits.

    Splits are values of the rows themselves, in their own type, with each group's least and
    greatest value among them. So a round takes at least these rows out of the ranges between
    splits, and the ranges that stay hold strictly fewer rows; the sample only makes them small.
    """
    spark = df.sparkSession
    key_fields = [T.StructField(k, df.schema[k].dataType, True) for k in keys]
    wanted = {tuple(r[k] for k in keys): min(MAX_RANGES, -(-r["__n"] // max(hot_rows, 1)) * 2) for r in hot}
    hot_df = spark.createDataFrame(
        [(*[r[k] for k in keys], min(1.0, _SAMPLES_PER_SPLIT * MAX_RANGES / r["__n"])) for r in hot],
        T.StructType([*key_fields, T.StructField("__rate", T.DoubleType())]),
    )
    renamed = hot_df.select(*[F.col(k).alias(f"__r_{k}") for k in keys], "__rate")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    inside = df.select(*keys, value).join(_small(renamed, len(hot)), same).filter(F.col(value).isNotNull())
    inside = inside.withColumn("__drawn", F.when(F.rand(7) < F.col("__rate"), F.col(value)))
    # Any splits give exact ranks, good ones balance the tasks: which rows are drawn changes no result.
    samples = inside.groupBy(*keys).agg(
        F.min(value).alias("__low"),
        F.max(value).alias("__high"),
        F.sort_array(F.collect_list("__drawn")).alias("__v"),
    )
    count, size = F.col("__count"), F.size("__v")
    places = F.sequence(F.lit(1), F.least(count, size).cast("int"))
    picked = F.when(size > 0, F.transform(places, lambda i: F.col("__v")[(F.floor((i - 0.5) * size / F.least(count, size))).cast("int")]))
    counts = spark.createDataFrame(
        [(*key, n) for key, n in wanted.items()], T.StructType([*key_fields, T.StructField("__count", T.IntegerType())])
    )
    splits = _broadcast_left(samples, counts, keys, len(hot)).select(
        *keys, F.array_sort(F.array_distinct(F.concat(F.array("__low", "__high"), F.coalesce(picked, F.array("__low"))))).alias("__s")
    ).collect()
    split_df = spark.createDataFrame(
        [tuple(r) for r in splits], T.StructType([*key_fields, T.StructField("__s", T.ArrayType(df.schema[value].dataType), True)])
    )
    out = _broadcast_left(df, split_df, keys, len(splits) * MAX_RANGES)
    v = F.col(value)
    between = F.size(F.filter("__s", lambda s: s < v)) * 2
    number = F.when(v.isNull(), F.lit(-1)).otherwise(between + F.array_contains("__s", v).cast("int"))
    return out.withColumn(name, F.when(F.col("__s").isNull(), F.lit(0)).otherwise(number)).drop("__s")


def cut_hot_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int | None = None, hot: list | None = None
) -> tuple[DataFrame, list[str], list]:
    """Cut every hot group into ordered ranges.

    Returns the frame with range columns, the names of those columns and the hot
    groups found at the first level. Ranges between split values are cut again by the same
    column until none is hot; ranges of a single value are then refined by the next column of
    ``order``, so the lexicographic range order agrees with the row order. ``hot`` hands in hot
    groups that are already known.
    """
    limit = hot_rows if hot_rows is not None else hot_row_limit(df.sparkSession)
    if hot is None:
        hot = hot_groups(df, keys, limit)
    first = hot
    levels: list[str] = []
    cur = df
    part = list(keys)
    for i, value in enumerate(order):
        single = F.lit(False)
        while hot:
            name = f"__b{len(levels)}"
            cur = _range_column(cur, part, value, hot, limit, name)
            levels.append(name)
            part = part + [name]
            single = single | (F.pmod(F.col(name), F.lit(2)) == 1)
            hot = hot_groups(cur.filter(~single), part, limit)
        if not levels or i + 1 == len(order):
            break
        hot = hot_groups(cur.filter(single), part, limit)
    return cur, levels, first


def _range_offsets(cur: DataFrame, keys: list[str], levels: list[str], extra: list[Column] | None = None) -> DataFrame:
    """Rows before each range of its group. Only hot groups have ranges other than 0."""
    counted = cur.groupBy(*keys, *levels).agg(F.count(F.lit(1)).alias("__cnt"), *(extra or []))
    before = W.partitionBy(*keys).orderBy(*levels).rowsBetween(W.unboundedPreceding, -1)
    return counted.withColumn("__off", F.coalesce(F.sum("__cnt").over(before), F.lit(0)))


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "rn",
    limit: int | str | None = None,
    hot_rows: int | None = None,
    hot: list | None = None,
) -> DataFrame:
    """Add the 1-based rank ``name`` of each row in its group, ascending by ``order``.

    ``order`` names numeric columns that together are unique in a group. ``limit``
    keeps ranks up to a number, or up to the value of a column that is constant in
    each group.
    """
    keys = list(keys)
    cur, levels, hot = cut_hot_groups(df, keys, order, hot_rows, hot)
    bound = None if limit is None else (F.col(limit) if isinstance(limit, str) else F.lit(limit))
    rank = F.row_number().over(W.partitionBy(*keys, *levels).orderBy(*order)).cast("bigint")
    if not levels:
        out = cur.withColumn(name, rank)
        return out if bound is None else out.filter(F.col(name) <= bound)
    spark = df.sparkSession
    hot_df = spark.createDataFrame(
        [tuple(r[k] for k in keys) for r in hot],
        T.StructType([T.StructField(k, df.schema[k].dataType, True) for k in keys]),
    )
    inside = cur.join(_small(hot_df, len(hot)), _same(cur, hot_df, keys), "left_semi")
    offsets = _range_offsets(inside, keys, levels).drop("__cnt")
    limit_rows = hot_rows if hot_rows is not None else hot_row_limit(spark)
    ranges = sum(max(MAX_RANGES, 4 * r["__n"] // max(limit_rows, 1)) * 2 for r in hot)
    cur = _broadcast_left(cur, offsets, keys + levels, ranges)
    cur = cur.withColumn("__off", F.coalesce("__off", F.lit(0)))
    if bound is not None:
        cur = cur.filter(F.col("__off") < bound)
    out = cur.withColumn(name, F.col("__off") + rank)
    if bound is not None:
        out = out.filter(F.col(name) <= bound)
    return out.drop("__off", *levels)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    hot_rows: int | None = None,
    hot: list | None = None,
) -> DataFrame:
    """Exact linear-interpolated percentiles per group, one column per entry of ``probs``."""
    keys = list(keys)
    spark = df.sparkSession
    names = list(probs)
    df = df.select(*keys, value).filter(F.col(value).isNotNull())
    cur, levels, hot = cut_hot_groups(df, keys, [value], hot_rows, hot)
    aggs = [F.percentile(value, probs[n]).alias(n) for n in names]
    if not levels:
        return cur.groupBy(*keys).agg(*aggs)

    key_fields = [T.StructField(k, df.schema[k].dataType, True) for k in keys]
    hot_df = spark.createDataFrame([tuple(r[k] for k in keys) for r in hot], T.StructType(key_fields))
    cold = cur.join(_small(hot_df, len(hot)), _same(cur, hot_df, keys), "left_anti").groupBy(*keys).agg(*aggs)

    inside = cur.join(_small(hot_df, len(hot)), _same(cur, hot_df, keys), "left_semi")
    targets = []
    for r in hot:
        for n in names:
            pos = (r["__n"] - 1) * probs[n]
            low = int(pos)
            targets.append((*[r[k] for k in keys], n, low, pos - low))
    target_df = spark.createDataFrame(
        targets,
        T.StructType(key_fields + [
            T.StructField("__p", T.StringType()),
            T.StructField("__low", T.LongType()),
            T.StructField("__frac", T.DoubleType()),
        ]),
    ).withColumn("__r", F.explode(F.array(F.col("__low"), F.col("__low") + 1)))
    ranges = _range_offsets(
        inside, keys, levels, [F.min(value).alias("__min"), F.max(value).alias("__max")]
    )
    hit = _broadcast_left(ranges, target_df, keys).filter(
        (F.col("__r") >= F.col("__off")) & (F.col("__r") < F.col("__off") + F.col("__cnt"))
    )
    # A range of one value needs no look at its rows; the others hold a small share of a group.
    single = hit.filter(F.col("__min") == F.col("__max")).select(
        *keys, "__p", "__r", "__low", "__frac", F.col("__min").cast("double").alias("__v")
    )
    needed = hit.filter(F.col("__min") != F.col("__max"))
    ranges_needed = needed.select(*keys, *levels, "__off").distinct()
    numbered = (
        inside.join(F.broadcast(ranges_needed), keys + levels)
        .withColumn("__at", F.col("__off") + F.row_number().over(W.partitionBy(*keys, *levels).orderBy(value)) - 1)
        .withColumn("__v", F.col(value).cast("double"))
    )
    looked = numbered.join(
        F.broadcast(needed.select(*keys, "__p", F.col("__r").alias("__at"), "__low", "__frac")),
        keys + ["__at"],
    ).select(*keys, "__p", F.col("__at").alias("__r"), "__low", "__frac", "__v")
    both = single.unionByName(looked).groupBy(*keys, "__p").agg(
        F.max("__frac").alias("__frac"),
        F.max(F.when(F.col("__r") == F.col("__low"), F.col("__v"))).alias("__a"),
        F.max(F.when(F.col("__r") > F.col("__low"), F.col("__v"))).alias("__z"),
    )
    a, z, frac = F.col("__a"), F.coalesce("__z", "__a"), F.col("__frac")
    # The blend that the built-in percentile uses, so hot and cold groups agree to the last bit.
    blended = F.when(frac == 0, a).when(a == z, a).otherwise((F.lit(1.0) - frac) * a + frac * z)
    wide = both.withColumn("__x", blended).groupBy(*keys).pivot("__p", names).agg(F.max("__x"))
    return cold.unionByName(wide.select(*keys, *names))
