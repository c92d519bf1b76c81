"""Space-filling-curve blocks: bounded runs of nearby rows with a bounding box.

Rows of a group are ordered along a Z-curve and cut into runs of equal length. A
run never exceeds its length whatever the density, so a third of all points in one
spot costs more blocks, not a bigger block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pointprep.plans.skew import hot_from_counts, hot_row_limit, ranked
from pointprep.session import materialize

_BITS = 20
ROWS_PER_TASK = 5_000_000
SMALL_TASK_ROWS = 100_000


# Shift and mask of each step that moves bit i of a 21-bit number to bit 3i.
_SPREAD = (
    (32, 0x1F00000000FFFF),
    (16, 0x1F0000FF0000FF),
    (8, 0x100F00F00F00F00F),
    (4, 0x10C30C30C30C30C3),
    (2, 0x1249249249249249),
)


def with_z_order(df: DataFrame, coords: Sequence[str], low: dict[str, float], span: float, name: str) -> DataFrame:
    """Add the Z-curve position of each row.

    One projection per spreading step: as one nested expression each step would repeat
    the previous one twice.
    """
    top = F.lit(2**_BITS - 1).cast("bigint")
    work = {c: f"__z_{c}" for c in coords}
    df = df.withColumns({
        work[c]: F.least(F.greatest(F.floor((F.col(c) - F.lit(low[c])) / F.lit(span) * F.lit(float(2**_BITS - 1))).cast("bigint"), F.lit(0).cast("bigint")), top)
        for c in coords
    })
    for shift, mask in _SPREAD:
        df = df.withColumns({
            w: F.col(w).bitwiseOR(F.shiftleft(F.col(w), shift)).bitwiseAND(F.lit(mask)) for w in work.values()
        })
    code = F.lit(0).cast("bigint")
    for i, w in enumerate(work.values()):
        code = code.bitwiseOR(F.shiftleft(F.col(w), i))
    return df.withColumn(name, code).drop(*work.values())


@dataclass(frozen=True)
class Profile:
    """What one pass over both sides of a join tells.

    ``largest`` group and ``hot`` groups are per side; ``work`` is the number of pairs if
    every row of a group met every row of the other side.
    """

    low: dict[str, float]
    span: float
    largest: tuple[int, int]
    hot: tuple[list, list]
    work: int


def profile(left: DataFrame, right: DataFrame, keys: Sequence[str], coords: Sequence[str], hot_rows: int) -> Profile:
    """Sizes and bounds per group, reduced to a few numbers and a bounded list of hot groups."""
    tagged = left.select(F.lit(0).alias("__side"), *keys, *coords).unionAll(
        right.select(F.lit(1).alias("__side"), *keys, *coords)
    )
    groups = tagged.groupBy(*keys).agg(
        *[F.count_if(F.col("__side") == i).alias(f"__n{i}") for i in (0, 1)],
        *[F.min(c).alias(f"lo_{c}") for c in coords],
        *[F.max(c).alias(f"hi_{c}") for c in coords],
    )
    row = groups.agg(
        F.max("__n0").alias("n0"),
        F.max("__n1").alias("n1"),
        F.sum(F.col("__n0").cast("double") * F.col("__n1")).alias("work"),
        *[F.min(f"lo_{c}").alias(f"lo_{c}") for c in coords],
        *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in coords],
    ).first()
    low = {c: float(row[f"lo_{c}"] or 0.0) for c in coords}
    span = max(max(float(row[f"hi_{c}"] or 0.0) - low[c] for c in coords), 1e-12)
    largest = (row["n0"] or 0, row["n1"] or 0)
    hot: tuple[list, list] = ([], [])
    for i in (0, 1):
        if largest[i] > hot_rows:
            hot[i].extend(hot_from_counts(groups, keys, f"__n{i}", hot_rows))
    return Profile(low, span, largest, hot, int(row["work"] or 0))


def partitions_for(spark: SparkSession, rows: float) -> int:
    """Tasks for a join by the rows it will put out.

    Adaptive execution sizes partitions by the bytes that go in, which says little
    where each row meets hundreds of others.
    """
    some = min(spark.sparkContext.defaultParallelism, int(rows // SMALL_TASK_ROWS) + 1)
    return max(some, int(rows // ROWS_PER_TASK) + 1)


#: Wide rows that one task sorts or keeps at a time.
TASK_ROWS = 250_000


def tasks_for(rows: int) -> int:
    """Tasks for ``rows`` wide rows. File sizes say little about rows that are made by exploding, and would leave them to one task."""
    return int(rows // TASK_ROWS) + 1


def assign_blocks(
    df: DataFrame,
    keys: Sequence[str],
    row_id: str,
    coords: Sequence[str],
    size: int,
    about: Profile,
    side: int,
    name: str = "block",
) -> DataFrame:
    """Add the block number of each row; copies of one position are ordered by ``row_id``."""
    coded = with_z_order(df, coords, about.low, about.span, "__z")
    numbered = ranked(coded, keys, ["__z", *coords, row_id], name="__rn", hot=about.hot[side])
    block = F.floor((F.col("__rn") - 1) / F.lit(size)).cast("bigint")
    return numbered.withColumn(name, block).drop("__z", "__rn")


#: The column in which rows keep their place along their group's curve.
CURVE = "curve"


def with_curve(df: DataFrame, keys: Sequence[str], row_id: str, coords: Sequence[str], name: str = CURVE) -> DataFrame:
    """Rows with their place from 1 along the Z-curve of their group, written out.

    Every later search over these rows, or over some of them, reads its blocks off this column and sorts nothing.
    """
    hot_rows = hot_row_limit(df.sparkSession)
    about = profile(df.select(*keys, *coords), df.select(*keys, *coords).limit(0), keys, coords, hot_rows)
    coded = with_z_order(df, coords, about.low, about.span, "__z")
    placed = ranked(coded, list(keys), ["__z", *coords, row_id], name=name, hot_rows=hot_rows, hot=about.hot[0])
    return materialize(placed.drop("__z"), "curve")


def block_of(size: int, curve: str = CURVE) -> Column:
    return F.floor((F.col(curve) - 1) / F.lit(size)).cast("bigint")


def boxes(df: DataFrame, by: Sequence[str], coords: Sequence[str], count: Column | None = None) -> DataFrame:
    return df.groupBy(*by).agg(
        (count if count is not None else F.count(F.lit(1))).alias("n"),
        *[F.min(c).alias(f"lo_{c}") for c in coords],
        *[F.max(c).alias(f"hi_{c}") for c in coords],
    )


def merge_boxes(df: DataFrame, by: Sequence[str], coords: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.sum("n").alias("n"),
        *[F.min(f"lo_{c}").alias(f"lo_{c}") for c in coords],
        *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in coords],
    )


def squared_sum(parts: Sequence[Column]) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return total


def box_min_d2(a: str, b: str, coords: Sequence[str]) -> Column:
    """Squared gap between box ``a`` and box ``b`` (column prefixes)."""
    return squared_sum([
        F.greatest(F.col(f"{a}lo_{c}") - F.col(f"{b}hi_{c}"), F.lit(0.0), F.col(f"{b}lo_{c}") - F.col(f"{a}hi_{c}"))
        for c in coords
    ])


def box_max_d2(a: str, b: str, coords: Sequence[str]) -> Column:
    """Squared distance of the farthest corners of two boxes."""
    return squared_sum([
        F.greatest(F.col(f"{a}hi_{c}") - F.col(f"{b}lo_{c}"), F.col(f"{b}hi_{c}") - F.col(f"{a}lo_{c}"))
        for c in coords
    ])
