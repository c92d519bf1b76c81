"""Selection by rank in a fixed number of passes, for all groups, columns and positions at once.

The first pass keeps one bounded quantile sketch per group and column, combined map-side. The sketch's rank error is
bounded, so it gives two values between which a wanted position certainly lies. The second pass counts the rows
beyond them and the few different values between them. No task ever holds a group's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pointprep.plans.salt import salted_join
from pointprep.plans.skew import BROADCAST_ROWS, hot_from_counts, hot_row_limit
from pointprep.session import materialize

#: A sketch is off by at most one part in so many of a group's rows.
ACCURACY = 10_000
#: In groups up to this size every value lies between the bounds; the sketch's error is less than a row there.
WHOLE_ROWS = 4 * ACCURACY


def near_bounds(df: DataFrame, bounds: DataFrame, keys: Sequence[str], spread: Sequence[str], n: str, hot_rows: int) -> DataFrame:
    """Rows with their group's bounds: by broadcast while there are few groups, else by key with large groups dealt out."""
    groups = bounds.count()
    if groups <= BROADCAST_ROWS:
        renamed = bounds.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in bounds.columns if c not in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        return df.join(F.broadcast(renamed), same).drop(*[f"__r_{k}" for k in keys])
    return salted_join(df, bounds, keys, spread, hot=hot_from_counts(bounds, keys, n, hot_rows))


def percentiles(
    df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]], hot_rows: int | None = None, whole_rows: int = WHOLE_ROWS
) -> DataFrame:
    """Exact linear-interpolated percentiles: per group ``n`` rows and for each name its (column, probability).

    Nulls of a column do not count in it. ``df`` is read twice, whatever the groups, columns and probabilities.
    """
    keys = list(keys)
    limit = hot_rows if hot_rows is not None else hot_row_limit(df.sparkSession)
    names = list(wanted)
    columns = sorted({c for c, _ in wanted.values()})
    slack = 3.0 / ACCURACY
    # From the nearer end: what lies beyond the bounds is then the smaller part and is only counted.
    low_end = {w: p <= 0.5 for w, (_, p) in wanted.items()}
    edges = {c: sorted({min(1.0, max(0.0, p + d)) for cc, p in wanted.values() if cc == c for d in (-slack, slack)}) for c in columns}
    sketched = df.select(*keys, *columns).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__all"),
        *[F.count(c).alias(f"__n_{c}") for c in columns],
        *[F.percentile_approx(c, edges[c], ACCURACY).alias(f"__q_{c}") for c in columns],
    )

    def edge(w: str, d: float) -> Column:
        c, p = wanted[w]
        at = edges[c].index(min(1.0, max(0.0, p + d)))
        inside = (F.col(f"__n_{c}") > whole_rows) & F.lit(0.0 < p + d < 1.0)
        return F.when(inside, F.col(f"__q_{c}")[at])

    bounds = materialize(
        sketched.select(
            *keys, "__all", *[f"__n_{c}" for c in columns],
            *[edge(w, -slack).alias(f"__lo_{w}") for w in names], *[edge(w, slack).alias(f"__hi_{w}") for w in names],
        ),
        "bounds",
    )
    found = _selected(near_bounds(df.select(*keys, *columns), bounds, keys, columns, "__all", limit), keys, wanted, low_end)
    wide = found.groupBy(*keys).pivot("__w", names).agg(F.first("__x"))
    totals = bounds.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col("__all").alias("n"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return totals.join(wide, same, "left").select(*[F.col(f"__r_{k}").alias(k) for k in keys], "n", *names)


def _selected(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], low_end: dict[str, bool]) -> DataFrame:
    marks = []
    for w, (c, p) in wanted.items():
        v = F.col(c)
        below, above = v < F.col(f"__lo_{w}"), v > F.col(f"__hi_{w}")
        inside = ~F.coalesce(below, F.lit(False)) & ~F.coalesce(above, F.lit(False))
        outside = below if low_end[w] else above
        n = F.col(f"__n_{c}")
        marks.append(F.when(v.isNotNull() & (inside | outside), F.struct(
            F.lit(w).alias("w"), F.when(inside, v.cast("double")).alias("v"), n.alias("n"),
        )))
    kept = F.filter(F.array(*marks), lambda m: m.isNotNull())
    counted = (
        rows.select(*keys, F.explode(kept).alias("m")).select(*keys, "m.*")
        .groupBy(*keys, F.col("w").alias("__w"), "v", "n").agg(F.count(F.lit(1)).alias("c"))
    )
    probs = F.create_map(*[F.lit(x) for w, (_, p) in wanted.items() for x in (w, p)])
    lows = F.create_map(*[F.lit(x) for w in wanted for x in (w, low_end[w])])
    one = W.partitionBy(*keys, "__w")
    # The count of what lies outside has no value and comes first.
    before = F.coalesce(F.sum("c").over(one.orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumns({
        "__before": before, "__sum": F.sum("c").over(one), "__p": F.element_at(probs, F.col("__w")), "__low": F.element_at(lows, F.col("__w")),
        "__out": F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))).over(one), F.lit(0)),
    })
    # From the upper end the outside rows follow the inside ones instead.
    start = F.when(F.col("__low"), F.col("__before")).otherwise(F.col("n") - F.col("__sum") + F.col("__before") - F.col("__out"))
    pos = (F.col("n") - 1) * F.col("__p")
    at = F.floor(pos)
    placed = placed.filter(F.col("v").isNotNull()).withColumns({"__s": start, "__at": at, "__frac": pos - at})

    def holds(r: Column) -> Column:
        return (F.col("__s") <= r) & (r < F.col("__s") + F.col("c"))

    both = placed.groupBy(*keys, "__w").agg(
        F.max("__frac").alias("__frac"),
        F.max(F.when(holds(F.col("__at")), F.col("v"))).alias("__a"),
        F.max(F.when(holds(F.least(F.col("__at") + 1, F.col("n") - 1)), F.col("v"))).alias("__z"),
    )
    a, z, frac = F.col("__a"), F.col("__z"), F.col("__frac")
    missed = F.raise_error(F.lit("a wanted position lies outside its sketch's bounds")).cast("double")
    # The blend that the built-in percentile uses, to the last bit.
    blended = F.when(a.isNull() | z.isNull(), missed).when(frac == 0, a).when(a == z, a).otherwise((F.lit(1.0) - frac) * a + frac * z)
    return both.select(*keys, "__w", blended.alias("__x"))


#: Shares of a group at which a sample's sketch is read, the whole first.
SHARES = [2.0**-j for j in range(14)]


def threshold(sketch: Column, n: Column, need: Column) -> Column:
    """A value that at least ``need`` of ``n`` rows do not exceed, read from ``sketch`` at ``SHARES``; NULL if all may be needed.

    The least such share of the group is taken, so a few times ``need`` rows pass, beside the sketch's error.
    """
    enough = [
        F.when((n > WHOLE_ROWS) & (n * s - n * (2.0 / ACCURACY) - 1 >= need), sketch[i]) for i, s in enumerate(SHARES) if 0 < i
    ]
    return F.coalesce(*reversed(enough))
