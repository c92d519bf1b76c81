"""Work on groups of bounded size: nearest rows, density clusters.

Groups of some hundred rows need no search tree, whose blocks and candidate pairs outweigh the rows many times: each
side is dealt out by key once, and a task compares a group's queries with its targets in pieces of bounded size. Likewise
density clusters of such groups need no cells and no rounds over their links.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pointprep.plans.blocks import partitions_for
from pointprep.session import materialize

#: Groups with up to so many rows on either side are compared in one task.
GROUP_ROWS = 4_096
#: Pairs that are held at a time.
PAIRS_AT_ONCE = 1 << 16
#: Lots that a row of distances is cut into, of which only the minima are sorted.
FOLDS = 8
#: A compared pair costs so much less than a row that comes out of a join.
PAIRS_PER_ROW = 20


def _bound(d2: np.ndarray, k: int) -> np.ndarray:
    """A distance for each row within which lie ``k`` of its values, and few more: the ``k``-th of the minima of small lots."""
    width = d2.shape[1] // FOLDS
    if width >= 2 * k:
        least = d2[:, :width].copy()
        for i in range(1, FOLDS):
            np.minimum(least, d2[:, i * width: (i + 1) * width], out=least)
        if not np.isnan(least).any():
            d2 = least
    return np.partition(d2, k - 1, axis=1)[:, k - 1: k]


def nearest_pairs(
    q: list[np.ndarray], t: list[np.ndarray], t_rank: np.ndarray, k: int, same: tuple[np.ndarray, np.ndarray] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, rank from 1, target, squared distance) of the ``k`` nearest, by position; ties go to the smaller ``t_rank``.

    ``same`` has codes of the ids of both sides; pairs of equal codes are left out. NaN is farther than everything.
    """
    n = len(t_rank)
    step = max(1, PAIRS_AT_ONCE // max(n, 1))
    for at in range(0, len(q[0]) if n else 0, step):
        d2 = None
        for a, b in zip(q, t):
            gap = b[None, :] - a[at: at + step, None]
            gap *= gap
            d2 = gap if d2 is None else d2 + gap
        out = None
        if same is not None:
            out = same[0][at: at + step, None] == same[1][None, :]
            np.putmask(d2, out, np.inf)
        if k < n:
            bound = _bound(d2, k)
            rows, cols = np.nonzero(~(d2 > bound) if np.isnan(bound).any() else d2 <= bound)
        else:
            rows, cols = (i.ravel() for i in np.indices(d2.shape))
        if out is not None:
            keep = ~out[rows, cols]
            rows, cols = rows[keep], cols[keep]
        order = np.lexsort((t_rank[cols], d2[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        first = np.searchsorted(rows, rows, side="left")
        rank = np.arange(len(rows)) - first + 1
        keep = rank <= k
        rows, cols = rows[keep], cols[keep]
        yield rows + at, rank[keep], cols, d2[rows, cols]


def _ranks(ids: pa.Array) -> np.ndarray:
    """Place of each id in ascending order; equal ids have one place."""
    return np.asarray(pc.rank(ids, sort_keys="ascending", tiebreaker="dense")).astype(np.int64)


def nearest_in_groups(
    q_side: DataFrame, t_side: DataFrame | None, k: int, keys: Sequence[str], coords: Sequence[str],
    payload: Sequence[str], carried: Sequence[str], exclude_same_id: bool, work: float,
) -> DataFrame:
    """The ``k`` nearest targets of each query as keys, ``__q``, ``__rank``, ``t___t``, ``__d2``, payload and carried columns.

    ``q_side`` has the keys and columns that begin with ``q_``, ``t_side`` those with ``t_``; without ``t_side`` the rows of
    ``q_side`` are the targets too, and only their id stands there twice. ``work`` is the number of pairs. As in a join, NULL is no key.
    """
    keys = list(keys)
    some = filled(keys)
    tasks = partitions_for(q_side.sparkSession, work / PAIRS_PER_ROW)
    q_side = q_side.filter(some).repartition(tasks, *keys)
    both = q_side if t_side is None else t_side
    schema = T.StructType([
        *[q_side.schema[c] for c in keys], T.StructField("__q", q_side.schema["q___q"].dataType), T.StructField("__rank", T.LongType()),
        T.StructField("t___t", both.schema["t___t"].dataType), T.StructField("__d2", T.DoubleType()),
        *[T.StructField(c, both.schema[c].dataType) for c in payload], *[T.StructField(c, q_side.schema[c].dataType) for c in carried],
    ])
    target = to_arrow_schema(schema)
    two = t_side is not None

    def compare(q: pa.Table, t: pa.Table) -> pa.Table:
        q, t = q.combine_chunks(), t.combine_chunks()
        if not len(q) or not len(t):
            return target.empty_table()
        axis = lambda rows, prefix: [rows[f"{prefix}{c}"].to_numpy() for c in coords]
        q_xyz, t_xyz = axis(q, "q_"), axis(t, "t_" if two else "q_")
        t_rank = _ranks(t["t___t"].combine_chunks())
        same = None
        if exclude_same_id:
            codes = _ranks(pa.chunked_array([*q["q___q"].chunks, *t["t___t"].chunks]).combine_chunks())
            same = codes[:len(q)], codes[len(q):]
        found = [np.concatenate(c) for c in zip(*nearest_pairs(q_xyz, t_xyz, t_rank, k, same))]
        of_q, of_t = q.take(found[0]), t.take(found[2])
        lacks = any(rows[f"{p}{c}"].null_count for rows, p in ((q, "q_"), (t, "t_" if two else "q_")) for c in coords)
        d2 = found[3].astype(float)
        columns = [
            *[of_q[c] for c in keys], of_q["q___q"], pa.array(found[1].astype(np.int64)), of_t["t___t"],
            pa.array(d2, mask=np.isnan(d2) if lacks else None), *[of_t[c] for c in payload], *[of_q[c] for c in carried],
        ]
        return pa.table(dict(zip(target.names, columns))).cast(target)

    if not two:
        return q_side.groupBy(*keys).applyInArrow(lambda rows: compare(rows, rows), schema)
    return q_side.groupBy(*keys).cogroup(t_side.filter(some).repartition(tasks, *keys).groupBy(*keys)).applyInArrow(compare, schema)


def filled(keys: Sequence[str]):
    """That no key is NULL."""
    some = F.lit(True)
    for c in keys:
        some = some & F.col(c).isNotNull()
    return some


def split_by_size(df: DataFrame, keys: Sequence[str], group_rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of groups with at most ``group_rows`` rows, dealt out by key, and the rows of the others; None where there are none."""
    keys = list(keys)
    df = df.filter(filled(keys))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    fits = F.col("__n") <= group_rows
    pairs = F.col("__n").cast("double") * F.col("__n")
    about = sizes.agg(F.count_if(fits).alias("small"), F.count_if(~fits).alias("large"), F.sum(F.when(fits, pairs)).alias("work")).first()
    small = large = df
    if about["small"] and about["large"]:
        listed = materialize(sizes.filter(~fits).select(*keys), "large")
        small, large = df.join(listed, keys, "left_anti"), df.join(listed, keys, "left_semi")
    tasks = partitions_for(df.sparkSession, (about["work"] or 0) / PAIRS_PER_ROW)
    return small.repartition(tasks, *keys) if about["small"] else None, large if about["large"] else None


def density_labels(coords: list[np.ndarray], eps2: float, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """DBSCAN of one group: the position of the first core row of each row's cluster, or -1, and which rows are core.

    A row that is not core takes the least label among the core rows within reach. NaN is near nothing.
    """
    n = len(coords[0])
    near = np.empty((n, n), bool)
    step = max(1, PAIRS_AT_ONCE // max(n, 1))
    for at in range(0, n, step):
        d2 = None
        for a in coords:
            gap = a[at: at + step, None] - a[None, :]
            gap *= gap
            d2 = gap if d2 is None else d2 + gap
        np.less_equal(d2, eps2, out=near[at: at + step])
    core = near.sum(axis=1) >= min_samples
    label = np.full(n, -1)
    open_rows = core.copy()
    for first in np.flatnonzero(core):
        if not open_rows[first]:
            continue
        front = np.array([first])
        open_rows[first] = False
        while len(front):
            label[front] = first
            front = np.flatnonzero(near[front].any(axis=0) & open_rows)
            open_rows[front] = False
    for i in np.flatnonzero(~core):
        around = label[near[i] & core]
        if len(around):
            label[i] = around.min()
    return label, core


def dbscan_in_groups(rows: DataFrame, eps: float, min_samples: int, key: str, coords: Sequence[str]) -> DataFrame:
    """``key``, ``id``, ``label`` and ``is_core`` of rows that have been dealt out by key."""
    schema = T.StructType([
        rows.schema[key], rows.schema["id"], T.StructField("label", rows.schema["id"].dataType), T.StructField("is_core", T.BooleanType()),
    ])
    target = to_arrow_schema(schema)

    def cluster(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["id"]))
        label, core = density_labels([table[c].to_numpy() for c in coords], eps * eps, min_samples)
        named = table["id"].take(pa.array(label, mask=label < 0))
        return pa.table(dict(zip(target.names, [table[key], table["id"], named, pa.array(core)]))).cast(target)

    return rows.groupBy(key).applyInArrow(cluster, schema)


def lloyd(xyz: list[np.ndarray], centres: list[np.ndarray], max_iter: int, tol: float) -> list[np.ndarray]:
    """Lloyd rounds of one group until no centroid moves by more than ``tol``; ties go to the first, missing values to no mean."""
    have = [~np.isnan(a) for a in xyz]
    for _ in range(max_iter):
        d2 = None
        for a, c in zip(xyz, centres):
            gap = c[None, :] - a[:, None]
            gap *= gap
            d2 = gap if d2 is None else d2 + gap
        near = d2.argmin(axis=1)
        new = []
        for a, c, ok in zip(xyz, centres, have):
            n = np.bincount(near[ok], minlength=len(c))
            new.append(np.where(n > 0, np.bincount(near[ok], a[ok], len(c)) / np.maximum(n, 1), c))
        moved = np.sqrt(sum((b - c) ** 2 for b, c in zip(new, centres)))
        centres = new
        if not (moved > tol).any():
            break
    return centres


def kmeans_in_groups(rows: DataFrame, seeds: DataFrame, keys: Sequence[str], coords: Sequence[str], max_iter: int, tol: float) -> DataFrame:
    """Final centroids of the groups in ``seeds``, whose points ``rows`` have been dealt out by the first key."""
    keys, coords = list(keys), list(coords)
    columns = [*keys, "cluster", *coords]
    schema = T.StructType([seeds.schema[c] if c not in coords else T.StructField(c, T.DoubleType()) for c in columns])
    target = to_arrow_schema(schema)

    def whole(points: pa.Table, first: pa.Table) -> pa.Table:
        if not len(points) or not len(first):
            return target.empty_table()
        first = first.sort_by([(c, "ascending") for c in (*keys[1:], "cluster")])
        # Groups of this key by their place among the seeds.
        named = list(zip(*(first[c].to_pylist() for c in keys)))
        group = {k: i for i, k in enumerate(dict.fromkeys(named))}
        of_seed = np.array([group[k] for k in named])
        of_point = np.array([group.get(k, -1) for k in zip(*(points[c].to_pylist() for c in keys))])
        xyz = [points[c].to_numpy().astype(float) for c in coords]
        out = [first[c].to_numpy().astype(float) for c in coords]
        for i in range(len(group)):
            mine, at = np.flatnonzero(of_point == i), np.flatnonzero(of_seed == i)
            if len(mine):
                for to, c in zip(out, lloyd([a[mine] for a in xyz], [a[at] for a in out], max_iter, tol)):
                    to[at] = c
        return pa.table(dict(zip(columns, [*(first[c] for c in (*keys, "cluster")), *map(pa.array, out)]))).cast(target)

    return rows.groupBy(keys[0]).cogroup(seeds.select(*columns).groupBy(keys[0])).applyInArrow(whole, schema)
