"""Centroid clustering whose nearest-centroid search is the threshold algorithm.

For each dimension the centroids are listed in the order of their component. A vector enters every
list at its own value and walks outward, one centroid of each list per step, always to the
nearer side. A centroid seen for the first time gets its exact distance. What no list has shown yet
is in each dimension at least as far as that list's next centroid, so the sum of these squared gaps bounds
all unseen distances; once it is strictly above the best exact distance, the walk ends. A bound
equal to the best goes on, since an unseen centroid of the same distance may have the smaller number.

Components are integers, so sums are exact in any order. Each task keeps one running sum per cluster.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pointprep.llm.common import arrow_map, materialize

#: Vectors that walk together.
BATCH = 512
#: Components up to this size keep squared distances of up to 2^9 dimensions within 64 bits; others are Python integers.
SAFE = 1 << 26
_FAR = np.iinfo(np.int64).max
_LONG = 1 << 63


class CentroidLists:
    """Centroids with, per dimension, their numbers and values in the order of the value."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = any(abs(v) > SAFE for c in centroids for v in c) or (bool(centroids) and len(centroids[0]) > 512)
        self.points = np.array(centroids, object if self.exact else np.int64)
        self.order = np.argsort(self.points, axis=0, kind="stable").T
        self.values = np.take_along_axis(self.points, self.order.T, axis=0).T

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row, ties to the smaller number."""
        if self.exact or vectors.dtype == object:
            return self._nearest_of_any_size(vectors)
        found = [self._walk(vectors[a: a + BATCH]) for a in range(0, len(vectors), BATCH)]
        return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, dims = x.shape
        k = len(self.points)
        right = np.stack([np.searchsorted(self.values[d], x[:, d]) for d in range(dims)], axis=1)
        left = right - 1
        # One guard at either end of each list: nothing there, infinitely far.
        low, high = np.full((dims, 1), -SAFE * 8), np.full((dims, 1), SAFE * 8)
        values = np.concatenate([low, self.values, high], axis=1).astype(np.int64)
        order = np.concatenate([np.zeros((dims, 1), np.int64), self.order, np.zeros((dims, 1), np.int64)], axis=1)
        dim = np.arange(dims)
        best = np.full(n, _FAR)
        who = np.full(n, k, np.int64)
        seen = np.zeros((n, k), bool)
        rows = np.arange(n)
        while len(rows):
            at = x[rows]
            down, up = at - values[dim, left[rows] + 1], values[dim, right[rows] + 1] - at
            nearer = down <= up
            step = np.where(nearer, left[rows], right[rows])
            fresh = np.zeros((len(rows), k), bool)
            fresh[np.arange(len(rows))[:, None], order[dim, step + 1]] = True
            fresh &= ~seen[rows]
            seen[rows] |= fresh
            i, c = np.nonzero(fresh)
            gap = at[i] - self.points[c]
            table = np.full((len(rows), k), _FAR)
            table[i, c] = np.einsum("ij,ij->i", gap, gap)
            first = table.argmin(axis=1)
            value = table[np.arange(len(rows)), first]
            better = (value < best[rows]) | ((value == best[rows]) & (first < who[rows]))
            best[rows[better]], who[rows[better]] = value[better], first[better]
            left[rows] -= nearer
            right[rows] += ~nearer
            frontier = np.minimum(at - values[dim, left[rows] + 1], values[dim, right[rows] + 1] - at)
            # Differences to the guards are far beyond any distance and stay within 64 bits as floats.
            bound = np.square(frontier.astype(np.float64)).sum(axis=1)
            exact = np.where(bound < 2.0**52, np.einsum("ij,ij->i", frontier, frontier), 0)
            over = np.where(bound < 2.0**52, exact > best[rows], bound * (1 - 1e-9) > best[rows])
            rows = rows[~(over | seen[rows].all(axis=1))]
        return who, best

    def _nearest_of_any_size(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same walk on Python integers, a vector at a time; for components too large for 64 bits."""
        from bisect import bisect_left

        k, values, order = len(self.points), self.values.tolist(), self.order.tolist()
        points = self.points.tolist()
        who, best = [], []
        for x in vectors.tolist():
            right = [bisect_left(v, a) for v, a in zip(values, x)]
            left = [r - 1 for r in right]
            distance: dict[int, int] = {}
            while True:
                bound = 0
                for d, a in enumerate(x):
                    lo = a - values[d][left[d]] if left[d] >= 0 else None
                    hi = values[d][right[d]] - a if right[d] < k else None
                    if lo is not None and (hi is None or lo <= hi):
                        c, left[d] = order[d][left[d]], left[d] - 1
                    elif hi is not None:
                        c, right[d] = order[d][right[d]], right[d] + 1
                    else:
                        continue
                    if c not in distance:
                        distance[c] = sum((p - q) ** 2 for p, q in zip(x, points[c]))
                    gaps = [a - values[d][left[d]]] if left[d] >= 0 else []
                    gaps += [values[d][right[d]] - a] if right[d] < k else []
                    bound += min(gaps, default=0) ** 2
                found, c = min((v, c) for c, v in distance.items())
                if bound > found or len(distance) == k:
                    break
            who.append(c)
            best.append(found)
        return np.array(who, np.int64), np.array(best, object)


def quantised(column, scale: int) -> np.ndarray:
    """floor(scale * x) of a batch of equally long lists as 64-bit integers, or Python integers if some are large."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    shape = (len(column), -1)
    if not len(flat):
        return np.zeros((len(column), 0), np.int64)
    if np.abs(flat).max() * scale <= SAFE:
        return np.floor(flat * scale).astype(np.int64).reshape(shape)
    whole = [math.floor(v * scale) if abs(v) < 1e300 else math.floor(Fraction(v) * scale) for v in flat.tolist()]
    return np.array(whole, object).reshape(shape)


def usable(column: str, dims: int):
    """Vectors of ``dims`` components, none null, infinite or NaN."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dims) & finite


def _sums(vectors: DataFrame, lists: CentroidLists, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Size and component sums of each cluster. Integers travel as text, so no size is too large."""

    def add(batches: Iterator[dict]):
        total: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            x = quantised(batch["v"], scale)
            who, _ = lists.nearest(x)
            for c in np.unique(who).tolist():
                part = x[who == c]
                n, had = total.get(c, (0, [0] * x.shape[1]))
                total[c] = n + len(part), [a + int(b) for a, b in zip(had, part.sum(axis=0).tolist())]
        for c, (n, s) in total.items():
            yield c, n, [str(v) for v in s]

    def merge(batches: Iterator[dict]):
        total: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for c, n, s in zip(*(batch[f].to_pylist() for f in ("cluster", "n", "sums"))):
                m, had = total.get(c, (0, [0] * len(s)))
                total[c] = m + n, [a + int(b) for a, b in zip(had, s)]
        for c, (n, s) in total.items():
            yield c, n, [str(v) for v in s]

    schema = "cluster int, n long, sums array<string>"
    parts = arrow_map(vectors.select("v"), add, schema)
    # At most one row per cluster and task comes in, one per cluster goes to the driver.
    rows = arrow_map(parts.repartition("cluster"), merge, schema).collect()
    return {r["cluster"]: (r["n"], [int(v) for v in r["sums"]]) for r in rows}


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, dims: int = 64,
    vector: str = "embedding", key: str = "vec_id",
) -> DataFrame:
    """Assign each usable vector to the nearest of ``k`` centroids that ``rounds`` rounds have moved.

    A component x counts as the integer floor(scale * x). Centroids start as the vectors with the smallest
    hex digests of ``seed:key``, in that order; rows of one digest come in the order of their components,
    and a null key counts as empty text. A round gives each vector to its nearest centroid (squared Euclidean
    distance, ties to the smaller number) and moves each centroid to the floor of its vectors' exact mean; one
    without vectors stays. Returns ``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256``, a row per usable row, rows with one key included.

    Null vectors, other lengths and null or non-finite components take no part; fewer than ``k`` vectors give
    fewer centroids, none an empty result. Other columns are not read. A distance or sum beyond a long is null,
    the cluster is right all the same.
    """
    spark = vectors.sparkSession
    kept = materialize(
        vectors.filter(usable(vector, dims)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")),
        "vectors",
    )
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    schema = f"{key} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = [[math.floor(Fraction(x) * scale) for x in r["v"]] for r in first]
    for _ in range(rounds):
        for c, (n, sums) in _sums(kept, CentroidLists(centroids), scale).items():
            centroids[c] = [s // n for s in sums]
    lists = CentroidLists(centroids)

    def assign(batches: Iterator[dict]):
        for batch in batches:
            who, far = lists.nearest(quantised(batch["v"], scale))
            for i, c, d in zip(batch["id"].to_pylist(), who.tolist(), far.tolist()):
                yield i, c, d if d < _LONG else None

    placed = materialize(arrow_map(kept, assign, "id long, cluster int, distance long"), "clusters")
    sums = placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")
    ).collect()
    part = {r["cluster"]: None if r["lost"] else int(r["s"]) for r in sums}
    whole = None if None in part.values() else sum(part.values())

    def fits(v: int | None) -> int | None:
        return v if v is not None and v < _LONG else None

    # One row per centroid.
    about = spark.createDataFrame(
        [(c, fits(s), fits(whole), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in part.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return placed.join(F.broadcast(about), "cluster").select(
        F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
