"""Nearest neighbours by randomly rotated one-bit codes.

A vector is centred, scaled to length one, turned by a random rotation and kept as the
signs of its components, with two numbers: its length, and its inner product with its own
code. From a query's rotated components the packed bits then give an unbiased estimate of
the inner product and a bound of its error. Only vectors whose lower bound of the
distance is below the k-th distance found so far are ranked by their original components.

Every row is scanned for every query, block by block: there are no cells to miss. Queries
go out in chunks of bounded size; a partition keeps k rows per query and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from pointprep.llm.common import arrow_map, materialize

#: Queries per broadcast chunk, queries and rows per block of estimates.
QUERY_CHUNK = 8_192
QUERY_BLOCK = 256
ROW_BLOCK = 4_096
#: Width of the error bound in standard deviations.
ERROR_WIDTH = 3.0


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vector: str, dim: int | None = None) -> Column:
    """Not null, not zero, every component a finite number, and of the right length."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    ok = F.col(vector).isNotNull() & good & some
    return ok if dim is None else ok & (F.size(vector) == dim)


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, distances to the centre, and inner products of unit vectors with their codes."""
    moved = (vectors - centre) @ turn
    length = np.linalg.norm(moved, axis=1)
    signs = moved > 0
    own = np.abs(moved).sum(axis=1) / np.sqrt(vectors.shape[1]) / np.where(length > 0, length, 1)
    return np.packbits(signs, axis=1), length, np.where(length > 0, own, 1.0)


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", seed: int = 42) -> tuple[DataFrame, dict]:
    """Every usable row with its code, written out, and the numbers needed to read the codes.

    The centre is the mean of all usable rows. The dimension is that of most rows; rows of
    another length take no part.
    """
    rows = vectors.filter(usable(vector)).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return rows.withColumns({"code": F.lit(b""), "len": F.lit(0.0), "own": F.lit(1.0)}), {"dim": 0}
    dim, n = lengths["d"], lengths["count"]
    rows = rows.filter(F.size("v") == dim)

    def sums(batches: Iterator[dict]):
        total = np.zeros(dim)
        for batch in batches:
            total += _matrix(batch["v"], dim).sum(axis=0)
        yield (total.tolist(),)

    parts = arrow_map(rows.select("v"), sums, "s array<double>")
    added = parts.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    centre = np.array([r["x"] for r in sorted(added)]) / n
    turn = rotation(dim, seed)

    def codes(batches: Iterator[dict]):
        for batch in batches:
            x = _matrix(batch["v"], dim)
            bits, length, own = encode(x, centre, turn)
            yield from zip(batch["id"].to_pylist(), x, map(bytes, bits), length.tolist(), own.tolist())

    kind = vectors.schema[key].dataType.simpleString()
    index = arrow_map(rows, codes, f"id {kind}, v array<double>, code binary, len double, own double")
    return materialize(index, "codes"), {"dim": dim, "centre": centre, "turn": turn}


class _Best:
    """The k nearest rows found so far for a block of queries, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, shape: dict):
        self.ids, self.queries, self.k = ids, queries, k
        self.near = [np.empty(0)] * len(ids)
        self.who = [np.empty(0, np.int64)] * len(ids)
        moved = (queries - shape["centre"]) @ shape["turn"]
        self.length = np.linalg.norm(moved, axis=1)
        self.turned = moved / np.where(self.length > 0, self.length, 1)[:, None]

    def add(self, ids: np.ndarray, x: np.ndarray, signs: np.ndarray, length: np.ndarray, own: np.ndarray) -> None:
        dim = x.shape[1]
        ip = signs @ self.turned.T / own[:, None]
        # The part of a unit vector across its code is turned at random against the query.
        error = ERROR_WIDTH * np.sqrt(np.maximum(1 - own**2, 0) / max(dim - 1, 1)) / own
        base = length[:, None] ** 2 + self.length[None, :] ** 2
        scale = 2 * length[:, None] * self.length[None, :]
        low = base - scale * np.minimum(ip + error[:, None], 1)
        for q in range(len(self.ids)):
            bound = low[:, q]
            if len(self.near[q]) < self.k and len(bound) > self.k:
                # The first k by estimate give a distance to beat.
                self._rank(q, np.argpartition(bound, self.k)[: self.k + 1], ids, x)
            reach = self.near[q][-1] ** 2 * (1 + 1e-9) + 1e-12 if len(self.near[q]) >= self.k else np.inf
            self._rank(q, np.flatnonzero(bound <= reach), ids, x)

    def _rank(self, q: int, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        rows = rows[(ids[rows] != self.ids[q]) & ~np.isin(ids[rows], self.who[q])]
        if not len(rows):
            return
        near = np.concatenate([self.near[q], np.sqrt(((x[rows] - self.queries[q]) ** 2).sum(axis=1))])
        who = np.concatenate([self.who[q], ids[rows]])
        best = np.lexsort((who, near))[: self.k]
        self.near[q], self.who[q] = near[best], who[best]


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """The ``k`` nearest other rows of every row that ``is_query`` marks.

    Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the Euclidean distance of
    the original components in double precision; ties go to the smaller id. A query without
    other rows gives none. Vectors that are null, zero, or hold a null or a number that is
    not finite take no part, as rows or as queries. Keys are integers and identify a row: rows with the
    query's own key are no candidates, and of rows with one key each batch keeps one. The
    error bound holds with probability 0.997 per estimate, so a neighbour can be missed.
    """
    index, shape = build_index(vectors.withColumn("__q", is_query), key, vector, seed)
    schema = "query_id long, vec_id long, score double"
    spark = vectors.sparkSession
    if not shape["dim"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = shape["dim"]
    asked = vectors.filter(is_query & usable(vector, dim)).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    chunks = max(1, math.ceil(asked.count() / QUERY_CHUNK))
    out = None
    for c in range(chunks):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c).orderBy("id").toArrow() if chunks > 1 else asked.orderBy("id").toArrow()
        ids = part["id"].combine_chunks().to_numpy()
        sent = spark.sparkContext.broadcast((ids, _matrix(part["v"].combine_chunks(), dim), shape))

        def search(batches: Iterator[dict], sent=sent):
            ids, queries, shape = sent.value
            best = [_Best(ids[i: i + QUERY_BLOCK], queries[i: i + QUERY_BLOCK], k, shape) for i in range(0, len(ids), QUERY_BLOCK)]
            for batch in batches:
                x = _matrix(batch["v"], dim)
                rows = batch["id"].to_numpy()
                width = math.ceil(dim / 8)
                bits = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, width)
                signs = (2.0 * np.unpackbits(bits, axis=1, count=dim) - 1) / math.sqrt(dim)
                length, own = batch["len"].to_numpy(), batch["own"].to_numpy()
                for at in range(0, len(rows), ROW_BLOCK):
                    s = slice(at, at + ROW_BLOCK)
                    for b in best:
                        b.add(rows[s], x[s], signs[s], length[s], own[s])
            for b in best:
                for q, near, who in zip(b.ids.tolist(), b.near, b.who):
                    yield from ((q, w, d) for w, d in zip(who.tolist(), near.tolist()))

        found = arrow_map(index, search, schema)
        out = found if out is None else out.unionAll(found)
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
