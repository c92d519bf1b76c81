"""Centroid clustering by threshold walks against plain loops."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from pointprep.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v int, id string"


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 0, "x", 1, "y") for i, v in rows], SCHEMA.replace("array<double>", f"array<{kind}>")).repartition(3)


def brute(rows, k, rounds, dims, scale=256):
    rows = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(Fraction(a) * scale) for a in v] for _, v in rows]

    def order(i):
        return hashlib.sha256(f"2:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), rows[i][1]

    cents = [x[i] for i in sorted(range(len(x)), key=order)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(cents)) for p in x]

    for _ in range(rounds):
        got = assign()
        for c in range(len(cents)):
            own = [p for p, (_, n) in zip(x, got) if n == c]
            if own:
                cents[c] = [sum(col) // len(own) for col in zip(*own)]
    got = assign()
    inertia = {c: sum(d for d, n in got if n == c) for c in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(
        ((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (d, n) in zip(rows, got)), key=repr
    )


def run(spark, rows, k, rounds, dims):
    return sorted(map(tuple, ce.cluster_vectors(frame(spark, rows), k, rounds, dims=dims).collect()), key=repr)


def test_equals_loops_with_ties_copies_and_unusable_rows(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-1.5, 0.0, 0.25, 1.0, 1.003]) for _ in range(4)]) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(None, [0.5] * 4), (None, [0.25] * 4), (5, [9.0] * 4), (5, [9.0] * 4)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0, None, 0.0, 0.0]), (2004, [float("nan")] * 4), (2005, [float("-inf")] * 4)]
    assert run(spark, rows, 7, 3, 4) == brute(rows, 7, 3, 4)


def test_components_of_any_size(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) * 10.0 ** rnd.choice([0, 3, 6]) for _ in range(3)]) for i in range(60)]
    assert run(spark, rows, 5, 2, 3) == brute(rows, 5, 2, 3)
    huge = rows + [(100, [1e308, -1e308, 1.0])]
    got, want = run(spark, huge, 5, 2, 3), brute(huge, 5, 2, 3)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == [r[2] if r[2] < 2**63 else None for r in want]


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5, -0.5]), (2, [3.0, 4.0])]
    assert run(spark, rows, 9, 2, 2) == brute(rows, 9, 2, 2)
    assert run(spark, [(1, None)], 9, 2, 2) == []
    assert ce.cluster_vectors(frame(spark, []).limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("spread", [1, 8, 200])
def test_walks_end_early_and_never_miss(spread, monkeypatch):
    rng = np.random.default_rng(spread)
    points = rng.integers(-4000, 4000, (40, 16))
    x = points[rng.integers(0, 40, 700)] + rng.integers(-spread, spread + 1, (700, 16))
    lists = ce.CentroidLists(points.tolist())
    who, far = lists.nearest(x)
    every = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (who == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
    large = ce.CentroidLists(points.tolist())
    large.exact = True
    slow = large.nearest(x[:50].astype(object))
    assert (slow[0] == who[:50]).all() and (slow[1] == far[:50]).all()
    met = []
    plain = np.einsum
    monkeypatch.setattr(ce.np, "einsum", lambda f, a, b: (met.append(len(a)), plain(f, a, b))[1])
    lists.nearest(x)
    assert sum(met[::2]) < 700 * 40
