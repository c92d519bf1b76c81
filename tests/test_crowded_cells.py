"""Links between two crowded cells: few pairs are formed, and the answer is that of all pairs."""

import numpy as np
import pytest

from pointprep.operators import cluster

EPS = 1.0


def links(spark, a, b, monkeypatch, direct=64):
    rows = [("c", 1, i, *map(float, p)) for i, p in enumerate(a)] + [("c", 2, 10**7 + i, *map(float, p)) for i, p in enumerate(b)]
    named = cluster.materialize(spark.createDataFrame(rows, "case_id string, node bigint, id bigint, x double, y double"), "named")
    monkeypatch.setattr(cluster, "DIRECT_PAIRS", direct)
    formed = []
    plain = cluster.materialize
    monkeypatch.setattr(cluster, "materialize", lambda df, label: (lambda d: (formed.append(d.count()) if label == "boxes" else None, d)[1])(plain(df, label)))
    large = spark.createDataFrame([("c", 1, 2)], "case_id string, src bigint, dst bigint")
    got = cluster._links_of_crowded(large, named, EPS * EPS, "case_id", ["x", "y"]).count()
    return got, sum(formed)


@pytest.mark.parametrize("gap,touch", [(0.3, True), (0.999, True), (1.0001, False), (1.3, False)])
def test_against_all_pairs(spark, monkeypatch, gap, touch):
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 0.7, (20_000, 2))
    b = rng.uniform(0, 0.7, (20_000, 2)) + [a[:, 0].max() + gap, 0]
    # The two points nearest to each other lie at the same height.
    a[0], b[0] = [a[:, 0].max(), 0.5], [a[:, 0].max() + gap, 0.5]
    got, formed = links(spark, a, b, monkeypatch)
    assert got == touch
    assert formed < 20_000


def test_copies_of_two_positions(spark, monkeypatch):
    one = np.zeros((3_000, 2))
    assert links(spark, one, one + [1.0, 0.0], monkeypatch)[0] == 1
    monkeypatch.undo()
    assert links(spark, one, one + [1.0 + 1e-9, 0.0], monkeypatch)[0] == 0
