import random

import numpy as np
import pytest
import xxhash

from pointprep.llm import simhash as sh
from tests.llm.conftest import EDGES


def plain_simhash(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not ws:
        return 0
    k = min(3, len(ws))
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i:i + k]), 42) for i in range(len(ws) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(prints):
    label = dict(prints)
    ids = list(prints)
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (label[a] ^ label[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("crowded", [50_000, 2])
def test_classes_against_all_pairs(spark, docs, monkeypatch, crowded):
    monkeypatch.setattr(sh, "GROUP_ROWS", crowded)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = list(EDGES)
    for g in range(30):
        base = rng.choices(vocabulary, k=rng.choice([5, 60, 300]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((100 + len(rows), " ".join(copy)))
    prints = {d: plain_simhash(t) for d, t in rows}
    got = {r["doc_id"]: r for r in sh.simhash_classes(docs(rows)).collect()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r["component_id"] for d, r in got.items()} == plain_classes(prints)


def test_trie_finds_every_pair(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 48, 60, dtype=np.uint64)
    near = base[rng.integers(0, 60, 900)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 48, 900).astype(np.uint64))
    values = np.unique(np.concatenate([base, near]))
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 3}
    for pairs in (1 << 20, 50):
        monkeypatch.setattr(sh, "PAIRS", pairs)
        got = sh.trie_links(values, 48)
        assert {(min(i, j), max(i, j)) for i, j in got.tolist()} == want


def test_edges(spark, docs):
    assert sh.simhash_classes(docs([])).count() == 0
    got = sorted((r["doc_id"], r["component_id"]) for r in sh.simhash_classes(docs([(4, "a b"), (4, "a b"), (2, "A  b")])).collect())
    assert got == [(2, 2), (4, 2), (4, 2)]
