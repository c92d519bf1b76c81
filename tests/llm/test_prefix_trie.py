"""The conversation trie against plain loops over all prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pointprep.llm import prefix_trie as pt
from pointprep.llm.queries import rebuilt_paths

SCHEMA = "conv_id long, turn long, role string, text string, path string, key int, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA).repartition(3)


def turns_of(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))

    def order(x):
        turn, role, text = x
        return turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()

    return {c: [x[1:] for x in sorted(t, key=order)] for c, t in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members, last = {}, {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
            last[tuple(path[:d])] = path[d - 1][1] if d else ""
    own = {p: (len(m) - 1) * len(last[p].encode()) for p, m in members.items()}
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children), leaves, sum(own[q] for q in below),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def rows_of(seed, n, words):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, 7)):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(words)))
    return rows


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


EDGES = [
    (50, None, "user", "a"), (50, 0, None, None), (50, 0, "user", "b"), (50, 0, "user", "b"), (None, 0, "user", "a"),
    (60, 0, "user", "naïve 漢字"), (61, 0, "user", "naïve 漢字"), (61, 1, "", ""), (75, 3, "user", "x" * 50_000), (-4, 0, "user", "a"),
]


@pytest.mark.parametrize("shards", [1, 3, 40, None])
def test_equals_loops(spark, shards):
    rows = rows_of(1, 60, ["a", "bb", "é"]) + EDGES
    got = pt.prefix_trie(pt.conversation_paths(frame(spark, rows)), shards)
    assert collected(got) == brute(turns_of(rows))


@pytest.mark.parametrize("shards", [5, 60])
def test_rebuilt_conversations(spark, shards):
    rows = rows_of(2, 90, ["a", "bb"]) + [(200 + i, t, "user", "same") for i in range(40) for t in range(3)] + [(503, 0, "user", "lone")]
    got = pt.prefix_trie(rebuilt_paths(frame(spark, rows)), shards)
    want = rebuilt(turns_of(rows))
    assert any(not p for p in want.values())
    assert collected(got) == brute(want)


def test_copies_and_a_common_first_turn_spread(spark, monkeypatch):
    """A third of all conversations are one path and another third share their first turn."""
    monkeypatch.setattr(pt, "CHUNK", 64)
    rows = [(c, 0, "user", "copy") for c in range(300)] + [(c, t, "user", "first" if t == 0 else str(c % 97)) for c in range(300, 600) for t in (0, 1)]
    rows += [(c, 0, "user", f"own {c}") for c in range(600, 700)]
    paths = pt.conversation_paths(frame(spark, rows))
    assert collected(pt.prefix_trie(paths, 20)) == brute(turns_of(rows))
    first = paths.filter("conv_id = 300").first()["path"][0]["key"]
    keys = [r["key"] for r in pt.distinct_paths(paths).select("key").collect()]
    splitters = pt.pick_splitters(keys, 20)
    assert sum(s.startswith(first) for s in splitters) >= 5
    # Every node whose members lie in two shards is in the skeleton.
    skeleton = pt.skeleton_of(splitters)
    at = {}
    for k in keys:
        for d in range(len(k) // pt.DIGITS + 1):
            at.setdefault(k[: d * pt.DIGITS], set()).add(pt.bisect_right(splitters, k))
    assert all(p in skeleton for p, s in at.items() if len(s) > 1)


def test_a_long_conversation_and_short_splitters(spark, monkeypatch):
    monkeypatch.setattr(pt, "DRAWN_BYTES", 1)
    rows = [(c, t, "user", "t") for c in (1, 2) for t in range(300 + c)] + rows_of(3, 30, ["t", "u"])
    rows = [(c + (10 if len(r) else 0), *r) for c, *r in rows]
    got = pt.prefix_trie(pt.conversation_paths(frame(spark, rows)), 6)
    assert collected(got) == brute(turns_of(rows))


def test_none(spark):
    empty = pt.prefix_trie(pt.conversation_paths(frame(spark, EDGES).limit(0)))
    assert empty.collect() == [] and len(empty.columns) == 8
    assert pt.prefix_trie(pt.conversation_paths(frame(spark, EDGES).filter(F.col("conv_id").isNull()))).isEmpty()
