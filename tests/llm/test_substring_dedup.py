import hashlib
import random

import pytest

from pointprep.llm import anchors as an, substring_dedup as sd
from tests.llm.conftest import EDGES


def brute(rows, window):
    """The contract, window by window."""
    first = {}
    split = [(d if d is not None else sd._LAST, sd.words_of(t or "")) for d, t in rows]
    for d, ws in split:
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i: i + window])
            first[w] = min(d, first.get(w, d))
    out = []
    for d, ws in split:
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i: i + window])] < d:
                gone[i: i + window] = [True] * window
        out.append((None if d == sd._LAST else d, len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone) if not g)))
    return sorted(out, key=str)


def corpus(seed, n=60, alphabet=30):
    """Texts that share passages, are copies of each other, and repeat within themselves."""
    rng = random.Random(seed)

    def fresh(k):
        return [f"w{rng.randrange(alphabet)}{rng.choice('abc')}" for _ in range(k)]

    passages = [fresh(rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for d in range(n):
        kind = rng.random()
        if rows and kind < 0.15:
            ws = rng.choice(rows)[1].split()
            if kind < 0.1 and ws:
                ws[rng.randrange(len(ws))] = "edit"
        else:
            ws = fresh(rng.randint(0, 30))
            for _ in range(rng.randint(0, 3)):
                p = rng.choice(passages)
                a = rng.randint(0, 5)
                ws += p[a: len(p) - rng.randint(0, 5)] + fresh(rng.randint(0, 6))
            if kind > 0.9:
                ws += ["x", "y"] * rng.randint(10, 40)
        rows.append((rng.randrange(10**6), " ".join(ws)))
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 5_000), (2, 5_000), (3, 1), (4, 3)])
def test_against_brute_force(spark, docs, monkeypatch, seed, hot):
    monkeypatch.setattr(an, "HOT_CONTEXTS", hot)
    rows = corpus(seed)
    want = brute(rows, 12)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"].encode()) for r in sd.dedup_words(docs(rows), 12, 4).collect()), key=str)
    assert got == want
    assert sum(r[2] for r in want) > 200
    digests = {(r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in sd.dedup_digests(docs(rows), 12, 4).collect()}
    assert digests == {(d, n, hashlib.sha256(k).hexdigest()) for d, _, n, k in want}


def test_edges(spark, docs):
    long = " ".join(f"v{i}" for i in range(120))
    rows = [*EDGES, (None, long), (None, long), (50, long), (50, long), (60, "\t" + long.replace(" ", "\r\n") + " x")]
    want = brute(rows, 50)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"].encode()) for r in sd.dedup_words(docs(rows)).collect()), key=str)
    assert got == want
    assert sd.dedup_words(docs([])).count() == 0
    spans = {r["doc_id"]: r["spans"] for r in sd.dedup_words(docs(rows)).collect()}
    assert spans[60] == [[0, 118]] and spans[50] == []


def test_a_factor_ends_where_its_reference_does():
    # The second reference carries on where the first one ends.
    passages = [(1, -3, [10, 11, 12]), (2, -3, [20, 11, 12, 13]), (3, -3, [10, 11, 12, 13])]
    assert sd.parse_block(passages)[2] == [(-3, -1), (0, 0)]
    assert sd.parse_block([(5, 0, [1]), (5, 0, [1])]) == [[], []]


@pytest.mark.parametrize("hot", [5_000, 1])
def test_null_and_repeated_keys(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(an, "HOT_CONTEXTS", hot)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else k, t) for i, (k, t) in enumerate(corpus(5) + corpus(5)[:20])]
    want = brute(rows, 12)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"].encode()) for r in sd.dedup_words(docs(rows), 12, 4).collect()), key=str)
    assert got == want and sum(r[2] for r in want) > 200


def test_rows_with_one_key_spread(spark, docs):
    """All ids null: no task gets more than its share of the rows, and each list of anchors is one row's."""
    rows = [(None, t) for _, t in corpus(6, 200)]
    joined, work = sd.duplicate_factors(sd._keyed(docs(rows), "text", "doc_id"), 12, 4)
    assert work.agg({"row": "count"}).first()[0] == work.select("row").distinct().count() > 50
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = an.identified(sd._keyed(docs(rows), "text", "doc_id")).repartition("row").rdd.glom().map(len).collect()
        parts = joined.rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(parts) == sum(dealt) == 200 and max(parts) < 120


@pytest.mark.parametrize("hot", [60_000, 1])
def test_texts_of_two_words_that_double_and_swap(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(an, "HOT_CONTEXTS", hot)
    words = ["ab"[bin(i).count("1") % 2] for i in range(1024)]
    swapped = ["ba"["ab".index(w)] for w in words]
    rows = [(1, " ".join(words)), (2, " ".join(swapped)), (3, "x " + " ".join(words[64:200]) + " y"), (4, "a b " * 200)]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"].encode()) for r in sd.dedup_words(docs(rows), 50, 16).collect()), key=str)
    assert got == brute(rows, 50)


def test_texts_are_shuffled_once(spark, docs):
    """Both passes read one exchange, also where the other columns travel along."""
    from tests.llm.test_suffix_dedup import text_scans

    frame = docs(corpus(8, 60))
    assert text_scans(sd.cut_passages(frame, 12, 4)) == 1
    assert text_scans(sd.dedup_words(frame, 12, 4)) == 1
    assert text_scans(sd.dedup_digests(frame, 12, 4)) == 1
