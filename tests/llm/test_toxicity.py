import random
import zlib

from pointprep.llm import toxicity as tx
from tests.llm.conftest import EDGES


def plain_kernel(a, b):
    """All pairs of equal subsequences, weighted by the length both spread over."""
    from itertools import combinations

    total = 0.0
    for p in tx.ORDERS:
        for i in combinations(range(len(a)), p):
            for j in combinations(range(len(b)), p):
                if all(a[x] == b[y] for x, y in zip(i, j)):
                    total += tx.DECAY ** ((i[-1] - i[0] - p + 1) + (j[-1] - j[0] - p + 1))
    return total


def test_kernel_against_all_subsequences():
    words, marks = ["idiot", "ixdiot", "banana", "ab", "toidi"], ["idiot", "bandana"]
    got = tx.kernel(words, marks)
    for i, a in enumerate(words):
        for j, b in enumerate(marks):
            own = plain_kernel(a, a) * plain_kernel(b, b)
            assert abs(got[i, j] - (plain_kernel(a, b) ** 2 / own if own else 0)) < 1e-4


def corpus():
    rng = random.Random(4)
    clean = ["".join(rng.choices("aeilnorstdm", k=rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for d in range(600):
        words = rng.choices(clean, k=rng.randint(20, 80))
        toxic = d % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["blorkhead", "zugwump", "fipquack"])
        rows.append((d, " ".join(words) + ".", int(toxic)))
    return rows


def test_held_out_rows_and_spelt_out_insults(spark, docs):
    rows = corpus()
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    known = labels.filter(~tx.held_out())
    assert {r["doc_id"] for r in known.collect()} == {d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 5}
    extra = [(9001, "some plain text with a b.l.o.r.k.h.e.a.d in it"), (9002, "you zugxwump"), (9003, "")]
    table = docs([(d, t) for d, t, _ in rows] + extra)
    machine = tx.fit(table, known)
    got = {r["doc_id"]: r for r in tx.score_documents(table, machine).collect()}
    out = [(d, y) for d, _, y in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(got[d]["predicted"] == y for d, y in out) >= 0.97 * len(out)
    assert got[9001]["predicted"] == 1 and got[9002]["score"] > got[9003]["score"] and got[9003]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.score_documents(docs([]), tx.fit(docs([]), none)).count() == 0
    got = tx.score_documents(docs(EDGES), tx.fit(docs(EDGES), none)).collect()
    assert len(got) == len(EDGES) and all(r["predicted"] == 0 for r in got)
    odd = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, None), (99, 1)], "doc_id long, toxic int")
    assert tx.score_documents(docs(EDGES), tx.fit(docs(EDGES), odd)).count() == len(EDGES)
    only = spark.createDataFrame([(5, 1)], "doc_id long, toxic int")
    assert tx.score_documents(docs(EDGES), tx.fit(docs(EDGES), only)).count() == len(EDGES)


def test_every_row_of_a_large_batch_is_scored(spark, docs):
    rows = [(d, f"word{d} and more") for d in range(2 * tx.TEXTS + 7)]
    machine = tx.fit(docs([r[:2] for r in corpus()[:60]]), spark.createDataFrame([(d, y) for d, _, y in corpus()[:60]], "doc_id long, toxic int"))
    got = tx.score_documents(docs(rows).coalesce(1), machine).collect()
    assert sorted(r["doc_id"] for r in got) == [d for d, _ in rows]


def test_kernel_by_the_trie_equals_the_table():
    rng = random.Random(7)
    marks = ["".join(rng.choices("abcdé", k=rng.randint(3, 10))) for _ in range(30)]
    words = ["".join(rng.choices("abcdeéxy", k=rng.randint(1, 24))) for _ in range(400)] + marks
    a, b = tx.kernel(words, marks), tx.kernel(words, marks, tx.Subsequences(marks))
    assert abs(a - b).max() < 1e-4 and b[-30:].max() > 0.99


def test_short_pieces_are_read_together():
    assert "idiot" in tx.sentence_units("you idi ot really")
    assert "stupid" in tx.sentence_units("such a st up id remark")
    assert "stupid" in tx.sentence_units("s t u pid")
    assert "blorkhead" in tx.sentence_units("a b l o r k h e a d in it") or "ablorkhead" in tx.sentence_units("a b l o r k h e a d in it")
    assert tx.sentence_units("some longer words here") == ["some", "longer", "words", "here"]


def test_insults_gapped_by_spaces(spark, docs):
    rows = corpus()
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    rows = [(d, t.replace("blorkhead", "blokid"), y) for d, t, y in rows]
    extra = [(9001, "deriolan blo kid merinolas"), (9002, "deriolan bl ok id merinolas"), (9003, "deriolan b lo kid merinolas"), (9004, "deriolan me ri merinolas")]
    table = docs([(d, t) for d, t, _ in rows] + extra)
    got = {r["doc_id"]: r["predicted"] for r in tx.score_documents(table, tx.fit(table, labels)).collect()}
    assert [got[d] for d, _ in extra] == [1, 1, 1, 0]
