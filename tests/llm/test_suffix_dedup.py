import hashlib
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pointprep.llm import anchors as an, suffix_dedup as sd
from tests.llm.conftest import EDGES
from tests.llm.test_substring_dedup import corpus


def brute(rows, window):
    """The contract, place by place."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = {}
    for _, t in texts:
        for i in range(len(t) - window + 1):
            count[t[i: i + window]] = count.get(t[i: i + window], 0) + 1
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if count[t[i: i + window]] > 1:
                gone[i: i + window] = [True] * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(frame, *sizes):
    return sorted((tuple(r) for r in sd.dedup_digests(frame, *sizes).collect()), key=str)


@pytest.mark.parametrize("seed,hot,pairwise", [(1, 5_000, 12), (2, 5_000, 1), (3, 1, 12), (4, 4, 1), (5, 5_000, 3)])
def test_against_brute_force(spark, docs, monkeypatch, seed, hot, pairwise):
    monkeypatch.setattr(an, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(sd, "PAIRWISE", pairwise)
    monkeypatch.setattr(sd, "SHARE_BYTES", 4_000)
    monkeypatch.setattr(sd, "RUN_BYTES", 9_000)
    rows = corpus(seed, 50, 8)
    want = brute(rows, 30)
    assert run(docs(rows), 30, 8) == want
    assert sum(r[2] for r in want) > 1000


def test_edges(spark, docs):
    long = "".join(chr(0x4E00 + i) for i in range(200))
    rows = [*EDGES, (70, "a" * 401), (71, long), (72, "é" + long[:190]), (73, "b" * 400), (73, "c" + "b" * 400), (None, "zz")]
    want = brute(rows, 400)
    assert run(docs(rows)) == want
    assert run(docs([])) == []
    kept = {r["doc_id"]: r for r in sd.dedup_bytes(docs(rows)).collect()}
    assert kept[72]["spans"] == [[2, 572]] and bytes(kept[72]["kept"]) == "é".encode()


def test_front_coding_and_merge_never_look_back():
    rng = random.Random(6)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(300)]
    runs = [sorted(texts[i::7]) for i in range(7)]
    coded = [sd.front_code(r) for r in runs]
    assert [[s for _, s in sd.front_decode(*c)] for c in coded] == runs
    merged = list(sd.LoserTree([((k, s, None) for k, s in sd.front_decode(*c)) for c in coded]))
    assert [s for _, s, _ in merged] == sorted(texts)
    before = b""
    for k, s, _ in merged:
        n = 0
        while n < min(len(s), len(before)) and s[n] == before[n]:
            n += 1
        assert k == n
        before = s
    assert list(sd.LoserTree([])) == []


@pytest.mark.parametrize("hot", [5_000, 1])
def test_null_and_repeated_keys(spark, docs, monkeypatch, hot):
    """Work and factors go by row: no list of anchors holds more than those of one text."""
    monkeypatch.setattr(an, "HOT_CONTEXTS", hot)
    rows = [(None if i % 2 else 7, t) for i, (_, t) in enumerate(corpus(7, 50, 8))]
    assert run(docs(rows), 30, 8) == brute(rows, 30)
    most = max(len(an.find_anchors(sd.byte_symbols(t)[0], 30, 8)[0]) for _, t in rows if len(t) >= 30)
    prepared = sd._prepared(docs(rows), 30, 8, "text", "doc_id").collect()
    assert len(prepared) == 50 and max(len(r["work"] or ()) for r in prepared) <= most


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("hot", [60_000, 1])
def test_texts_of_two_letters_that_double_and_swap(spark, docs, monkeypatch, hot):
    """Such texts and their complements agree in polynomials modulo a power of two."""
    monkeypatch.setattr(an, "HOT_CONTEXTS", hot)
    a = thue_morse(2048)
    swapped = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a[:1500]), (2, swapped[:1500]), (3, "q" + a[100:700] + "r"), (4, "ab" * 600)]
    assert run(docs(rows), 400, 100) == brute(rows, 400)


def test_window_hashes_follow_the_window_only():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    whole, part = an.WindowHashes(x), an.WindowHashes(x[37:])
    assert (whole.of(37, 400, 50) == part.of(0, 363, 50)).all()
    assert len(set(whole.of(0, 450, 50).tolist())) == 451
    p = (1 << 61) - 1
    a, b = (rng.integers(0, p, 1000, dtype=np.uint64) for _ in range(2))
    assert an.times61(a, b).tolist() == [int(i) * int(j) % p for i, j in zip(a, b)]


def text_scans(frame):
    """How often the plan that ran has read and dealt out the texts."""
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("FileScan" in line and "text#" in line for line in final.splitlines())


def test_texts_are_shuffled_once(spark, docs):
    """Both passes over the texts read one exchange, which holds only if they ask for the same columns."""
    frame = docs(corpus(8, 60))
    assert text_scans(sd.dedup_digests(frame, 30, 8)) == 1
    assert text_scans(sd.dedup_bytes(frame, 30, 8)) == 1


@pytest.mark.parametrize("before", [None, "false"])
def test_shuffles_of_a_stage_end_with_it(spark, docs, before):
    """They are on no disk any more once the stage is written; the session's setting is as it was."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)

    def files():
        return {str(p) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for p in Path(d).rglob("shuffle_*")}

    try:
        frame = an.identified(docs(corpus(9, 60))).withColumn("key", F.col("row"))
        had = files()
        work = an.sort_anchors(frame, sd.byte_symbols, 30, 8, F.col("n") > 1)
        for _ in range(50):
            left = files() - had
            if not left:
                break
            time.sleep(0.1)
        assert not left and work.count() > 10
        assert spark.conf.get(key, None) == before
    finally:
        spark.conf.unset(key)
