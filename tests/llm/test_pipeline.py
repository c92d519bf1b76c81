import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pointprep.llm import mixing, toxicity
from tests.llm.test_simhash import plain_classes, plain_simhash
from tests.llm.test_substring_dedup import brute


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with toxic ones, copies, near copies, shared passages, nulls and odd columns."""
    rng = random.Random(9)
    clean = ["".join(rng.choices("aeilnorstdm", k=rng.randint(2, 9))) for _ in range(900)]
    passage = " ".join(rng.choices(clean, k=70))
    rows = []
    for d in range(400):
        words = rng.choices(clean, k=rng.randint(60, 160))
        if d % 5 == 0:
            words[3:3] = ["blorkhead", "zugwump"]
        elif d % 17 == 1:
            words[10:10] = passage.split()
        elif d % 13 == 2 and rows:
            words = rng.choice(rows)[1].split()
        rows.append((d, " ".join(words), "en", f"s{d % 3}" if d % 29 else None, d))
    rows += [(1000, None, None, "s1", 0), (1001, "", "en", "s0", 0), (1002, "  \t", "en", "s2", 3), (1003, "long " * 20000, "en", "s2", 100000)]
    rows = [(d, t, lang, s, len(t or ""), n) for d, t, lang, s, n in rows]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, work int").write.parquet(f"{folder}/documents.parquet")
    labels = [(d, 1, int(d % 5 == 0)) for d in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_each_stage_against_the_plain_rule(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]

    def step(f, docs):
        out = f(spark, docs, tables)
        rows = out.collect()
        return spark.createDataFrame(rows, out.schema), rows

    machine = toxicity.fit(docs, spark.read.parquet(f"{tables}/labels.parquet").filter(~toxicity.held_out()))
    bad = {r["doc_id"] for r in toxicity.score_documents(docs, machine).filter("predicted = 1").collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    docs, rows = step(stages[0], docs)
    assert docs.columns == columns and {r["doc_id"] for r in rows} == set(before) - bad
    assert bad >= {d for d in range(0, 400, 5)} and len(bad) < 90

    classes = plain_classes({r["doc_id"]: plain_simhash(r["text"]) for r in rows})
    docs, rows = step(stages[1], docs)
    assert docs.columns == columns and {r["doc_id"] for r in rows} == {d for d, c in classes.items() if d == c}

    want = {d: (n, kept) for d, _, n, kept in brute([(r["doc_id"], r["text"]) for r in rows], 50)}
    old = {r["doc_id"]: r for r in rows}
    docs, rows = step(stages[2], docs)
    assert docs.columns == columns and {r["doc_id"] for r in rows} == set(old)
    assert sum(n > 0 for n, _ in want.values()) > 3
    for r in rows:
        n, kept = want[r["doc_id"]]
        if n:
            assert r["text"].encode() == kept and r["n_chars"] == len(r["text"])
        else:
            assert r == old[r["doc_id"]]

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect()}
    docs, rows = step(stages[3], docs)
    assert docs.columns == columns
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, n in copies.items() for _ in range(n))

    _, out = step(stages[4], docs)
    assert len(out) == len(rows)


def test_run_is_the_stages_in_order_and_repeats(spark, tables):
    first = sorted(map(tuple, corpus_pipeline.run(spark, tables).collect()))
    assert first == sorted(map(tuple, corpus_pipeline.run(spark, tables).collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mix_sources", "bpe_encode_decode"]


def test_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() == 0
