import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pointprep.llm import bpe, token_counts
from pointprep.llm.bpe import ByteBPE, load_spec
from tests.llm.conftest import EDGES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(spark, docs, library):
    got = {r["doc_id"]: r["token_ids"] for r in bpe.bpe_encode(docs(EDGES), PATH).collect()}
    assert got == {d: library.encode(t or "", add_special_tokens=False).ids for d, t in EDGES}


def test_decoding_equals_the_library(spark, library):
    broken = [(0, [50256, 11, 220]), (1, [447]), (2, []), (3, None)]
    rows = spark.createDataFrame(broken, "doc_id long, token_ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(rows, PATH).collect()}
    assert got == {d: library.decode(i or [], skip_special_tokens=False) for d, i in broken}


def test_digests_and_counts(spark, docs, library):
    rows = {r["doc_id"]: r for r in bpe.bpe_round_trip(docs(EDGES), PATH).collect()}
    counts = {r["doc_id"]: r for r in token_counts.count_tokens(docs(EDGES), PATH, limit=3).collect()}
    for d, t in EDGES:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[d]["n_tokens"] == counts[d]["n_tokens"] == len(ids)
        assert rows[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert counts[d]["n_bytes"] == len((t or "").encode())
        assert counts[d]["over_limit"] == (len(ids) > 3)


def test_scan_and_heap_agree():
    model = ByteBPE(load_spec(PATH))
    for word in (b"a" * 150, b"abcabcabd" * 20, bytes(range(200))):
        assert model.word_ids(word) == model._by_heap(word)


def test_empty_table_and_repeated_rows(spark, docs):
    assert bpe.bpe_round_trip(docs([]), PATH).count() == 0
    assert token_counts.count_tokens(docs([]), PATH).count() == 0
    assert token_counts.count_tokens(docs([(1, "a b")] * 3), PATH).count() == 3
