import hashlib
import random

import pytest

from pointprep.llm import fingerprints as fp
from tests.llm.conftest import EDGES


def expected(rows):
    """The contract's edited texts, by walking the sorted rows."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: r[0])
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        yield d, t, t[: len(t) - half] + following[:half], following


def plain_boundaries(data):
    """Chunk ends and levels byte by byte."""
    ends = []
    for i in range(len(data)):
        h = sum((data[i - j] + 1) * int(fp._COEF[j]) for j in range(fp.WINDOW) if i - j >= 0) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        h ^= h >> 12
        ends.append((i + 1, 32 if h == 0 else (h & -h).bit_length() - 1))
    return ends


@pytest.mark.parametrize("ranges", [8_000, 3])
def test_documents_against_a_plain_walk(spark, docs, monkeypatch, ranges):
    monkeypatch.setattr(fp, "RANGE_ROWS", ranges)
    rows = fp.fingerprint_with_edits(docs(EDGES)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(EDGES)
    for d, t, edited, following in expected(EDGES):
        r = got[d]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fp.fingerprint(t.encode())
        assert r["edited_fingerprint"] == fp.fingerprint(edited.encode())
        assert r["near_edited"] == fp.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == fp.likeness(r["fingerprint"], fp.fingerprint(following.encode()))
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and got[5]["near_next"] == 1.0


@pytest.mark.parametrize("block", [1 << 20, 64, 7])
def test_blocks_do_not_show(monkeypatch, block):
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(500))
    whole = fp.fingerprint(data)
    monkeypatch.setattr(fp, "BLOCK", block)
    assert fp.fingerprint(data) == whole
    level = int(whole.split(":")[0])
    ends = [e for e, k in plain_boundaries(data) if k >= level]
    chunks = len(ends) + (not ends or ends[-1] != len(data))
    assert chunks <= fp.MAX_CHUNKS and len(whole.split(":")[1]) == 2 * chunks


def test_likeness_follows_the_shared_part():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(600)]
    a = " ".join(words).encode()
    quarter = " ".join(words[:150] + ["".join(rng.choices("klmnop", k=6)) for _ in range(450)]).encode()
    moved = ("some new opening words " + " ".join(words)).encode()
    f = fp.fingerprint(a)
    assert fp.likeness(f, f) == 1
    assert fp.likeness(f, fp.fingerprint(moved)) > 0.9
    assert 0.1 < fp.likeness(f, fp.fingerprint(quarter)) < 0.45
    other = " ".join("".join(rng.choices("qrstuv", k=6)) for _ in range(600)).encode()
    assert fp.likeness(f, fp.fingerprint(other)) < 0.05
    assert fp.fingerprint(b"") == "0::" and fp.likeness("0::", f) == 0 and fp.likeness("0::", "0::") == 1


def test_ties_nulls_and_empty_table(spark, docs):
    assert fp.fingerprint_with_edits(docs([])).count() == 0
    rows = fp.fingerprint_with_edits(docs([(None, "first"), (1, "b"), (1, "a"), (1, "a")])).collect()
    assert sorted((r["doc_id"] is not None, r["n_chars"]) for r in rows) == [(False, 5), (True, 1), (True, 1), (True, 1)]
    assert fp.fingerprint_with_edits(docs([(4, "alone")])).first()["near_next"] == 1.0
