"""Byte-level BPE: encoding by a contiguous rank array, and decoding.

A pre-token is held as a list of part ids and, beside it, a list with the rank of every
adjacent pair. The smallest rank is found by a scan, its boundary deleted, and the ranks of
its two neighbours refreshed. Words are short, so the scan beats any queue; words above
``SCAN_BYTES`` take a heap, which gives the same merges in n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import regex
from pyspark.sql import DataFrame

from pointprep.llm.common import arrow_map

#: Words longer than this take the heap.
SCAN_BYTES = 200
#: Chunks, and pre-tokens, that a worker remembers before it starts anew, and the longest of them.
CACHE_WORDS = 500_000
CACHE_CHARS = 64

_ID_BITS = 20
_ID_MASK = (1 << _ID_BITS) - 1
_NONE = 1 << 62


#: White space as Unicode defines it; \\s of ``re`` also has four separators.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level split into pre-tokens.
PRE_TOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: A run of white space splits the same way whatever surrounds it, so a text can first be cut
#: into blank-led chunks, which repeat far more often than texts do.
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> dict[str, int]:
    """The letter that vocabulary files write for each byte: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """A vocabulary and its merges. ``spec`` is the text of a tokenizers JSON file."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        letters = byte_letters()
        vocab = parsed["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"] if t["special"]}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(parsed["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a] << _ID_BITS | vocab[b]] = rank << _ID_BITS | vocab[a + b]
        self.words = _Cache(lambda w: _pack(self.word_ids(w.encode())))
        self.chunks = _Cache(self._chunk)
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        if len(word) > SCAN_BYTES:
            return self._by_heap(word)
        parts = [self.byte_id[b] for b in word]
        rank_of = self.pairs.get
        ranks = [rank_of(a << _ID_BITS | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            parts[i] = merged = best & _ID_MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << _ID_BITS | merged, _NONE)
            if i < len(ranks):
                ranks[i] = rank_of(merged << _ID_BITS | parts[i + 1], _NONE)
        return parts

    def _by_heap(self, word: bytes) -> list[int]:
        parts = [self.byte_id[b] for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (value := self.pairs.get(parts[i] << _ID_BITS | parts[j])) is not None:
                heapq.heappush(heap, (value >> _ID_BITS, i, parts[i], parts[j], value & _ID_MASK))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = merged, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special strings become their own ids."""
        if self.special_split is None:
            return self._plain(text)
        pieces = self.special_split.split(text) if any(s in text for s in self.special) else [text]
        return b"".join(
            _pack([self.special[p]]) if k % 2 else self._plain(p) for k, p in enumerate(pieces)
        )

    def _plain(self, text: str) -> bytes:
        self.words.trim()
        self.chunks.trim()
        return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text)))

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, PRE_TOKEN.findall(chunk)))

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return b"".join(map(self.token_bytes.__getitem__, numbers)).decode("utf-8", "replace")


class _Cache(dict):
    """Packed ids by string, filled on a miss. Bounded by CACHE_WORDS once trimmed after a text."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        packed = self.make(word)
        if len(word) <= CACHE_CHARS:
            self[word] = packed
        return packed

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()


def _pack(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def load_spec(path: str) -> str:
    """The vocabulary file, a megabyte or two, read once on the driver and sent to every worker."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_LOADED: dict[int, ByteBPE] = {}


def worker_bpe(spec) -> ByteBPE:
    """One encoder per worker process; ``spec`` is a broadcast of the file's text."""
    known = hash(spec.value)
    if known not in _LOADED:
        _LOADED.clear()
        _LOADED[known] = ByteBPE(spec.value)
    return _LOADED[known]


def bpe_encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and the token ids of each text as ``token_ids``, an array of integers.

    A null text counts as empty and gives an empty array. Every row gives one row, rows
    with equal keys included; other columns are dropped.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(path))

    def rows(batches: Iterator[dict]):
        bpe = worker_bpe(spec)
        for batch in batches:
            for k, t in zip(batch[key].to_pylist(), batch[text]):
                yield k, array("I", bpe.encode(t.as_py() or ""))

    return arrow_map(docs.select(key, text), rows, f"{key} {docs.schema[key].dataType.simpleString()}, token_ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, ids: str = "token_ids", key: str = "doc_id") -> DataFrame:
    """``key`` and the text that the ids stand for; null ids count as none."""
    spec = encoded.sparkSession.sparkContext.broadcast(load_spec(path))

    def rows(batches: Iterator[dict]):
        bpe = worker_bpe(spec)
        for batch in batches:
            for k, i in zip(batch[key].to_pylist(), batch[ids]):
                yield k, bpe.decode(_pack(i.as_py() or []))

    return arrow_map(encoded.select(key, ids), rows, f"{key} {encoded.schema[key].dataType.simpleString()}, text string")


def bpe_round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode in one pass; returns digests, so ids never leave the task.

    Columns: ``key``, ``n_tokens``, ``ids_sha256`` over the packed ids and
    ``decoded_sha256`` over the decoded text. A null text counts as empty.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(path))

    def rows(batches: Iterator[dict]):
        bpe = worker_bpe(spec)
        for batch in batches:
            for k, t in zip(batch[key].to_pylist(), batch[text]):
                ids = bpe.encode(t.as_py() or "")
                back = bpe.decode(ids).encode()
                yield k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), rows, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
