"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the most frequent pre-tokens and their lengths in tokens,
sent to every worker: two flat buffers of bounded size. Tier two is a cache in each worker
that holds what misses the table, encoded once. Which pre-tokens are frequent is told by summaries of bounded size, one
for each partition of all documents, that are merged in a tree; no pre-token is shuffled, neither then nor while counting.
The table only saves work: counts do not depend on what is in it.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from pointprep.llm.bpe import CACHE_CHARS, CACHE_WORDS, PRE_TOKEN, ByteBPE, load_spec, worker_bpe
from pointprep.llm.common import arrow_map, materialize

#: Rows of the table of frequent pre-tokens, counters of a summary, and summaries that one task merges.
TABLE_WORDS = 50_000
SUMMARY_WORDS = 60_000
FAN_IN = 16


def pack_lengths(words: list[str], bpe: ByteBPE) -> tuple[str, bytes]:
    """The table as one joined string and one 16-bit length per word."""
    kept = [w for w in words if "\n" not in w and len(w) <= CACHE_CHARS]
    return "\n".join(kept), array("H", [len(bpe.word_ids(w.encode())) for w in kept]).tobytes()


def unpack_lengths(packed: tuple[str, bytes]) -> dict[str, int]:
    joined, lengths = packed
    return dict(zip(joined.split("\n"), array("H", lengths))) if lengths else {}


def shrink(found: Counter, size: int) -> Counter:
    """At most ``size`` counters: the next largest count is taken off all of them, so a frequent word keeps most of its count."""
    if len(found) <= size:
        return found
    off = sorted(found.values(), reverse=True)[size]
    return Counter({w: n - off for w, n in found.items() if n > off})


def frequent_pre_tokens(docs: DataFrame, text: str = "text", n: int = TABLE_WORDS, size: int = SUMMARY_WORDS, fan_in: int = FAN_IN) -> list[str]:
    """The commonest pre-tokens of all documents, at most ``n``, up to the error of summaries of ``size`` counters.

    A word that makes up more than one part in ``size`` of all pre-tokens is certainly there.
    """

    def packed(found: Counter) -> tuple:
        # Ties go by the word, so the table does not depend on the order of rows.
        best = sorted(shrink(found, size).items(), key=lambda x: (-x[1], x[0]))
        return [w for w, _ in best], [c for _, c in best]

    def count(batches: Iterator[dict]):
        found: Counter = Counter()
        for batch in batches:
            for t in batch[text]:
                found.update(w for w in PRE_TOKEN.findall(t.as_py() or "") if len(w) <= CACHE_CHARS)
                if len(found) > 4 * size:
                    found = shrink(found, size)
        yield packed(found)

    def merge(batches: Iterator[dict]):
        found: Counter = Counter()
        for batch in batches:
            for words, counts in zip(batch["words"].to_pylist(), batch["counts"].to_pylist()):
                for w, c in zip(words, counts):
                    found[w] += c
                found = shrink(found, 2 * size)
        yield packed(found)

    kind = "words array<string>, counts array<long>"
    # One row per partition; written, so that no merge counts a text again.
    summaries = materialize(arrow_map(docs.select(text), count, kind, out_rows=1), "summaries")
    parts = summaries.count()
    while parts > 1:
        parts = -(-parts // fan_in)
        summaries = arrow_map(summaries.repartition(parts), merge, kind, out_rows=1)
    rows = summaries.collect()
    return shrink_to([(r["words"], r["counts"]) for r in rows], n)


def shrink_to(summaries: list[tuple[list[str], list[int]]], n: int) -> list[str]:
    total: Counter = Counter()
    for words, counts in summaries:
        for w, c in zip(words, counts):
            total[w] += c
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:n]]


_TABLES: dict[int, tuple[dict[str, int], "_Misses"]] = {}


class _Misses(dict):
    """Lengths of pre-tokens outside the table, encoded on a miss."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> int:
        n = len(self.bpe.word_ids(word.encode()))
        if len(word) <= CACHE_CHARS:
            self[word] = n
        return n


def _tiers(table, spec) -> tuple[dict[str, int], _Misses]:
    known = hash(table.value)
    if known not in _TABLES:
        _TABLES.clear()
        _TABLES[known] = unpack_lengths(table.value), _Misses(worker_bpe(spec))
    return _TABLES[known]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text.

    A null text counts as empty: no bytes, no tokens. Each row gives one row, so repeated
    rows stay repeated; other columns are dropped. A special string is one token.
    """
    sc = docs.sparkSession.sparkContext
    text_of_spec = load_spec(path)
    spec = sc.broadcast(text_of_spec)
    table = sc.broadcast(pack_lengths(frequent_pre_tokens(docs, text), ByteBPE(text_of_spec)))

    def rows(batches: Iterator[dict]):
        bpe = worker_bpe(spec)
        first, second = _tiers(table, spec)
        lookup = first.get
        for batch in batches:
            for k, t in zip(batch[key].to_pylist(), batch[text]):
                whole = t.as_py() or ""
                cut = bpe.special_split is not None and any(s in whole for s in bpe.special)
                pieces = bpe.special_split.split(whole) if cut else [whole]
                n = len(pieces) // 2
                for piece in pieces[::2]:
                    for w in PRE_TOKEN.findall(piece):
                        n += lookup(w) or second[w]
                if len(second) > CACHE_WORDS:
                    second.clear()
                yield k, len(whole.encode()), n, n > limit

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), rows, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")
