"""Removal of word passages that an earlier document has, by relative Lempel-Ziv parsing.

Anchors (see ``anchors``) route each passage to the block of reference passages that shares its gram;
a passage without one in common with a block has no factor there that is long enough. In
a block, passages are indexed in the order of their documents. Each is parsed greedily
against the index of the ones before: a lookup of 50 words finds a reference, the factor
goes on as long as that reference does, and where it ends the windows across the boundary are
looked up again, since another reference may hold them. Factors of 50 words and more
are the duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from pointprep.llm import anchors as an
from pointprep.llm.common import arrow_map

WINDOW = 50
GRAM = 16
#: Stands for a null key; keys come before it.
_LAST = (1 << 63) - 1


def words_of(text: str) -> list[bytes]:
    """Bytes split at the six white-space bytes, which is what ``bytes.split`` cuts at."""
    return text.encode().split()


def word_symbols(text: str) -> tuple[np.ndarray, bytes, int]:
    words = words_of(text)
    values = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return values, values.tobytes(), 8


def parse_block(passages: list[tuple[int, int, list[int]]]) -> list[list[tuple[int, int]]]:
    """Factors of each passage against those before it with a smaller key, as pairs of offsets.

    A passage is its key, the offset of its first window from the anchor, and its windows' hashes.
    Passages come in the order of their keys.
    """
    # Offsets differ by less than a window, hashes are of 64 bits: one number names both.
    index: dict[int, int] = {}
    out = []
    for number, (key, offset, hashes) in enumerate(passages):
        factors = []
        i, n = 0, len(hashes)
        while i < n:
            reference = index.get(hashes[i] + ((offset + i) << 64))
            if reference is None or passages[reference][0] >= key:
                i += 1
                continue
            _, its_offset, its = passages[reference]
            shift = offset - its_offset
            j = i + 1
            while j < n and 0 <= j + shift < len(its) and its[j + shift] == hashes[j]:
                j += 1
            factors.append((offset + i, offset + j - 1))
            i = j
        out.append(factors)
        for i, h in enumerate(hashes):
            index.setdefault(h + ((offset + i) << 64), number)
    return out


def duplicate_factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """``docs`` (key, text) dealt by rows, with the work and factors found for each of its passages.

    Returns the joined rows and the work lists. The rows are written once with a number of their own; keys only say
    which of two passages is earlier. The texts are shuffled once; both passes over them read the same exchange, if the
    caller takes all columns of ``docs``: an exchange of other columns would be another exchange.
    """
    docs = an.identified(docs)
    work = an.sort_anchors(docs, word_symbols, window, gram, F.col("least") < F.col("key"))
    kinds = work.select(F.explode("work.kind").alias("k")).groupBy("k").count().collect()
    some_hot = any(r["k"] & an.HOT for r in kinds)
    dealt = docs.repartition("row")

    def passages(batches: Iterator[dict], hot: int):
        for batch in batches:
            work_at = an.work_of(batch["work"])
            for i, (r, k) in enumerate(zip(batch["row"].to_pylist(), batch["key"].to_pylist())):
                todo = [w for w in work_at(i) if w[2] & an.SHIP and w[2] & an.HOT == hot]
                if not todo:
                    continue
                symbols = word_symbols(batch["text"][i].as_py())[0]
                hashes = an.WindowHashes(symbols)
                for g, c, _, positions in todo:
                    first, last = an.reach(positions[0], len(symbols), window, gram)
                    yield g, c, r, k, first - positions[0], hashes.of(first, last, window)

    def shipped(rows: DataFrame, hot: int) -> DataFrame:
        return arrow_map(
            rows, lambda batches: passages(batches, hot),
            "gram long, context long, row long, key long, offset int, hashes array<long>", out_rows=5_000,
        )

    def parse(batches: Iterator[dict]):
        gram_now, held, names = None, [], []

        def flush():
            for (r, c), factors in zip(names, parse_block(held)):
                if factors:
                    yield r, gram_now, c, factors

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("gram", "context", "row", "key", "offset"))
            for g, c, r, k, o, h in zip(*columns, batch["hashes"]):
                if g != gram_now:
                    yield from flush()
                    gram_now, held, names = g, [], []
                held.append((k, o, h.as_py()))
                names.append((r, c))
        yield from flush()

    blocks = shipped(dealt.join(work, "row", "left"), 0).repartition("gram").sortWithinPartitions("gram", "key", "context")
    factors = arrow_map(blocks, parse, "row long, gram long, context long, spans array<array<int>>")
    if some_hot:
        crowded, crowded_path = an.stage(shipped(docs.select("row", "key", "text").join(an.crowded_work(work), "row"), an.HOT), "crowded")
        factors = factors.unionByName(an.compare_by_hashes(crowded, lambda: F.col("least") < F.col("key"), round((window - gram + 1) ** 0.5)))
        an.discard(docs.sparkSession, crowded_path)
    if any(r["k"] & an.WANT for r in kinds):
        # Rows with the same key and context as the row that was compared.
        factors = an.materialize(factors, "factors")
        want = work.select("row", F.explode("work").alias("w")).filter(F.col("w.kind").bitwiseAND(an.WANT) > 0)
        want = want.select("row", F.col("w.gram").alias("gram"), F.col("w.context").alias("context"))
        factors = factors.unionByName(want.join(factors.drop("row"), ["gram", "context"]))
    per = factors.groupBy("row").agg(F.collect_list(F.struct("gram", "context", "spans")).alias("factors"))
    return dealt.join(work, "row", "left").join(per, "row", "left"), work


def removed_words(text: str, work: list, factors: list | None, window: int, gram: int) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and which of them go."""
    words = words_of(text)
    gone = np.zeros(len(words), bool)
    if work and len(words) >= window:
        spans = {(f["gram"], f["context"]): f["spans"] for f in factors or ()}
        gone = an.covered(an.mark_starts(work, spans, len(words), window, gram), window, len(words))
    return words, gone


def _keyed(docs: DataFrame, text: str, key: str, *more: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("key"), F.coalesce(text, F.lit("")).alias("text"), *more
    )


def dedup_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What is left of each text once the passages of earlier documents are taken out.

    A word goes if it lies in ``window`` words in a row that also start in a document with a smaller
    key. Windows are judged on the input. Returns ``key``, ``n_words``, ``n_removed``, ``kept_text`` (kept words
    joined by one space) and ``spans``, the removed runs as first and last word numbers. A null text
    has no words; null keys come last and are not smaller than one another; rows with equal
    keys do not remove from each other. Each row gives one row.
    """
    joined, _ = duplicate_factors(_keyed(docs, text, key), window, gram)

    def rows(batches: Iterator[dict]):
        for batch in batches:
            work_at = an.work_of(batch["work"])
            for i, k in enumerate(batch["key"].to_pylist()):
                words, gone = removed_words(batch["text"][i].as_py(), work_at(i), batch["factors"][i].as_py(), window, gram)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode()
                yield None if k == _LAST else k, len(words), int(gone.sum()), kept, [(a, b - 1) for a, b in edges.tolist()]

    return arrow_map(
        joined.select("key", "text", "work", "factors"), rows,
        f"{key} long, n_words long, n_removed long, kept_text string, spans array<array<int>>", out_rows=500,
    )


def dedup_digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept_sha256`` as ``dedup_words`` would keep them; texts stay in their task."""
    joined, _ = duplicate_factors(_keyed(docs, text, key), window, gram)

    def rows(batches: Iterator[dict]):
        for batch in batches:
            work_at = an.work_of(batch["work"])
            for i, k in enumerate(batch["key"].to_pylist()):
                words, gone = removed_words(batch["text"][i].as_py(), work_at(i), batch["factors"][i].as_py(), window, gram)
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                yield None if k == _LAST else k, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()

    return arrow_map(joined.select("key", "text", "work", "factors"), rows, f"{key} long, n_words long, n_removed long, kept_sha256 string")


def cut_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", key: str = "doc_id", length: str = "n_chars") -> DataFrame:
    """``docs`` with all its columns, the passages of earlier documents cut out of ``text``.

    A text that loses nothing stays as it is, null included; another is its kept words joined by one space, and
    ``length``, where the table has it, becomes its number of code points. The other columns
    travel with the text through its one shuffle.
    """
    rest = [c for c in docs.columns if c != text]
    joined, _ = duplicate_factors(_keyed(docs, text, key, F.col(text).isNull().alias("__null"), F.struct(*rest).alias("__rest")), window, gram)

    def rows(batches: Iterator[dict]):
        for batch in batches:
            work_at = an.work_of(batch["work"])
            for i, rest_of in enumerate(batch["__rest"].to_pylist()):
                whole = batch["text"][i].as_py()
                words, gone = removed_words(whole, work_at(i), batch["factors"][i].as_py(), window, gram)
                cut = bool(gone.any())
                if cut:
                    whole = b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode()
                yield None if batch["__null"][i].as_py() else whole, rest_of, cut, len(whole)

    kind = docs.select(F.struct(*rest).alias("r")).schema["r"].dataType.simpleString()
    out = arrow_map(joined.select("key", "text", "work", "factors", "__null", "__rest"), rows, f"text string, rest {kind}, cut boolean, n long", out_rows=500)
    return out.select(*[
        F.col("text").alias(c) if c == text
        else F.when(F.col("cut"), F.col("n")).otherwise(F.col("rest")[c]).cast(docs.schema[c].dataType).alias(c) if c == length
        else F.col("rest")[c].alias(c)
        for c in docs.columns
    ])
