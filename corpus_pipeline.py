"""From raw documents to token ids: filter, near-duplicates, repeated passages, mix, encode.

``run(spark, sf_dir)`` applies the stages in order. Each one works on all that the stage
before kept, written as Parquet and read again. All but the last return the columns of
``documents``; columns that a table has beyond these are passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pointprep.llm import bpe, mixing, simhash, substring_dedup, toxicity
from pointprep.llm.common import read_table
from pointprep.llm.queries import vocabulary
from pointprep.session import materialize


#: Seed of the order in which the mix takes documents.
SEED = 42


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half.

    The machine learns from the labels whose rows are not held out. A row that cannot be told from
    another by its key shares the verdict of all rows with that key: it goes if one of them does.
    """
    labels = read_table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    rejected = scored.filter("predicted = 1").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(rejected, docs["doc_id"].eqNullSafe(F.col("__id")), "left_anti")


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest key of each SimHash class.

    Rows with the same key stay together. Documents without words are one class, so one of them stays.
    """
    classes = simhash.simhash_classes(docs)
    dropped = classes.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(dropped, docs["doc_id"].eqNullSafe(F.col("__id")), "left_anti")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that an earlier document has; untouched texts stay byte for byte.

    A text that loses words keeps the others joined by one space, and ``n_chars`` follows. A document
    that is all repetition stays as an empty text.
    """
    return substring_dedup.cut_passages(docs)


def take_the_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a document that it takes twice as two rows.

    Rows equal in key and text are taken alike.
    """
    mix = mixing.mix_sources(docs.select("doc_id", "text", "source"), seed=SEED)
    copies = mix.groupBy(F.col("draw").alias("__draw"), F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies")).filter("__copies > 0")
    drawn = docs.withColumn("__drawn", mixing.draw_of("text", "doc_id", SEED))
    taken = drawn.join(copies, (F.col("__drawn") == F.col("__draw")) & docs["doc_id"].eqNullSafe(F.col("__id")))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of each row, its text decoded back from them."""
    return bpe.bpe_round_trip(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_each_class),
    ("substring_dedup", cut_repeated_passages),
    ("mix_sources", take_the_mix),
    ("bpe_encode_decode", encode),
]

#: A trained machine, hashes of shingles and merges of a vocabulary are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole ``documents`` table of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
