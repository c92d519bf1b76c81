"""What the text operators share: reading tables, Arrow maps and stage writes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from pointprep.session import materialize, scratch_path

__all__ = ["WORD", "arrow_map", "materialize", "read_table", "stage"]

#: A word is a run of anything but these six white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that leave a Python map in one Arrow batch.
OUT_ROWS = 20_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path, so that it can be discarded once nothing reads it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def arrow_map(df: DataFrame, rows: Callable[[Iterator[dict]], Iterable[tuple]], schema: str, out_rows: int = OUT_ROWS) -> DataFrame:
    """Run ``rows`` over each partition; it takes an iterator of batches and yields output tuples.

    A batch is a dict of Arrow arrays by column name. Output goes out in small Arrow
    batches, so memory is bounded by the input batch whatever the partition's size.
    """
    spark = df.sparkSession
    target = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns():
            for batch in batches:
                yield {n: batch.column(i) for i, n in enumerate(batch.schema.names)}

        held: list[tuple] = []
        for row in rows(columns()):
            held.append(row)
            if len(held) >= out_rows:
                yield _batch(held, target)
                held = []
        if held:
            yield _batch(held, target)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )
