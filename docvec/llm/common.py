"""Helpers shared by the operators: reading only the needed columns, and
walking Arrow batches in bounded slices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one slice of an Arrow batch holds at most (a single
# longer text makes a slice of its own).
SLICE_BYTES = 4 << 20


# Bytes of an Arrow batch that Spark hands to a Python worker (its own default is 64 MB, held several times over).
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends rows to Python in batches of
    about BATCH_BYTES, so that a worker's memory does not follow the rows'."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def column(name: str) -> Column:
    """A top-level column by its exact name (dots and spaces included)."""
    return F.col(f"`{name}`")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text binary): the only columns an operator reads, so
    extra columns can neither clash nor travel.  A null text is empty."""
    return bounded(docs).select(
        column(id_col).cast("long").alias("doc_id"),
        F.coalesce(column(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def slices(batches: Iterable[pa.RecordBatch], text: str | int = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of about ``limit`` bytes of the column ``text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + int(n) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)
