"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import staging

#: Rows and bytes of an Arrow batch: texts may be long, so batches are kept short and a worker's memory stays bounded.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
#: The ASCII white space that separates words, strips lines and is left out of normalised texts.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


#: A new path under the folder that driver and executors share, as all tables of a job are.
shared_folder = staging.folder


def written(df: DataFrame, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Sets how many rows and bytes an Arrow batch has at most; a longer row is a batch by itself."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_within = 0


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Other Arrow batches for the jobs that run within."""
    global _within
    _within += 1
    short_batches(spark, rows)
    try:
        yield
    finally:
        _within -= 1
        short_batches(spark)


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow() in short batches."""
    if not _within:
        short_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t.type) for x, t in zip(columns, schema, strict=True)], schema=schema)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, as its files lie."""
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (b for b in it if b.num_rows)
