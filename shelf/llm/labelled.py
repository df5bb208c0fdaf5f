"""The bounded sample of labelled rows from which classifiers are fitted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents that a classifier is fitted on, at most.
SAMPLE = 12_000
#: Bytes of their texts, at most, that are learned from: a text that goes beyond is passed over.
SAMPLE_BYTES = 128 << 20
#: Rows of fold 0 of so many are held out.
FOLDS = 5


def held_out(docs: DataFrame):
    return common.fold(docs["doc_id"], FOLDS) == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """text, label of up to most labelled rows outside the held-out fold, in one partition, in the order of a hash.

    Rows without doc_id or label are left out; of labels that disagree about a document the larger counts, of rows repeated
    under one doc_id the smallest text (null: empty). The sample is the most documents with the smallest hashes of doc_id;
    its ids alone are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & (common.fold(F.col("_id"), FOLDS) != 0))
    chosen = known.groupBy("_id").agg(F.max("_label").alias("_label")).withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    # A repeated row is left behind where it lies: a text for each document of the sample is all that a task hands on. One
    # task reads and groups them, so they are shuffled once.
    found = found.groupBy("_order", "_id").agg(F.min("text").alias("text"), F.max("_label").alias("label"))
    return found.coalesce(1).sortWithinPartitions("_order", "_id").select("text", "label")


def within(it: Iterator[pa.RecordBatch], most: int = SAMPLE_BYTES) -> Iterator[tuple[bytes, int]]:
    """Texts and labels of a sample's batches, in its order, as far as most bytes go."""
    left = most
    for b in common.each(it):
        for text, label in zip(common.texts(b.column("text")), b.column("label").to_pylist(), strict=True):
            if len(text) <= left:
                left -= len(text)
                yield text, label
