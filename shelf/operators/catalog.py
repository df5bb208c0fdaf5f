"""Reads of the store's metadata: joins and aggregates over documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_collections(docs: DataFrame) -> DataFrame:
    return docs.groupBy("collection").agg(F.count(F.lit(1)).alias("doc_count")).orderBy("collection")


def list_docs(docs: DataFrame, chunks: DataFrame | None = None, collection: str | None = None) -> DataFrame:
    """Documents with their number of chunks (counted if the table doesn't have it), by id."""
    rows = docs if collection is None else docs.where(F.col("collection") == collection)
    if chunks is not None:
        counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
        rows = rows.drop("chunk_count").join(counts, F.col("id") == F.col("doc_id"), "left").drop("doc_id").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long")))
    return rows.orderBy("id")


def bodies(chunks: DataFrame) -> DataFrame:
    """doc_id, body: all chunks of a document in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    return chunks.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("body"))


def enrich(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Top-k hits with their chunk's and document's fields. Hits are a few rows; the tables are filtered by their ids."""
    few = F.broadcast(hits)
    with_chunk = chunks.select("chunk_id", "doc_id", "idx", "text", "section_path").join(few, "chunk_id")
    fields = docs.select(F.col("id").alias("doc_id"), F.col("title").alias("doc_title"), F.col("url").alias("doc_url"), "collection")
    return fields.join(F.broadcast(with_chunk), "doc_id")


def pending(chunks: DataFrame, embeddings: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks that have no vector yet."""
    rows = chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_anti")
    return rows if limit is None else rows.orderBy("chunk_id").limit(limit)
