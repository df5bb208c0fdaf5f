"""Classification of incoming documents against those stored: new, unchanged or replaced, by key and content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(chunks: Column) -> Column:
    """Hash of the ordered (section_path, text) pairs; title and byline don't count."""
    pairs = F.transform(chunks, lambda c: F.concat(F.coalesce(c["section_path"], F.lit("")), F.lit("\x1f"), c["text"]))
    return F.sha2(F.array_join(pairs, "\x1e").cast("binary"), 256)


#: What else is kept of a stored document, where the table has it.
_MORE = {"chunk_count": "old_chunks", "tokens": "old_tokens", "title": "old_title", "byline": "old_byline", "site_name": "old_site_name"}


def classify(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Of each incoming (collection, url): status, and what is stored of it, if anything.

    One shuffle of each side on the key, of hashes only; texts needn't be moved.
    """
    old = stored.select("collection", "url", F.col("id").alias("old_id"), F.col("content_hash").alias("old_hash"), F.col("version").alias("old_version"), *(F.col(c).alias(n) for c, n in _MORE.items() if c in stored.columns))
    rows = incoming.join(old, ["collection", "url"], "left")
    status = F.when(F.col("old_id").isNull(), "inserted").when(F.col("content_hash") == F.col("old_hash"), "unchanged").otherwise("replaced")
    return rows.withColumn("status", status)
