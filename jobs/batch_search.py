"""Searches all articles for every query of a table in one job, and writes each query's best chunks.

    python -m jobs.batch_search --documents /data/documents.parquet --queries /data/benchmark.parquet --output /shared/hits

Articles (doc_id, text, lang) are cut into chunks, queries (item_id, text) into the terms that a search has. All queries of a block
share one pass over the chunks' words, which are counted and scored where they lie. Hits are written by
collection, item_id and rank beside the chunk's place, score and snippet; a run replaces the hits of the run before, and
the same tables give the same hits.

Cases: rows without doc_id or item_id, and queries without a term, have no hits; null and blank texts have no chunks; without
lang the collection is "default"; rows repeated under one item_id are one query, of the first text in order; rows repeated
under one doc_id are an article each. Ties go to the smaller doc_id, then idx.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.functions.chunking import chunk_text
from shelf.functions.text import SNIPPET, snippet
from shelf.operators import batch, fulltext
from shelf.schemas import DEFAULT_COLLECTION

from .config import log, settings

CONFIG = Path(__file__).with_suffix(".json")
HITS = "item_id long, rank int, doc_id long, idx int, fts_score double, snippet string, collection string"


def chunks(documents: DataFrame) -> DataFrame:
    """chunk_id, doc_id, idx, collection, text, toks, dl of each article's chunks; chunk_ids are in the order of doc_id and idx.

    Articles are dealt by ranges of doc_id, so the files that they come in don't decide how many tasks there are.
    """
    rows = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit(DEFAULT_COLLECTION)).alias("collection"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    cut = dealt.select("doc_id", "collection", F.posexplode(chunk_text("text")).alias("idx", "text")).withColumn("chunk_id", F.monotonically_increasing_id())
    return fulltext.tokenized(cut, "doc_id", "idx", "collection", "text")


def hits(documents: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The best chunks of each query by BM25 (rows of HITS), a rank each. Chunks are cut and tokenised once; what is written of them
    is how often the queries' terms stand there."""
    asked = queries.where(F.col("item_id").isNotNull()).groupBy(F.col("item_id").cast("long").alias("query_id")).agg(F.min(F.col("text").cast("string")).alias("query"))
    every = chunks(documents).withColumn("head", F.substring("text", 1, SNIPPET))
    best = batch.search_chunks(every, asked, limit, "doc_id", "idx", "collection", "head")
    return best.select(F.col("query_id").alias("item_id"), "rank", "doc_id", "idx", "fts_score", snippet("head").alias("snippet"), "collection")


def run(spark: SparkSession, documents: str, queries: str, output: str, limit: int = 6) -> int:
    """Searches and writes; how many hits there are."""
    tables = spark.read.parquet(documents), spark.read.parquet(queries)
    hits(*tables, limit).hint("rebalance", "collection").write.mode("overwrite").partitionBy("collection").parquet(output)
    n = read(spark, output).count()
    log.info("read %d articles of %s and %d queries of %s; wrote %d hits to %s", tables[0].count(), documents, tables[1].count(), queries, n, output)
    return n


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(HITS).parquet(output)


def main(argv: list[str] | None = None) -> None:
    values = settings(__doc__.split("\n")[0], CONFIG, argv)
    spark = SparkSession.builder.appName("batch search").getOrCreate()
    try:
        run(spark, **values)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
