"""Keeps a table of articles' chunks up to date with a folder in which new and changed articles land.

    python -m jobs.article_feed --input /data/documents.parquet --output /shared/feed

Articles (doc_id, text, lang) are read as a file stream, so a run takes only the files that no run has taken yet; its
checkpoint lies beside the output, under _checkpoint, and belongs to it. Of each batch, what is stored already under the same
content hash is left alone; new and changed articles are cut into chunks. Everything is written once per batch, into folders
named by the batch, so a batch that is run again after a failure replaces what it had written and nothing else:

    output/chunks/batch=N/collection=C   url, version, idx, text, n_tokens
    output/docs/batch=N                  id, collection, url, content_hash, version, status of new and changed articles

docs is written last and says which chunks count: those of the batch that last changed their article.

Cases: articles without doc_id, and blank ones, are counted and not stored (a stored article keeps what it had); without
lang the collection is "default"; of several versions of an article in one batch the one of the greatest hash counts,
identical rows count once; no files, no change.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.functions.chunking import chunk_text
from shelf.functions.text import tokens, trim
from shelf.operators import upsert
from shelf.schemas import DEFAULT_COLLECTION
from shelf.staging import staged

from .config import log, settings

CONFIG = Path(__file__).with_suffix(".json")
ARTICLES = "doc_id long, text string, lang string"
_DOCS = "id long, collection string, url string, content_hash string, version long, status string, batch long"
_CHUNKS = "url string, version long, idx int, text string, n_tokens int, batch long, collection string"
_KEY = ["collection", "url"]


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the output; empty before its first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _latest(docs: DataFrame) -> DataFrame:
    """Of each article the row of the last batch that changed it: keys and hashes, no texts."""
    fields = ["id", "content_hash", "version", "batch"]
    return docs.groupBy(*_KEY).agg(F.max_by(F.struct(*fields), "batch").alias("d")).select(*_KEY, "d.*")


def articles(rows: DataFrame) -> DataFrame:
    """collection, url, text and content_hash of each row that can be stored."""
    named = rows.select(F.coalesce("lang", F.lit(DEFAULT_COLLECTION)).alias("collection"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), "text")
    return named.where(F.col("url").isNotNull() & (trim("text") != "")).withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))


def take(batch: DataFrame, number: int, output: str) -> None:
    """Stores one batch. Hashes are compared first; only texts of new and changed articles are moved."""
    spark = batch.sparkSession
    rows = articles(batch)
    seen = staged(rows.groupBy(*_KEY).agg(F.max("content_hash").alias("content_hash")))  # a hash for each article
    # Where a batch is small, which Spark tells by its size, its keys are sent to what is stored, and little of that is shuffled.
    before = _table(spark, f"{output}/docs", _DOCS).where(F.col("batch") < number) if number else spark.createDataFrame([], _DOCS)
    stored = _latest(before.join(seen.select(*_KEY), _KEY, "left_semi"))
    told = upsert.classify(stored, seen).where("status <> 'unchanged'")
    version = F.when(F.col("status") == "replaced", F.col("old_version") + 1).otherwise(F.lit(0).cast("long"))
    changed = told.select(F.coalesce("old_id", F.xxhash64(*_KEY)).alias("id"), *_KEY, "content_hash", version.alias("version"), "status")
    # Identical rows meet within their tasks first.
    texts = rows.join(changed.select(*_KEY, "content_hash", "version"), [*_KEY, "content_hash"]).groupBy(*_KEY, "version", "content_hash").agg(F.max("text").alias("text"))
    chunks = texts.select(*_KEY, "version", F.posexplode(chunk_text("text")).alias("idx", "text")).withColumn("n_tokens", F.size(tokens("text")))
    at = f"batch={number}"
    chunks.hint("rebalance", "collection").write.mode("overwrite").partitionBy("collection").parquet(f"{output}/chunks/{at}")
    changed.write.mode("overwrite").parquet(f"{output}/docs/{at}")
    done = {r.status: r.n for r in _table(spark, f"{output}/docs", _DOCS).where(F.col("batch") == number).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    log.info("batch %d: read %d articles; wrote %d new, %d changed", number, batch.count(), done.get("inserted", 0), done.get("replaced", 0))


def _pattern(path: str) -> str:
    """A path as a pattern that it alone matches: file streams take patterns and folders, but no single file."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, input: str, output: str, max_files: int = 1000) -> int:
    """Takes the files that are new, up to max_files a batch, and returns when they are stored; how many batches that took."""
    stream = spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", max_files).parquet(_pattern(input))
    writer = stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, output))
    query = writer.option("checkpointLocation", f"{output}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    n = len([p for p in query.recentProgress if p["numInputRows"]])
    log.info("read %s; wrote %d batches to %s", input, n, output)
    return n


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks as they stand: collection, url, version, idx, text, n_tokens, content_hash."""
    named = _latest(_table(spark, f"{output}/docs", _DOCS)).select(*_KEY, "batch", "content_hash")
    return _table(spark, f"{output}/chunks", _CHUNKS).join(named, [*_KEY, "batch"]).select(*_KEY, "version", "idx", "text", "n_tokens", "content_hash")


def main(argv: list[str] | None = None) -> None:
    values = settings(__doc__.split("\n")[0], CONFIG, argv)
    spark = SparkSession.builder.appName("article feed").getOrCreate()
    try:
        run(spark, **values)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
