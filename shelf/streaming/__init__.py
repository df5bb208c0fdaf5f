"""Streams of landing pages into a store."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def ingest_stream(spark: SparkSession, engine: Engine, landing: str, checkpoint: str, collection: str = "default", once: bool = True) -> StreamingQuery:
    """Upserts each micro-batch of pages (Parquet: url, html) that land in a folder. A batch that runs again after a failure
    upserts the same pages, which leaves them unchanged, so the sink is idempotent."""
    pages = spark.readStream.schema("url string, html string").parquet(landing)

    def upsert(batch, _id: int) -> None:
        engine.add(batch.dropDuplicates(["url"]), collection).count()

    writer = pages.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
