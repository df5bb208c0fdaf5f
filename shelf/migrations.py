"""Steps that bring a store of an earlier schema forward, one version each; run when a store is opened.

A step reads the tables that its pointer names, writes new ones beside them and returns the pointer that names those; the
pointer is replaced after each step, so a chain that breaks off goes on where it was. What is no longer named stays until
the store is compacted.

1 to 2: documents know their tokens and batch; what replaced versions left behind is no longer told by a join with them.
2 to 3: words are folded as FTS5 folds them (combining marks, the dotted I, letter forms), so all chunks are indexed anew; the
pointer holds the last id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schemas
from .functions.text import tokens
from .operators import fulltext

#: Tables of version 1, where they differ.
_DOCS_1 = "id long, url string, title string, byline string, site_name string, collection string, content_hash string, version long, chunk_count long, fetched_at timestamp"
_POSTINGS = f"{schemas.POSTINGS}, doc_id long, version long"
_BATCHED = f"{schemas.DOCS}, batch long"


def _read(store, folders: list[str], schema: str) -> DataFrame:
    return store.spark.read.schema(schema).parquet(*folders) if folders else store.spark.createDataFrame([], schema)


def _write(store, table: str, rows: DataFrame, schema: str) -> list[str]:
    at = store._folder(table)
    rows.select(*(f.split(" ")[0] for f in schema.split(", "))).write.parquet(at)
    return [at]


def _with_tokens(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with the number of tokens of their chunks."""
    sums = chunks.groupBy(F.col("doc_id").alias("id")).agg(F.sum("dl").cast("long").alias("tokens"))
    return docs.join(sums, "id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))


def _counted(store, meta: dict) -> dict:
    n, words = _read(store, meta["chunks"], schemas.CHUNKS).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return meta | {"n_chunks": n, "n_tokens": words}


def _to_2(store, meta: dict) -> dict:
    docs = _read(store, [meta["docs"]] if meta["docs"] else [], _DOCS_1)
    live = docs.select(F.col("id").alias("doc_id"), "version")
    new = {"schema_version": 2, "model": meta["model"], "dim": meta["dim"], "batch": 1, "stale": [], "docs": [], "chunks": [], "postings": [], "embeddings": []}
    if not meta["docs"]:
        return new | {"n_chunks": 0, "n_tokens": 0}
    new["chunks"] = _write(store, "chunks", _read(store, meta["chunks"], schemas.CHUNKS).join(live, ["doc_id", "version"], "left_semi"), schemas.CHUNKS)
    chunks = _read(store, new["chunks"], schemas.CHUNKS)
    posts = _read(store, meta["postings"], _POSTINGS).join(live, ["doc_id", "version"], "left_semi").repartitionByRange("tok", "chunk_id", "pos").sortWithinPartitions("tok", "chunk_id", "pos")
    new["postings"] = _write(store, "postings", posts, _POSTINGS)
    if meta["embeddings"]:
        new["embeddings"] = _write(store, "embeddings", _read(store, meta["embeddings"], schemas.EMBEDDINGS).join(chunks, "chunk_id", "left_semi"), schemas.EMBEDDINGS)
    new["docs"] = _write(store, "docs", _with_tokens(docs, chunks).withColumn("batch", F.lit(0).cast("long")), _BATCHED)
    return _counted(store, new)


def _to_3(store, meta: dict) -> dict:
    store.meta = meta
    new = meta | {"schema_version": 3, "last_id": 0}
    if not meta["docs"]:
        return new
    docs, chunks, vectors = store.docs(), store.chunks(), store.embeddings()  # as they stand, without what is stale
    by = ["tok", "chunk_id", "pos"]
    again = chunks.withColumn("dl", F.size(tokens("text"))).repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")
    new["chunks"] = _write(store, "chunks", again, schemas.CHUNKS)
    chunks = _read(store, new["chunks"], schemas.CHUNKS)
    new["postings"] = _write(store, "postings", fulltext.postings(chunks, "doc_id", "version").repartitionByRange(*by).sortWithinPartitions(*by), _POSTINGS)
    if meta["embeddings"]:
        new["embeddings"] = _write(store, "embeddings", vectors, schemas.EMBEDDINGS)
    new["docs"] = _write(store, "docs", _with_tokens(docs.drop("tokens"), chunks).withColumn("batch", F.lit(meta["batch"] - 1).cast("long")), _BATCHED)
    last = docs.agg(F.max("id")).first()[0] or 0
    return _counted(store, new | {"stale": [], "last_id": last})


STEPS: dict[int, Callable] = {1: _to_2, 2: _to_3}
