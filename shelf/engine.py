"""The engine: everything a user does with a store."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas
from .functions.chunking import build_chunks
from .functions.text import score_tag, snippet
from .operators import catalog, fulltext, fusion, vector
from .operators.models import RERANK_BATCH, Embedder, Reranker, probe_ollama, providers, reranker_state, transformers_available
from .plans.crawl import MAX_DEPTH, MAX_PAGES, MISSING, Crawl, crawl
from .sources.html import read_articles, sections_of
from .sources.web import DELAY, PAGES, fetch_in_turn
from .staging import staged
from .store import Store

LIMIT, MOST = 6, 20
MODES = ("fts", "vector", "hybrid")
#: Why a page that was read isn't stored.
NOTHING = "Nothing to store: the page gave no chunks"
_HITS = "chunk_id long, doc_id long, doc_title string, doc_url string, collection string, idx int, text string, section_path string, fts_score double, vec_distance double, fused_score double, source string"


class Engine:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None):
        self.spark, self.store, self.embedder = spark, Store(spark, path), embedder

    # -- ingestion

    def articles(self, pages: DataFrame) -> DataFrame:
        """Pages (url, html; final_url, if redirects were followed) as articles with their chunks; error where there are none."""
        url = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
        read = read_articles(pages.select(url.alias("url"), "html", *(["error"] if "error" in pages.columns else [])))
        chunks = build_chunks(sections_of("content_html", "title", "text_content"))
        out = read.withColumn("chunks", F.when(F.col("error").isNull(), chunks))
        none = F.col("error").isNull() & (F.size("chunks") < 1)
        return out.withColumn("error", F.when(none, NOTHING).otherwise(F.col("error")))

    def add(self, pages: DataFrame, collection: str = schemas.DEFAULT_COLLECTION, embed: bool = True) -> DataFrame:
        """Reads pages and upserts them; status of each, rejects with their error. New and changed documents are embedded.

        Pages are fetched and parsed once: what was read of them is written down before anything else looks at it.
        """
        return self._ingest(staged(self.articles(pages)), collection, embed)

    def _ingest(self, articles: DataFrame, collection: str, embed: bool = True) -> DataFrame:
        """articles: a table that is stored and so reads alike each time."""
        good = articles.where("error is null").select("url", "title", "byline", "site_name", F.lit(collection).alias("collection"), "chunks")
        status = self.store.upsert(good)
        if embed and self.embedder:
            self.store.embed_pending(self.embedder, ids=status.where("status <> 'unchanged'"))
        bad = articles.where("error is not null").select(F.lit(None).cast("long").alias("doc_id"), "url", F.lit(collection).alias("collection"), "title", F.lit(0).cast("long").alias("chunk_count"), F.lit("failed").alias("status"), "error")
        return status.withColumn("error", F.lit(None).cast("string")).unionByName(bad)

    def crawl(
        self, pages: DataFrame | None, root: str, collection: str = schemas.DEFAULT_COLLECTION, max_depth: int = MAX_DEPTH, max_pages: int = MAX_PAGES,
        same_origin: bool = True, include: str | None = None, exclude: str | None = None, delay: float = DELAY, fetch=fetch_in_turn,
    ) -> Crawl:
        """Crawls a table of pages (url, html; final_url) from root and ingests what it reads, in one upsert; events with the
        ids of documents. Without a table, pages are fetched: one at a time, in crawl order, delay seconds apart.

        Of each depth only the frontier's pages are parsed, once; what was read of them is what is ingested.
        """
        rounds: list[DataFrame] = []
        if pages is not None:
            final = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
            error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
            table = pages.select("url", final.alias("final_url"), "html", error.alias("failed")).dropDuplicates(["url"])

        def read(taken: DataFrame) -> DataFrame:
            if pages is None:
                urls = [r.url for r in taken.orderBy("ord").collect()]  # as many as the page budget at most
                found = self.spark.createDataFrame(fetch(urls, delay, bool(rounds)), PAGES).withColumnRenamed("error", "failed")
            else:
                found = table.join(F.broadcast(taken.select("url")), "url", "left_semi")
            found = staged(found)
            parsed = self.articles(found.where("failed is null").select(F.col("final_url").alias("url"), "html").dropDuplicates(["url"])).withColumnRenamed("url", "final_url")
            got = staged(found.drop("html").join(parsed, "final_url", "left").withColumn("error", F.coalesce("failed", "error")))
            rounds.append(got)
            return got.select("url", "final_url", "links", "error", (F.col("error").isNull() | F.col("error").eqNullSafe(NOTHING)).alias("fetched"))

        done = crawl(self.spark, read, root, max_depth, max_pages, same_origin, include, exclude)
        if not rounds:
            return done
        articles = staged(reduce(DataFrame.unionByName, rounds))
        status = self._ingest(articles.drop("url").withColumnRenamed("final_url", "url").dropDuplicates(["url"]), collection)
        of = articles.select("url", "final_url").join(status.select(F.col("url").alias("final_url"), F.col("doc_id").alias("_doc"), "status"), "final_url").select("url", "_doc", "status")
        events = done.events.join(of, "url", "left")
        # A page that was reached by another URL before is there already. As many rows as the page budget at most.
        again = F.row_number().over(Window.partitionBy("_doc", "kind").orderBy("ord")) > 1
        kind = F.when((F.col("kind") == "indexed") & F.col("_doc").isNotNull() & ((F.col("status") == "unchanged") | again), "unchanged").otherwise(F.col("kind"))
        return Crawl(events.select("ord", kind.alias("kind"), "url", "depth", F.col("_doc").alias("doc_id"), "error", "reason").orderBy("ord"), done.fetched)

    def refresh(self, pages: DataFrame, ids: Iterable[int] | None = None, all_: bool = False, collection: str | None = None, embed: bool | None = None) -> DataFrame:
        """Reads stored documents' pages again from a newer snapshot; status of each: refreshed, unchanged or failed.

        embed: by default only if the store has vectors already.
        """
        if ids is None and not all_:
            raise ValueError("refresh needs ids, or all_")
        targets = staged(self.targets(ids, collection).select(F.col("id").alias("target_id"), "url", F.col("collection").alias("target_collection")))
        final = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
        failed = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
        wanted = pages.select("url", final.alias("final_url"), "html", failed.alias("failed")).join(targets.select("url"), "url", "left_semi").dropDuplicates(["url"])
        snapshot = staged(targets.join(wanted, "url", "left"))
        articles = self.articles(snapshot.where("html is not null").select("url", "final_url", "html").dropDuplicates(["final_url"])).withColumnRenamed("url", "final_url")
        error = F.when(F.col("html").isNull(), F.coalesce("failed", F.lit(MISSING))).otherwise(F.col("error"))
        rows = staged(snapshot.join(articles, "final_url", "left").withColumn("error", error).drop("html"))
        good = rows.where("error is null").select(F.col("final_url").alias("url"), "title", "byline", "site_name", F.col("target_collection").alias("collection"), "chunks")
        failed = rows.where("error is not null").select(F.col("target_id").alias("doc_id"), "url", F.col("target_collection").alias("collection"), F.lit("failed").alias("status"), "error")
        had = self.store.has_embeddings()
        status = self.store.upsert(good)
        if (had if embed is None else embed) and self.embedder:
            self.store.embed_pending(self.embedder, ids=status.where("status <> 'unchanged'"))
        named = F.when(F.col("status") == "unchanged", "unchanged").otherwise("refreshed")
        return status.select("doc_id", "url", "collection", named.alias("status"), F.lit(None).cast("string").alias("error")).unionByName(failed)

    def targets(self, ids: Iterable[int] | None = None, collection: str | None = None) -> DataFrame:
        """Stored documents by ids, or all, or all of a collection; an id that isn't there is an error."""
        docs = self.store.docs()
        if ids is None:
            return docs if collection is None else docs.where(F.col("collection") == collection)
        ids = sorted(set(ids))
        docs = docs.where(F.col("id").isin(ids))
        missing = set(ids) - {r.id for r in docs.select("id").collect()}  # as many as were asked for
        if missing:
            raise ValueError(f"the store has no document {min(missing)}")
        return docs

    def embed(self, collection: str | None = None) -> int:
        if self.embedder is None:
            raise RuntimeError("No embedding provider available")
        return self.store.embed_pending(self.embedder, collection)

    # -- reads

    def list_docs(self, collection: str | None = None) -> DataFrame:
        return catalog.list_docs(self.store.docs(), collection=collection)

    def list_collections(self) -> DataFrame:
        return catalog.list_collections(self.store.docs())

    def get_doc(self, doc_id: int) -> dict | None:
        """A document with its chunks in order and its whole text; None if there is none."""
        docs = self.store.docs().where(F.col("id") == doc_id).collect()
        if not docs:
            return None
        chunks = self.store.chunks().where(F.col("doc_id") == doc_id).orderBy("idx").collect()
        return docs[0].asDict() | {"chunks": [c.asDict() for c in chunks], "body": "\n\n".join(c.text for c in chunks)}

    def search(self, query: str, mode: str | None = None, collection: str | None = None, limit: int = LIMIT, reranker: Reranker | None = None, on_unavailable: str = "fallback") -> DataFrame:
        """The best chunks. Mode by default: hybrid if the store has vectors, else fts.

        Without vectors or a provider, vector mode is an error, and hybrid falls back to fts or, on request, is one too.
        """
        has = self.store.has_embeddings()
        mode = mode or ("hybrid" if has else "fts")
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if mode != "fts" and not (has and self.embedder):
            if mode == "vector" or on_unavailable == "error":
                raise RuntimeError("Semantic search needs embeddings and an embedding provider")
            mode = "fts"
        pool = fusion.overfetch(limit, reranker is not None)
        within = None if collection is None else self.store.documents_of(collection)
        none = lambda name: F.lit(None).cast("double").alias(name)
        if mode != "vector":
            fts = fulltext.fts_search(self.store.postings(), self.store.corpus_stats(), query, pool, within)
        if mode != "fts":
            vec = self._nearest(self.embedder.embed([query])[0], pool, within)
        if mode == "fts":
            hits = fts.select("chunk_id", "fts_score", none("vec_distance"), F.lit(0.0).alias("fused_score"), F.lit("fts").alias("source"))
        elif mode == "vector":
            hits = vec.select("chunk_id", none("fts_score"), "vec_distance", F.lit(0.0).alias("fused_score"), F.lit("vector").alias("source"))
        else:
            hits = fusion.rrf_fuse(fts, vec, pool)
        # pool rows at most, once: their ids then filter the scans of chunks and documents.
        best = hits.collect()
        hits = self.spark.createDataFrame(best, hits.schema)
        ids = [r.chunk_id for r in best]
        chunks = self.store._table("chunks").where(F.col("chunk_id").isin(ids))
        docs = self.store.docs().where(F.col("id").isin([k // (schemas.PLACES * schemas.VERSIONS) for k in ids]))
        order = {"fts": lambda r: (r.fts_score, r.chunk_id), "vector": lambda r: (r.vec_distance, r.chunk_id), "hybrid": lambda r: (-r.fused_score, r.chunk_id)}[mode]
        found = sorted(catalog.enrich(hits, chunks, docs).select(*schemas.HIT).collect(), key=order)
        schema = _HITS
        if reranker is not None:
            scores = [s for k in range(0, len(found), RERANK_BATCH) for s in reranker.rerank(query, [r.text for r in found[k : k + RERANK_BATCH]])]
            found = [Row(**r.asDict(), rerank_score=float(s)) for r, s in sorted(zip(found, scores, strict=True), key=lambda x: -x[1])][:limit]  # stable
            schema += ", rerank_score double"
        return self.spark.createDataFrame([tuple(r) for r in found], schema).coalesce(1)

    def _nearest(self, query: list[float], pool: int, within: DataFrame | None) -> DataFrame:
        """The nearest chunks: by the store's index where it is of all vectors that count, else by reading them."""
        index = None if within is not None else self.store.vector_index()
        return index.search(query, pool).hits if index else vector.vector_search(self.store.embeddings(), query, pool, within=within)

    def search_all(self, queries: DataFrame, collection: str | None = None, limit: int = LIMIT) -> DataFrame:
        """The best chunks by full text for every query of a table (query_id, query), in one job: query_id, rank and the fields
        of a hit. Null queries and those without a term have none."""
        within = None if collection is None else self.store.documents_of(collection)
        best = fulltext.batch_search(self.store.postings(), self.store.corpus_stats(), queries, limit, within)
        chunks = self.store.chunks().select("chunk_id", "doc_id", "idx", "text", "section_path")
        docs = self.store.docs().select(F.col("id").alias("doc_id"), F.col("title").alias("doc_title"), F.col("url").alias("doc_url"), "collection")
        hits = best.join(chunks, "chunk_id").join(docs, "doc_id")
        hits = hits.withColumn("vec_distance", F.lit(None).cast("double")).withColumn("fused_score", F.lit(0.0)).withColumn("source", F.lit("fts"))
        return hits.select("query_id", "rank", *schemas.HIT)

    def show(self, hits: DataFrame) -> DataFrame:
        """Hits as they are printed: tag of the score and a snippet."""
        return hits.select("doc_id", "idx", "collection", score_tag(hits).alias("tag"), "doc_title", "section_path", "doc_url", snippet("text").alias("snippet"))

    def doctor(self, env: Mapping[str, str] | None = None, reachable=probe_ollama, local=transformers_available) -> DataFrame:
        """One row: counts, what the store's vectors are of, which providers there are and which is used, and the reranker."""
        docs = self.store.docs().agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("collection").alias("collections"))
        vectors = self.store.embeddings().agg(F.count(F.lit(1)).alias("embeddings"))
        meta, active = self.store.meta, self.embedder
        state = [F.lit(f"{name}: {what}").alias(f"{name}_provider") for name, what in providers(env, reachable, local).items() if name != "hashing"]
        used = f"{active.name} ({active.model}, {active.dim})" if active else "none: search is full-text only"
        return docs.crossJoin(vectors).select(  # one row each
            "docs", "collections", F.lit(meta["n_chunks"]).cast("long").alias("chunks"), "embeddings", F.lit(meta["model"]).cast("string").alias("embedding_model"),
            F.lit(meta["dim"]).cast("int").alias("embedding_dim"), F.lit(active.name if active else None).cast("string").alias("provider"), F.lit(used).alias("active"),
            *state, F.lit(reranker_state(env)).alias("reranker"),
        )
