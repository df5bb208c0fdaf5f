"""The five functions that an assistant's server offers, as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .engine import LIMIT, MOST, Engine
from .functions.text import score_tag
from .operators.models import Reranker


def list_collections(engine: Engine) -> str:
    rows = engine.list_collections().collect()  # a row for each collection
    return "\n".join(f"{r.collection}  ({r.doc_count} docs)" for r in rows) or "(no collections)"


def list_docs(engine: Engine, collection: str | None = None) -> str:
    rows = engine.list_docs(collection).toLocalIterator()
    return "\n".join(f"#{r.id} [{r.collection}]  {r.title}\n     {r.url}  ({r.chunk_count} chunks, {r.fetched_at})" for r in rows) or "(no documents)"


def get_doc(engine: Engine, doc_id: int) -> str:
    if isinstance(doc_id, bool) or not isinstance(doc_id, int) or doc_id < 1:
        raise ValueError("a document's id is a whole number from 1 on")
    doc = engine.get_doc(doc_id)
    if doc is None:
        return f"There is no document {doc_id}."
    byline = f"\nby {doc['byline']}" if doc["byline"] else ""
    return f"# {doc['title']}\n{doc['url']}{byline}\ncollection: {doc['collection']}\n\n{doc['body']}"


def search_docs(engine: Engine, query: str, mode: str | None = None, collection: str | None = None, limit: int = LIMIT, reranker: Reranker | None = None) -> str:
    """Hits as blocks of text; vector and hybrid are errors if the store has no vectors."""
    if not query:
        raise ValueError("query must not be empty")
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be between 1 and {MOST}")
    try:
        hits = engine.search(query, mode, collection, limit, reranker, on_unavailable="error")
    except RuntimeError as e:
        return str(e)
    rows = hits.withColumn("tag", score_tag(hits)).collect()  # limit rows, in order
    label = (mode or ("hybrid" if engine.store.has_embeddings() else "fts")) + ("+rerank" if reranker else "")
    blocks = [f"[{k}] {r.doc_title} (doc #{r.doc_id}, chunk {r.idx}, {r.collection}) {r.tag}\n{r.doc_url}\n{r.text}" for k, r in enumerate(rows, 1)]
    return f"mode={label}, hits={len(blocks)}\n\n" + "\n\n---\n\n".join(blocks) if blocks else f"(no matches, mode={label})"


def refresh_doc(engine: Engine, pages: DataFrame, doc_id: int | None = None, all_: bool = False, collection: str | None = None, embed: bool | None = None) -> str:
    """embed: by default only if the store has vectors."""
    rows = engine.refresh(pages, None if doc_id is None else [doc_id], all_, collection, embed).toLocalIterator()
    return "\n".join(f"{r.status} #{r.doc_id} {r.url}" + (f": {r.error}" if r.error else "") for r in rows)
