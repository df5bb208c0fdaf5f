"""Commands over a store: add, crawl, refresh, embed, list, collections, search, doctor."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import tools
from .engine import LIMIT, MODES, Engine
from .operators.models import default_reranker, embedding_provider, load_reranker
from .plans.crawl import MAX_DEPTH, MAX_PAGES
from .sources.location import default_store
from .sources.web import DELAY, fetch_given, fetch_pages, read_pages


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shelf", description=__doc__)
    p.add_argument("--store", help="folder of the store (default: found from the working folder)")
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser("add", help="fetch and index URLs, or pages of a table")
    add.add_argument("url", nargs="*")
    add.add_argument("--crawl", action="store_true", help="follow links from the first URL, over the network or through --pages")
    add.add_argument("--depth", type=int, default=MAX_DEPTH)
    add.add_argument("--max-pages", type=int, default=MAX_PAGES)
    add.add_argument("--any-origin", action="store_true")
    add.add_argument("--delay", type=int, default=int(DELAY * 1000), help="milliseconds between two fetches of a crawl")
    add.add_argument("--include")
    add.add_argument("--exclude")
    refresh = sub.add_parser("refresh", help="read documents again")
    refresh.add_argument("id", nargs="?", type=int)
    refresh.add_argument("--all", action="store_true")
    for s in (add, refresh):
        s.add_argument("--pages", help="Parquet table of pages (url, html) instead of the network")
        s.add_argument("--no-embed", action="store_true")
    embed = sub.add_parser("embed", help="vectors for chunks that have none")
    embed.add_argument("--index", action="store_true", help="lay all vectors out for search afterwards")
    search = sub.add_parser("search", help="search chunks")
    search.add_argument("query", nargs="+")
    search.add_argument("-n", "--limit", type=int, default=LIMIT)
    search.add_argument("-m", "--mode", choices=MODES)
    search.add_argument("--rerank", action="store_true")
    search.add_argument("--rerank-model")
    docs = sub.add_parser("list", help="documents")
    for s in (add, refresh, embed, search, docs):
        s.add_argument("-c", "--collection")
    sub.add_parser("collections", help="collections with their numbers of documents")
    sub.add_parser("doctor", help="state of the store and of providers")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    command = parser()
    a = command.parse_args(argv)
    spark = spark or SparkSession.builder.appName("shelf").getOrCreate()
    engine = Engine(spark, a.store or default_store(), None if getattr(a, "no_embed", False) else embedding_provider())
    collection = getattr(a, "collection", None)
    if a.command in ("add", "refresh"):
        if a.command == "add" and not a.url and (a.crawl or not a.pages):
            command.error("add needs a URL" + (" to crawl from" if a.crawl else " or --pages"))
        if a.command == "refresh" and a.id is None and not a.all:
            command.error("refresh needs an id or --all")
        if a.pages:
            pages = read_pages(spark, a.pages)
        elif a.command == "refresh":
            pages = fetch_pages(engine.targets(None if a.id is None else [a.id], collection).select("url"), spark.sparkContext.defaultParallelism)
        else:
            pages = None if a.crawl else fetch_given(spark, a.url, a.delay / 1000)
        if a.command == "refresh":
            print(tools.refresh_doc(engine, pages, a.id, a.all, collection, embed=not a.no_embed))
        elif a.crawl:
            done = engine.crawl(pages, a.url[0], collection or "default", a.depth, a.max_pages, not a.any_origin, a.include, a.exclude, a.delay / 1000)
            for r in done.events.toLocalIterator():
                print(f"{r.kind} [{r.depth}] {r.url}" + (f": {r.error or r.reason}" if r.error or r.reason else ""))
        else:
            some = pages.where(F.col("url").isin(a.url)) if a.url and a.pages else pages
            for r in engine.add(some, collection or "default").toLocalIterator():
                print(f"{r.status} #{r.doc_id} [{r.collection}]: {r.title} ({r.chunk_count} chunks)" + (f" {r.error}" if r.error else ""))
    elif a.command == "embed":
        print(f"Embedded {engine.embed(collection)} chunks.")
        if a.index:
            print(f"Indexed {engine.store.index_vectors().total} vectors.")
    elif a.command == "search":
        reranker = load_reranker(a.rerank_model) if a.rerank and a.rerank_model else default_reranker({"SHELF_RERANK": "1"} if a.rerank else None)
        if a.rerank and reranker is None:
            print("warning: --rerank requested but sentence_transformers is not installed", file=sys.stderr)
        query = " ".join(a.query)
        hits = engine.search(query, a.mode, collection, a.limit, reranker)
        for k, r in enumerate(engine.show(hits).collect(), 1):
            section = f" [{r.section_path}]" if r.section_path else ""
            print(f"[{k}] doc #{r.doc_id} chunk {r.idx} [{r.collection}] ({r.tag}) — {r.doc_title}{section}\n    {r.doc_url}\n    {r.snippet}\n")
    elif a.command == "list":
        print(tools.list_docs(engine, collection))
    elif a.command == "collections":
        print(tools.list_collections(engine))
    else:
        print("\n".join(f"{k}: {v}" for k, v in engine.doctor().first().asDict().items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
