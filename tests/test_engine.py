from __future__ import annotations

import glob
import json
import os
import re
import sys
import uuid

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from jobs import queries as jobs
from shelf import cli, queries, schemas, tools
from shelf.engine import Engine
from shelf.operators import fulltext, vector
from shelf.operators.models import Hashing, LexicalReranker
from shelf.plans.crawl import crawl
from shelf.staging import staged
from shelf.streaming import ingest_stream

UPSERT = "url string, title string, byline string, site_name string, collection string, chunks array<struct<text: string, section_path: string>>"
PAGE = "<html><head><title>{0}</title></head><body><article><h1>Head {0}</h1><p>{1}</p></article></body></html>"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"{tmp_path}/store", Hashing(8))


def docs(spark, *rows):
    return spark.createDataFrame([(u, t, None, None, c, [(x, p) for x, p in chunks]) for u, t, c, chunks in rows], UPSERT)


def pages(spark, rows):
    return spark.createDataFrame([(u, PAGE.format(t, b) if b is not None else None) for u, t, b in rows], "url string, html string")


def test_upsert_inserts_keeps_and_replaces_in_place(spark, engine):
    put = lambda *rows: {r.url: r for r in engine.store.upsert(docs(spark, *rows)).collect()}
    a = put(("a", "Doc A", None, [("alpha bravo charlie", None), ("echo foxtrot", "Doc A > Section")]), ("b", "Doc B", "x", [("same content", None)]))
    assert {r.status for r in a.values()} == {"inserted"} and a["a"].chunk_count == 2 and a["a"].collection == "default"
    full = engine.get_doc(a["a"].doc_id)
    assert full["title"] == "Doc A" and [c["text"] for c in full["chunks"]] == ["alpha bravo charlie", "echo foxtrot"] and full["chunks"][1]["section_path"] == "Doc A > Section"
    again = put(("b", "Doc B", "x", [("same content", None)]), ("b", "Doc B", "other", [("same content", None)]))
    assert len(engine.store.docs().collect()) == 3
    b = put(("a", "Doc A", None, [("new text beta", None)]), ("c", "Doc C", None, [("gamma", None)]))
    assert (b["a"].status, b["a"].doc_id, b["c"].status) == ("replaced", a["a"].doc_id, "inserted")
    assert len({r.id for r in engine.store.docs().collect()}) == 4
    assert [c["text"] for c in engine.get_doc(a["a"].doc_id)["chunks"]] == ["new text beta"]
    assert engine.search("charlie", "fts").collect() == [] and len(engine.search("beta", "fts").collect()) == 1
    assert again and engine.get_doc(999) is None
    engine.store.compact()
    assert [c["text"] for c in engine.get_doc(a["a"].doc_id)["chunks"]] == ["new text beta"] and len(engine.search("gamma", "fts").collect()) == 1


def test_an_unchanged_document_only_moves_its_time(spark, engine):
    row = ("a", "Doc A", None, [("same content here today", None)])
    first = engine.store.upsert(docs(spark, row)).first()
    before, old = dict(engine.store.meta), engine.store.docs().first()
    second = engine.store.upsert(docs(spark, row)).first()
    new = engine.store.docs().first()
    assert (first.status, second.status, first.doc_id) == ("inserted", "unchanged", second.doc_id)
    assert all(engine.store.meta[t] == before[t] for t in ("chunks", "postings", "embeddings")) and new.fetched_at > old.fetched_at
    other = spark.createDataFrame([("a", "Another title", "by someone", "a site", None, [("same content here today", None)])], UPSERT)
    assert engine.store.upsert(other).first().title == "Doc A"
    assert [tuple(r) for r in engine.store.docs().select("title", "byline", "site_name").collect()] == [("Doc A", None, None)]
    changed = other.withColumn("chunks", F.expr("array(named_struct('text', 'other content', 'section_path', cast(null as string)))"))
    assert engine.store.upsert(changed).first().title == "Another title" and engine.store.docs().first().site_name == "a site"


def test_an_upsert_sends_its_keys_to_the_stored_documents(spark, engine):
    """Documents that a batch doesn't name are filtered where they lie: what is shuffled of them is the batch's."""
    for k in range(3):
        engine.store.upsert(docs(spark, *[(f"u{n}", "T", None, [(f"text {n} {k * (n % 7 == 0)}", None)]) for n in range(60)]))
    keys = staged(spark.createDataFrame([("default", "u7"), ("default", "u8")], "collection string, url string"))
    found = engine.store.docs(keys)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.url, r.version) for r in found.collect()) == [("u7", 2), ("u8", 0)]
    assert plan.index("BroadcastHashJoin [collection") > plan.index("Exchange hashpartitioning(id") and plan.count("Exchange hashpartitioning") == 1
    assert engine.store.meta["last_id"] == 60 and engine.store.upsert(docs(spark, ("new", "N", None, [("x", None)]))).first().doc_id == 61


def test_what_is_told_outlives_compaction_and_staging_is_removed(spark, engine):
    told = engine.store.upsert(docs(spark, ("a", "A", None, [("alpha", None)]), ("b", "B", None, [("beta", None)])))
    assert os.listdir(f"{engine.store.path}/staged") == []
    engine.store.upsert(docs(spark, ("a", "A", None, [("gamma", None)])))
    engine.store.compact()
    assert sorted((r.url, r.status) for r in told.collect()) == [("a", "inserted"), ("b", "inserted")]


def former_store(spark, path, version):
    """A store as an earlier version wrote it: a document of two versions, one without a mark in its word, one with vectors."""
    place = lambda doc, v, idx: doc * (schemas.PLACES * schemas.VERSIONS) + v * schemas.PLACES + idx
    fields = [(1, "http://x/a", "A", None, None, "default", "h1", 2, 1), (2, "http://x/b", "B", None, None, "k", "h2", 1, 2)]
    chunks = [(place(1, 1, 0), 1, 1, 0, "old words", None, 2), (place(1, 2, 0), 1, 2, 0, "new cafe\u0301s here", None, 4), (place(2, 1, 0), 2, 1, 0, "beta text", "B", 2), (place(2, 1, 1), 2, 1, 1, "more beta", "B", 2)]
    words = {"old words": ["old", "words"], "new cafe\u0301s here": ["new", "cafe", "s", "here"], "beta text": ["beta", "text"], "more beta": ["more", "beta"]}
    posts = [(t, c[0], k, len(words[c[4]]), c[1], c[2]) for c in chunks for k, t in enumerate(words[c[4]])]
    vectors = [(c[0], [float(c[3])] * 8) for c in chunks if c[1] == 2 or c[2] == 1]
    now = F.current_timestamp().alias("fetched_at")
    rows = spark.createDataFrame(fields, "id long, url string, title string, byline string, site_name string, collection string, content_hash string, version long, chunk_count long")
    rows = rows.select("*", now) if version == 1 else rows.select("*", F.lit(4).cast("long").alias("tokens"), now, F.lit(0).cast("long").alias("batch"))
    tables = {"docs": rows, "chunks": spark.createDataFrame(chunks, schemas.CHUNKS), "postings": spark.createDataFrame(posts, f"{schemas.POSTINGS}, doc_id long, version long"), "embeddings": spark.createDataFrame(vectors, schemas.EMBEDDINGS)}
    meta = {"schema_version": version, "model": "hashing", "dim": 8}
    if version == 2:
        tables["stale"] = spark.createDataFrame([(schemas.VERSIONS + 1,)], "owner long")
        meta |= {"batch": 1, "n_chunks": 3, "n_tokens": 8}
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}/first")
        meta[name] = f"{path}/{name}/first" if version == 1 and name == "docs" else [f"{path}/{name}/first"]
    with open(f"{path}/pointer.json", "w") as f:
        json.dump(meta, f)


@pytest.mark.parametrize("version", [1, 2])
def test_a_store_of_an_earlier_version_is_brought_forward_once(spark, tmp_path, version):
    path = str(tmp_path / "store")
    former_store(spark, path, version)
    engine = Engine(spark, path, Hashing(8))
    meta = json.load(open(f"{path}/pointer.json"))
    assert meta["schema_version"] == schemas.SCHEMA_VERSION and engine.store.corpus_stats().first() == fulltext.corpus_stats(engine.store.chunks()).first() == (3, 7 / 3)
    assert {(r.id, r.version, r.tokens) for r in engine.store.docs().collect()} == {(1, 2, 3), (2, 1, 4)}
    assert sorted(r.text for r in engine.store.chunks().collect()) == ["beta text", "more beta", "new cafe\u0301s here"]
    assert engine.store.embeddings().count() == 2 and engine.store.pending().count() == 1
    assert [r.doc_url for r in engine.search("cafés", "fts").collect()] == ["http://x/a"] and engine.search("words", "fts").collect() == []
    stamp = os.stat(f"{path}/pointer.json").st_mtime_ns
    again = Engine(spark, path, Hashing(8))
    assert os.stat(f"{path}/pointer.json").st_mtime_ns == stamp and again.store.meta == meta
    put = again.store.upsert(docs(spark, ("http://x/a", "A", None, [("newer", None)]), ("http://x/c", "C", None, [("third", None)])))
    assert sorted((r.doc_id, r.status) for r in put.collect()) == [(1, "replaced"), (3, "inserted")]
    again.store.compact()
    assert sorted(r.text for r in again.store.chunks().collect()) == ["beta text", "more beta", "newer", "third"] and [len(os.listdir(f"{path}/{t}")) for t in ("docs", "chunks", "postings")] == [1, 1, 1]
    os.remove(f"{path}/.pointer.json.crc")
    with open(f"{path}/pointer.json", "w") as f:
        json.dump(meta | {"schema_version": schemas.SCHEMA_VERSION + 1}, f)
    with pytest.raises(RuntimeError):
        Engine(spark, path)


def test_an_empty_store_of_the_first_version_opens(spark, tmp_path):
    with open(f"{tmp_path}/pointer.json", "w") as f:
        json.dump({"schema_version": 1, "docs": None, "model": None, "dim": None, "chunks": [], "postings": [], "embeddings": []}, f)
    engine = Engine(spark, str(tmp_path))
    assert engine.store.docs().count() == 0 and engine.store.upsert(docs(spark, ("a", "A", None, [("alpha", None)]))).count() == 1


def test_search_finds_chunks_and_collections_are_counted(spark, engine):
    engine.store.upsert(docs(spark, ("d", "D", None, [("the quick brown fox jumps over the lazy dog", None), ("completely unrelated content about ferrets", None)]), ("e1", "E", "alpha", [("body brown", None)]), ("e2", "E", "alpha", [("body", None)]), ("e3", "E", "beta", [("body", None)])))
    hits = engine.search("brown").collect()
    assert len(hits) == 2 and all("brown" in h.text and h.source == "fts" and h.fts_score < 0 for h in hits)
    assert [h.collection for h in engine.search("brown", collection="alpha").collect()] == ["alpha"]
    assert [tuple(r) for r in engine.list_collections().collect()] == [("alpha", 2), ("beta", 1), ("default", 1)]
    assert [r.collection for r in engine.list_docs("alpha").collect()] == ["alpha", "alpha"]


def test_all_queries_of_a_table_find_what_each_finds_alone(spark, engine):
    rows = [(f"u{k}", "T", "even" if k % 2 == 0 else "odd", [(f"alpha word{k % 5} and café-bar number {k}", None), (f"other text{k}", "S")]) for k in range(24)]
    engine.store.upsert(docs(spark, *rows))
    engine.store.upsert(docs(spark, ("u3", "T", "odd", [("replaced alpha alpha", None)])))
    asked = ["alpha", "word3 text1", "cafe-bar numbers", "nothing", "", None, "“other” alpha alpha"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    for collection in (None, "odd"):
        got: dict[int, list] = {}
        for r in engine.search_all(queries, collection, 4).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_url, r.idx, r.text, r.collection, r.section_path, round(r.fts_score, 9), r.source))
        alone = {k: [(r.doc_url, r.idx, r.text, r.collection, r.section_path, round(r.fts_score, 9), r.source) for r in engine.search(q, "fts", collection, 4).collect()] for k, q in enumerate(asked) if q}
        assert got == {k: v for k, v in alone.items() if v} and len(got) == 4


def test_searches_by_an_index_find_what_scans_find_until_vectors_change(spark, engine, monkeypatch, capsys):
    rows = [(f"u{k}", "T", "odd" if k % 2 else "even", [(f"alpha word{k % 5} number{k}", None)]) for k in range(30)]
    engine.store.upsert(docs(spark, *rows))
    engine.embed()
    shown = lambda **how: [(r.doc_url, round(r.vec_distance, 9)) for r in engine.search("alpha word3", "vector", **how).collect()]
    by_scan = shown(limit=8)
    monkeypatch.setattr(cli, "embedding_provider", lambda: Hashing(8))
    cli.main(["--store", engine.store.path, "embed", "--index"], spark)
    assert "Indexed 30 vectors" in capsys.readouterr().out
    engine = Engine(spark, engine.store.path, Hashing(8))
    scans = []
    plain = vector.vector_search
    monkeypatch.setattr(vector, "vector_search", lambda *a, **k: scans.append(1) or plain(*a, **k))
    assert shown(limit=8) == by_scan and not scans
    assert [u for u, _ in shown(limit=3, collection="odd")] == [u for u, _ in by_scan if int(u[1:]) % 2][:3] or len(scans) == 1
    engine.store.upsert(docs(spark, ("u3", "T", "odd", [("another text", None)])))
    assert engine.store.vector_index() is None and "u3" not in [u for u, _ in shown(limit=30)]
    engine.embed()
    engine.store.index_vectors()
    assert engine.store.vector_index().total == 30
    engine.store.compact()
    assert engine.store.vector_index() is None and os.listdir(f"{engine.store.path}/index") == [] and len(shown(limit=40)) == 30


def test_modes_need_vectors(spark, engine):
    engine.store.upsert(docs(spark, ("a", "A", None, [("one two three four", None), ("five six seven eight", None)])))
    with pytest.raises(RuntimeError):
        engine.search("three", "vector")
    with pytest.raises(RuntimeError):
        engine.search("three", "hybrid", on_unavailable="error")
    with pytest.raises(ValueError):
        engine.search("three", "what")
    assert engine.search("three", "hybrid").first().source == "fts"
    assert engine.embed() == 2 and engine.embed() == 0
    assert engine.search("three").first().source in ("hybrid", "fts", "vector")
    near = engine.search("one two three four", "vector", limit=1).first()
    assert near.idx == 0 and near.vec_distance < 1e-3 and near.source == "vector"
    best = engine.search("five eight", reranker=LexicalReranker(), limit=1).first()
    assert best.text.startswith("five") and best.rerank_score == 1.0
    with pytest.raises(ValueError):
        engine.store.init_embeddings(9, "other")
    engine.store.drop_embeddings()
    assert not engine.store.has_embeddings()
    row = engine.doctor().first()
    assert (row.docs, row.chunks, row.embeddings, row.provider) == (1, 2, 0, "hashing")


def test_add_and_refresh(spark, engine):
    status = {r.url: r for r in engine.add(pages(spark, [("http://x/a", "A", "alpha text"), ("http://x/b", "B", "beta text"), ("http://x/c", "C", None)])).collect()}
    assert [status[f"http://x/{k}"].status for k in "abc"] == ["inserted", "inserted", "failed"] and status["http://x/c"].error
    assert engine.store.pending().count() == 0
    a, b = status["http://x/a"].doc_id, status["http://x/b"].doc_id
    new = pages(spark, [("http://x/a", "A", "alpha text"), ("http://x/b", "B", "beta changed")])
    got = {r.doc_id: r.status for r in engine.refresh(new, all_=True).collect()}
    assert got == {a: "unchanged", b: "refreshed"} and engine.store.pending().count() == 0
    assert [r.status for r in engine.refresh(new.limit(0), ids=[a]).collect()] == ["failed"]
    for bad in ({}, {"ids": [99]}):
        with pytest.raises(ValueError):
            engine.refresh(new, **bad)


def test_pages_are_fetched_and_parsed_once_even_if_a_fetch_would_fail_only_the_first_time(spark, engine, tmp_path):
    """A source that counts its fetches in files and fails the first of each page."""
    folder = str(tmp_path / "fetched")
    os.mkdir(folder)

    def fetch(batches):
        for b in batches:
            out = []
            for k in b.column(0).to_pylist():
                before = len(glob.glob(f"{folder}/{k}-*"))
                open(f"{folder}/{k}-{uuid.uuid4().hex}", "w").close()
                fails = k % 3 == 0 and before == 0
                out.append({"url": f"http://x/{k}", "html": None if fails else PAGE.format(f"T{k}", f"text number {k}"), "error": "The server answered 503" if fails else None})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c, pa.string()) for c in ("url", "html", "error")]))

    status = engine.add(spark.range(12).mapInArrow(fetch, "url string, html string, error string")).collect()
    assert len(os.listdir(folder)) == 12
    assert sorted((r.status, r.doc_id is None, r.error) for r in status) == [("failed", True, "The server answered 503")] * 4 + [("inserted", False, None)] * 8
    assert engine.store.docs().where("id is null").isEmpty() and engine.store.docs().count() == 8 == engine.store.chunks().select("doc_id").distinct().count()
    assert engine.store.pending().isEmpty()


def test_ids_stay_in_their_range_and_nothing_is_stored_beyond(spark, engine, monkeypatch):
    row = lambda n: ("a", "A", None, [(f"text {k}", None) for k in range(n)])
    monkeypatch.setattr(schemas, "PLACES", 4)
    with pytest.raises(ValueError):
        engine.store.upsert(docs(spark, row(5)))
    monkeypatch.setattr(schemas, "DOCUMENTS", 2)
    engine.store.upsert(docs(spark, row(4)))
    with pytest.raises(ValueError):
        engine.store.upsert(docs(spark, ("b", "B", None, [("x", None)])))
    assert engine.store.docs().count() == 1 and len({r.chunk_id for r in engine.store.chunks().collect()}) == 4


def test_versions_that_begin_anew_meet_no_old_vectors(spark, engine, monkeypatch):
    monkeypatch.setattr(schemas, "VERSIONS", 2)
    for k in range(5):
        engine.store.upsert(docs(spark, ("a", "A", None, [(f"words of round {k}", None), ("same", None)][: 1 + k % 2])))
        assert engine.store.pending().count() == 1 + k % 2
        engine.embed()
        near = engine.search(f"words of round {k}", "vector", limit=9).collect()
        assert [r.text for r in near][:1] == [f"words of round {k}"] and len(near) == 1 + k % 2
        assert engine.store.corpus_stats().first().n == engine.store.chunks().count()


def test_batches_of_documents_are_merged_and_compacting_deletes_what_no_longer_counts(spark, engine, monkeypatch):
    monkeypatch.setattr("shelf.store.MERGE", 3)
    for k in range(6):
        engine.store.upsert(docs(spark, ("a", "A", None, [(f"round {k}", None)]), (f"d{k}", "D", None, [("kept", None)])))
        assert len(engine.store.meta["docs"]) <= 3 and engine.store.docs().count() == k + 2
    stats = engine.store.corpus_stats().first()
    assert stats == fulltext.corpus_stats(engine.store.chunks()).first() and stats.n == 7
    engine.store.compact()
    assert [len(os.listdir(f"{engine.store.path}/{t}")) for t in ("docs", "chunks", "postings")] == [1, 1, 1] and not os.listdir(f"{engine.store.path}/staged")
    assert engine.store.meta["stale"] == [] and engine.store.corpus_stats().first() == stats and engine.store.chunks().count() == 7
    assert [r.text for r in engine.search("round").collect()] == ["round 5"]
    put = {r.url: r.status for r in engine.store.upsert(docs(spark, ("a", "A", None, [("round 5", None)]), ("d0", "D", None, [("new", None)]))).collect()}
    assert put == {"a": "unchanged", "d0": "replaced"}


def test_a_search_scans_postings_once_and_reads_chunks_by_their_ids(spark, engine):
    rows = [(f"u{k}", "T", "even" if k % 2 == 0 else "odd", [(f"alpha word{k}", None)]) for k in range(40)]
    engine.store.upsert(docs(spark, *rows))
    plan = fulltext.fts_search(engine.store.postings(), engine.store.corpus_stats(), "alpha", 3, engine.store.documents_of("even"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3 and plan.count("Relation [tok") == 2  # the second is the document frequencies'
    assert [r.doc_url for r in engine.search("alpha", collection="odd", limit=2).collect()] == ["u1", "u11"]


def test_embedding_in_rounds_stores_each(spark, engine):
    engine.store.upsert(docs(spark, *[(f"u{k}", "T", None, [(f"text {k}", None)]) for k in range(20)]))
    assert engine.store.embed_pending(engine.embedder, rounds=3) == 20 and len(engine.store.meta["embeddings"]) == 3 and engine.store.pending().isEmpty()


def test_refreshing_one_document_leaves_the_backlog_alone(spark, engine):
    first = engine.add(pages(spark, [("http://x/a", "A", "alpha text")])).first()
    engine.add(pages(spark, [("http://x/b", "B", "beta text")]), embed=False)
    changed = pages(spark, [("http://x/a", "A", "alpha anew"), ("http://x/b", "B", "beta anew")])
    assert [(r.doc_id, r.status) for r in engine.refresh(changed, ids=[first.doc_id]).collect()] == [(first.doc_id, "refreshed")]
    assert [r.doc_id != first.doc_id for r in engine.store.pending().collect()] == [True]


def test_refresh_embeds_only_what_changed(spark, engine):
    engine.add(pages(spark, [("http://x/a", "A", "alpha text"), ("http://x/b", "B", "beta text")]), embed=False)
    engine.add(pages(spark, [("http://x/c", "C", "gamma text")]))
    new = pages(spark, [("http://x/a", "A", "alpha text"), ("http://x/b", "B", "beta anew"), ("http://x/c", "C", "gamma text")])
    assert sorted(r.status for r in engine.refresh(new, all_=True).collect()) == ["refreshed", "unchanged", "unchanged"]
    assert engine.store.embeddings().count() == 2 and [r.text.endswith("alpha text") for r in engine.store.pending().collect()] == [True]


def test_the_commands_refresh_embeds_with_a_provider_and_the_tools_only_with_vectors(spark, engine, tmp_path, monkeypatch, capsys):
    engine.add(pages(spark, [("http://x/a", "A", "alpha text")]), embed=False)
    for k, change in enumerate(("first change", "second change")):
        pages(spark, [("http://x/a", "A", change)]).write.parquet(f"{tmp_path}/{k}")
    tools.refresh_doc(engine, spark.read.parquet(f"{tmp_path}/0"), all_=True)
    assert not engine.store.has_embeddings()
    monkeypatch.setattr(cli, "embedding_provider", lambda: Hashing(8))
    cli.main(["--store", engine.store.path, "refresh", "--all", "--pages", f"{tmp_path}/1"], spark)
    assert Engine(spark, engine.store.path).store.has_embeddings() and "refreshed" in capsys.readouterr().out


def test_a_page_reached_twice_is_indexed_once(spark, engine):
    link = lambda *us: "".join(f'<a href="{u}">x</a>' for u in us)
    body = lambda t, x: PAGE.format(t, x)
    rows = spark.createDataFrame([("https://e.com/", "https://e.com/", body("Root", "r" + link("/one", "/two", "/three"))), *((f"https://e.com/{k}", "https://e.com/same", body("Same", "alpha")) for k in ("one", "two", "three"))], "url string, final_url string, html string")
    done = engine.crawl(rows, "https://e.com/")
    assert [(r.kind, r.url.rpartition("/")[2]) for r in done.events.collect()] == [("indexed", ""), ("indexed", "one"), ("unchanged", "two"), ("unchanged", "three")]
    assert tuple(done.summary().first()) == (4, 2, 2, 0, 0) and engine.store.docs().count() == 2


def test_a_live_crawl_fetches_in_order_and_waits_between(spark, engine, monkeypatch):
    link = lambda *us: "".join(f'<a href="{u}">x</a>' for u in us)
    web = {"https://e.com/": "root" + link("a/", "b?x=1"), "https://e.com/a/": "alpha" + link("../c", "/"), "https://e.com/b?x=1": None, "https://e.com/c": "gamma"}
    asked, slept = [], []

    def fetch(url, timeout=30.0):
        asked.append(url)
        body = web[url]
        return {"url": url, "final_url": url, "html": body and PAGE.format(url, body), "error": None if body else "The server answered 404"}

    monkeypatch.setattr("shelf.sources.web.fetch", fetch)
    monkeypatch.setattr("shelf.sources.web.sleep", slept.append)
    done = engine.crawl(None, "https://e.com/", delay=0.1)
    assert asked == ["https://e.com/", "https://e.com/a/", "https://e.com/b?x=1", "https://e.com/c"] and slept == [0.1] * 3
    assert [(r.kind, r.url, r.error) for r in done.events.collect()] == [("indexed", asked[0], None), ("indexed", asked[1], None), ("failed", asked[2], "The server answered 404"), ("indexed", asked[3], None)]
    assert engine.store.docs().count() == 3


def test_a_crawl_parses_the_frontier_only(spark, engine, monkeypatch):
    parsed = []
    plain = engine.articles
    monkeypatch.setattr(engine, "articles", lambda rows: parsed.append(sorted(r.url for r in rows.collect())) or plain(rows))
    rows = pages(spark, [("https://e.com/", "Root", 'r <a href="/a">x</a>'), ("https://e.com/a", "A", "alpha")] + [(f"https://e.com/far{k}", "F", "far") for k in range(9)])
    engine.crawl(rows, "https://e.com/")
    assert parsed == [["https://e.com/"], ["https://e.com/a"]]


def tree(spark, n, **change):
    at = lambda k: f"https://e.com/{k}"
    rows = {k: (at(k), at(k), [at(2 * k + 1), at(2 * k + 2), at(0), "https://other.com/z"], None) for k in range(n)}
    for k, v in change.items():
        rows[int(k[1:])] = v
    return spark.createDataFrame(list(rows.values()), "url string, final_url string, links array<string>, error string")


def kinds(done):
    return [(r.kind, r.url.rpartition("/")[2], r.depth) for r in done.events.collect()]


def test_crawl_goes_breadth_first_within_budgets(spark):
    assert kinds(crawl(spark, tree(spark, 50), "https://e.com/0#x", 2, 50)) == [("indexed", str(k), d) for k, d in ((0, 0), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2))]
    assert len(kinds(crawl(spark, tree(spark, 50), "https://e.com/0", 9, 5))) == 5
    one = crawl(spark, tree(spark, 3), "https://e.com/0", 2, 50)
    assert tuple(one.summary().first()) == (7, 3, 0, 4, 0)
    with pytest.raises(ValueError):
        crawl(spark, tree(spark, 3), "mailto:x")


def test_crawl_skips_without_using_the_budget_and_never_sees_links_of_skipped_pages(spark):
    done = kinds(crawl(spark, tree(spark, 50), "https://e.com/0", 3, 4, exclude="/1$"))
    assert done == [("indexed", "0", 0), ("skipped", "1", 1), ("indexed", "2", 1), ("indexed", "5", 2), ("indexed", "6", 2)]
    assert kinds(crawl(spark, tree(spark, 50), "https://e.com/0", 3, 4, include="nothing")) == [("skipped", "0", 0)]


def test_crawl_widens_origins_by_redirects_in_crawl_order(spark):
    z = "https://other.com/z"
    moved = ("https://e.com/2", "https://other.com/2", [z, "https://e.com/5"], None)
    pages_ = tree(spark, 7, k2=moved).unionByName(spark.createDataFrame([(z, z, [], None)], "url string, final_url string, links array<string>, error string"))
    got = [u for _, u, _ in kinds(crawl(spark, pages_, "https://e.com/0", 2, 50))]
    assert got == ["0", "1", "2", "3", "4", "z", "5"]
    assert "z" in [u for _, u, _ in kinds(crawl(spark, tree(spark, 7), "https://e.com/0", 1, 50, same_origin=False))]
    failed = tree(spark, 7, k1=("https://e.com/1", "https://e.com/1", ["https://e.com/3"], "Nothing to store: the page gave no chunks"))
    assert ("failed", "1", 1) in kinds(crawl(spark, failed, "https://e.com/0", 2, 50)) and "3" not in [u for _, u, _ in kinds(crawl(spark, failed, "https://e.com/0", 2, 50))]


def test_engine_crawls_and_ingests(spark, engine):
    link = lambda *us: "".join(f'<a href="{u}">x</a>' for u in us)
    rows = pages(spark, [("https://e.com/", "Root", "root text" + link("/a", "/b")), ("https://e.com/a", "A", "alpha text" + link("/")), ("https://e.com/b", "B", None)])
    done = engine.crawl(rows, "https://e.com/")
    assert [(r.kind, r.url) for r in done.events.collect()] == [("indexed", "https://e.com/"), ("indexed", "https://e.com/a"), ("failed", "https://e.com/b")]
    assert engine.store.docs().count() == 2
    assert [r.kind for r in engine.crawl(rows, "https://e.com/").events.collect()] == ["unchanged", "unchanged", "failed"]


def test_tools_and_commands(spark, engine, tmp_path, capsys):
    source = pages(spark, [("http://x/a", "A", "alpha text words"), ("http://x/b", "B", "beta text words")])
    source.write.parquet(f"{tmp_path}/pages")
    store = ["--store", engine.store.path]
    assert cli.main([*store, "add", "--pages", f"{tmp_path}/pages", "-c", "k", "--no-embed"], spark) == 0
    cli.main([*store, "search", "words", "-n", "1"], spark)
    cli.main([*store, "collections"], spark)
    cli.main([*store, "list"], spark)
    cli.main([*store, "doctor"], spark)
    cli.main([*store, "refresh", "1", "--pages", f"{tmp_path}/pages"], spark)
    out = capsys.readouterr().out
    assert out.count("inserted #") == 2 and "bm25=-" in out and "k  (2 docs)" in out and "docs: 2" in out and "unchanged #1" in out
    again = Engine(spark, engine.store.path, Hashing(8))
    assert "alpha text words" in tools.get_doc(again, 1) or "beta text words" in tools.get_doc(again, 1)
    assert tools.search_docs(again, "words").count("---") == 1
    assert "needs embeddings" in tools.search_docs(again, "words", "hybrid") and tools.search_docs(again, "zzzz") == "(no matches, mode=fts)"
    for bad in (lambda: tools.get_doc(again, 0), lambda: tools.search_docs(again, ""), lambda: tools.search_docs(again, "x", limit=21)):
        with pytest.raises(ValueError):
            bad()


def test_a_stream_of_pages_is_ingested_once(spark, engine, tmp_path):
    landing = f"{tmp_path}/landing"
    pages(spark, [("http://x/a", "A", "alpha text")]).write.parquet(landing)
    for _ in range(2):
        ingest_stream(spark, engine, landing, f"{tmp_path}/checkpoint").awaitTermination()
    pages(spark, [("http://x/a", "A", "alpha text"), ("http://x/b", "B", "beta text")]).write.mode("append").parquet(landing)
    ingest_stream(spark, engine, landing, f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r.url for r in engine.store.docs().collect()) == ["http://x/a", "http://x/b"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_match_their_sql(spark, sf_dir, name):
    table = queries.QUERIES[name](spark, sf_dir).toArrow()
    assert table.num_rows > 0
    if name not in queries.SQL:
        return
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    db.register("got", table)
    db.sql(f"create table want as {queries.SQL[name]}")
    columns = ", ".join(sorted(table.column_names))
    assert sorted(table.column_names) == sorted(r[0] for r in db.sql("describe want").fetchall())
    for a, b in (("got", "want"), ("want", "got")):
        assert db.sql(f"select {columns} from (select {columns} from {a} except all select {columns} from {b})").fetchall() == []


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert {*queries.QUERIES, *jobs.QUERIES} <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)


def test_without_the_training_data_operators_the_rest_is_registered(monkeypatch):
    """Whether their folder is gone, only its cache is left, or something that they import is missing."""
    for gone in ("shelf.llm", "corpus_pipeline", "tiktoken"):
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n.startswith(("shelf.llm", "corpus_pipeline", "tiktoken"))]:
                m.delitem(sys.modules, name)
            m.delattr("shelf.llm", raising=False)
            m.setitem(sys.modules, gone, None)
            assert set(__spark_entry__.queries()) == {*queries.QUERIES, *jobs.QUERIES} and set(__spark_entry__.oracle_sql()) == {*queries.SQL, *jobs.SQL}


def test_nothing_but_the_entry_imports_the_training_data_operators():
    from pathlib import Path

    for root in (Path(queries.__file__).parent, Path(jobs.__file__).parent):
        for f in root.rglob("*.py"):
            if "llm" not in f.relative_to(root).parts:
                assert not re.search(r"^\s*(from|import) .*\b(llm|corpus_pipeline)\b", f.read_text(), re.M), f


def test_articles_of_pages_have_chunks(spark, engine, sf_dir):
    rows = engine.articles(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert rows.where("error is null and size(chunks) > 0").count() == rows.count() > 0
    assert rows.select(F.explode("chunks").alias("c")).where("c.section_path is null or not startswith(c.text, c.section_path)").count() == 0
