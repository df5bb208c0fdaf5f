from __future__ import annotations

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from shelf.operators import catalog, fulltext, fusion, models, upsert, vector
from shelf.sources import location

HITS = "chunk_id long, fts_score double, vec_distance double"


def fts(spark, rows):
    return spark.createDataFrame([(c, float(s)) for c, s in rows], "chunk_id long, fts_score double")


def vec(spark, rows):
    return spark.createDataFrame([(c, float(s)) for c, s in rows], "chunk_id long, vec_distance double")


def test_fusion_sums_scores_of_both_lists(spark):
    out = fusion.rrf_fuse(fts(spark, [(1, 0)]), vec(spark, [(1, 0.42)]), 10).collect()
    assert len(out) == 1 and math.isclose(out[0].fused_score, 2 / 61) and out[0].source == "hybrid" and out[0].vec_distance == 0.42


def test_fusion_ranks_and_limits(spark):
    out = fusion.rrf_fuse(fts(spark, [(1, 0), (2, 1), (3, 2)]), vec(spark, [(2, 0), (3, 1)]), 10).collect()
    assert [r.chunk_id for r in out] == [2, 3, 1] and out[2].source == "fts"
    assert len(fusion.rrf_fuse(fts(spark, [(k, k) for k in range(5)]), vec(spark, []), 3).collect()) == 3
    assert fusion.rrf_fuse(fts(spark, []), vec(spark, []), 3).collect() == []


def test_rerank_is_stable_and_cuts(spark):
    hits = spark.createDataFrame([(1, "x", 1), (2, "alpha beta", 2), (3, "alpha", 3), (4, "alpha", 4)], "chunk_id long, text string, prev_rank long")
    out = fusion.rerank(hits, fusion.lexical_score("text", "Alpha béta"), 3).collect()
    assert [(r.chunk_id, r.rerank_score) for r in out] == [(2, 1.0), (3, 0.5), (4, 0.5)]
    by_model = fusion.model_scores(hits, "alpha beta", models.LexicalReranker).collect()
    assert {r.chunk_id: r.rerank_score for r in by_model} == {1: 0.0, 2: 1.0, 3: 0.5, 4: 0.5}
    assert fusion.overfetch(6, True) == 24 and fusion.overfetch(2, True) == 20 and fusion.overfetch(6, False) == 6


def test_bm25_equals_an_independent_engine(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(text, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("sqlite without fts5")
    db.executemany("insert into t(rowid, text) values (?, ?)", [tuple(r) for r in docs.collect()])
    stats = fulltext.corpus_stats(docs)
    for query, match in (("attion thing nicht", '"attion"* OR "thing"* OR "nicht"*'), ("the-on élle", '"the-on"* OR "élle"*')):
        truth = dict(db.execute("select rowid, bm25(t) from t where t match ?", (match,)))
        got = {r.chunk_id: r.fts_score for r in fulltext.bm25(fulltext.postings(docs), stats, query).collect()}
        assert got.keys() == truth.keys() and truth
        assert all(math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-12) for k, v in truth.items())


def test_search_filters_a_collection_before_the_limit_but_not_the_statistics(spark):
    chunks = spark.createDataFrame([(k, "alpha word" if k % 2 else "alpha alpha") for k in range(10)] + [(10, "other")], "chunk_id long, text string")
    posts, stats = fulltext.postings(chunks), fulltext.corpus_stats(chunks)
    everything = {r.chunk_id: r.fts_score for r in fulltext.bm25(posts, stats, "alpha").collect()}
    some = fulltext.fts_search(posts, stats, "alpha", 3, chunks.where("chunk_id % 2 = 1")).collect()
    assert [r.chunk_id for r in some] == [1, 3, 5] and all(r.fts_score == everything[r.chunk_id] for r in some)
    assert fulltext.fts_search(posts, stats, "a an of", 3).collect() == []


def test_search_plans_push_prefixes_to_the_scan(spark, tmp_path):
    chunks = spark.createDataFrame([(k, f"alpha{k} beta gamma") for k in range(200)], "chunk_id long, text string")
    fulltext.sorted_postings(chunks, partitions=2).write.parquet(f"{tmp_path}/p")
    posts = spark.read.parquet(f"{tmp_path}/p")
    plan = fulltext.fts_search(posts, fulltext.corpus_stats(chunks), "alpha1 gamm", 5)._jdf.queryExecution().toString()
    assert "StringStartsWith(tok,alpha1)" in plan and "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0]), (4, None), (5, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    assert [(r.chunk_id, r.vec_distance) for r in vector.vector_search(rows, [0.0, 0.0], 9).collect()] == [(1, 0.0), (5, 1.0), (2, 5.0)]
    assert [r.chunk_id for r in vector.vector_search(rows, [0.0, 0.0], 1, within=rows.where("chunk_id > 1")).collect()] == [5]
    cosine = {r.chunk_id: r.d for r in rows.where("chunk_id in (2, 5)").select("chunk_id", vector.distance(F.col("embedding"), [0.0, 2.0], "cosine").alias("d")).collect()}
    assert math.isclose(cosine[5], 0.0, abs_tol=1e-12) and math.isclose(cosine[2], 0.2)
    with pytest.raises(ValueError):
        vector.distance(F.col("embedding"), [1.0], "other")


def test_catalog(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "alpha"), (3, "beta")], "id long, collection string")
    chunks = spark.createDataFrame([(11, 1, 1, "b"), (10, 1, 0, "a"), (30, 3, 0, "c")], "chunk_id long, doc_id long, idx int, text string")
    assert [tuple(r) for r in catalog.list_collections(docs).collect()] == [("alpha", 2), ("beta", 1)]
    assert [(r.id, r.chunk_count) for r in catalog.list_docs(docs, chunks).collect()] == [(1, 2), (2, 0), (3, 1)]
    assert {r.doc_id: r.body for r in catalog.bodies(chunks).collect()} == {1: "a\n\nb", 3: "c"}
    done = spark.createDataFrame([(10,)], "chunk_id long")
    assert [r.chunk_id for r in catalog.pending(chunks, done, 1).collect()] == [11]


def test_content_hash_covers_paths_and_order(spark):
    make = lambda *cs: spark.createDataFrame([([dict(text=t, section_path=p) for t, p in cs],)], "c array<struct<text: string, section_path: string>>").select(upsert.content_hash(F.col("c"))).first()[0]
    a = make(("x", None), ("y", "p"))
    assert a == make(("x", None), ("y", "p")) != make(("y", "p"), ("x", None)) and a != make(("x", "p"), ("y", "p"))


ENV = {"OPENAI_API_KEY": "k"}


def test_provider_choice():
    pick = lambda env, up=False, local=False: models.embedding_provider(env, lambda _: up, lambda: local)
    assert pick({}) is None
    assert (pick(ENV).name, pick(ENV).dim) == ("openai", 1536)
    assert pick(ENV | {"SHELF_EMBED_MODEL": "text-embedding-3-large"}).dim == 3072
    assert pick(ENV | {"SHELF_EMBED_DIM": "99"}).dim == 99
    assert pick({"OLLAMA_HOST": "h"}, up=True).dim == 768
    assert pick({"OLLAMA_HOST": "h"}, up=False, local=True).name == "transformers"
    assert pick({}, local=True).dim == 384
    assert pick({"SHELF_EMBED_PROVIDER": "hashing"}).name == "hashing"
    for env in ({"SHELF_EMBED_PROVIDER": "openai"}, {"SHELF_EMBED_PROVIDER": "ollama"}, {"SHELF_EMBED_PROVIDER": "transformers"}, {"SHELF_EMBED_PROVIDER": "what"}):
        with pytest.raises(RuntimeError):
            pick(env)


def test_openai_answers_are_put_in_order(monkeypatch):
    sent = {}
    monkeypatch.setattr(models, "_call", lambda url, body=None, *a, **k: sent.update(body) or {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})
    assert models.OpenAI("k", "text-embedding-3-small", 1).embed(["a", "b"]) == [[1.0], [2.0]] and sent["dimensions"] == 1
    sent.clear()
    models.OpenAI("k", "text-embedding-ada-002", 1).embed(["a", "b"])
    assert "dimensions" not in sent


def test_batches_and_rerankers():
    class Counting(models.Hashing):
        sizes: list[int] = []  # noqa: RUF012

        def embed(self, texts):
            self.sizes.append(len(texts))
            return super().embed(texts)

    p = Counting(8)
    assert models.embed_in_batches(p, [str(k) for k in range(150)]) == models.Hashing(8).embed([str(k) for k in range(150)])
    assert p.sizes == [64, 64, 22]
    assert models.default_reranker({}) is None
    assert models.default_reranker({"SHELF_RERANK_MODEL": "lexical"}).model == "lexical"
    assert models.default_reranker({"SHELF_RERANK": "true"}) is None or models.transformers_available()


def test_a_folder_that_may_not_be_looked_at_is_no_store(tmp_path, monkeypatch):
    def stat(self, **_):
        raise PermissionError(13, "Permission denied", str(self))

    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.setattr(location.Path, "exists", stat)
    assert location.default_store(tmp_path, {}) == str(tmp_path / "home" / ".shelf" / "store")


def test_location(tmp_path, monkeypatch):
    assert location.default_store("/whatever", {"SHELF_STORE": "/abs/custom"}) == "/abs/custom"
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    plain = tmp_path / "plain"
    plain.mkdir()
    default_store = lambda cwd, env: location.default_store(cwd, env, top=tmp_path)  # noqa: E731  whatever lies above
    assert default_store(plain, {}) == str(tmp_path / "home" / ".shelf" / "store")
    repo, deep = tmp_path / "repo", tmp_path / "repo" / "a" / "b"
    deep.mkdir(parents=True)
    (repo / ".git").mkdir()
    assert default_store(deep, {}) == str(repo / "data" / "shelf")
    (repo / "a" / "data" / "shelf").mkdir(parents=True)
    assert default_store(deep, {}) == str(repo / "a" / "data" / "shelf")
    assert default_store(repo / "a", {}) == str(repo / "a" / "data" / "shelf")


def test_states_of_providers_and_reranker():
    got = models.providers(ENV, lambda _: False, lambda: False)
    assert list(got) == ["openai", "ollama", "transformers", "hashing"] and got["openai"] == got["hashing"] == "ready" and "11434" in got["ollama"]
    assert models.reranker_state({}) == "off" and models.reranker_state({"SHELF_RERANK_MODEL": "lexical"}) == "lexical"


def test_scanning_texts_scores_as_postings_do(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    for query in ("attion thing nicht", "the-on élle attion", "a an"):
        want = {r.chunk_id: r.fts_score for r in fulltext.bm25(fulltext.postings(docs), fulltext.corpus_stats(docs), query).collect()}
        got = {r.chunk_id: r.fts_score for r in fulltext.scan_scores(fulltext.scanned(docs, query)).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


def test_scores_of_a_cross_encoder_are_raw(monkeypatch):
    import sys
    import types

    said = {}

    class Model:
        def predict(self, pairs, batch_size, activation_fn=None):
            said.update(batch=batch_size, activation=type(activation_fn).__name__)
            return [float(len(p)) for _, p in pairs]

    monkeypatch.setitem(sys.modules, "torch", types.SimpleNamespace(nn=types.SimpleNamespace(Identity=type("Identity", (), {}))))
    monkeypatch.setitem(sys.modules, "torch.nn", types.SimpleNamespace(Identity=type("Identity", (), {})))
    monkeypatch.setattr(models, "_cross_encoder", lambda name: Model())
    assert models.CrossEncoderReranker("m").rerank("q", ["a", "bcd"]) == [1.0, 3.0] and said == {"batch": 16, "activation": "Identity"}
    assert models.CrossEncoderReranker("m").rerank("q", []) == []
