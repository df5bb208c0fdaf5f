"""The jobs over growing copies of the given tables, and their command lines."""

from __future__ import annotations

import json
import shutil
import uuid
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import article_feed, batch_search, config
from jobs import queries as jobs
from shelf.operators import fulltext
from shelf.staging import staged

KEYS = ["collection", "url", "version", "idx", "text", "n_tokens", "content_hash"]
ROWS = "doc_id long, text string, lang string"


def land(spark, folder, rows):
    """A file of articles, put into the folder in one step."""
    part = folder.parent / uuid.uuid4().hex
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(str(part))
    folder.mkdir(exist_ok=True)
    shutil.move(next(part.glob("part-*.parquet")), folder / f"{uuid.uuid4().hex}.parquet")


def state(spark, output):
    return sorted((tuple(r) for r in article_feed.current(spark, output).select(*KEYS).collect()), key=str)


def batches(path):
    return sorted(p.name for p in Path(path).iterdir() if p.name.startswith("batch="))


def test_feed_takes_only_what_is_new(spark, tmp_path, sf_dir, caplog):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    land(spark, landing, docs[:120])
    with caplog.at_level("INFO", "shelf.jobs"):
        assert article_feed.run(spark, str(landing), out) == 1
    first = state(spark, out)
    assert {k[1] for k in first} == {f"doc://{d}" for d, t, _ in docs[:120] if t and t.strip()} and {k[2] for k in first} == {0}
    assert "read 120 articles; wrote" in caplog.text
    files = {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")}
    assert article_feed.run(spark, str(landing), out) == 0  # nothing new: nothing read, nothing written
    assert {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")} == files and state(spark, out) == first

    again = [(d, t + " Revised." if d % 3 == 0 else t, lang) for d, t, lang in docs[:40]] + docs[120:]
    land(spark, landing, again)
    caplog.clear()
    with caplog.at_level("INFO", "shelf.jobs"):
        assert article_feed.run(spark, str(landing), out) == 1
    assert f"read {len(again)} articles; wrote {sum(1 for d, t, _ in docs[120:] if t.strip())} new, {sum(1 for d, t, _ in docs[:40] if d % 3 == 0 and t.strip())} changed" in caplog.text
    assert batches(f"{out}/docs") == ["batch=0", "batch=1"] and not set(files) - set(Path(out).rglob("*.parquet"))
    second = state(spark, out)
    assert {k[1]: k[2] for k in second} == {f"doc://{d}": int(d < 40 and d % 3 == 0) for d, t, _ in docs if t.strip()}
    # The same articles in one batch are the same chunks, but for their versions.
    land(spark, tmp_path / "whole", again + docs[40:120])
    article_feed.run(spark, str(tmp_path / "whole"), str(tmp_path / "once"))
    assert [k[:2] + k[3:] for k in state(spark, str(tmp_path / "once"))] == sorted((k[:2] + k[3:] for k in second), key=str)


def test_feed_in_many_batches_and_a_batch_that_runs_again(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    for k in range(3):
        land(spark, landing, [(d, f"Article {d}, {'second' if d == k else 'first'} state.", "en") for d in range(5)])
    assert article_feed.run(spark, str(landing), out, max_files=1) == 3
    want = state(spark, out)
    last = spark.read.schema(ROWS).parquet(str(landing)).where("doc_id = 2").limit(0)
    assert batches(f"{out}/docs") == ["batch=0", "batch=1", "batch=2"] and last.count() == 0
    # A driver that died after writing: the batch is taken again, over what it had written.
    files = sorted(landing.glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    article_feed.take(spark.read.schema(ROWS).parquet(str(files[2])), 2, out)
    assert state(spark, out) == want
    shutil.rmtree(f"{out}/docs/batch=2")  # died between chunks and docs: chunks that no docs name don't count
    assert all(k[2] < 3 for k in state(spark, out))
    article_feed.take(spark.read.schema(ROWS).parquet(str(files[2])), 2, out)
    assert state(spark, out) == want


def test_feed_of_odd_rows(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    long = "A sentence of some length stands here. " * 9_000
    land(spark, landing, [(None, "no id", "en"), (1, None, "en"), (2, " \n ", "en"), (3, "kept", None), (4, "twice", "en"), (4, "twice", "en"), (5, "a", "en"), (5, "b", "en"), (6, long, "de"), (6, "other collection", "a/b c=d")])
    article_feed.run(spark, str(landing), out)
    got = state(spark, out)
    assert {(k[0], k[1]) for k in got} == {("default", "doc://3"), ("en", "doc://4"), ("en", "doc://5"), ("de", "doc://6"), ("a/b c=d", "doc://6")}
    assert len([k for k in got if k[1] == "doc://4"]) == 1 and len([k for k in got if k[1] == "doc://5"]) == 1
    assert " ".join(k[4] for k in sorted((k for k in got if k[0] == "de"), key=lambda k: k[3])) == long.strip()
    land(spark, landing, [(3, "", None), (4, None, "en")])  # blank: what is stored stays
    article_feed.run(spark, str(landing), out)
    assert state(spark, out) == got
    assert article_feed.current(spark, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_registered_jobs_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.sources.partitionOverwriteMode")}
    got = jobs.QUERIES[name](spark, sf_dir)
    want = con.sql(jobs.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(want.select(*columns).fetchall(), key=str)
    assert {k: spark.conf.get(k) for k in before} == before


def test_batch_search_equals_searches_one_by_one(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    texts = ["the-on attion", "thing nicht attion attion", "ab-c the", "no", "", "“erti” und-ei and-th", "Éti ETION ç"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    every = staged(batch_search.chunks(rows))
    posts, stats = staged(fulltext.exploded(every)), fulltext.corpus_stats(every)
    assert [(r.doc_id, r.idx) for r in every.orderBy("chunk_id").collect()] == sorted((r.doc_id, r.idx) for r in every.collect())
    got = {(r.query_id, r.chunk_id): r.fts_score for r in fulltext.batch_scores(posts, stats, queries).collect()}
    want = {(k, r.chunk_id): r.fts_score for k, q in enumerate(texts) for r in fulltext.bm25(posts, stats, q).collect()}
    assert got.keys() == want.keys() and len({k for k, _ in got}) >= 4
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
    best = fulltext.batch_search(posts, stats, queries, 3)
    ranked = sorted((k[0], s, k[1]) for k, s in got.items())
    assert sorted((r.query_id, r["rank"]) for r in best.collect()) == sorted((q, n + 1) for q in {k[0] for k in got} for n in range(min(3, sum(x[0] == q for x in ranked))))
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()


def test_batch_search_of_odd_rows(spark, tmp_path):
    docs = [(None, "lost words", "en"), (1, None, "en"), (2, "", "en"), (3, "hot words here", None), *[(10 + k, "hot words here", "en") for k in range(50)], (3, "hot words here", None), (99, "Hot. " * 20_000, "de")]
    queries = [(None, "words"), (1, None), (2, "words"), (2, "zzzz"), (3, "a b"), (4, "words-here")]
    spark.createDataFrame(docs, ROWS).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(queries, "item_id long, text string").write.parquet(str(tmp_path / "q"))
    for _ in range(2):  # a second run replaces the first's
        n = batch_search.run(spark, str(tmp_path / "d"), str(tmp_path / "q"), str(tmp_path / "o"), 4)
        got = sorted((r.item_id, r["rank"], r.doc_id, r.idx, r.collection) for r in batch_search.read(spark, str(tmp_path / "o")).collect())
        assert n == len(got) == 8
        assert got == [(q, k + 1, d, 0, c) for q in (2, 4) for k, (d, c) in enumerate([(3, "default"), (3, "default"), (10, "en"), (11, "en")])]
    for table, at in ((docs, "e"), (queries, "f")):
        spark.createDataFrame(table, ROWS if at == "e" else "item_id long, text string").limit(0).write.parquet(str(tmp_path / at))
    assert batch_search.run(spark, str(tmp_path / "e"), str(tmp_path / "q"), str(tmp_path / "o"), 4) == 0
    assert batch_search.run(spark, str(tmp_path / "d"), str(tmp_path / "f"), str(tmp_path / "o"), 4) == 0


def test_command_lines(spark, tmp_path, monkeypatch, sf_dir):
    """Values come from the config file unless the command line gives them; only the command line makes and stops a session."""
    stopped = []

    class Builder:
        def appName(self, _):
            return self

        def getOrCreate(self):
            return spark

    monkeypatch.setattr(type(spark), "builder", Builder())
    monkeypatch.setattr(type(spark), "stop", lambda self: stopped.append(1))
    article_feed.main(["--input", f"{sf_dir}/documents.parquet", "--output", str(tmp_path / "a")])
    values = {"documents": f"{sf_dir}/documents.parquet", "queries": f"{sf_dir}/benchmark.parquet", "output": "elsewhere", "limit": 2}
    (tmp_path / "c.json").write_text(json.dumps(values))
    batch_search.main(["--config", str(tmp_path / "c.json"), "--output", str(tmp_path / "b")])
    assert len(stopped) == 2
    assert batch_search.read(spark, str(tmp_path / "b")).agg(F.max("rank")).first()[0] == 2
    assert article_feed.current(spark, str(tmp_path / "a")).count() > 200
    for bad in (["--output", "x"], ["--config", str(tmp_path / "c.json")]):
        with pytest.raises(SystemExit):
            config.settings("", article_feed.CONFIG, bad)
