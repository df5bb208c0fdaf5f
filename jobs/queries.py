"""The jobs as queries over whole tables, each run twice into one folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf import queries as engine
from shelf.schemas import DEFAULT_COLLECTION
from shelf.staging import folder

from . import article_feed, batch_search

LIMIT = 6


def job1_article_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents taken by the feed; the second run finds nothing new."""
    output = folder(spark)
    for _ in range(2):
        article_feed.run(spark, f"{sf_dir}/documents.parquet", output)
    return article_feed.current(spark, output)


def job2_batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of all documents for every text of benchmark."""
    output = folder(spark)
    for _ in range(2):
        batch_search.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", output, LIMIT)
    return batch_search.read(spark, output).withColumn("fts_score", F.round("fts_score", 6))


_FEED_SQL = f"""
WITH named AS (SELECT coalesce(lang, '{DEFAULT_COLLECTION}') AS collection, 'doc://' || doc_id AS url, text, sha256(text) AS content_hash FROM documents WHERE doc_id IS NOT NULL AND {engine._TRIM('text')} <> ''),
latest AS (SELECT DISTINCT * FROM (SELECT *, max(content_hash) OVER (PARTITION BY collection, url) AS best FROM named) WHERE content_hash = best),
cut AS (SELECT collection, url, content_hash, {engine._chunk_sql('text')} AS cs FROM latest),
each AS (SELECT collection, url, content_hash, CAST(i - 1 AS INTEGER) AS idx, cs[i] AS text FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM cut))
SELECT collection, url, CAST(0 AS BIGINT) AS version, idx, text, CAST(len({engine._TOKENS}) AS INTEGER) AS n_tokens, content_hash FROM each"""

_PARTS = engine._TOKENS.replace("(text)", "(w)")
_SEARCH_SQL = f"""
WITH {engine._CHUNKS},
words AS (SELECT item_id, unnest(list_filter(list_transform(regexp_split_to_array({engine._TRIM('text')}, '{engine._CLASS}+'), lambda w: trim(w, '"' || chr(39) || '`“”‘’')), lambda w: length(w) > 3)) AS w FROM benchmark),
asked AS (SELECT item_id, p, count(*) AS times FROM (SELECT item_id, {_PARTS} AS p FROM words) WHERE len(p) > 0 GROUP BY ALL),
terms AS (SELECT DISTINCT p FROM asked),
k AS (SELECT *, {engine._TOKENS} AS toks FROM chunks),
there AS (SELECT chunk_id, tok, count(*) AS n FROM (SELECT chunk_id, unnest(toks) AS tok FROM k) GROUP BY ALL),
v AS (SELECT DISTINCT tok FROM there),
one AS (SELECT p, chunk_id, sum(n) AS f FROM terms JOIN v ON len(p) = 1 AND starts_with(v.tok, p[1]) JOIN there ON there.tok = v.tok GROUP BY ALL),
more AS (SELECT p, chunk_id, len(list_filter(range(1, len(toks) - len(p) + 2), lambda i: toks[i:i + len(p) - 2] = p[1:len(p) - 1] AND starts_with(toks[i + len(p) - 1], p[len(p)]))) AS f FROM terms, k WHERE len(p) > 1),
f AS (SELECT p, chunk_id, CAST(f AS DOUBLE) AS f FROM one UNION ALL SELECT p, chunk_id, CAST(f AS DOUBLE) FROM more WHERE f > 0),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(toks)) AS avgdl FROM k),
df AS (SELECT p, count(*) AS df FROM f GROUP BY p),
idf AS (SELECT p, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf, avgdl FROM df, st),
w AS (SELECT f.p, k.chunk_id, k.doc_id, k.idx, k.collection, k.text, idf * f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * len(toks) / avgdl)) AS w FROM f JOIN idf ON f.p = idf.p JOIN k ON k.chunk_id = f.chunk_id),
s AS (SELECT item_id, doc_id, idx, collection, text, CAST(sum(CAST(round(w * times * 1e12) AS BIGINT)) AS DOUBLE) / -1e12 AS score FROM w JOIN asked ON asked.p = w.p GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score, doc_id, idx) AS INTEGER) AS rank FROM s)
SELECT item_id, rank, doc_id, idx, round(score, 6) AS fts_score, regexp_replace(substring(text, 1, 260), '{engine._CLASS}+', ' ', 'g') || '…' AS snippet, collection FROM r WHERE rank <= {LIMIT}"""

QUERIES = {f.__name__: f for f in (job1_article_feed, job2_batch_search)}
SQL = {"job1_article_feed": _FEED_SQL, "job2_batch_search": _SEARCH_SQL}
