"""Full-text search: positional postings and BM25 as DataFrame aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_py, query_terms, query_terms_col, tokens
from ..schemas import PLACES, VERSIONS
from ..staging import staged

#: Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Parts of one in which the scores of many queries are summed.
PARTS = 1e12


def tokenized(chunks: DataFrame, *keep: str) -> DataFrame:
    """chunk_id, toks, dl of each chunk, and the columns to keep."""
    return chunks.select("chunk_id", *keep, tokens("text").alias("toks")).withColumn("dl", F.size("toks"))


def postings(chunks: DataFrame, *keep: str) -> DataFrame:
    """tok, chunk_id, pos, dl: a row for each token, in one pass without a shuffle."""
    return exploded(tokenized(chunks, *keep), *keep)


def exploded(rows: DataFrame, *keep: str) -> DataFrame:
    """Postings of a tokenized() table."""
    return rows.select("chunk_id", *keep, "dl", F.posexplode("toks").alias("pos", "tok")).select("tok", "chunk_id", "pos", "dl", *keep)


def sorted_postings(chunks: DataFrame, *keep: str, partitions: int | None = None) -> DataFrame:
    """Postings laid out for the store: ranges of (tok, chunk_id), so that a prefix touches few row groups of few files and a
    token that very many chunks hold is spread over several. chunks: with their texts or, as tokenized(), with their tokens."""
    rows = exploded(chunks, *keep) if "toks" in chunks.columns else postings(chunks, *keep)
    by = ["tok", "chunk_id", "pos"]
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by)


def segment_postings(chunks: DataFrame, *keep: str) -> DataFrame:
    """Postings of chunks (with their dl) as the store appends them: those of each partition of chunks sorted by (tok, chunk_id,
    pos) where they lie, without a shuffle. A prefix touches few pages of every file; a token that very many chunks hold is in as
    many files as they are."""
    rows = chunks.select("chunk_id", *keep, "dl", F.posexplode(tokens("text")).alias("pos", "tok"))
    return rows.select("tok", "chunk_id", "pos", "dl", *keep).sortWithinPartitions("tok", "chunk_id", "pos")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length in tokens (dl, if the table has it; else counted)."""
    rows = chunks if "dl" in chunks.columns else tokenized(chunks)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def _parts(term: str) -> list[str]:
    """Tokens of a term; more than one where it has punctuation inside, which then is a phrase."""
    out, now = [], ""
    for c in fold_py(term):
        if c.isalpha() or c.isnumeric():
            now += c
        elif now:
            out.append(now)
            now = ""
    return out + [now] if now else out


def _terms(query: str) -> list[list[str]]:
    """Terms of a query as their tokens."""
    return [p for p in (_parts(t) for t in query_terms(query)) if p]


def bm25(posts: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """chunk_id, fts_score (negative; the lower the better) of all chunks that match any term of the query.

    A term is a prefix; a term with punctuation inside is a phrase whose last token is a prefix. The prefixes filter the
    scan of the postings; what is shuffled is the matching postings, pre-aggregated, and a row of document frequencies.
    """
    terms = _terms(query)
    if not terms:
        return posts.sparkSession.createDataFrame([], "chunk_id long, fts_score double")
    wanted = reduce(Column.__or__, [F.col("tok").startswith(p[-1]) for p in terms] + [F.col("tok") == x for p in terms for x in p[:-1]])
    found = posts.where(wanted)
    if any(len(p) > 1 for p in terms):  # read for each token of each phrase: once from the postings, then as they were found
        found = staged(found.select("tok", "chunk_id", "pos", "dl"))
    plain = [k for k, p in enumerate(terms) if len(p) == 1]
    counts = [F.sum(F.when(F.col("tok").startswith(terms[k][0]), 1).otherwise(0)).alias(f"f{k}") for k in plain]
    hits = found.groupBy("chunk_id").agg(F.first("dl").alias("dl"), *counts)
    for k in set(range(len(terms))) - set(plain):
        hits = hits.join(_phrase(found, terms[k], f"f{k}"), "chunk_id", "left")
    names = [f"f{k}" for k in range(len(terms))]
    hits = hits.select("chunk_id", "dl", *(F.coalesce(n, F.lit(0)).alias(n) for n in names)).where(reduce(Column.__or__, [F.col(n) > 0 for n in names]))
    df = hits.agg(*(F.sum((F.col(n) > 0).cast("long")).alias(f"d{n}") for n in names))
    return _scored(hits, df, stats, names)


def _scored(hits: DataFrame, df: DataFrame, stats: DataFrame | None, names: list[str], *keep: str) -> DataFrame:
    """stats: where df, the document frequencies, doesn't hold the statistics too."""
    one = F.lit(1.0)
    length = K1 * ((one - B) + B * F.col("dl") / F.col("avgdl"))

    def part(n: str) -> Column:
        idf = F.log((F.col("n") - F.col(f"d{n}") + 0.5) / (F.col(f"d{n}") + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        return idf * F.col(n) * (K1 + 1) / (F.col(n) + length)

    # One row each on the right: sizes that can't grow.
    scored = hits.crossJoin(F.broadcast(df))
    if stats is not None:
        scored = scored.crossJoin(F.broadcast(stats))
    return scored.select("chunk_id", (-reduce(Column.__add__, [part(n) for n in names])).alias("fts_score"), *keep)


def _count(toks: Column, parts: list[str]) -> Column:
    """How often the tokens of a term stand next to each other, the last as a prefix."""
    if len(parts) == 1:
        return F.size(F.filter(toks, lambda t: t.startswith(parts[0])))
    last = len(parts) - 1
    places = F.when(F.size(toks) > last, F.sequence(F.lit(0), F.size(toks) - len(parts))).otherwise(F.array().cast("array<int>"))
    here = lambda i: reduce(Column.__and__, [toks[i + k].startswith(p) if k == last else toks[i + k] == p for k, p in enumerate(parts)])
    return F.size(F.filter(places, here))


def scanned(chunks: DataFrame, query: str, *keep: str) -> DataFrame:
    """chunk_id, the columns to keep, dl and how often each term of the query occurs, of every chunk: a thin table, written
    so that texts without an index are read and tokenised once for all that scan_scores() takes from it."""
    return staged(tokenized(chunks, *keep).select("chunk_id", *keep, "dl", *(_count(F.col("toks"), p).alias(f"f{k}") for k, p in enumerate(_terms(query)))))


def scan_scores(rows: DataFrame, *keep: str) -> DataFrame:
    """bm25() over a scanned() table: statistics, document frequencies and scores; and the columns to keep."""
    names = [c for c in rows.columns if c[0] == "f" and c[1:].isdigit()]
    if not names:
        return rows.select("chunk_id", F.lit(0.0).alias("fts_score"), *keep).limit(0)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(n) > 0).cast("long")).alias(f"d{n}") for n in names))
    hits = rows.where(reduce(Column.__or__, [F.col(n) > 0 for n in names]))
    return _scored(hits, facts, None, names, *keep)


def _phrase(found: DataFrame, parts: list[str], name: str) -> DataFrame:
    """chunk_id and how often the tokens stand next to each other, the last as a prefix."""
    last = len(parts) - 1
    rows = [found.where(F.col("tok").startswith(p) if k == last else F.col("tok") == p).select("chunk_id", (F.col("pos") - k).alias("at")) for k, p in enumerate(parts)]
    joined = reduce(lambda a, b: a.join(b, ["chunk_id", "at"]), rows)
    return joined.groupBy("chunk_id").agg(F.count(F.lit(1)).alias(name))


def fts_search(posts: DataFrame, stats: DataFrame, query: str, limit: int, within: DataFrame | None = None) -> DataFrame:
    """The best chunks by BM25; within: the chunk_ids, or doc_ids of a store, of a collection. Document frequencies stay those
    of all chunks."""
    return best(inside(bm25(posts, stats, query), within), limit)


def best(scored: DataFrame, limit: int) -> DataFrame:
    return scored.orderBy("fts_score", "chunk_id").limit(limit)


def inside(rows: DataFrame, within: DataFrame | None) -> DataFrame:
    """Rows (chunk_id, ...) of the chunk_ids given, or of the documents, whose ids lead a store's chunk_ids."""
    if within is None:
        return rows
    if "chunk_id" in within.columns:
        return rows.join(within.select("chunk_id"), "chunk_id", "left_semi")
    return rows.join(within.select("doc_id"), F.shiftright("chunk_id", (PLACES * VERSIONS).bit_length() - 1) == F.col("doc_id"), "left_semi")


def query_parts(queries: DataFrame) -> DataFrame:
    """query_id, term, times of each query (query_id, query): terms as their tokens, parted by blanks, how often each is there."""
    words = queries.select("query_id", F.explode(query_terms_col("query")).alias("word"))
    terms = words.select("query_id", F.array_join(tokens("word"), " ").alias("term")).where("term <> ''")
    return terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def matched(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """chunk_id, pos, dl, term, k, parts: the postings whose token can stand at place k of a term (term); the last is a prefix.

    Each token meets the terms by equality with its prefixes of the lengths that are asked for, and a term's other tokens as a
    whole, so nothing but a small table of terms is joined and postings stay where they are.
    """
    parts = terms.select("term", F.split("term", " ").alias("p")).select("term", F.size("p").alias("parts"), F.posexplode("p").alias("k", "part"))
    # Tokens hold no blank, so one after it tells that the whole is meant.
    parts = staged(parts.select("term", "parts", "k", F.when(F.col("k") == F.col("parts") - 1, F.col("part")).otherwise(F.concat("part", F.lit(" "))).alias("part")))
    lengths = [r.n for r in parts.where("k = parts - 1").select(F.length("part").alias("n")).distinct().orderBy("n").collect()]  # a row for each length
    forms = [F.when(F.length("tok") >= n, F.substring("tok", 1, n)) for n in lengths]
    if not parts.where("parts > 1").isEmpty():
        forms.append(F.concat("tok", F.lit(" ")))
    rows = posts.select("chunk_id", "pos", "dl", F.explode(F.array(*forms) if forms else F.array().cast("array<string>")).alias("part"))
    return rows.where(F.col("part").isNotNull()).join(parts, "part").drop("part")


def _counts(posts: DataFrame, terms: DataFrame, dealt: bool) -> DataFrame:
    """term, chunk_id, f, dl: how often each term stands in each chunk. Without phrases, all rows of a chunk are in one partition."""
    found = matched(posts, terms)
    found = found if dealt else found.repartition("chunk_id")
    single = found.where("parts = 1").groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("f"), F.max("dl").alias("dl"))
    if terms.where(F.contains("term", F.lit(" "))).isEmpty():
        return single
    places = found.where("parts > 1").groupBy("chunk_id", "term", "parts", (F.col("pos") - F.col("k")).alias("at")).agg(F.count(F.lit(1)).alias("there"), F.max("dl").alias("dl"))
    phrases = places.where("there = parts").groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("f"), F.max("dl").alias("dl"))
    return single.unionByName(phrases)


def batch_scores(posts: DataFrame, stats: DataFrame, queries: DataFrame, dealt: bool = False) -> DataFrame:
    """bm25() of every query (query_id, query) of a table: query_id, chunk_id, fts_score of all chunks that match it.

    All that is known of a chunk is in one partition: there its terms are counted, whichever queries share them, meet the
    queries that ask for them, and are summed, so what is moved is postings that match, twice, and not the many scores.
    dealt: posts are dealt by chunk_id already, and stay. Document frequencies are counted first, and join the queries' terms.
    What is broadcast is one row, or what Spark's own size check allows. Scores are summed as whole numbers of parts of a
    million millionth, so they don't depend on the order of rows.
    """
    asked = staged(query_parts(queries))
    counts = _counts(posts, staged(asked.select("term").distinct()), dealt)
    of = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    of = of.select("term", F.when(idf <= 0, LEAST_IDF).otherwise(idf).alias("idf"), "avgdl")
    asked = staged(asked.join(of, "term"))
    one = F.lit(1.0)
    weight = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * ((one - B) + B * F.col("dl") / F.col("avgdl")))
    scored = counts.join(asked, "term").select("query_id", "chunk_id", F.round(weight * F.col("times") * PARTS).cast("long").alias("w"))
    return scored.groupBy("query_id", "chunk_id").agg((F.sum("w") / -PARTS).alias("fts_score"))


def batch_search(posts: DataFrame, stats: DataFrame, queries: DataFrame, limit: int, within: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """query_id, rank, chunk_id, fts_score: the best chunks of every query; tasks keep limit rows a query before they meet.
    within: as in fts_search(). dealt: as in batch_scores()."""
    order = Window.partitionBy("query_id").orderBy("fts_score", "chunk_id")
    return inside(batch_scores(posts, stats, queries, dealt), within).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
