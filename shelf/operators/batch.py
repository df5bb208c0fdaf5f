"""Full-text search for many queries at once over chunks without postings: each chunk's words are counted where they lie.

A chunk is one row, so nothing of it has to meet: its tokens are counted against all terms of a block of queries, and its scores are
summed for all of that block's queries, a slice of chunks at a time, by numpy within Spark's tasks. What is moved are document
frequencies and each task's best chunks. The scores are those of fulltext.batch_scores(), to the last digit.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from .fulltext import B, K1, LEAST_IDF, PARTS, corpus_stats, query_parts

#: Queries of a block, about: their terms are held by the driver and by each task. Chunks of a slice; tokens that a task remembers the
#: terms of.
BLOCK, SLICE, KNOWN = 1024, 1024, 1 << 20

_BEST = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("fts_score", pa.float64())])


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... n[k] of them, for each k in turn."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Terms:
    """The terms of a block, each as its tokens: how often each stands in each chunk of a slice."""

    def __init__(self, terms: list[str]):
        parts = [t.split(" ") for t in terms]
        self.n = len(terms)
        self.prefixes = {p[0]: k for k, p in enumerate(parts) if len(p) == 1}
        self.lengths = sorted({len(p) for p in self.prefixes})
        self.phrases = [(k, p) for k, p in enumerate(parts) if len(p) > 1]
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, tok: str) -> tuple[int, ...]:
        """The terms that are prefixes of a token."""
        found = self.known.get(tok)
        if found is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            heads = (tok[:n] for n in self.lengths if n <= len(tok))
            found = self.known[tok] = tuple(self.prefixes[h] for h in heads if h in self.prefixes)
        return found

    def _phrase_rows(self, words: list[str], codes: np.ndarray, rows: np.ndarray):
        """Term and the rows that it stands in, once for each time, of each phrase; the last token is a prefix."""
        at, order = {w: k for k, w in enumerate(words)}, np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=len(words)))
        for k, parts in self.phrases:
            whole = [at.get(p) for p in parts[:-1]]
            if None in whole:
                continue
            places, last = order[ends[whole[0]] - np.count_nonzero(codes == whole[0]) : ends[whole[0]]], len(parts) - 1
            places = places[places + last < len(codes)]
            places = places[rows[places + last] == rows[places]]
            for n, code in enumerate(whole[1:], 1):
                places = places[codes[places + n] == code]
            ends_as, which = np.unique(codes[places + last], return_inverse=True)
            yield k, rows[places[np.array([words[c].startswith(parts[-1]) for c in ends_as], bool)[which]]]

    def count(self, toks: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and how often it stands there, by row and term."""
        coded = toks.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        rows = np.repeat(np.arange(len(toks)), pc.list_value_length(toks).fill_null(0).to_numpy())
        found = [self._of(w) for w in words]
        n = np.fromiter(map(len, found), np.int64, len(found))
        terms, starts = np.fromiter((t for f in found for t in f), np.int64, n.sum()), np.cumsum(n) - n
        hit = np.flatnonzero(n[codes]) if len(codes) else codes
        times = n[codes[hit]]
        keys = [np.repeat(rows[hit], times) * self.n + terms[_spread(starts[codes[hit]], times)]]
        if self.phrases and len(codes):
            keys += [r * self.n + k for k, r in self._phrase_rows(words, codes, rows)]
        found, f = np.unique(np.concatenate(keys), return_counts=True)
        return found // self.n, found % self.n, f


def _counting(terms: list[str], keep: list[str]):
    def run(batches):
        of = Terms(terms)
        for b in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            rows, found, f = of.count(b.column("toks"))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=b.num_rows))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (found, f)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *lists], names=[*keep, "terms", "counts"])

    return run


class Block:
    """A block's queries by term, and what its terms weigh; times: how often a query has a term."""

    def __init__(self, asked: list, terms: list[str], idf: dict[str, float], avgdl: float):
        at = {t: k for k, t in enumerate(terms)}
        asked = sorted((at[r.term], r.query_id, r.times) for r in asked)
        self.queries = np.array(sorted({q for _, q, _ in asked}), np.int64)
        self.idf, self.avgdl = np.array([idf.get(t, 0.0) for t in terms]), avgdl
        self.of = np.searchsorted(self.queries, np.array([q for _, q, _ in asked], np.int64))
        self.times = np.array([n for *_, n in asked], np.float64)
        self.n = np.bincount(np.array([t for t, *_ in asked], np.int64), minlength=len(terms))
        self.starts = np.cumsum(self.n) - self.n

    def best(self, ids: np.ndarray, dl: np.ndarray, terms: pa.ListArray, counts: pa.ListArray, limit: int):
        """Place of the query, parts of its score and chunk_id of the best chunks of a slice, ties too."""
        rows, t = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).to_numpy()), terms.flatten().to_numpy()
        f, one = counts.flatten().to_numpy().astype(np.float64), 1.0
        weight = self.idf[t] * f * (K1 + 1) / (f + K1 * ((one - B) + B * dl[rows] / self.avgdl))
        n = self.n[t]
        pair = _spread(self.starts[t], n)
        cells = self.of[pair] * len(ids) + np.repeat(rows, n)
        # Whole numbers below 2 ** 53, so their sums are exact.
        parts = np.floor(np.repeat(weight, n) * self.times[pair] * PARTS + 0.5)
        shape, size = (len(self.queries), len(ids)), len(self.queries) * len(ids)
        scores = np.where(np.bincount(cells, minlength=size) > 0, np.bincount(cells, parts, size), -1.0).reshape(shape)
        k = max(len(ids) - limit, 0)
        least = np.maximum(np.partition(scores, k, axis=1)[:, k], 0.0)
        q, r = np.nonzero(scores >= least[:, None])
        return q, scores[q, r], ids[r]


def _scoring(block: Block, limit: int):
    def run(batches):
        held = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]
        for b in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            found = block.best(b.column("chunk_id").to_numpy(), b.column("dl").to_numpy(), b.column("terms"), b.column("counts"), limit)
            q, score, ids = (np.concatenate(x) for x in zip(held, found, strict=True))
            order = np.lexsort((ids, -score, q))
            q, score, ids = q[order], score[order], ids[order]
            kept = np.arange(len(q)) - np.searchsorted(q, q) < limit
            held = [q[kept], score[kept], ids[kept]]
        q, score, ids = held
        yield pa.record_batch([pa.array(block.queries[q]), pa.array(ids), pa.array(score / -PARTS)], schema=_BEST)

    return run


def _block(every: DataFrame, asked: DataFrame, limit: int, keep: list[str]) -> DataFrame:
    asked = asked.collect()  # of a block of queries
    terms = sorted({r.term for r in asked})
    kinds = {f.name: f.dataType.simpleString() for f in every.schema}
    ddl = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "terms array<int>", "counts array<int>"])
    found = staged(every.select(*keep, "toks").mapInArrow(_counting(terms, keep), ddl))
    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    of = df.crossJoin(F.broadcast(corpus_stats(found))).select("term", F.when(idf <= 0, LEAST_IDF).otherwise(idf).alias("idf"), "avgdl").collect()  # a row for each term
    block = Block(asked, terms, {terms[r.term]: r.idf for r in of}, of[0].avgdl if of else 1.0)
    order = Window.partitionBy("query_id").orderBy("fts_score", "chunk_id")
    scored = found.where(F.size("terms") > 0).select("chunk_id", "dl", "terms", "counts").mapInArrow(_scoring(block, limit), "query_id long, chunk_id long, fts_score double")
    best = staged(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit))
    return best.join(found.drop("dl", "terms", "counts"), "chunk_id")


def search_chunks(chunks: DataFrame, queries: DataFrame, limit: int, *keep: str) -> DataFrame:
    """query_id, rank, chunk_id, fts_score of the best chunks (a fulltext.tokenized() table) for every query (query_id, query) of a
    table, and the columns to keep; ties go to the smaller chunk_id. Queries are taken a block at a time, each over all chunks,
    which are tokenised once."""
    asked = staged(query_parts(queries))
    n = asked.select("query_id").distinct().count()
    blocks = -(-n // BLOCK)
    every = staged(chunks) if blocks > 1 else chunks
    kept = ["chunk_id", "dl", *keep]
    out = [_block(every, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k), limit, kept) for k in range(blocks)]
    if out:
        return reduce(DataFrame.unionByName, out)
    return every.select(F.lit(0).cast("long").alias("query_id"), "chunk_id", F.lit(0.0).alias("fts_score"), F.lit(0).alias("rank"), *keep).limit(0)
