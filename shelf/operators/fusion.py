"""Reciprocal rank fusion and reranking of result lists. Lists are top-k results, so one partition ranks them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_py, tokens

#: Fixed value: the constant of reciprocal ranks.
RRF_K = 60


def rrf_fuse(fts: DataFrame, vec: DataFrame, limit: int) -> DataFrame:
    """chunk_id, fts_score, vec_distance, fused_score, source: sums of 1 / (60 + rank) over both lists, best first."""
    one = F.lit(1.0)
    a = fts.select("chunk_id", "fts_score", F.lit(None).cast("double").alias("vec_distance"), F.lit("fts").alias("source"), F.row_number().over(Window.orderBy("fts_score", "chunk_id")).alias("rank"))
    b = vec.select("chunk_id", F.lit(None).cast("double").alias("fts_score"), "vec_distance", F.lit("vector").alias("source"), F.row_number().over(Window.orderBy("vec_distance", "chunk_id")).alias("rank"))
    fused = a.unionByName(b).groupBy("chunk_id").agg(
        F.max("fts_score").alias("fts_score"),
        F.max("vec_distance").alias("vec_distance"),
        F.sum(one / (F.lit(RRF_K) + F.col("rank"))).alias("fused_score"),
        F.when(F.count(F.lit(1)) > 1, "hybrid").otherwise(F.max("source")).alias("source"),
    )
    return fused.orderBy(F.desc("fused_score"), "chunk_id").limit(limit)


def overfetch(limit: int, reranked: bool) -> int:
    """Results to fetch before reranking."""
    return max(4 * limit, 20) if reranked else limit


def lexical_score(text: Column | str, query: str) -> Column:
    """Share of the query's tokens that a passage holds: a deterministic stand-in for a cross-encoder."""
    wanted = sorted({t for w in query.split() for t in "".join(c if c.isalnum() else " " for c in fold_py(w)).split()})
    if not wanted:
        return F.lit(0.0)
    return F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, wanted)))) / F.lit(float(len(wanted)))


def rerank(hits: DataFrame, score: Column, limit: int) -> DataFrame:
    """Hits by rerank_score, ties in their order before (prev_rank), cut to limit; a missing score counts as 0."""
    return hits.withColumn("rerank_score", score).orderBy(F.desc(F.coalesce("rerank_score", F.lit(0.0))), "prev_rank").limit(limit)


def model_scores(hits: DataFrame, query: str, reranker_factory: Callable, batch: int = 16) -> DataFrame:
    """Hits with rerank_score by a model: reranker_factory() is called once in a Python worker and returns an object with
    rerank(query, passages); passages go to it in batches."""

    def run(frames):
        model = reranker_factory()
        for pdf in frames:
            scores: list[float] = []
            for k in range(0, len(pdf), batch):
                scores += list(model.rerank(query, pdf["text"].iloc[k : k + batch].tolist()))
            yield pdf.assign(rerank_score=pd.Series(scores, dtype="float64", index=pdf.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema) + ", rerank_score double"
    return hits.mapInPandas(run, schema)
