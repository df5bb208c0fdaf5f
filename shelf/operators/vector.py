"""Exact nearest neighbours by L2 or cosine distance, in double precision on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fulltext import inside


def distance(embedding: Column, query: list[float], metric: str = "l2") -> Column:
    """Distance of a vector column from a query vector; null if their widths differ."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = embedding.cast("array<double>")
    if metric == "l2":
        d = F.sqrt(F.aggregate(F.zip_with(v, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    elif metric == "cosine":
        d = 1 - dot(v, q) / F.sqrt(dot(v, v) * dot(q, q))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return F.when(F.size(embedding) == len(query), d)


def vector_search(embeddings: DataFrame, query: list[float], limit: int, metric: str = "l2", within: DataFrame | None = None) -> DataFrame:
    """chunk_id, vec_distance of the nearest chunks; a filter on chunk_ids, or a store's doc_ids, comes first, so limit rows come back if there are."""
    near = inside(embeddings, within).select("chunk_id", distance(F.col("embedding"), query, metric).alias("vec_distance"))
    return near.where(F.col("vec_distance").isNotNull()).orderBy("vec_distance", "chunk_id").limit(limit)
