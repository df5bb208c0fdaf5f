"""Nearest neighbours of many queries at once, and an exact index for single ones; distances are L2, in double precision."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Bytes of a block of vectors, about: what a task holds of either side at once.
BLOCK_BYTES = 4 << 20
#: Vectors that an index' centres are learned from, at most, and rounds; centres, at most. The centres only shape the layout:
#: every vector is indexed, and results are exact wherever they lie.
SAMPLE, ROUNDS, CENTRES = 20_000, 8, 1024

_BLOCK = pa.schema([("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
_NEAR = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("vec_distance", pa.float64())])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _by_width(b: pa.RecordBatch):
    """Identifiers and vectors of a batch, by their width; nulls and vectors with null in them are left out."""
    ids, vectors = b.column(0), b.column(1)
    widths = pc.list_value_length(vectors).fill_null(0).to_numpy()
    known = ~ids.is_null().to_numpy(zero_copy_only=False)
    for width in np.unique(widths[widths > 0]):
        at = np.flatnonzero((widths == width) & known)
        some = vectors.take(pa.array(at))
        matrix = _matrix(some, int(width))
        whole = ~np.isnan(matrix).any(1)
        yield int(width), ids.take(pa.array(at)).to_numpy()[whole], matrix[whole]


def _pack(most: int):
    def run(it):
        held: dict[int, list] = {}
        for b in it:
            for width, ids, matrix in _by_width(b):
                held.setdefault(width, []).append((ids, matrix))
                if sum(m.nbytes for _, m in held[width]) >= most:
                    yield block(width, held.pop(width))
        for width, some in held.items():
            yield block(width, some)

    def block(width: int, some: list) -> pa.RecordBatch:
        ids, vectors = (np.concatenate([x[k] for x in some]) for k in (0, 1))
        return pa.record_batch([pa.array([width], pa.int32()), pa.array([ids.astype(np.int64).tobytes()]), pa.array([vectors.tobytes()])], schema=_BLOCK)

    return run


def blocks(rows: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """width, ids, vectors: the rows (identifier, vector) of each partition in blocks of about so many bytes."""
    return rows.select(F.col(rows.columns[0]).cast("long"), F.col(rows.columns[1]).cast("array<double>")).mapInArrow(_pack(most), "width int, ids binary, vectors binary")


def nearest_of(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, identifier and distance of the k nearest of each query. A matrix product rules out what can't be
    among them, allowing for its rounding; what is left is measured difference by difference."""
    square, own = (vectors**2).sum(1), (queries**2).sum(1)
    rows, found, far = [], [], []
    step = max(1, BLOCK_BYTES // (8 * max(1, len(vectors))))
    for lo in range(0, len(queries), step):
        some = queries[lo : lo + step]
        slack = square[None] + own[lo : lo + step, None]
        about = some @ vectors.T
        about *= -2
        about += slack
        slack *= 1e-10
        slack += 1e-300
        last = min(k, len(vectors)) - 1
        about += slack
        bound = np.partition(about, last, axis=1)[:, last, None]
        about -= slack
        about -= slack
        for i, row in enumerate(about <= bound):
            at = np.flatnonzero(row)
            d = np.sqrt(((vectors[at] - some[i]) ** 2).sum(1))
            best = np.lexsort((ids[at], d))[:k]
            rows.append(np.full(len(best), lo + i))
            found.append(ids[at[best]])
            far.append(d[best])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(far)


def _compare(k: int):
    def run(it):
        for b in it:
            for i in range(b.num_rows):  # a pair of blocks at a time, read where the batch holds it
                width = b.column(0)[i].as_py()
                qids, queries, ids, vectors = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in ((1, np.int64), (2, np.float64), (3, np.int64), (4, np.float64)))
                rows, found, far = nearest_of(queries.reshape(-1, width), ids, vectors.reshape(-1, width), k)
                yield pa.record_batch([pa.array(qids[rows]), pa.array(found), pa.array(far)], schema=_NEAR)

    return run


def nearest(queries: DataFrame, embeddings: DataFrame, k: int, most: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, chunk_id, vec_distance of the k nearest embeddings (chunk_id, embedding) of each query (query_id,
    embedding) of the same width; ties go to the smaller chunk_id.

    Both sides are packed into blocks; every block of queries meets every block of embeddings, as a row each, and keeps k of it
    for each query. What is shuffled after that is k rows for each query and task. Null vectors have and are no neighbours;
    a query_id or chunk_id that is repeated is compared for each of its vectors.
    """
    # Written, so that Spark knows their size: sent to all tasks if they are few, else read again by each task's partition.
    left = staged(blocks(queries.select("query_id", "embedding"), most)).toDF("width", "qids", "queries")
    right = blocks(embeddings.select("chunk_id", "embedding"), most).toDF("_width", "ids", "vectors")
    pairs = right.crossJoin(left).where(F.col("width") == F.col("_width")).select("width", "qids", "queries", "ids", "vectors")
    near = pairs.mapInArrow(_compare(k), "query_id long, chunk_id long, vec_distance double")
    order = Window.partitionBy("query_id").orderBy("vec_distance", "chunk_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "vec_distance")


def centres_of(sample: np.ndarray, n: int) -> np.ndarray:
    """n centres of a sample, at most, by Lloyd's rounds from rows that are far apart."""
    n = min(n, len(sample))
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centres = sample[chosen].copy()
    for _ in range(ROUNDS):
        own = assigned(sample, centres)[0]
        for c in np.unique(own):
            centres[c] = sample[own == c].mean(0)
    return centres


def assigned(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each vector, and how far it is."""
    own = ((vectors**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * vectors @ centres.T).argmin(1)
    return own, np.sqrt(((vectors - centres[own]) ** 2).sum(1))


@dataclass
class Found:
    """hits: chunk_id, vec_distance, nearest first. scanned: vectors that were measured, of all."""

    hits: DataFrame
    scanned: int
    total: int


class VectorIndex:
    """Vectors in folders by their nearest centre, sorted by their distance from it.

    By the triangle inequality a vector is as far from a query as their distances from one centre differ, at least. A search
    reads the nearest centres' folders until it has k vectors; the k-th distance then bounds, for each other folder, which
    ring of distances from its centre can hold a nearer one: folders are pruned as partitions, rings by row group.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.clusters = [(r.cluster, np.array(r.centre), r.n, r.least, r.most) for r in spark.read.parquet(f"{self.path}/clusters").collect()]  # CENTRES rows at most
        self.total = sum(c[2] for c in self.clusters)

    @classmethod
    def build(cls, embeddings: DataFrame, path: str, centres: int | None = None) -> VectorIndex:
        """Indexes all embeddings (chunk_id, embedding of one width) that are not null. centres: by default the root of their
        number, CENTRES at most."""
        spark = embeddings.sparkSession
        rows = embeddings.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("chunk_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null)")
        n, least, most = rows.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if least != most:
            raise ValueError(f"vectors of one width are needed, these have {least} to {most}")
        sample = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("embedding").toArrow()
        width = most or 0
        chosen = centres_of(_matrix(sample.column(0).combine_chunks(), width), min(CENTRES, centres or max(1, round(n**0.5)))) if n else np.empty((0, 0))

        def assign(it):
            for b in it:
                if b.num_rows:
                    own, far = assigned(_matrix(b.column(1), width), chosen)
                    yield pa.record_batch([b.column(0), b.column(1), pa.array(far), pa.array(own.astype(np.int32))], names=["chunk_id", "embedding", "far", "cluster"])

        told = rows.mapInArrow(assign, "chunk_id long, embedding array<double>, far double, cluster int")
        # A centre that very many vectors are near to is spread over several files.
        told.repartitionByRange("cluster", "far", "chunk_id").sortWithinPartitions("cluster", "far", "chunk_id").write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/vectors")
        facts = cls._vectors(spark, path).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("least"), F.max("far").alias("most"))
        named = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(chosen)], "cluster int, centre array<double>")
        facts.join(F.broadcast(named), "cluster").write.mode("overwrite").parquet(f"{path}/clusters")
        return cls(spark, path)

    @staticmethod
    def _vectors(spark: SparkSession, path: str) -> DataFrame:
        schema = "chunk_id long, embedding array<double>, far double, cluster int"
        try:
            return spark.read.schema(schema).parquet(f"{path}/vectors")
        except AnalysisException as e:  # nothing was indexed
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def _near(self, some: list[tuple], query: list[float], k: int) -> tuple[list, int]:
        """The k nearest in rings (cluster, from, to), and how many vectors these hold."""
        from .vector import distance

        rows = self._vectors(self.spark, self.path).where(F.col("cluster").isin([c for c, _, _ in some]))
        ring = F.lit(False)
        for c, lo, hi in some:
            ring = ring | (F.col("cluster") == c) & F.col("far").between(lo, hi)
        inside = rows.where(ring & F.col("far").between(min(lo for _, lo, _ in some), max(hi for _, _, hi in some)))
        near = inside.select("chunk_id", distance(F.col("embedding"), query).alias("vec_distance"))
        order = Window.orderBy("vec_distance", "chunk_id")
        best = near.orderBy("vec_distance", "chunk_id").limit(k).withColumn("place", F.row_number().over(order))
        return [(r.vec_distance, r.chunk_id) for r in best.collect()], inside.count()  # k rows

    def search(self, query: list[float], k: int) -> Found:
        """The k nearest vectors of all, as vector_search() finds them."""
        empty = "chunk_id long, vec_distance double"
        q = np.asarray(query, np.float64)
        if not self.clusters or len(q) != len(self.clusters[0][1]):
            return Found(self.spark.createDataFrame([], empty), 0, self.total)
        away = sorted((float(np.sqrt(((q - centre) ** 2).sum())), cluster, n, least, most) for cluster, centre, n, least, most in self.clusters)
        first, have = [], 0
        while have < k and len(first) < len(away):
            first.append(away[len(first)])
            have += first[-1][2]
        best, scanned = self._near([(c, least, most) for _, c, _, least, most in first], query, k)
        bound = best[-1][0] if len(best) == k else float("inf")
        slack = 1e-9 * (1 + bound if bound < float("inf") else 1)
        more = [(c, max(least, d - bound - slack), min(most, d + bound + slack)) for d, c, _, least, most in away[len(first) :]]
        if more := [x for x in more if x[1] <= x[2]]:
            found, n = self._near(more, query, k)
            best, scanned = sorted(best + found)[:k], scanned + n
        return Found(self.spark.createDataFrame([(i, d) for d, i in best], empty).coalesce(1), scanned, self.total)
