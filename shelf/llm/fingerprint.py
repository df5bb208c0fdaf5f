"""Document fingerprints: bottom-k sketches of word shingles.

A fingerprint keeps the k smallest hashes of a text's distinct five-word shingles. Sketches of parts merge into that of
the whole; two sketches estimate resemblance and containment, and one the number of distinct shingles. Up to k shingles
all of these are exact.

Cases: null text counts as empty; a text with fewer than five words is one shingle, one without words has an empty sketch;
two empty sketches resemble each other fully, an empty and another not at all; rows repeated under one doc_id follow each
other in the order of their texts, null doc_ids come last; a lone document is followed by itself; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import WordHashes, shingles, words

K = 128

_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_PART = pa.schema([("key", pa.string()), ("sketch", pa.binary())])


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of a whole, from those of its parts."""
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.empty(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets: the share of the union's k smallest that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.unique(np.concatenate((a, b)))[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1])) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j * (distinct(a, k) + distinct(b, k)) / (1 + j) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8").astype(np.uint64)


class Sketcher:
    def __init__(self, k: int = K):
        self.k, self.hashes = k, WordHashes()

    def __call__(self, text: str) -> np.ndarray:
        return shingles(self.hashes.of(words(text.encode())))[: self.k]


def edited(text: str, following: str) -> str:
    """The last half of text replaced by as many of following's first code points (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _buckets(bounds: np.ndarray, first: dict[int, int]):
    """Bucket of each doc_id (descending; null last), then the bucket before, if the row begins its bucket."""

    def of(ids: pa.Array) -> pa.Array:
        out = []
        for x in ids.to_pylist():
            b = len(bounds) + 1 if x is None else len(bounds) - int(np.searchsorted(bounds, x, side="right"))
            guest = first.get((b, x))
            out.append([b] if guest is None else [b, guest])
        return pa.array(out, pa.list_(pa.int32()))

    return of


def _follow(k: int):
    """Rows sorted by (bucket, guests last, order): each own row, edited by the one that follows it."""

    def run(it):
        sketch = Sketcher(k)
        bucket, held = None, None
        out: list[tuple] = []

        def meet(text: str, own: np.ndarray) -> None:
            doc, before, fp = held
            new = edited(before, text)
            fp_new = fp if new == before else sketch(new)
            out.append((doc, len(before), hashlib.sha256(new.encode()).hexdigest(), to_text(fp), to_text(fp_new), resemblance(fp, fp_new, k), resemblance(fp, own, k)))

        for b in common.each(it):
            for at, guest, doc, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                text = text or ""
                if at != bucket:
                    bucket, held = at, None
                if guest and held is None:
                    continue
                own = sketch(text)
                if held is not None:
                    meet(text, own)
                held = None if guest else (doc, text, own)
            if len(out) >= 128:
                yield common.batch(_OUT, *zip(*out, strict=True))
                out = []
        if out:
            yield common.batch(_OUT, *zip(*out, strict=True))

    return run


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Of each row: its fingerprint, that of its text edited with the following document, and likenesses.

    Texts are dealt once, to buckets of neighbouring doc_ids; each bucket also gets the row that begins the next one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = [i / n for i in range(1, n)]
    bounds = rows.agg(F.percentile_approx("doc_id", share, 20 * n)).first()[0]  # as many numbers as buckets
    bounds = np.unique(np.array(bounds or [], dtype=np.int64))
    bucket = F.arrow_udf(_buckets(bounds, {}), "array<int>")
    begins = sorted(rows.select("doc_id").withColumn("bucket", bucket("doc_id")[0]).groupBy("bucket").agg(F.max("doc_id")).collect())  # one row for each bucket
    first = {(b, doc): begins[i - 1][0] for i, (b, doc) in enumerate(begins)}
    placed = rows.withColumn("to", F.arrow_udf(_buckets(bounds, first), "array<int>")("doc_id"))
    dealt = placed.select(F.posexplode("to").alias("guest", "bucket"), "doc_id", "text").repartition("bucket")
    ordered = dealt.select("bucket", "guest", "doc_id", "text").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return common.map_arrow(ordered, _follow(k), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _partial(k: int):
    def run(it):
        sketch, sums = Sketcher(k), {}
        for b in common.each(it):
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                sums[key] = merge(sums.get(key, np.empty(0, np.uint64)), sketch(text or ""), k=k)
            if len(sums) > 10_000:
                yield common.batch(_PART, list(sums), [x.tobytes() for x in sums.values()])
                sums = {}
        if sums:
            yield common.batch(_PART, list(sums), [x.tobytes() for x in sums.values()])

    return run


def merged_by(docs: DataFrame, column: str, k: int = K) -> DataFrame:
    """A sketch for each value of a column (key, as text), merged first in each task, then over tasks."""

    def whole(it):
        for b in common.each(it):
            sketches = [merge(*(np.frombuffer(x, np.uint64) for x in some), k=k) for some in b.column("sketches").to_pylist()]
            yield common.batch(pa.schema([("key", pa.string()), ("fingerprint", pa.string()), ("n_distinct", pa.float64())]), b.column("key"), [to_text(x) for x in sketches], [distinct(x, k) for x in sketches])

    rows = docs.select(docs[f"`{column}`"].cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    parts = common.map_arrow(rows, _partial(k), "key string, sketch binary")
    return common.map_arrow(parts.groupBy("key").agg(F.collect_list("sketch").alias("sketches")), whole, "key string, fingerprint string, n_distinct double")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.documents(spark, sf_dir))
