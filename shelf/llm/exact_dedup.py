"""Exact deduplication through a log-structured merge index of digests.

Each task fills a memtable (digest -> best row so far and count) and flushes it as a sorted run, together with a Bloom
filter of the run's digests. Compaction goes by levels: FAN runs of a digest bucket at a time are merged in one streaming
pass into a run with a filter of its own, until FAN are left, which the last pass merges into the index. In every pass a
digest that at most one run's filter can hold is passed through, all others are merged, keeping the best row. Digests seen twice or more are
hits; their texts are compared byte by byte. A hit whose texts are all the same is confirmed, and the best row and count are
those of the index; the texts under digests that collide are split by their bytes, so a collision never joins two texts.

Cases: null text counts as empty, empty texts equal each other, rows repeated under one doc_id count one each and share
their doc_id's fate, null doc_ids sort last among ties, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Digests that a memtable holds before it is flushed.
MEMTABLE = 200_000
#: Bits of a run's filter for each digest; a digest sets FILTER_HASHES of them.
FILTER_BITS, FILTER_HASHES = 12, 4
#: Rows to a bucket of digests, about, and the fewest buckets as a power of two: a bucket is one task's work at the last level.
BUCKET_ROWS, LEAST_BITS = 1 << 20, 8
#: Runs that one pass of compaction merges.
FAN = 4

_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("digest", pa.int64()), ("sha", pa.binary())])
_RUN = pa.schema([("run", pa.int64()), ("bucket", pa.int32()), ("digest", pa.int64()), ("is_filter", pa.bool_()), ("best_len", pa.int64()), ("best_id", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
RUN = "run long, bucket int, digest long, is_filter boolean, best_len long, best_id long, n long, bits binary"
_INDEX = pa.schema([("digest", pa.int64()), ("keep_len", pa.int64()), ("keep_id", pa.int64()), ("n", pa.int64())])
_TEXT = pa.schema([("digest", pa.int64()), ("sha", pa.binary()), ("n_chars", pa.int64()), ("doc_id", pa.int64()), ("normal", pa.binary())])


def normalised(text: bytes) -> bytes:
    return text.translate(None, common.ASCII_SPACE)


def digest_of(sha: bytes, digest_bits: int) -> int:
    return (int.from_bytes(sha[:8], "big") >> (64 - digest_bits)) - (1 << (digest_bits - 1))


def _signatures(digest_bits: int):
    def run(it):
        for b in common.each(it):
            shas = [hashlib.sha256(normalised(t)).digest() for t in common.texts(b.column("text"))]
            digests = [digest_of(s, digest_bits) for s in shas]
            chars = pc.fill_null(pc.utf8_length(b.column("text")), 0).cast(pa.int64())
            yield common.batch(_SIGNATURE, b.column("doc_id").cast(pa.int64()), chars, digests, shas)

    return run


def better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, doc_id): more code points, then the smaller doc_id (null last)."""
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    return a if key(a) <= key(b) else b


def _places(digests: np.ndarray, bits: int) -> np.ndarray:
    x = digests.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, FILTER_HASHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def bucket_bits(rows: int) -> int:
    """Buckets of so many rows, as a power of two."""
    return max(LEAST_BITS, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS)))


def _bucket(digests: np.ndarray, bits: int) -> np.ndarray:
    return ((digests.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int32)


def _packed(bits: np.ndarray) -> bytes:
    return len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes()


def _flush(memtable: dict, run: int, bucket_bits: int):
    """The memtable as a sorted run: of each bucket first its filter, then its digests."""
    digests = np.array(sorted(memtable), dtype=np.int64)
    buckets = _bucket(digests, bucket_bits)
    rows: list[tuple] = []
    for k in np.unique(buckets).tolist():
        own = digests[buckets == k]
        size = max(64, FILTER_BITS * len(own))
        bits = np.zeros(size, dtype=bool)
        bits[_places(own, size)] = True
        rows.append((run, k, None, True, None, None, None, _packed(bits)))
        rows += [(run, k, d, False, *memtable[d], None) for d in own.tolist()]
        if len(rows) >= 4096:
            yield common.batch(_RUN, *zip(*rows, strict=True))
            rows = []
    if rows:
        yield common.batch(_RUN, *zip(*rows, strict=True))


def _memtables(bucket_bits: int):
    def run(it):
        memtable: dict = {}
        number = TaskContext.get().partitionId() << 32
        for b in common.each(it):
            for doc, length, digest in zip(b.column("doc_id").to_pylist(), b.column("n_chars").to_pylist(), b.column("digest").to_pylist(), strict=True):
                old = memtable.get(digest)
                if old is None:
                    memtable[digest] = (length, doc, 1)
                else:
                    memtable[digest] = (*better(old[:2], (length, doc)), old[2] + 1)
            if len(memtable) >= MEMTABLE:
                yield from _flush(memtable, number, bucket_bits)
                memtable, number = {}, number + 1
        yield from _flush(memtable, number, bucket_bits)

    return run


class Merge:
    """Merges runs of a bucket; rows come sorted by run group, bucket, filters first, then digest."""

    def __init__(self):
        self.at: tuple[int, int] | None = None
        self.filters: list[np.ndarray] = []
        self.held: tuple | None = None
        self.asked = self.passed = 0

    def several(self, digests: np.ndarray) -> np.ndarray:
        """Whether more than one run's filter can hold each digest."""
        found = sum((f[_places(digests, len(f))].all(1).astype(np.int32) for f in self.filters), np.zeros(len(digests), np.int32))
        self.asked += len(digests)
        self.passed += int((found <= 1).sum())
        return found > 1

    def rows(self, b: pa.RecordBatch):
        """Of a batch: (group and bucket, filters where these are new, merged rows)."""
        groups, buckets, is_filter = (b.column(c).to_numpy(zero_copy_only=False) for c in ("run", "bucket", "is_filter"))
        groups = groups // FAN
        cuts = np.flatnonzero((groups[1:] != groups[:-1]) | (buckets[1:] != buckets[:-1])) + 1
        cuts = [0, *cuts.tolist(), b.num_rows]
        for k, to in zip(cuts, cuts[1:]):
            at = (int(groups[k]), int(buckets[k]))
            if at != self.at:
                if self.held is not None:
                    yield self.at, [self.held]
                    self.held = None
                self.at, self.filters = at, []
            n = int(is_filter[k:to].sum())
            for bits in b.column("bits").slice(k, n).to_pylist():
                self.filters.append(np.unpackbits(np.frombuffer(bits, np.uint8, offset=8), count=int.from_bytes(bits[:8], "little")).astype(bool))
            part = b.slice(k + n, to - k - n)
            out: list[tuple] = []
            if part.num_rows:
                several = self.several(part.column("digest").to_numpy()).tolist()
                for more, digest, length, doc, count in zip(several, *(part.column(c).to_pylist() for c in ("digest", "best_len", "best_id", "n")), strict=True):
                    if self.held is not None and self.held[0] == digest:
                        self.held = (digest, *better(self.held[1:3], (length, doc)), self.held[3] + count)
                        continue
                    if self.held is not None:
                        out.append(self.held)
                        self.held = None
                    if more:
                        self.held = (digest, length, doc, count)
                    else:
                        out.append((digest, length, doc, count))
            yield at, out

    def rest(self):
        if self.held is not None:
            yield self.at, [self.held]


def _merge_level(it):
    """FAN runs at a time to one run with its filter, for which there is room in as many bits as those of its parts have."""
    merge, at, bits = Merge(), None, None

    def filter_row():
        return common.batch(_RUN, [at[0]], [at[1]], [None], [True], [None], [None], [None], [_packed(bits)])

    def level(parts):
        nonlocal at, bits
        for now, rows in parts:
            if now != at:
                if at is not None:
                    yield filter_row()
                at, bits = now, None
            if rows:
                if bits is None:
                    bits = np.zeros(sum(map(len, merge.filters)), dtype=bool)
                bits[_places(np.array([x[0] for x in rows], dtype=np.int64), len(bits))] = True
                yield common.batch(_RUN, [now[0]] * len(rows), [now[1]] * len(rows), *zip(*((d, False, length, doc, n, None) for d, length, doc, n in rows), strict=True))

    for b in common.each(it):
        yield from level(merge.rows(b))
    yield from level(merge.rest())
    if at is not None:
        yield filter_row()


def _compact(it):
    """The last FAN runs to rows of the index."""
    merge = Merge()
    for b in common.each(it):
        if rows := [r for _, some in merge.rows(b) for r in some]:
            yield common.batch(_INDEX, *zip(*rows, strict=True))
    if rows := [r for _, some in merge.rest() for r in some]:
        yield common.batch(_INDEX, *zip(*rows, strict=True))


def signatures(docs: DataFrame, digest_bits: int = 64) -> DataFrame:
    """doc_id, n_chars, digest, sha of each row."""
    rows = common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _signatures(digest_bits), "doc_id long, n_chars long, digest long, sha binary")
    return common.written(rows)


def runs(signed: DataFrame) -> DataFrame:
    """Level 0: sorted runs and their filters, in as many buckets as the rows ask for."""
    return common.map_arrow(signed.select("doc_id", "n_chars", "digest"), _memtables(bucket_bits(signed.count())), RUN)


def _dealt(level: DataFrame) -> DataFrame:
    group = F.floor(F.col("run") / FAN).alias("group")
    return level.repartition(group, F.col("bucket")).sortWithinPartitions(group, "bucket", F.col("is_filter").desc(), "digest")


def compact(level0: DataFrame) -> DataFrame:
    """The merged index: a row for each digest with its best row and count.

    To the driver comes a number for each run, that is for each task or MEMTABLE digests, so that runs can be numbered
    without gaps.
    """
    level = common.written(level0)
    numbers = sorted(r.run for r in level.select("run").distinct().collect())
    n = len(numbers)
    if n > FAN:
        places = level.sparkSession.createDataFrame([(r, k) for k, r in enumerate(numbers)], "run long, place long")
        level = level.join(F.broadcast(places), "run").select(F.col("place").alias("run"), *[c for c in _RUN.names if c != "run"])
    else:
        level = level.withColumn("run", F.lit(0).cast("long"))
    while n > FAN:
        level = common.written(common.map_arrow(_dealt(level), _merge_level, RUN))
        n = -(-n // FAN)
    return common.map_arrow(_dealt(level), _compact, "digest long, keep_len long, keep_id long, n long")


def _normal_texts(digest_bits: int):
    def run(it):
        for b in common.each(it):
            normal = [normalised(t) for t in common.texts(b.column("text"))]
            shas = [hashlib.sha256(x).digest() for x in normal]
            chars = pc.fill_null(pc.utf8_length(b.column("text")), 0).cast(pa.int64())
            yield common.batch(_TEXT, [digest_of(s, digest_bits) for s in shas], shas, chars, b.column("doc_id").cast(pa.int64()), normal)

    return run


def verified_groups(docs: DataFrame, signed: DataFrame, hits: DataFrame, digest_bits: int = 64) -> DataFrame:
    """sha, keep_id, group_size of the hits: those of the index where all texts under a digest are the same byte by byte;
    where digests collide, those of each text among them.

    Equal texts meet in a task's partial aggregate first, so a huge group leaves one row for each task.
    """
    suspects = signed.join(hits.select("digest"), "digest", "left_semi").select("doc_id").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(suspects, rows.doc_id.eqNullSafe(suspects.doc_id), "left_semi")
    whole = common.map_arrow(rows, _normal_texts(digest_bits), "digest long, sha binary, n_chars long, doc_id long, normal binary")
    first = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    kinds = common.written(whole.groupBy("digest", "sha", "normal").agg(first.alias("best"), F.count(F.lit(1)).alias("members")).drop("normal"))
    found = kinds.join(kinds.groupBy("digest").agg(F.count(F.lit(1)).alias("n_kinds")), "digest").join(hits, "digest")
    confirmed = F.col("n_kinds") == 1
    return found.select("sha", F.when(confirmed, F.col("keep_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.when(confirmed, F.col("n")).otherwise(F.col("members")).alias("group_size"))


def exact_groups(docs: DataFrame, digest_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    Texts are equal when they are identical without ASCII white space; the row with the most code points, then the
    smallest doc_id, stays. digest_bits under 64 makes digests collide, for tests.
    """
    signed = signatures(docs, digest_bits)
    index = compact(runs(signed))
    hits = common.written(index.where("n > 1"))
    groups = common.written(verified_groups(docs, signed, hits, digest_bits))
    out = signed.join(groups, "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.documents(spark, sf_dir))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS normal
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY normal ORDER BY n DESC, doc_id) AS keep_id,
       CAST(count(*) OVER (PARTITION BY normal) AS BIGINT) AS group_size,
       first_value(doc_id) OVER (PARTITION BY normal ORDER BY n DESC, doc_id) = doc_id AS kept,
       sha256(normal) AS text_sha256
FROM d
"""
