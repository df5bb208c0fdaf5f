"""Line deduplication over range-partitioned line hashes.

Line hashes are range-partitioned and sorted by (hash, document, position), so that even a line that a third of all
documents hold is spread over several partitions. Each partition streams its rows once; the first document of a hash keeps
its lines. A hash that began in an earlier partition is known from that partition's last hash (a row for each partition
is gathered). What is returned is a compressed keep bitmap for each text of a document that loses lines, not the text.

Cases: null and empty text are one empty line, keys under min_chars code points are never dropped, a line repeated inside
the smallest doc_id stays, rows repeated under one doc_id count as one document (what one of them holds first, all keep),
but each different text among them has positions and a bitmap of its own, null doc_id sorts first, an empty table
gives no rows, other columns are left alone.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 10
#: Hashes dealt to a range partition at most, about.
LINES_PER_PARTITION = 1_000_000

_LINES = pa.schema([("hash", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32())])
_EDGE = pa.schema([("part", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("last_doc", pa.int64())])
_DROPS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])


def line_key(line: bytes) -> bytes:
    return line.strip(common.ASCII_SPACE).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def text_key(docs: DataFrame):
    """Tells apart the texts under one doc_id; null and empty are the same."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def _hashes(min_chars: int):
    def run(it):
        for b in common.each(it):
            hashes, ids, keys, places = [], [], [], []
            for doc, of_text, text in zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), common.texts(b.column("text")), strict=True):
                for pos, line in enumerate(text.split(b"\n")):
                    if long_enough(key := line_key(line), min_chars):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        ids.append(doc)
                        keys.append(of_text)
                        places.append(pos)
            yield common.batch(_LINES, hashes, ids, keys, places)

    return run


def _edges(it):
    first = last = doc = None
    for b in common.each(it):
        hashes = b.column("hash").to_pylist()
        if first is None:
            first = hashes[0]
        if last != hashes[-1]:
            last = hashes[-1]
            doc = b.column("doc_id")[hashes.index(last)].as_py()
    if first is not None:
        yield common.batch(_EDGE, [TaskContext.get().partitionId()], [first], [last], [doc])


def _stream(before: dict[int, tuple[bytes, int | None]]):
    """Rows to drop; before: of each partition the hash that ended the ones before it and the document that keeps it."""

    def run(it):
        held, keeper = before.get(TaskContext.get().partitionId(), (None, None))
        for b in common.each(it):
            ids, keys, places = [], [], []
            for h, doc, of_text, pos in zip(*(b.column(c).to_pylist() for c in ("hash", "doc_id", "text_key", "pos")), strict=True):
                if h != held:
                    held, keeper = h, doc
                elif doc != keeper:
                    ids.append(doc)
                    keys.append(of_text)
                    places.append(pos)
            yield common.batch(_DROPS, ids, keys, places)

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, partitions: int | None = None) -> DataFrame:
    """doc_id, text_key, pos of the lines to drop."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("text_key"), F.col("text").cast("string").alias("text"))
    lines = common.written(common.map_arrow(rows, _hashes(min_chars), "hash binary, doc_id long, text_key long, pos int"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // LINES_PER_PARTITION + 1)
    ordered = lines.repartitionByRange(n, "hash", "doc_id", "pos").sortWithinPartitions("hash", "doc_id", "pos").checkpoint()
    common.short_batches(spark)
    edges = sorted(ordered.mapInArrow(_edges, "part int, first binary, last binary, last_doc long").collect())  # a row for each partition
    before, held = {}, None
    for part, first, last, doc in edges:
        if held:
            before[part] = held
        # A hash that fills whole partitions keeps the document with which it began.
        held = held if held and held[0] == last else (bytes(last), doc)
    return common.map_arrow(ordered, _stream(before), "doc_id long, text_key long, pos int")


def _pack(it):
    """Positions of one text of a document, sorted, as a compressed bitmap of the lines to drop, bit by bit from position 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_dropped", pa.int64()), ("drop_bitmap", pa.binary())])
    for b in common.each(it):
        out = []
        for places in b.column("places").to_pylist():
            bits = np.zeros(max(places) + 1, dtype=bool)
            bits[places] = True
            out.append((int(bits.sum()), zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)))
        yield common.batch(schema, b.column("doc_id"), b.column("text_key"), [x[0] for x in out], [x[1] for x in out])


def bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, partitions: int | None = None) -> DataFrame:
    """doc_id, text_key, n_dropped, drop_bitmap of each text of a document that loses lines; all lines without a set bit stay."""
    drops = dropped_lines(docs, min_chars, partitions)
    places = drops.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("places"))
    return common.written(common.map_arrow(places, _pack, "doc_id long, text_key long, n_dropped long, drop_bitmap binary"))


def keep_bits(n_lines: int, bitmap: bytes | None) -> np.ndarray:
    keep = np.ones(n_lines, dtype=bool)
    if bitmap is not None:
        gone = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little").astype(bool)[:n_lines]
        keep[: len(gone)] &= ~gone
    return keep


def apply_bitmap(text: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """Lines, dropped lines and what stays of a text."""
    lines = text.split(b"\n")
    if bitmap is None:
        return len(lines), 0, text
    keep = keep_bits(len(lines), bitmap)
    return len(lines), int((~keep).sum()), b"\n".join(x for x, stays in zip(lines, keep.tolist(), strict=True) if stays)


def with_bitmaps(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """docs with its own columns in a struct named row, and drop_bitmap. The two sides share no column name."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_doc"), text_key(docs).alias("_text"))
    # Never broadcast: bitmaps grow with the input, and so does what this join shuffles, alike at every size.
    other = maps.select(F.col("doc_id").alias("_with"), F.col("text_key").alias("_of"), "drop_bitmap").hint("merge")
    return rows.join(other, F.col("_doc").eqNullSafe(F.col("_with")) & (F.col("_text") == F.col("_of")), "left").select("row", "drop_bitmap")


def _digests(it):
    for b in common.each(it):
        out = [apply_bitmap(t, m) for t, m in zip(common.texts(b.column("text")), b.column("drop_bitmap").to_pylist(), strict=True)]
        yield common.batch(_DIGEST, b.column("doc_id").cast(pa.int64()), [x[0] for x in out], [x[1] for x in out], [hashlib.sha256(x[2]).hexdigest() for x in out])


def _texts(names: list[str]):
    """Batches of (row, drop_bitmap) to rows with what stays of their texts; columns are told apart by place."""

    def run(it):
        for b in common.each(it):
            columns = b.column(0).flatten()
            at = names.index("text")
            new = [apply_bitmap(t, m)[2].decode() for t, m in zip(common.texts(columns[at]), b.column(1).to_pylist(), strict=True)]
            columns[at] = pa.array(new, columns[at].type)
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([len(x) for x in new], columns[names.index("n_chars")].type)
            yield pa.record_batch(columns, names=names)

    return run


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the dropped lines taken out of text, n_chars following it; all other columns stay."""
    return common.map_arrow(with_bitmaps(docs, bitmaps(docs, min_chars)), _texts(docs.columns), docs.schema)


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS, partitions: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    maps = bitmaps(rows, min_chars, partitions)
    return common.map_arrow(with_bitmaps(rows, maps).select("row.doc_id", "row.text", "drop_bitmap"), _digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(common.documents(spark, sf_dir))


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP4_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key AND length(k.key) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
