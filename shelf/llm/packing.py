"""Packing of token sequences by sum-of-squares online bin packing.

Each document's ids (with the end id) are cut into whole windows and a rest. A rest goes to the fill level that minimises
the sum over levels of the squared number of open windows, tracked in a level array; a window that becomes full is closed.
Windows are never shared between tasks, so a task's memory is its open windows alone. At the end of a partition open
windows are emptied into one another by cutting pieces; what then is left of it, less than one window, is cut into sequences
whose lengths are powers of two, which need no padding. Where more than OPEN windows are open at once, which bounds a task's
memory, they are emptied into one another earlier: that cuts more documents, and loses no id.

Documents are dealt by a hash of doc_id and text over a given number of partitions and sorted by both, so the packing is
a function of the rows and that number: neither cores, nor files, nor the order in which rows or blocks arrive matter.

Cases: null text counts as empty (the end id alone), rows repeated under one doc_id are packed one by one, an empty table
gives no rows, other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import codec, default_vocabulary

WINDOW = 2048
END_ID = 1
#: Open windows of a task at most: 128 MB of ids.
OPEN = 16_384

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs one partition's documents; closed sequences gather in out as rows of pieces."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0, most_open: int = OPEN):
        self.window, self.next, self.most_open = window, first_sequence, most_open
        #: Open windows by fill level, and how many there are.
        self.bins: dict[int, list[list[tuple]]] = {}
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.window
        for at in range(0, whole, self.window):
            self._close([(doc, at, ids[at : at + self.window], n)])
        if whole < n:
            self._place((doc, whole, ids[whole:], n))

    def level_for(self, size: int) -> int:
        """Level (0: a new window) for a rest of so many ids: least sum of squares after placing, then the fullest."""
        last = self.window - size
        counts = self.levels
        # From level h to h + size: (c[h]-1)^2 - c[h]^2 + (c[h+size]+1)^2 - c[h+size]^2; a full window isn't counted.
        change = np.where(counts[: last + 1] > 0, 1 - 2 * counts[: last + 1], 1 << 40)
        change[0] = 0
        change += 2 * counts[size:] + 1
        change[last] -= 2 * counts[self.window] + 1
        return last - int(np.argmin(change[::-1]))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2])
        level = self.level_for(size)
        window: list[tuple] = []
        if level:
            window = self.bins[level].pop()
            self.levels[level] -= 1
            self.open -= 1
        window.append(piece)
        self._put(window, level + size)
        if self.open > self.most_open:
            self.refill()

    def _put(self, window: list[tuple], level: int) -> None:
        if level == self.window:
            self._close(window)
        else:
            self.bins.setdefault(level, []).append(window)
            self.levels[level] += 1
            self.open += 1

    def _close(self, window: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n in window:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, self.next, offset))
            offset += len(ids)
        self.next += 1

    def refill(self) -> list[tuple]:
        """Empties the least filled windows into the fullest, cutting pieces; one window at most stays open."""
        windows = [w for level in sorted(self.bins, reverse=True) for w in self.bins[level]]
        self.bins, self.open = {}, 0
        self.levels[:] = 0
        pieces = [p for w in windows for p in w]
        now: list[tuple] = []
        room = self.window
        for doc, start, ids, n in pieces:
            while len(ids) >= room:
                now.append((doc, start, ids[:room], n))
                self._close(now)
                start, ids, now, room = start + room, ids[room:], [], self.window
            if len(ids):
                now.append((doc, start, ids, n))
                room -= len(ids)
        if now:
            self._put(now, self.window - room)
        return now

    def finish(self) -> None:
        """Cuts what is left into sequences of lengths that are powers of two."""
        left = self.refill()
        self.bins = {}
        total = sum(len(p[2]) for p in left)
        now: list[tuple] = []
        room = 1 << (total.bit_length() - 1) if total else 0
        for doc, start, ids, n in left:
            while len(ids):
                take = min(room, len(ids))
                now.append((doc, start, ids[:take], n))
                start, ids, room, total = start + take, ids[take:], room - take, total - take
                if not room:
                    self._close(now)
                    now, room = [], 1 << (total.bit_length() - 1) if total else 0

    def taken(self, least: int = 0) -> list[tuple]:
        if len(self.out) <= least:
            return []
        out, self.out = self.out, []
        return out


def _pack(path: str, window: int, end_id: int):
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    def run(it):
        c = codec(path)
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        for b in common.each(it):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = c.encode(text or "")
                ids.append(end_id)
                packer.add(doc, np.array(ids, dtype="<u4"))
            if rows := packer.taken(512):
                yield common.batch(_PIECES, *zip(*rows, strict=True))
        packer.finish()
        if rows := packer.taken():
            yield common.batch(_PIECES, *zip(*rows, strict=True))

    return run


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Pieces of the documents' ids in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    partitions: packed apart from each other; by default the session's shuffle partitions.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    return common.map_arrow(dealt, _pack(path or default_vocabulary(), window, end_id), SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.documents(spark, sf_dir))
