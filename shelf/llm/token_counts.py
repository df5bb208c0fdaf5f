"""Token counts kept as delta-maintained rollups.

Totals of documents, tokens and characters by source, language and tokenizer version are additive. A batch of changes is
signed: an insert adds a document's counts, a delete takes them away, a revision takes the old counts and adds the new.
Each batch is summed per task, shuffled as one row for each key and task, and appended as a delta; totals are sums of
deltas. A batch commits by writing its delta to a folder named by its batch id and only then its marker, so a batch that
is sent again, or that a failed driver left half written, changes nothing or is written anew. A compaction commits by one
file that names its sum and the batches within; these don't count any more from then on, whether their deltas are deleted
yet or not. One writer at a time.

Cases: null text counts as empty (0 tokens, 1 document), null source or language is a key of its own, rows repeated under
one doc_id count each, a batch without rows commits an empty delta, other columns are not read.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import codec, default_vocabulary

INSERT, DELETE = 1, -1
_ID = r"[A-Za-z0-9][A-Za-z0-9-]*"
KEYS = ["source", "lang", "tokenizer"]
_DELTA = "source string, lang string, tokenizer string, documents long, tokens long, chars long"
_ROWS = pa.schema([("source", pa.string()), ("lang", pa.string()), ("tokenizer", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("chars", pa.int64())])


def default_tokenizers() -> dict[str, str]:
    """Versions of tokenizers and their vocabulary files."""
    return {"byte_bpe_50k/1": default_vocabulary()}


def _signed(tokenizers: dict[str, str]):
    """Rows of source, lang, text, sign to their summed counts; the keys of a task are few beside its rows."""

    def run(it):
        sums: dict[tuple, list[int]] = {}
        for b in common.each(it):
            sources, langs, signs = (b.column(k).to_pylist() for k in ("source", "lang", "sign"))
            for source, lang, sign, text in zip(sources, langs, signs, b.column("text").to_pylist(), strict=True):
                for version, path in tokenizers.items():
                    s = sums.setdefault((source, lang, version), [0, 0, 0])
                    text = text or ""
                    s[0] += sign
                    s[1] += sign * len(codec(path).encode(text))
                    s[2] += sign * len(text)
            if len(sums) > 10_000:
                yield common.batch(_ROWS, *zip(*((*k, *v) for k, v in sums.items()), strict=True))
                sums = {}
        if sums:
            yield common.batch(_ROWS, *zip(*((*k, *v) for k, v in sums.items()), strict=True))

    return run


def delta(changes: DataFrame, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """The additive change of totals that signed rows (source, lang, text, sign) make."""
    rows = changes.select(*(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")), F.col("sign").cast("int").alias("sign"))
    counted = common.map_arrow(rows, _signed(tokenizers or default_tokenizers()), _DELTA)
    return counted.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("documents", "tokens", "chars")))


def inserts(docs: DataFrame) -> DataFrame:
    return docs.select("source", "lang", "text", F.lit(INSERT).alias("sign"))


def deletes(docs: DataFrame) -> DataFrame:
    return docs.select("source", "lang", "text", F.lit(DELETE).alias("sign"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """old rows are taken away and new ones added; both in one batch."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, tokenizers: dict[str, str] | None = None):
        self.spark, self.path, self.tokenizers = spark, path, tokenizers or default_tokenizers()
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def committed(self, batch_id: str) -> bool:
        return self.fs.exists(self._at("commits", batch_id))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch once; False if it was there already."""
        if not re.fullmatch(_ID, batch_id):
            raise ValueError(f"batch ids have letters, digits and hyphens: {batch_id!r}")
        if self.committed(batch_id):
            return False
        self._write(batch_id, delta(changes, self.tokenizers))
        return True

    def _write(self, batch_id: str, change: DataFrame) -> None:
        change.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch_id}")
        self.fs.create(self._at("commits", batch_id), True).close()

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def batches(self) -> list[str]:
        return self._names("commits")

    def _manifests(self) -> list[str]:
        return [m for m in self._names("compactions") if not m.startswith("_")]

    def _compacted(self) -> dict:
        """into, batches of the last compaction."""
        found = self._manifests()
        if not found:
            return {"into": None, "batches": []}
        stream = self.fs.open(self._at("compactions", found[-1]))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def compact(self, into: str) -> None:
        """Sums all committed batches into one delta; their markers stay, so none of them counts again."""
        done, last = self.batches(), self._compacted()
        if not re.fullmatch(_ID, into) or into == last["into"]:
            raise ValueError(f"{into!r} is no name for a new sum")
        self._totals(done, last).write.mode("overwrite").parquet(f"{self.path}/sums/{into}")
        self._name({"into": into, "batches": done})
        self._sweep()

    def _name(self, manifest: dict) -> None:
        """Makes a compaction count, in one step."""
        number = f"{len(self._manifests()) + 1:09d}"
        new = self._at("compactions", f"_{number}")
        out = self.fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self.fs.rename(new, self._at("compactions", number)):
            raise RuntimeError(f"compaction {number} is there already: two writers")

    def _sweep(self) -> None:
        """Deletes what the last compaction replaced, and what earlier ones left behind."""
        last = self._compacted()
        for name in self._names("sums"):
            if name != last["into"]:
                self.fs.delete(self._at("sums", name), True)
        for batch in last["batches"]:
            self.fs.delete(self._at("deltas", f"batch={batch}"), True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens, chars over all committed batches."""
        return self._totals(self.batches(), self._compacted())

    def _totals(self, batches: list[str], compacted: dict) -> DataFrame:
        within = set(compacted["batches"])
        paths = [f"{self.path}/deltas/batch={b}" for b in batches if b not in within]
        if compacted["into"]:
            paths.append(f"{self.path}/sums/{compacted['into']}")
        rows = self.spark.read.schema(_DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in ("documents", "tokens", "chars")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits all documents in three batches and returns the totals, which are the table's.

    The first has drafts (half the text) of an eighth of the documents and leaves another eighth out. The second adds those
    left out, revises the drafts and deletes a further eighth, which the third puts back. The second is sent again, too.
    """
    rollup = Rollup(spark, common.shared_folder(spark))
    docs = common.documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    late, final, back = (docs.where(part == k) for k in range(3))
    half = F.expr("substring(text, 1, cast(length(text) / 2 AS int))")
    second = inserts(late).unionByName(revisions(final.withColumn("text", half), final)).unionByName(deletes(back))
    rollup.commit("documents-1", inserts(docs.where(part != 0).withColumn("text", F.when(part == 1, half).otherwise(F.col("text")))))
    rollup.commit("documents-2", second)
    rollup.commit("documents-3", inserts(back))
    rollup.commit("documents-2", second)
    return rollup.totals()
