"""The store: Parquet tables under one folder that driver and executors share.

All tables are only ever appended to, each batch in a folder of its own. A row of chunks, postings or vectors belongs to a
document's version; documents have a row for each batch that touched them, of which the latest counts. Replacing a document
writes its new chunks and names the old version as stale; an unchanged one writes nothing but its line. The documents'
batches are merged when there are more than MERGE; compact() merges everything and drops what is stale. The pointer file,
replaced last, names all folders that count and holds the corpus statistics of full-text search. A job that dies before
that leaves the store as it was. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import migrations, schemas
from .functions.text import tokens
from .operators import catalog, fulltext, upsert
from .operators.models import Embedder, embed_chunks
from .operators.neighbours import VectorIndex
from .staging import staged

_TABLES = {
    "docs": f"{schemas.DOCS}, batch long",
    "chunks": schemas.CHUNKS,
    "postings": f"{schemas.POSTINGS}, doc_id long, version long",
    "embeddings": schemas.EMBEDDINGS,
    "stale": "owner long",
}
_FIELDS = {t: [f.split(" ")[0] for f in ddl.split(", ")] for t, ddl in _TABLES.items()}
#: Batches of documents that are read together before they are merged.
MERGE = 16
#: How the store's files are compressed: texts and postings take a third less than by Spark's default.
CODEC = "zstd"


def owner(chunk_id: Column | str = "chunk_id") -> Column:
    """Document and version of a chunk in one number."""
    return F.shiftright(chunk_id, schemas.PLACES.bit_length() - 1)


def _owner_of(doc_id: Column, version: Column) -> Column:
    return doc_id * schemas.VERSIONS + F.pmod(version, F.lit(schemas.VERSIONS))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.meta = self._load()
        while (at := self.meta["schema_version"]) < schemas.SCHEMA_VERSION:
            self._commit(migrations.STEPS[at](self, self.meta))

    # -- folders and the pointer

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _load(self) -> dict:
        at = self._hadoop(f"{self.path}/pointer.json")
        if not self._fs.exists(at):
            return {"schema_version": schemas.SCHEMA_VERSION, "model": None, "dim": None, "batch": 0, "last_id": 0, "n_chunks": 0, "n_tokens": 0, **{t: [] for t in _TABLES}}
        stream = self._fs.open(at)
        try:
            raw = stream.readAllBytes()
        finally:
            stream.close()
        meta = json.loads(bytes(raw).decode())
        if meta["schema_version"] > schemas.SCHEMA_VERSION:
            raise RuntimeError(f"the store has schema {meta['schema_version']}, this version reads {schemas.SCHEMA_VERSION} and earlier ones")
        return meta

    def _commit(self, meta: dict) -> None:
        at, new = self._hadoop(f"{self.path}/pointer.json"), self._hadoop(f"{self.path}/pointer.{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        # Replaces the old pointer in one step.
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(new).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(new), self._fs.makeQualified(at), how)
        self.meta = meta

    def _folder(self, table: str) -> str:
        return f"{self.path}/{table}/{uuid.uuid4().hex}"

    def _table(self, name: str) -> DataFrame:
        folders = self.meta[name]
        if not folders:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(*folders)

    # -- tables as they stand

    def docs(self, keys: DataFrame | None = None) -> DataFrame:
        """Documents; keys: only those of a table's collections and urls. Where the keys are few, which Spark tells by their
        size, they are sent to the documents, which then are filtered where they lie."""
        rows, fields = self._table("docs"), _FIELDS["docs"][:-1]
        if keys is not None:
            rows = rows.join(keys, ["collection", "url"], "left_semi")
        if len(self.meta["docs"]) < 2:
            return rows.select(*fields)
        # Thin rows; a batch holds a document once.
        latest = rows.groupBy("id").agg(F.max_by(F.struct(*fields), "batch").alias("d"))
        return latest.select("d.*")

    def _current(self, rows: DataFrame) -> DataFrame:
        """Without rows of replaced versions, which are few; where none is, there is no join."""
        return rows.join(self._table("stale"), owner() == F.col("owner"), "left_anti") if self.meta["stale"] else rows

    def documents_of(self, collection: str) -> DataFrame:
        return self.docs().where(F.col("collection") == collection).select(F.col("id").alias("doc_id"))

    def chunks(self, collection: str | None = None) -> DataFrame:
        rows = self._current(self._table("chunks"))
        return rows if collection is None else rows.join(self.documents_of(collection), "doc_id", "left_semi")

    def postings(self) -> DataFrame:
        return self._current(self._table("postings"))

    def embeddings(self) -> DataFrame:
        return self._current(self._table("embeddings"))

    def corpus_stats(self) -> DataFrame:
        """One row, from the pointer: n chunks and their mean length in tokens."""
        n = self.meta["n_chunks"]
        return self.spark.createDataFrame([(n, self.meta["n_tokens"] / n if n else None)], "n long, avgdl double")

    # -- writes

    def upsert(self, incoming: DataFrame, index_partitions: int | None = None) -> DataFrame:
        """Inserts, keeps or replaces documents (schemas.UPSERT) by (collection, url); status of each: doc_id, url,
        collection, title, chunk_count, status. Of rows with one key the first in content order counts. An unchanged document
        keeps its title, byline and site.

        incoming is computed once, into the store's staging folder; texts are moved once, and only those of documents that
        are new or changed. Their postings aren't moved: each file of chunks has its own, sorted; index_partitions: in so many
        ranges of tokens over all of them instead, as compact() lays them out.
        """
        key, stage = ["collection", "url"], self._folder("staged")
        rows = incoming.select("url", "title", "byline", "site_name", "collection", "chunks").withColumn("collection", F.coalesce("collection", F.lit(schemas.DEFAULT_COLLECTION))).where(F.col("url").isNotNull())
        rows = rows.withColumn("content_hash", upsert.content_hash(F.col("chunks"))).withColumn("row", F.monotonically_increasing_id())
        rows = rows.withColumn("chunk_count", F.size("chunks").cast("long")).withColumn("tokens", F.aggregate("chunks", F.lit(0).cast("long"), lambda s, c: s + F.size(tokens(c["text"]))))
        # Those without chunks are left out where they are read again, or else they would be cut once more to find them.
        rows = staged(rows, f"{stage}/in", CODEC).where(F.size("chunks") > 0)
        thin = rows.drop("chunks")
        first = Window.partitionBy(*key).orderBy("content_hash", "title", "row")
        keys = staged(thin.select(*key).distinct(), f"{stage}/keys")
        classified = upsert.classify(self.docs(keys), thin.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))
        classified = staged(classified, f"{stage}/classified")
        top = self.meta["last_id"]
        # New ids follow the order of keys: ranges of keys are numbered within partitions, partitions by their counts.
        new = classified.where("status = 'inserted'").select(*key).repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
        new = staged(new, f"{stage}/numbered")
        counts = sorted(map(tuple, new.groupBy("part").agg(F.count(F.lit(1)), F.min("place")).collect()))  # a row for each partition
        starts, total = [], top + 1
        for part, n, least in counts:
            starts.append((part, total - least))
            total += n
        offsets = self.spark.createDataFrame(starts, "part int, offset long")
        ids = new.join(F.broadcast(offsets), "part").select(*key, (F.col("place") + F.col("offset")).alias("new_id"))
        same = F.col("status") == "unchanged"
        out = classified.join(ids, key, "left").select(
            F.coalesce("old_id", "new_id").alias("id"), "url", *(F.when(same, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in ("title", "byline", "site_name")), "collection", "content_hash",
            F.when(F.col("status") == "replaced", F.col("old_version") + 1).otherwise(F.coalesce("old_version", F.lit(0).cast("long"))).alias("version"),
            "chunk_count", "tokens", F.current_timestamp().alias("fetched_at"), F.lit(self.meta["batch"]).cast("long").alias("batch"),
            "status", "row", "old_version", "old_chunks", "old_tokens",
        )
        out = staged(out, f"{stage}/out")
        changed, replaced = out.where("status <> 'unchanged'"), out.where("status = 'replaced'")
        facts = out.agg(
            F.max("id"), F.max("chunk_count"), F.coalesce(F.sum(F.col("id").isNull().cast("long")), F.lit(0)),
            F.coalesce(F.max((F.col("version") >= schemas.VERSIONS) & F.pmod("version", F.lit(schemas.VERSIONS)).isin(0, schemas.VERSIONS - 1)), F.lit(False)),
            *(F.coalesce(F.sum(F.when(F.col("status") != "unchanged", F.col(a) - F.coalesce(b, F.lit(0)))), F.lit(0)) for a, b in (("chunk_count", "old_chunks"), ("tokens", "old_tokens"))),
            F.count(F.when(F.col("status") != "unchanged", 1)), F.count(F.when(F.col("status") == "replaced", 1)),
        ).first()
        last, most, nameless, begins_anew, more_chunks, more_tokens, n_changed, n_replaced = facts
        if nameless:
            raise RuntimeError(f"{nameless} documents came out without an id; nothing is stored")
        if (last or 0) >= schemas.DOCUMENTS or (most or 0) > schemas.PLACES:
            raise ValueError(f"a store holds {schemas.DOCUMENTS - 1} documents of {schemas.PLACES} chunks at most")
        if begins_anew:  # or else the version would be one that is stale already
            self.compact(keep=stage)
        meta = {k: list(v) if isinstance(v, list) else v for k, v in self.meta.items()}

        def append(table: str, new: DataFrame) -> DataFrame:
            at = self._folder(table)
            new.select(*_FIELDS[table]).write.parquet(at, compression=CODEC)
            meta[table].append(at)
            return self.spark.read.schema(_TABLES[table]).parquet(at)

        if n_changed:
            place = _owner_of(F.col("doc_id"), F.col("version")) * schemas.PLACES + F.col("idx")
            pieces = rows.select("row", "chunks").join(changed.select("row", F.col("id").alias("doc_id"), "version"), "row").select("doc_id", "version", F.posexplode("chunks").alias("idx", "c"))
            pieces = pieces.select(place.cast("long").alias("chunk_id"), "doc_id", "version", "idx", F.col("c.text").alias("text"), F.col("c.section_path").alias("section_path"))
            # Each task's are a file, sorted: texts aren't moved again to lay them out by ranges.
            pieces = append("chunks", pieces.sortWithinPartitions("chunk_id").withColumn("dl", F.size(tokens("text"))))
            self._fs.delete(self._hadoop(f"{stage}/in"), True)  # texts are read from the store's own chunks from here on
            of = "doc_id", "version"
            append("postings", fulltext.sorted_postings(pieces, *of, partitions=index_partitions) if index_partitions else fulltext.segment_postings(pieces, *of))
        if n_replaced:
            append("stale", replaced.select(_owner_of(F.col("id"), F.col("old_version")).alias("owner")))
        # Of an unchanged document only its time moves.
        append("docs", out)
        if len(meta["docs"]) > MERGE:
            before, self.meta = self.meta, meta
            merged = self.docs().withColumn("batch", F.lit(meta["batch"]).cast("long"))
            meta["docs"] = []
            self.meta = before
            append("docs", merged)
        self._commit(meta | {"batch": meta["batch"] + 1, "last_id": max(top, last or 0), "n_chunks": meta["n_chunks"] + more_chunks, "n_tokens": meta["n_tokens"] + more_tokens})
        # What is told of the documents lies outside the store, so it can be read whatever becomes of that meanwhile.
        told = staged(out.select(F.col("id").alias("doc_id"), "url", "collection", "title", "chunk_count", "status"))
        self._fs.delete(self._hadoop(stage), True)
        return told

    def init_embeddings(self, dim: int, model: str) -> None:
        if self.meta["dim"] not in (None, dim):
            raise ValueError(f"the store has {self.meta['dim']}-wide vectors of {self.meta['model']}; drop_embeddings() and embed again for {model} ({dim})")
        self._commit(self.meta | {"dim": dim, "model": model})

    def drop_embeddings(self) -> None:
        self._commit(self.meta | {"dim": None, "model": None, "embeddings": []})

    def pending(self, collection: str | None = None, limit: int | None = None) -> DataFrame:
        return catalog.pending(self.chunks(collection), self._table("embeddings"), limit)

    def store_embeddings(self, vectors: DataFrame) -> None:
        if self.meta["dim"] is None:
            raise ValueError("init_embeddings() comes first")
        at = self._folder("embeddings")
        vectors.select("chunk_id", F.col("embedding").cast("array<float>")).write.parquet(at)
        if not self.spark.read.parquet(at).where(F.size("embedding") != self.meta["dim"]).isEmpty():
            raise ValueError(f"vectors must be {self.meta['dim']} wide")
        self._commit(self.meta | {"embeddings": [*self.meta["embeddings"], at]})

    def embed_pending(self, provider: Embedder, collection: str | None = None, ids: Iterable[int] | DataFrame | None = None, rounds: int = 1) -> int:
        """Vectors for all chunks that have none: one anti-join and one pass, however many there are.

        ids: only of these documents. rounds: chunks are dealt by a hash to so many passes, each stored when it ends, so that
        what a failure loses is one of them.
        """
        self.init_embeddings(provider.dim, provider.model)
        done = 0
        for k in range(rounds):
            rows = self.pending(collection)
            if isinstance(ids, DataFrame):
                rows = rows.join(ids.select("doc_id"), "doc_id", "left_semi")
            elif ids is not None:
                rows = rows.where(F.col("doc_id").isin(list(ids)))
            if rounds > 1:
                rows = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(rounds)) == k)
            self.store_embeddings(embed_chunks(rows, provider))
            done += self.spark.read.parquet(self.meta["embeddings"][-1]).count()
        return done

    def index_vectors(self, centres: int | None = None) -> VectorIndex:
        """An exact index of the vectors as they stand; searches use it until vectors come or go."""
        at = self._folder("index")
        index = VectorIndex.build(self.embeddings(), at, centres)
        self._commit(self.meta | {"index": {"path": at, "of": self._vectors_named()}})
        return index

    def vector_index(self) -> VectorIndex | None:
        """The index, if there is one of the vectors as they stand."""
        at = self.meta.get("index")
        return VectorIndex(self.spark, at["path"]) if at and at["of"] == self._vectors_named() else None

    def _vectors_named(self) -> list[str]:
        return [*self.meta["embeddings"], *self.meta["stale"]]

    def compact(self, keep: str | None = None) -> None:
        """Rewrites all tables without what no longer counts, as one folder each, and deletes every folder that the pointer
        doesn't name (but keep). Readers that still hold older tables must begin anew."""
        meta = dict(self.meta)
        order = {"docs": ["id"], "chunks": ["chunk_id"], "postings": ["tok", "chunk_id", "pos"], "embeddings": ["chunk_id"]}
        # The batch before the next one: whatever is appended from here on is later.
        tables = {"docs": self.docs().withColumn("batch", F.lit(meta["batch"] - 1).cast("long")), "chunks": self.chunks(), "postings": self.postings(), "embeddings": self.embeddings()}
        for name, rows in tables.items():
            if meta[name]:
                at = self._folder(name)
                rows.select(*_FIELDS[name]).repartitionByRange(*order[name]).sortWithinPartitions(*order[name]).write.parquet(at, compression=CODEC)
                meta[name] = [at]
        self._commit({k: v for k, v in meta.items() if k != "index"} | {"stale": []})
        named = {self._hadoop(f).toString() for name in _TABLES for f in self.meta[name]} | {self._hadoop(keep).toString() if keep else ""}
        for name in (*_TABLES, "staged", "index"):
            at = self._hadoop(f"{self.path}/{name}")
            for found in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if self._hadoop(f"{self.path}/{name}/{found.getPath().getName()}").toString() not in named:
                    self._fs.delete(found.getPath(), True)

    # -- state

    def has_embeddings(self) -> bool:
        return bool(self.meta["embeddings"]) and not self._table("embeddings").isEmpty()
