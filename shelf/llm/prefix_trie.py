"""Prefix trie of conversations: nodes by polynomial rolling fingerprints of turn prefixes, verified, and rolled up.

1. A turn is known by 60 bits of the MD5 of its role and text. That these tell all turns apart is verified on the turns'
   own bytes, each against its digest's representative; turns that share a digest get a number beside it.
2. Turns are put in order by ranges of (conversation, turn, digest), so that a conversation of any length lies in as many
   partitions as it fills; a turn's place follows from its place in its partition and the sizes of its conversation's runs
   before. First turns of a conversation's family head are put before its own.
3. Conversations are cut into blocks of depths; numpy scans sum digest * base ** depth over a block modulo two primes, and
   the sums of a conversation's earlier blocks are added: the fingerprint of the prefix of each depth.
4. Rows of one depth and fingerprint are a group. Turn by turn, so depth by depth, each member must have the turn and the
   parent of the group's representative, its smallest conversation; members that don't, after a collision, get fingerprints
   of their own from there on, and all groups are verified again.
5. Leaves and saved words of a subtree: a node's weight belongs to its representative's path, so a conversation's weights
   are summed from its end up to each depth, and these sums over the members of each node. No loop over depths.
6. Members that end at a node are packed into blobs of sorted identifiers before they meet, and hashed as a stream.

Cases: null role or text is empty; null turns come first; turns of one number are ordered by the digest of role and text;
repeated rows are turns of their own; rows without conv_id belong to no conversation and are left out; an empty table gives
no rows; other columns are not read. Remainders of negative conv_ids are those of SQL, negative.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .shingles import mixed

#: Conversations of a family share the first turns of its first; so many of them, at most, are taken over.
FAMILY, HEADS = 20, 4
#: Depths in a block: what one task scans or sums of a conversation at once.
BLOCK = 4096
#: Primes below 2 ** 31 and the bases of the two sums.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003_921, 1_618_033_989)
#: Identifiers in a blob of ends.
BLOB = 4096
EMPTY = hashlib.sha256(b"").hexdigest()

_SCANNED = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("d", pa.int64()), ("turn_id", pa.int64()), ("variant", pa.int32()), ("words", pa.int64()), ("len", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64())])
_ROWS = "conv_id long, block long, d long, turn_id long, variant int, words long, len long"
_BLOBS = pa.schema([("d", pa.int64()), ("fp", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("ids", pa.binary())])
_ENDS = pa.schema([("d", pa.int64()), ("fp", pa.int64()), ("ends_sha256", pa.string())])


def digest(role: Column, text: Column) -> Column:
    """60 bits of the MD5 of a turn, as a number that orders as its hexadecimal digits do."""
    spelt = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.conv(F.substring(F.md5(spelt.cast("binary")), 1, 15), 16, 10).cast("long")


def turns_of(conversations: DataFrame, turn_digest=digest) -> DataFrame:
    """conv_id, turn, turn_id, variant, words of each turn; (turn_id, variant) is one role and text, byte by byte."""
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    rows = rows.withColumn("turn_id", turn_digest(F.col("role"), F.col("text")))
    spellings = rows.groupBy("turn_id", "role", "text").agg(F.count(F.lit(1)).alias("n")).drop("n")  # tasks merge copies first
    shared = common.written(spellings.groupBy("turn_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("turn_id"))
    if shared.isEmpty():
        rows = rows.withColumn("variant", F.lit(0))
    else:
        number = F.row_number().over(Window.partitionBy("turn_id").orderBy("role", "text")) - 1
        variants = spellings.join(shared, "turn_id", "left_semi").withColumn("variant", number)
        rows = rows.join(variants, ["turn_id", "role", "text"], "left").withColumn("variant", F.coalesce("variant", F.lit(0)))
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    return rows.select("conv_id", "turn", "turn_id", "variant", words.alias("words"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, block, d, turn_id, variant, words, len), and conv_id, len of all of them."""
    by = ["conv_id", F.asc_nulls_first("turn"), "turn_id", "variant"]
    ordered = turns.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "turn_id", "variant", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"))
    ordered = common.written(ordered)
    # A run: what a partition holds of a conversation. Thin rows; a conversation has as many as it has partitions.
    runs = ordered.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    of = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(of), F.lit(0).cast("long"))).withColumn("own", F.sum("n").over(Window.partitionBy("conv_id")))
    runs = common.written(runs)
    own = runs.where("before = 0").select("conv_id", "own")
    head = F.col("conv_id") - F.col("conv_id") % FAMILY
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    heads = own.select(F.col("conv_id").alias("head"), F.col("own").alias("there"))
    convs = own.select("conv_id", "own", head.alias("head"), taken.alias("h")).join(heads, "head", "left")
    convs = convs.withColumn("hb", F.least("h", F.coalesce("there", F.lit(0).cast("long")))).withColumn("len", F.col("hb") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long")))
    convs = common.written(convs.select("conv_id", "head", "h", "hb", "len"))

    def placed(some: DataFrame, of_runs: DataFrame) -> DataFrame:
        """Rows with their place i in their conversation; conversations that fill many partitions join in as many."""
        return some.join(of_runs, ["part", "conv_id"]).withColumn("i", F.col("pos") - F.col("first") + F.col("before") + 1)

    # The larger side of either join is dealt by (part, conv_id), so no conversation is one task's.
    mine = placed(ordered, runs.join(convs, "conv_id").drop("n", "own")).where("i > h").withColumn("d", F.col("i") - F.col("h") + F.col("hb"))
    first = (F.col("conv_id") % FAMILY == 0) & (F.col("before") < HEADS)
    firsts = placed(ordered.where(F.col("conv_id") % FAMILY == 0), runs.where(first).drop("n", "own")).where(F.col("i") < HEADS).select(F.col("conv_id").alias("head"), F.col("i").alias("d"), "turn_id", "variant", "words")
    theirs = convs.where("hb > 0").join(firsts, "head").where("d <= hb")
    block = F.floor((F.col("d") - 1) / BLOCK).cast("long").alias("block")
    columns = ["conv_id", block, "d", "turn_id", "variant", "words", "len"]
    return mine.select(*columns).unionByName(theirs.select(*columns)), convs.select("conv_id", "len")


class Powers:
    """base ** d modulo a prime, for arrays of depths below 2 ** 40, from tables of 1,024 powers."""

    def __init__(self, base: int, prime: int):
        self.prime = np.uint64(prime)
        self.tables = []
        for _ in range(4):
            table = [1]
            for _ in range(1023):
                table.append(table[-1] * base % prime)
            self.tables.append(np.array(table, np.uint64))
            base = table[-1] * base % prime

    def __call__(self, d: np.ndarray) -> np.ndarray:
        out = self.tables[0][d & 1023]
        for k, table in enumerate(self.tables[1:], 1):
            digits = d >> (10 * k) & 1023
            if digits.any():
                out = out * table[digits] % self.prime
        return out


def _scan(primes: tuple[int, int]):
    """Adds to rows sorted by (conv_id, block, d) the sums of their block up to each row (s) and before it (x)."""

    def run(it):
        powers = [Powers(b % p, p) for b, p in zip(BASES, primes, strict=True)]
        last, held = None, [np.uint64(0)] * 2
        for b in common.each(it):
            conv, block, d, turn, variant = (b.column(n).to_numpy() for n in ("conv_id", "block", "d", "turn_id", "variant"))
            new = np.ones(len(d), bool)
            new[1:] = (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])
            new[0] = last != (conv[0], block[0])
            begins = np.maximum.accumulate(np.where(new, np.arange(len(d)), -1))  # -1: the run that the last batch left open
            code = mixed(turn.astype(np.uint64) * np.uint64(2) + np.uint64(1) + variant.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            sums = []
            for k, p in enumerate(np.uint64(x) for x in primes):
                term = code % p * powers[k](d) % p
                code = mixed(code)
                total = np.cumsum(term)
                base = np.where(begins > 0, total[np.maximum(begins, 1) - 1], 0)
                s = np.where(begins >= 0, total - base, total + held[k]) % p
                held[k] = s[-1]
                sums += [s, (s + p - term) % p]
            last = (conv[-1], block[-1])
            yield common.batch(_SCANNED, *(b.column(n) for n in _SCANNED.names[:7]), *(sums[k].astype(np.int64) for k in (0, 2, 1, 3)))

    return run


def fingerprinted(rows: DataFrame, primes: tuple[int, int] = PRIMES, block: int = BLOCK) -> DataFrame:
    """rebuilt() rows with fp, the fingerprint of the prefix that a row ends, and prev, of the prefix before it (0: none)."""
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "d")
    with common.batches_of(rows.sparkSession, 20_000):
        got = common.written(common.map_arrow(dealt, _scan(primes), f"{_ROWS}, s1 long, s2 long, x1 long, x2 long"))
    # Of conversations of several blocks the last row of each; tables a block shorter than the turns.
    long = F.col("len") > block
    ends = got.where(long & ((F.col("d") % block == 0) | (F.col("d") == F.col("len")))).select("conv_id", "block", "s1", "s2")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carries = ends.select("conv_id", "block", *(F.coalesce(F.sum(f"s{k}").over(before), F.lit(0).cast("long")).alias(f"c{k}") for k in (1, 2)))
    zero = F.lit(0).cast("long")
    both = got.where(~long).withColumn("c1", zero).withColumn("c2", zero).unionByName(got.where(long).join(carries, ["conv_id", "block"]))
    of = lambda k: [(F.col(f"c{n}") + F.col(f"{k}{n}")) % p for n, p in enumerate(primes, 1)]
    packed = lambda a, b: a * (1 << 31) + b + 1  # noqa: E731  never 0, which is the root's
    return both.select(*_SCANNED.names[:7], packed(*of("s")).alias("fp"), F.when(F.col("d") == 1, zero).otherwise(packed(*of("x"))).alias("prev"))


def _groups(rows: DataFrame) -> DataFrame:
    """Groups with their representative; alike: all members have its turn and its parent."""
    same = ["turn_id", "variant", "prev"]
    facts = [f(c).alias(f"{n}_{c}") for c in same for n, f in (("least", F.min), ("most", F.max))]
    out = rows.groupBy("d", "fp").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), *facts)
    alike = F.lit(True)
    for c in same:
        alike = alike & (F.col(f"least_{c}") == F.col(f"most_{c}"))
    return out.select("d", "fp", "conv_id", "n_convs", "words", F.col("least_prev").alias("prev"), alike.alias("alike"))


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of fingerprinted() rows, and the rows, whose fingerprints then tell prefixes apart without fail."""
    rows = common.written(rows)
    while True:
        groups = common.written(_groups(rows))
        bad = groups.where("not alike").select("d", "fp", F.col("conv_id").alias("rep"))
        if bad.isEmpty():
            return groups.drop("alike"), rows
        # Members of colliding groups that differ from the representative: from that depth on they are told apart by what
        # they have there.
        of = rows.join(bad, ["d", "fp"])
        reps = of.where("conv_id = rep").select("d", "fp", *(F.col(c).alias(f"rep_{c}") for c in ("turn_id", "variant", "prev")))
        odd = of.join(reps, ["d", "fp"]).where("turn_id <> rep_turn_id or variant <> rep_variant or prev <> rep_prev")
        splits = odd.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("d", F.xxhash64("d", "turn_id", "variant", "prev").alias("mark")))).alias("splits"))
        marked = rows.join(splits, "conv_id", "left")

        def told(fp: Column, depth: Column) -> Column:
            own = F.filter("splits", lambda s: s["d"] <= depth)
            return F.when(F.col("splits").isNull() | (F.size(own) == 0), fp).otherwise(F.xxhash64(fp, F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["d"], s["mark"])), " ")))

        rows = common.written(marked.select(*_SCANNED.names[:7], told(F.col("fp"), F.col("d")).alias("fp"), told(F.col("prev"), F.col("d") - 1).alias("prev")))


def _pack(it):
    """Identifiers of rows sorted by (d, fp, conv_id), as text, up to BLOB in a row."""
    part, key, ids, seq, out = TaskContext.get().partitionId(), None, [], 0, []

    def close():
        nonlocal ids, seq
        out.append((*key, part, seq, zlib.compress(b",".join(ids), 1)))
        ids, seq = [], seq + 1

    for b in common.each(it):
        for d, fp, conv in zip(*(b.column(n).to_pylist() for n in ("d", "fp", "conv_id")), strict=True):
            if key != (d, fp):
                if ids:
                    close()
                key, seq = (d, fp), 0
            ids.append(b"%d" % conv)
            if len(ids) == BLOB:
                close()
        if out:
            yield common.batch(_BLOBS, *zip(*out, strict=True))
            out.clear()
    if ids:
        close()
        yield common.batch(_BLOBS, *zip(*out, strict=True))


def _hash(it):
    """Blobs sorted by (d, fp, part, seq) to the hash of each node's identifiers."""
    key, sha = None, None
    for b in common.each(it):
        out = []
        for d, fp, ids in zip(*(b.column(n).to_pylist() for n in ("d", "fp", "ids")), strict=True):
            if key != (d, fp):
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (d, fp), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(zlib.decompress(ids))
        if out:
            yield common.batch(_ENDS, *zip(*out, strict=True))
    if key is not None:
        yield common.batch(_ENDS, *zip((*key, sha.hexdigest()), strict=True))


def ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """d, fp, ends_sha256 of nodes at which conversations end. A node that a third of all end at meets as blobs."""
    here = rows.where("d = len").select("d", "fp", "conv_id").unionByName(convs.where("len = 0").select(F.col("len").alias("d"), F.lit(0).cast("long").alias("fp"), "conv_id"))
    sorted_ = here.repartitionByRange("conv_id").sortWithinPartitions("d", "fp", "conv_id")
    blobs = common.map_arrow(sorted_, _pack, "d long, fp long, part int, seq int, ids binary")
    return common.map_arrow(blobs.repartition("d", "fp").sortWithinPartitions("d", "fp", "part", "seq"), _hash, "d long, fp long, ends_sha256 string")


def rollup(nodes: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """d, fp, n_leaves, saved_tokens of each node's subtree. nodes: with n_children."""
    at = F.floor((F.col("d") - 1) / block).cast("long").alias("block")
    own = nodes.select("conv_id", at, "d", F.lit(None).cast("long").alias("fp"), F.lit(0).cast("long").alias("len"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")).where("leaf > 0 or saved > 0")
    zero = F.lit(0).cast("long")
    every = rows.select("conv_id", "block", "d", "fp", "len", zero.alias("leaf"), zero.alias("saved")).unionByName(own)
    below = Window.partitionBy("conv_id", "block").orderBy(F.desc("d")).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # a block at most
    local = every.select("conv_id", "block", "d", "fp", "len", *(F.sum(c).over(below).alias(c) for c in ("leaf", "saved"))).where("fp is not null")
    # Of conversations of several blocks, what their later blocks hold.
    blocks = rows.where(F.col("len") > block).groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    sums = blocks.join(own.groupBy("conv_id", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")), ["conv_id", "block"], "left")
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = sums.select("conv_id", "block", *(F.coalesce(F.sum(c).over(after), zero).alias(f"later_{c}") for c in ("leaf", "saved")))
    long = local.where(F.col("len") > block).join(later, ["conv_id", "block"]).select("d", "fp", (F.col("leaf") + F.col("later_leaf")).alias("leaf"), (F.col("saved") + F.col("later_saved")).alias("saved"))
    return local.where(F.col("len") <= block).select("d", "fp", "leaf", "saved").unionByName(long).groupBy("d", "fp").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def trie(conversations: DataFrame, turn_digest=digest, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    rows, convs = rebuilt(turns_of(conversations, turn_digest))
    groups, rows = verified(fingerprinted(rows, primes))
    children = groups.groupBy((F.col("d") - 1).alias("d"), F.col("prev").alias("fp")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = common.written(groups.join(children, ["d", "fp"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    below = nodes.agg(F.sum((F.col("d") == 1).cast("long")).alias("n_children"), F.sum((F.col("n_children") == 0).cast("long")).alias("n_leaves"), F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    root = top.crossJoin(below).select(  # one row each
        "conv_id", zero.alias("d"), zero.alias("fp"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"),
    )
    known = nodes.join(rollup(nodes, rows), ["d", "fp"]).drop("words")
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("fp").alias("prev"), F.col("conv_id").alias("parent_conv_id"))
    deep = known.where("d > 1").join(parents, ["d", "prev"])
    # All first turns have one parent: no join.
    flat = known.where("d = 1").crossJoin(F.broadcast(top.select(F.col("conv_id").alias("parent_conv_id"))))
    columns = ["conv_id", "d", "fp", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = root.select(*columns).unionByName(flat.select(*columns)).unionByName(deep.select(*columns))
    return every.join(ends(rows, convs), ["d", "fp"], "left").select("conv_id", F.col("d").alias("depth"), *columns[3:], F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(common.table(spark, sf_dir, "conversations"))


_DIGEST = "md5(CAST(length(role) AS VARCHAR) || ':' || role || text)"
_POLY = 0xEDB88320
OP12_SQL = f"""
WITH RECURSIVE o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_DIGEST}) AS i FROM o),
bits AS (SELECT DISTINCT conv_id, 0 AS pos, CAST(4294967295 AS BIGINT) AS c FROM o UNION ALL
  SELECT conv_id, pos + 1, list_reduce(list_concat([xor(c, CAST(unicode(substr(CAST(conv_id AS VARCHAR), pos + 1, 1)) AS BIGINT))], CAST(range(8) AS BIGINT[])), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, CAST({_POLY} AS BIGINT)) ELSE s >> 1 END)
  FROM bits WHERE pos < length(CAST(conv_id AS VARCHAR))),
h AS (SELECT conv_id, xor(c, CAST(4294967295 AS BIGINT)) % 4 AS h FROM bits WHERE pos = length(CAST(conv_id AS VARCHAR))),
r AS (SELECT h.conv_id, t.i AS k, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 AND t.i <= h.h
  UNION ALL SELECT h.conv_id, 4 + t.i, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND t.i > h.h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d FROM r),
q AS (SELECT h.conv_id, coalesce(list({{'role': n.role, 'text': n.text}} ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS seq FROM h LEFT JOIN n ON n.conv_id = h.conv_id GROUP BY h.conv_id),
p AS (SELECT conv_id, d, seq[1:d] AS prefix, d = len(seq) AS ends FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM q)),
g AS (SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids FROM p GROUP BY prefix, d),
c AS (SELECT g.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM g x WHERE x.d = g.d + 1 AND x.prefix[1:g.d] = g.prefix) AS n_children FROM g LEFT JOIN g u ON u.d = g.d - 1 AND u.prefix = g.prefix[1:g.d - 1]),
w AS (SELECT *, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(prefix[d].text, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM c),
s AS (SELECT a.prefix[1:a.up] AS prefix, a.up AS d, count(*) FILTER (WHERE a.n_children = 0) AS n_leaves, sum(a.saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM w) a GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, w.parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN s ON s.prefix = w.prefix AND s.d = w.d
"""
