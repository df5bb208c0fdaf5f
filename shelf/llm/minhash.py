"""Near-duplicate detection: fast similarity sketching, banding and exact verification.

Sketch. In round i < t every shingle hash falls into a bin of its own choosing with a value in [i, i+1), in round t + j into
bin j; each of the t coordinates keeps its least value, and rounds end when all bins are filled, at the latest after round
2t. Two sketches agree in a coordinate with the probability of the sets' Jaccard similarity, with concentration as if
coordinates were independent, and a sketch takes about t ln t + |set| steps.

Links. Texts with the same shingle set are one node, the smallest doc_id. Nodes meet in the buckets of BANDS bands of ROWS
coordinates. In a bucket every node is first linked to the smallest only; of each node's candidates the best is verified
first, then those that still connect different components. Such a candidate is dropped if its 8-bit sketches agree in too
few coordinates (5 standard deviations under the threshold).

In a bucket that then still holds several components, nodes of different components are candidates too, under two bounds
that lose no link. No more of a set can be shared with another component than the shingles that occur in one; that is
counted for each node, in proportion to the texts, and leaves only nodes that share three quarters of their shingles: a
passage that many texts hold ends here. Of two nodes, the shingles that only one has are at least as many as the bits in
which their parity bitmaps differ, and links have at most a seventh of both sizes' sum of them; buckets are dealt out in
blocks of bounded size whose bitmaps are compared, and only pairs that pass are emitted. Nodes of one component are never paired again. All that is left is verified on whole shingle
sets. A pair at the threshold goes unseen with a chance of about 2e-5.

Cases: null text counts as empty; a text with fewer than five words is one shingle, one without words has an empty set and
no links; rows repeated under one doc_id are one node, linked by what any of them holds; rows without doc_id are linked
with nothing and have no component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import WordHashes, mixed, shingles, words

ROWS, BANDS = 5, 40
SIZE = ROWS * BANDS
#: Linked are sets with 100 * intersection >= PERCENT * union. Bounds below are derived from 75.
PERCENT = 75
#: Least share of coordinates in which the 8-bit sketches of a candidate agree.
LEAST = 0.75 - 5 * (0.75 * 0.25 / SIZE) ** 0.5
#: Words of 64 bits in a parity bitmap, and in its fold, which is looked at first.
PARITY, FOLD = 32, 8
#: Nodes of a block of a bucket, about.
BLOCK = 2_000

_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = mixed(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SIG = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.binary()), ("small", pa.binary())])
SIG = "doc_id long, n_shingles long, digest binary, bands binary, small binary"
_BAND = pa.schema([("key", pa.int64()), ("node", pa.int64())])


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SIZE coordinates of a non-empty set of distinct 64-bit hashes."""
    out = np.full(SIZE, _UNSET, np.uint64)
    n = len(hashes)
    step = max(1, -(-6 * SIZE // n))
    i = 0
    low, shift = np.uint64(0xFFFFFFFF), np.uint64(32)
    while i < 2 * SIZE:
        stop = min(i + step, SIZE if i < SIZE else 2 * SIZE)
        x = mixed(hashes[None, :] ^ _SEEDS[i:stop, None])
        values = (np.arange(i, stop, dtype=np.uint64)[:, None] << shift) | (x & low)
        if i < SIZE:
            np.minimum.at(out, (((x >> shift) * np.uint64(SIZE)) >> shift).astype(np.int64).ravel(), values.ravel())
        else:
            out[i - SIZE : stop - SIZE] = np.minimum(out[i - SIZE : stop - SIZE], values.min(1))
        if out.max() != _UNSET:
            break
        i = stop
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    rows = mixed(coordinates).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k]
    return mixed(key)


def _sign(it):
    hashes = WordHashes()
    for b in common.each(it):
        rows = []
        for text in common.texts(b.column("text")):
            s = shingles(hashes.of(words(text)))
            if len(s):
                c = sketch(s)
                rows.append((len(s), blake2b(s.tobytes(), digest_size=16).digest(), band_keys(c).tobytes(), (mixed(c) & np.uint64(0xFF)).astype(np.uint8).tobytes()))
            else:
                rows.append((0, None, None, None))
        yield common.batch(_SIG, b.column("doc_id"), *zip(*rows, strict=True))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    return common.written(common.map_arrow(_rows(docs), _sign, SIG))


def _bands(it):
    for b in common.each(it):
        nodes = b.column("node").to_numpy()
        keys = np.concatenate([np.frombuffer(x, np.int64) for x in b.column("bands").to_pylist()])
        yield common.batch(_BAND, keys, np.repeat(nodes, BANDS))


def _estimate(it):
    """(a, b, small_a, small_b) to the pairs that agree in enough coordinates."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for b in common.each(it):
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SIZE) for c in ("small_a", "small_b"))
        share = ((x == y).mean(1) - 1 / 256) / (1 - 1 / 256)
        near = np.flatnonzero(share >= LEAST)
        yield common.batch(schema, b.column("a").take(pa.array(near)), b.column("b").take(pa.array(near)))


def _compare(percent: int):
    """(a, b, set_a, set_b) to the pairs linked by their whole sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it):
        for b in common.each(it):
            links = []
            for a_id, b_id, x, y in zip(*(b.column(k).to_pylist() for k in ("a", "b", "set_a", "set_b")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        links.append((a_id, b_id))
            yield common.batch(schema, [p[0] for p in links], [p[1] for p in links])

    return run


def _sets(it):
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])
    hashes = WordHashes()
    for b in common.each(it):
        yield common.batch(schema, b.column("doc_id"), [shingles(hashes.of(words(t))).tobytes() for t in common.texts(b.column("text"))])


def _with(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """pairs (a, b) with a value of each end from table (node, value)."""
    for end in ("a", "b"):
        t = table.select(F.col("node").alias(end), F.col(value).alias(f"{value}_{end}")).hint("merge")
        pairs = pairs.join(t, end)
    return pairs


def near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The candidates that sketches don't rule out."""
    return common.written(common.map_arrow(_with(pairs, nodes, "small").select("a", "b", "small_a", "small_b"), _estimate, "a long, b long"))


def whole_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, set of each end of a pair, from the texts."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_end")).distinct().hint("merge")
    rows = _rows(docs)
    return common.written(common.map_arrow(rows.join(ends, rows.doc_id == ends._end, "left_semi"), _sets, "node long, set binary"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that whole shingle sets confirm."""
    common.short_batches(pairs.sparkSession)
    return common.written(common.map_arrow(_with(pairs, sets, "set").select("a", "b", "set_a", "set_b"), _compare(percent), "a long, b long").distinct())


def _contracted(edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """node, rep: the least of a node and its neighbours, in an order of its own for each round k; and the edges between
    representatives. edges (node, other) hold both directions."""

    def ranked(c: str):
        # Hubs are least by number, so the first round folds stars at once.
        return F.struct((F.col(c) if k == 0 else F.xxhash64(F.lit(k), F.col(c))).alias("rank"), F.col(c).alias("node"))

    nearest = edges.groupBy("node").agg(F.min(ranked("other")).alias("least"))
    rep = common.written(nearest.select("node", F.least(ranked("node"), "least")["node"].alias("rep")))
    ends = edges.join(rep.withColumnRenamed("rep", "a"), "node").select("a", "other")
    ends = ends.join(rep.select(F.col("node").alias("other"), F.col("rep").alias("b")), "other").where("a <> b")
    return rep, common.written(ends.select(F.col("a").alias("node"), F.col("b").alias("other")).distinct())


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of each node that has a link.

    Every round folds each node into the least of itself and its neighbours, under a new hash order, until no edge is left.
    Of nodes in any arrangement a round is expected to leave three quarters at most (chains: half), so rounds grow as the
    logarithm of the nodes and all rounds together read in proportion to the links. Then representatives are followed back
    from the last round to the first, and each component takes its smallest node. All tables stay distributed; rows of one
    hub or label meet in partial aggregates, and in joins with one row of the other side, which Spark splits by size.
    """
    edges = common.written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("node", "other"))
    rounds = []
    while not edges.isEmpty():
        rep, edges = _contracted(edges, len(rounds))
        rounds.append(rep)
    if not rounds:
        return edges.toDF("node", "component")
    labels = rounds.pop()
    while rounds:
        labels = common.written(rounds.pop().join(labels.toDF("rep", "root"), "rep", "left").select("node", F.coalesce("root", "rep").alias("rep")))
    least = labels.groupBy("rep").agg(F.min("node").alias("component"))
    return common.written(labels.join(least, "rep").select("node", "component"))


def _component(table: DataFrame, node: str, labels: DataFrame, to: str) -> DataFrame:
    """table with the component of a node, itself where it has no label."""
    own = labels.select(F.col("node").alias(node), F.col("component").alias(to))
    return table.join(own, node, "left").withColumn(to, F.coalesce(to, node))


def _merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after further links: only the components that these tie together are looked at again."""
    if more.isEmpty():
        return labels
    between = _component(_component(more, "a", labels, "ca"), "b", labels, "cb").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    fresh = components(between)
    new = fresh.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = labels.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return common.written(old.unionByName(fresh.join(labels.select("node"), "node", "left_anti")))


def _several(table: DataFrame) -> DataFrame:
    """Rows (key, node, component, ...) of the keys that hold several components, with the number n of their rows."""
    sizes = table.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    return common.written(table.join(common.written(sizes.select("key", "n")), "key"))


def _open_buckets(bands: DataFrame, shared: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, component, hub, n of buckets with several components; of two nodes all pairs are known already."""
    members = bands.join(shared.where("n > 2").select("key", "hub").hint("merge"), "key")
    return _several(common.written(_component(members, "node", labels, "component")))


def _spell(it):
    schema = pa.schema([("shingle", pa.int64()), ("node", pa.int64()), ("component", pa.int64())])
    for b in common.each(it):
        sets = [np.frombuffer(x, np.int64) for x in b.column("set").to_pylist()]
        sizes = [len(x) for x in sets]
        yield common.batch(schema, np.concatenate(sets), np.repeat(b.column("node").to_numpy(), sizes), np.repeat(b.column("component").to_numpy(), sizes))


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bitmap with a bit for each place to which an odd number of hashes fall."""
    counts = np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view(np.int64)


def _parities(it):
    schema = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("bits", pa.binary())])
    for b in common.each(it):
        sets = [np.frombuffer(x, np.uint64) for x in b.column("set").to_pylist()]
        yield common.batch(schema, b.column("node"), [len(x) for x in sets], [parity(x).tobytes() for x in sets])


def _shareable(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """node, size, bits, common: how many of a node's shingles some other component in an open bucket holds."""
    nodes = open_.groupBy("node").agg(F.min("component").alias("component"))
    spelt = common.map_arrow(sets.join(nodes, "node"), _spell, "shingle long, node long, component long")
    between = spelt.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
    counted = spelt.join(common.written(between).hint("merge"), "shingle").groupBy("node").agg(F.count(F.lit(1)).alias("common"))
    return common.written(common.map_arrow(sets, _parities, "node long, size long, bits binary").join(counted.hint("merge"), "node"))


def passing(nodes, components_, sizes, shared, bits, left: np.ndarray, right: np.ndarray):
    """Pairs (a, b) of rows of left and of right that are of different components and that both bounds let pass."""
    folded = np.bitwise_xor.reduce(bits.reshape(len(bits), -1, FOLD), axis=1)
    for k in range(0, len(left), 64):
        i = left[k : k + 64]
        sums = sizes[i, None] + sizes[None, right]
        can = (components_[i, None] != components_[None, right]) & (7 * np.minimum(shared[i, None], shared[None, right]) >= 3 * sums)
        x, y = np.nonzero(can)
        for words in (folded, bits):
            differing = np.bitwise_count(words[i[x]] ^ words[right[y]]).sum(1, dtype=np.int64)
            near_ = 7 * differing <= sums[x, y]
            x, y = x[near_], y[near_]
        yield np.minimum(nodes[i[x]], nodes[right[y]]), np.maximum(nodes[i[x]], nodes[right[y]])


def _pair_up(it):
    """Rows sorted by (key, i, j), a block of a bucket against another or itself, to the pairs that pass."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list = []

    def pairs():
        table = pa.Table.from_batches(held)
        own = table.column("own").to_numpy()
        columns = [table.column(c).to_numpy() for c in ("node", "component", "size", "common")]
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, PARITY)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = list(passing(*columns, bits, left, right))
        a, b = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        both = np.unique(np.stack((a, b), 1), axis=0)
        return common.batch(schema, both[:, 0], both[:, 1])

    for b in common.each(it):
        group = np.stack([b.column(c).to_numpy() for c in ("key", "i", "j")])
        starts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for k, (lo, hi) in enumerate(zip(starts, starts[1:], strict=False)):
            part = b.slice(lo, hi - lo)
            if held and (k or any(held[-1].column(c)[0] != part.column(c)[0] for c in ("key", "i", "j"))):
                yield pairs()
                held = []
            held.append(part)
    if held:
        yield pairs()


def _open_pairs(open_: DataFrame, share: DataFrame) -> DataFrame:
    """Pairs of nodes of different components in one bucket that both bounds let pass, but for those with the bucket's hub.

    A bucket is dealt out in blocks of about BLOCK nodes, every two blocks as a group of their own, so no group grows.
    """
    few = share.where("100 * common >= 75 * size")
    found = _several(open_.drop("n").where("node <> hub").join(few, "node"))
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("node"), blocks)
    rows = found.select("key", "node", "component", "size", "common", "bits", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    rows = rows.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "node", "component", "size", "common", "bits", "own")
    dealt = rows.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")
    return common.written(common.map_arrow(dealt, _pair_up, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs."""
    signed = signatures(docs)
    full = signed.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    # One node for each shingle set; copies meet in each task's partial aggregate first.
    nodes = full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("small").alias("small"))
    nodes = common.written(nodes)
    bands = common.map_arrow(nodes.select("node", "bands"), _bands, "key long, node long")
    shared = common.written(bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).where("hub <> last").drop("last"))
    stars = bands.join(shared.hint("merge"), "key").where("node <> hub").groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    stars = common.written(stars)
    candidates = near(stars.select("a", "b"), nodes)
    sets = whole_sets(docs, candidates)
    weighed = common.written(candidates.join(stars, ["a", "b"]))
    best = common.written(weighed.groupBy("a").agg(F.max(F.struct("times", (-F.col("b")).alias("b"))).alias("best")).select("a", (-F.col("best.b")).alias("b")))
    links = linked(best, sets, percent)
    # Rows repeated under one doc_id with different texts tie their sets together.
    named = nodes.select("digest", F.col("node").alias("of"))
    repeated = common.written(full.groupBy("doc_id").agg(F.countDistinct("digest").alias("k")).where("k > 1").select("doc_id"))
    ties = full.join(repeated, "doc_id").join(named, "digest").select(F.col("doc_id").alias("a"), F.col("of").alias("b")).where("a <> b")
    labels = components(links.union(ties))
    rest = weighed.select("a", "b").join(best, ["a", "b"], "left_anti")
    rest = _component(_component(rest, "a", labels, "ca"), "b", labels, "cb").where("ca <> cb").select("a", "b")
    labels = _merged(labels, linked(rest, sets, percent))
    open_ = _open_buckets(bands, shared, labels)
    if not open_.isEmpty():
        sets = whole_sets(docs, open_.select(F.col("node").alias("a"), F.col("node").alias("b")))
        labels = _merged(labels, linked(_open_pairs(open_, _shareable(open_, sets)), sets, percent))
    of_node = _component(nodes.select("digest", "node"), "node", labels, "component_id").select("digest", "component_id")
    out = signed.select("doc_id", "n_shingles", "digest").join(common.written(of_node).hint("merge"), "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id stands for its component, or that have none."""
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct().hint("merge")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


#: Brute force: all pairs that share a shingle, then everything reachable over links.
OP1_SQL = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), shingles as materialized (
  select distinct doc_id, hash(s) as h, s from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from words)
), sizes as materialized (
  select doc_id, count(s) as n from documents left join shingles using (doc_id) group by doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as m
  from shingles a join shingles b on a.h = b.h and a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
), links as materialized (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * m >= 75 * (x.n + y.n - m)
), reached as (
  select doc_id, doc_id as other from sizes
  union
  select r.doc_id, l.b from reached r join links l on l.a = r.other
)
select doc_id, any_value(n) as n_shingles, min(other) as component_id, doc_id = min(other) as kept
from reached join sizes using (doc_id) group by doc_id"""
