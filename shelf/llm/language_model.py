"""Hidden Markov language model.

Words are emitted by latent states as classes: the most frequent words, TOP at most, have a class each (of words of one
count all or none), every other word belongs to one of TAILS classes by its last three bytes, and the end of a text has its
own. Within a tail class a word's probability is its share of the class' training count, times a factor of its own for each
state; one share, estimated from the words seen once, is that of all words never seen. So the model is a proper
distribution over words and "some unknown word". What is broadcast is of bounded size; counts and factors of all words
are distributed tables that grow with the words.

Training is Baum-Welch. Training texts are cut into segments of SEGMENT tokens, so that many of them run side by side
however long a text is and a worker's memory is bounded; a text's first segment begins in the start distribution, others in
one that is learned for them. Each partition runs scaled forward-backward recursions over its segments and emits expected
counts, which are summed over partitions by blocks of classes. Each of ITERATIONS covers all training texts; in the last,
expected counts of every word outside the top are gathered too, and give it its factors. A text's score is the exact scaled
forward likelihood of its whole sequence of words, uncut.

Tables. Texts lie in chunks of about CHUNK bytes, a row each: numbers of words in the chunk's own list of words. Training
segments lie beside them as lattices, in the order in which the recursion takes their tokens, so an iteration only reads
rows. The rows of words that chunks hold are shuffled once by word, to be summed, and once by chunk, to be scored.
Of the rows of one word there are as many as chunks that hold it, and a word outside the top is at most one in TOP tokens.

Cases: null and empty texts are the end token alone; without training texts N and V are 0 and all words are unknown; null
doc_id hashes as the empty text; rows repeated under one doc_id are scored each; a very long text is a chunk by itself,
whose numbers of words a worker holds; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS = 10
TOP, TAILS = 40_000, 8_192
STATES, ITERATIONS = 8, 12
#: Bytes of a chunk and tokens of a lattice, about; tokens of a segment, at most. Blocks in which classes are summed.
CHUNK, GROUP, SEGMENT, BLOCKS = 12_000_000, 131_072, 128, 64
#: Steps between two scalings of a recursion; steps whose emissions are looked up at once.
RESCALE, STRIDE = 3, 16
#: Weight of the class distribution in each state's emissions, as so many tokens.
PRIOR = 200.0
#: Weight of its class' states in those of a tail word, as so many tokens.
OWN = 5.0
#: Factors are kept as 16-bit logarithms, so many steps to a power of 2.
STEPS = 512
#: Rows in an Arrow batch of texts, lattices and words' rows.
TEXT_ROWS, LATTICE_ROWS, WORD_ROWS = 1_024, 64, 20_000
#: Expected counts of words are kept as 16-bit shares of their training counts.
SHARES = 65_535

_CHUNKS = pa.schema([("chunk", pa.int64()), ("doc_id", pa.binary()), ("has_id", pa.binary()), ("held_out", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary()), ("words", pa.binary()), ("sizes", pa.binary()), ("texts", pa.int64()), ("word", pa.binary()), ("c", pa.int64())])
CHUNKS = "chunk long, doc_id binary, has_id binary, held_out binary, lengths binary, ids binary, words binary, sizes binary, texts long, word binary, c long"
_LATTICES = pa.schema([("classes", pa.binary()), ("n", pa.binary()), ("first", pa.binary())])
LATTICES = "classes binary, n binary, first binary"
_SUMS = [("block", pa.int32()), ("at", pa.binary()), ("counts", pa.binary())]
SUMS = "block int, at binary, counts binary"
_EXPECTED = pa.schema([*_SUMS, ("word", pa.binary()), ("tail", pa.int32()), ("chunk", pa.int64()), ("place", pa.int32()), ("c", pa.int64()), ("expected", pa.binary())])
EXPECTED = f"{SUMS}, word binary, tail int, chunk long, place int, c long, expected binary"
_OWN = pa.schema([*_SUMS, ("chunk", pa.int64()), ("place", pa.int32()), ("c", pa.int64()), ("own", pa.binary())])
OWN_ROWS = f"{SUMS}, chunk long, place int, c long, own binary"
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _tail(word):
    """Of a column of words the tail class: crc32 of the last three bytes, modulo TAILS."""
    return (F.crc32(F.substring(word, -3, 3)) % TAILS).cast("int")


#: crc32's table: what each byte does to the register.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)


def tails_of(words_of: pa.BinaryArray, tails: int) -> np.ndarray:
    """_tail() over an array."""
    ends, data = offsets(words_of)
    begins = np.maximum(ends[:-1], ends[1:] - 3)
    crc = np.full(len(words_of), 0xFFFFFFFF, np.uint32)
    for k in range(3):
        has = np.flatnonzero(begins + k < ends[1:])
        crc[has] = _CRC[(crc[has] ^ data[begins[has] + k]) & 0xFF] ^ crc[has] >> 8
    return (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % tails


def offsets(words_of: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values begin and end, and the bytes."""
    _, at, data = words_of.buffers()
    at = np.frombuffer(at, np.int32)[words_of.offset : words_of.offset + len(words_of) + 1]
    return at, np.frombuffer(data, np.uint8) if data and data.size else np.zeros(1, np.uint8)


def rows_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of the columns given; the others are null."""
    n = len(next(iter(columns.values())))
    return common.batch(schema, *(columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema))


def packed(rows: np.ndarray, has: np.ndarray) -> pa.Array:
    """Binary values: the bytes of the next of rows where has, else none."""
    ends = np.concatenate(([0], np.cumsum(has) * (rows.itemsize * rows.shape[1]))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(has), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


# -- chunks and counts


class Chunk:
    """Texts one behind the other as numbers of words, the end being word 0."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, held_out: np.ndarray, words: pa.BinaryArray):
        self.ids, self.lengths, self.held_out, self.words = ids, lengths, held_out, words

    def training(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and lengths of the training texts alone."""
        return self.ids[np.repeat(~self.held_out, self.lengths)], self.lengths[~self.held_out]

    @staticmethod
    def of(batch: pa.RecordBatch, k: int) -> Chunk:
        value = lambda name: batch.column(name)[k].as_buffer()
        ends = np.concatenate(([0], np.cumsum(unplaned(value("sizes"))))).astype(np.int32)
        words_of = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), value("words")])
        return Chunk(unplaned(value("ids")), np.frombuffer(value("lengths"), np.int64), np.frombuffer(value("held_out"), bool), words_of)


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, lowest bytes first: most others are 0 and compress away."""
    return numbers.view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(raw) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()


def _numbered(texts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of the words of texts, one behind the other and each with its end, which is 0; lengths; words by number."""
    plain = [pc.fill_null(t, "") for t in texts]
    lists = [pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(t))) for t in plain]  # [""] where there are no words
    lengths = np.concatenate([pc.list_value_length(x).to_numpy() for x in lists]).astype(np.int64)
    coded = pa.concat_arrays([pa.array([""], lists[0].type.value_type), *(x.flatten() for x in lists)]).dictionary_encode()
    numbers = coded.indices.to_numpy()[1:]
    ends = np.cumsum(lengths)
    wordless = numbers[ends - 1] == 0
    ids = np.insert(numbers, ends[~wordless], 0)
    return ids, lengths + ~wordless, coded.dictionary.cast(pa.binary())


def _split(size: int):
    """Texts in chunks of that many tokens; after each a row for each of its words that training texts hold, with their count."""

    def run(it):
        number = TaskContext.get().partitionId() << 33

        def rows():
            ids, lengths, words_of = _numbered([b.column("text") for b in held])
            held_out = np.concatenate([b.column("held_out").to_numpy(zero_copy_only=False) for b in held])
            docs = pa.concat_arrays([b.column("doc_id") for b in held])
            chunk = Chunk(ids, lengths, held_out, words_of)
            at, data = offsets(words_of)
            yield rows_of(
                _CHUNKS, chunk=[number], doc_id=[docs.fill_null(0).to_numpy().tobytes()], has_id=[docs.is_valid().to_numpy(zero_copy_only=False).tobytes()],
                held_out=[held_out.tobytes()], lengths=[lengths.tobytes()], ids=[planes(ids)], words=[data[at[0] : at[-1]].tobytes()], sizes=[planes(np.diff(at))], texts=[int((~held_out).sum())],
            )
            counts = np.bincount(chunk.training()[0], minlength=len(chunk.words))
            counts[0] = 0
            known = np.flatnonzero(counts)
            if len(known):
                yield rows_of(_CHUNKS, word=words_of.take(pa.array(known)), c=counts[known])

        held, tokens = [], 0
        for b in common.each(it):
            held.append(b)
            tokens += pc.sum(pc.binary_length(b.column("text"))).as_py() or 0
            if tokens >= size:
                yield from rows()
                number += 1
                held, tokens = [], 0
        if held:
            yield from rows()

    return run


class Vocabulary:
    """What workers must know of the training counts, of bounded size: the top words, and sums over the rest by tail.

    tails: of each tail the count of its words, and how many of them were seen once.
    """

    def __init__(self, top: list[tuple[bytes, int]], n_words: int, n_types: int, n_texts: int, tails: dict[int, tuple[int, int]]):
        self.words = [w for w, _ in top]
        self.counts = np.array([c for _, c in top], dtype=np.float64)
        #: N and V: all training tokens and distinct ones, ends among them.
        self.n = n_words + n_texts
        self.v = n_types + (n_texts > 0)
        self.n_texts, self.divisor = n_texts, self.n + 0.1 * (self.v + 1)
        #: Places of the classes: tails from here on, then the end.
        self.top, self.end, self.size = TOP, TOP + TAILS, TOP + TAILS + 1
        #: By tail: training count, and the share of words never seen.
        self.in_tail, once = np.zeros(TAILS), np.zeros(TAILS)
        for k, (c, n) in tails.items():
            self.in_tail[k], once[k] = c, n
        self.unseen = (once + 1) / (self.in_tail + 2)
        classes = np.full(self.size, 0.1)
        classes[: len(top)] += self.counts
        classes[self.top : self.end] += self.in_tail
        classes[self.end] += n_texts
        self.prior = classes / classes.sum()

    def classes(self, words_of: pa.BinaryArray) -> np.ndarray:
        """Classes of a chunk's words."""
        place = pc.index_in(words_of, value_set=pa.array(self.words, pa.binary())).fill_null(-1).to_numpy().astype(np.int64)
        out = np.where(place < 0, self.top + tails_of(words_of, self.end - self.top), place)
        out[0] = self.end
        return out


def vocabulary(counts: DataFrame, n_texts: int) -> Vocabulary:
    """The vocabulary from the counts of all training words.

    The top are all words above the least count that leaves TOP of them at most. To the driver come the largest distinct
    counts, of which there are few (about the root of the number of tokens at most), TOP words and TAILS sums.
    """
    totals = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    cut, above = 0, 0
    for c, n in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(TOP + 1).collect():
        above += n
        if above > TOP:
            cut = c
            break
    top = sorted(((bytes(w), c) for w, c in counts.where(F.col("c") > cut).select("word", "c").collect()), key=lambda x: (-x[1], x[0]))
    rest = counts.where(F.col("c") <= cut).groupBy(_tail(F.col("word"))).agg(F.sum("c"), F.sum((F.col("c") == 1).cast("long")))
    return Vocabulary(top, totals[0] or 0, totals[1], n_texts, {k: (c, once) for k, c, once in rest.collect()})


# -- the hidden Markov model


class Model:
    """Start (2, K: of texts, of their later segments), moves (K, K) and emissions (classes, K) as probabilities."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emissions: np.ndarray):
        self.start, self.moves, self.emissions = start, moves, emissions

    def relative(self, prior: np.ndarray) -> Model:
        """With emissions divided by the class distribution, which keeps them near 1."""
        return Model(self.start.astype(np.float32), self.moves.astype(np.float32), (self.emissions / prior[:, None]).astype(np.float32))

    @staticmethod
    def first(prior: np.ndarray, states: int, seed: int = 7) -> Model:
        """States that hold on, with emissions strewn about the class distribution."""
        noise = np.random.default_rng(seed).gamma(1.0, size=(len(prior), states)) + 0.05
        emissions = prior[:, None] * noise
        moves = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(moves, 0.95 if states > 1 else 1.0)
        return Model(np.full((2, states), 1 / states), moves, emissions / emissions.sum(0))

    @staticmethod
    def from_counts(counts: Counts, prior: np.ndarray) -> Model:
        """The M-step, smoothed."""
        share = lambda x: (x + 0.1) / (x + 0.1).sum(1, keepdims=True)
        emissions = counts.emissions + PRIOR * prior[:, None]
        return Model(share(counts.start), share(counts.moves), emissions / emissions.sum(0))


class Counts:
    """Expected starts, moves and emissions (classes, K)."""

    def __init__(self, states: int, size: int):
        self.start, self.moves, self.emissions = np.zeros((2, states)), np.zeros((states, states)), np.zeros((size, states))


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and length of each segment of texts that lie one behind the other, and whether it is its text's first."""
    n = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(lengths) - lengths)[text] + k * SEGMENT, np.minimum(SEGMENT, lengths[text] - k * SEGMENT), k == 0


def lattices(lengths: np.ndarray):
    """Groups of segments side by side, longest first: (places of their tokens, step by step; n; first).

    At step t the first n[t] segments of a group have a token, so nothing is padded.
    """
    begins, sizes, first = segments(lengths)
    order = np.argsort(-sizes, kind="stable")
    group = np.cumsum(sizes[order]) // GROUP
    for some in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        if len(some):
            own = sizes[some]
            n = np.searchsorted(-own, -np.arange(1, int(own[0]) + 1), side="right")
            step = np.repeat(np.arange(len(n)), n)
            yield begins[some][np.arange(len(step)) - np.repeat(np.cumsum(n) - n, n)] + step, n, first[some]


def expect(tokens: np.ndarray, n: np.ndarray, first: np.ndarray, model: Model, emissions: np.ndarray, counts: Counts) -> np.ndarray:
    """The E-step of a lattice: adds starts and moves to counts; of each token the posterior of its state (K, tokens).

    emissions (tokens, K) are relative to the class distribution; so it is enough to scale every RESCALE steps. The backward
    recursion is scaled by what the forward one was, and begins with the inverse of its last sum, so that products of both
    are posteriors as they are.
    """
    off = np.concatenate(([0], np.cumsum(n)))
    even = n[0] == n[-1]
    before = slice(0, off[-2]) if even else np.arange(n[0], off[-1]) - np.repeat(n[:-1], n[1:])
    last = slice(off[-2], None) if even else off[np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right") - 1] + np.arange(n[0])
    n, off = n.tolist(), off.tolist()
    moves, back, ones = model.moves, np.ascontiguousarray(model.moves.T), np.ones(len(model.moves), emissions.dtype)
    e = emissions.take(tokens, axis=0)
    alpha, scales = np.empty_like(e), {}
    a = np.multiply(e[: n[0]], model.start[1 - first], out=alpha[: n[0]])
    for t in range(1, len(n)):
        at = slice(off[t], off[t + 1])
        a = np.matmul(a[: n[t]], moves, out=alpha[at])
        a *= e[at]
        if t % RESCALE == 0:
            scales[t] = (1 / (a @ ones))[:, None]
            a *= scales[t]
    beta = np.empty_like(e)
    beta[last] = (1 / (alpha[last] @ ones))[:, None]
    for t in range(len(n) - 1, 0, -1):
        at = slice(off[t], off[t + 1])
        v = e[at]  # from here on emission times beta
        v *= beta[at]
        if t % RESCALE == 0:
            v *= scales[t]
        np.matmul(v, back, out=beta[off[t - 1] : off[t - 1] + n[t]])
    if len(n) > 1:
        counts.moves += (alpha[before].T @ e[n[0] :]) * moves
    beta *= alpha
    counts.start[0] += beta[: n[0]][first == 1].sum(0)
    counts.start[1] += beta[: n[0]][first == 0].sum(0)
    return np.ascontiguousarray(beta.T)


def add(by_token: np.ndarray, tokens: np.ndarray, posteriors: np.ndarray) -> None:
    """Adds posteriors to the expected emissions (K, classes or words)."""
    for k, p in enumerate(posteriors):
        by_token[k] += np.bincount(tokens, p, by_token.shape[1])


def likelihoods(ids: np.ndarray, lengths: np.ndarray, emissions: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log10 likelihood of each text by the scaled forward recursion; emissions are by word. Only STRIDE steps are held."""
    order = np.argsort(-lengths, kind="stable")
    begins, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    n = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right").tolist()
    logs, ones, here = np.zeros(len(order)), np.ones(len(start)), np.empty(0)
    for t, m in enumerate(n):
        if t % STRIDE == 0:  # emissions of some steps at once, for the texts that reach the first of them
            steps = np.arange(t, min(t + STRIDE, len(n)))
            here = emissions.take(ids.take(begins[:m] + steps[:, None], mode="clip"), axis=0)
        if t == 0:
            a = start * here[0]
            continue
        if m < len(a):
            logs[m : len(a)] += np.log10(a[m:] @ ones)
        a = a[:m] @ moves
        a *= here[t % STRIDE, :m]
        if t % RESCALE == 0:
            c = a @ ones
            logs[:m] += np.log10(c)
            a *= (1 / c)[:, None]
    logs[: len(a)] += np.log10(a @ ones)
    out = np.empty(len(order))
    out[order] = logs
    return out


# -- sums over partitions


def _emit(schema: pa.Schema, counts: np.ndarray, rest: np.ndarray):
    """Sums by blocks of rows, only of rows that have any; block -1 holds the rest."""
    seen = np.flatnonzero(counts.any(1))
    blocks, at, values = [-1], [b""], [rest.astype(np.float64).tobytes()]
    for k in range(BLOCKS):
        if len(some := seen[seen % BLOCKS == k]):
            blocks.append(k)
            at.append(some.astype(np.int32).tobytes())
            values.append(counts[some].astype(np.float32).tobytes())
    yield rows_of(schema, block=blocks, at=at, counts=values)


def _sum(width: int, size: int, rest_size: int):
    """Rows sorted by block to a row for each block."""
    schema = pa.schema(_SUMS)

    def run(it):
        block, total, rest = None, None, None

        def row():
            if block == -1:
                return common.batch(schema, [-1], [b""], [rest.tobytes()])
            at = np.flatnonzero(total.any(1))
            return common.batch(schema, [block], [(at * BLOCKS + block).astype(np.int32).tobytes()], [total[at].astype(np.float32).tobytes()])

        for b in common.each(it):
            for k, at, counts in zip(b.column("block").to_pylist(), b.column("at").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if k != block:
                    if block is not None:
                        yield row()
                    block, total, rest = k, np.zeros((size // BLOCKS + 1, width)), np.zeros(rest_size)
                if k == -1:
                    rest += np.frombuffer(counts)
                else:
                    total[np.frombuffer(at, np.int32) // BLOCKS] += np.frombuffer(counts, np.float32).reshape(-1, width)
        if block is not None:
            yield row()

    return run


def summed(parts: DataFrame, width: int, size: int, rest_size: int) -> tuple[np.ndarray, np.ndarray]:
    """What tasks emitted, summed: (size, width), and the rest. BLOCKS + 1 rows, of that size in all, come to the driver."""
    rows = parts.select("block", "at", "counts").repartition("block").sortWithinPartitions("block")
    total, rest = np.zeros((size, width)), np.zeros(rest_size)
    for block, at, counts in common.map_arrow(rows, _sum(width, size, rest_size), SUMS).collect():
        if block == -1:
            rest += np.frombuffer(counts)
        else:
            total[np.frombuffer(at, np.int32)] = np.frombuffer(counts, np.float32).reshape(-1, width)
    return total, rest


def _rest(counts: Counts) -> np.ndarray:
    return np.concatenate((counts.start.ravel(), counts.moves.ravel()))


def gathered(parts: DataFrame, states: int, size: int) -> Counts:
    counts = Counts(states, size)
    counts.emissions, rest = summed(parts, states, size, states * (states + 2))
    counts.start, counts.moves = rest[: 2 * states].reshape(2, states), rest[2 * states :].reshape(states, states)
    return counts


# -- iterations


def _lattices(shared):
    """The training texts of chunks as lattices of classes."""

    def run(it):
        v: Vocabulary = shared.value
        for b in common.each(it):
            for k in range(b.num_rows):
                chunk = Chunk.of(b, k)
                classes = v.classes(chunk.words).astype(np.uint16)
                ids, lengths = chunk.training()
                of_tokens = classes[ids]
                for at, n, first in lattices(lengths):
                    yield common.batch(_LATTICES, [of_tokens[at].tobytes()], [n.astype(np.int32).tobytes()], [first.astype(np.int8).tobytes()])

    return run


def _expect(shared, size: int):
    def run(it):
        model: Model = shared.value
        states = len(model.moves)
        counts, by_class = Counts(states, 0), np.zeros((states, size))
        for b in common.each(it):
            for row in zip(*(b.column(c).to_pylist() for c in ("classes", "n", "first")), strict=True):
                classes, n, first = (np.frombuffer(x, t).astype(np.int64) for x, t in zip(row, (np.uint16, np.int32, np.int8), strict=True))
                add(by_class, classes, expect(classes, n, first, model, model.emissions, counts))
        if counts.start.any():
            yield from _emit(pa.schema(_SUMS), by_class.T, _rest(counts))

    return run


def baum_welch(training: DataFrame, model: Model, prior: np.ndarray) -> Model:
    """One iteration over the lattices of all training texts."""
    states, size = len(model.moves), len(prior)
    shared = training.sparkSession.sparkContext.broadcast(model.relative(prior))
    with common.batches_of(training.sparkSession, LATTICE_ROWS):
        parts = common.map_arrow(training, _expect(shared, size), SUMS)
        return Model.from_counts(gathered(parts, states, size), prior)


def _expect_words(shared):
    """Expected counts by class and, of words outside the top, by word and chunk."""

    def run(it):
        model, v = shared.value
        states = len(model.moves)
        counts, by_class = Counts(states, 0), np.zeros((states, v.size))
        for b in common.each(it):
            for k in range(b.num_rows):
                chunk = Chunk.of(b, k)
                classes = v.classes(chunk.words)
                ids, lengths = chunk.training()
                emissions, by_word = model.emissions[classes], np.zeros((states, len(classes)))
                tokens, posteriors = [], []
                for at, n, first in lattices(lengths):
                    tokens.append(ids[at].astype(np.int64))
                    posteriors.append(expect(tokens[-1], n, first.astype(np.int64), model, emissions, counts))
                    if len(tokens) == 8:
                        add(by_word, np.concatenate(tokens), np.hstack(posteriors))
                        tokens, posteriors = [], []
                if tokens:
                    add(by_word, np.concatenate(tokens), np.hstack(posteriors))
                for s in range(states):
                    by_class[s] += np.bincount(classes, by_word[s], v.size)
                places = np.flatnonzero((classes >= v.top) & (classes < v.end))
                seen = np.bincount(ids, minlength=len(classes))[places]
                for some in np.array_split(np.arange(len(places)), -(-len(places) // 100_000) or 1):
                    at = places[some]
                    if len(at):
                        has = seen[some] > 0
                        shares = np.rint(by_word[:, at[has]] / seen[some][has] * SHARES)
                        expected = packed(shares.clip(0, SHARES).T.astype(np.uint16), has)
                        yield rows_of(
                            _EXPECTED, word=chunk.words.take(pa.array(at)), tail=classes[at] - v.top, chunk=pa.repeat(b.column("chunk")[k], len(at)), place=at, c=seen[some], expected=expected
                        )
        if counts.start.any():
            yield from _emit(_EXPECTED, by_class.T, _rest(counts))

    return run


def _by_word(it):
    """Tables of whole groups of rows of a word, which come sorted by its hash, and where each group begins."""
    held: list[pa.RecordBatch] = []
    for b in common.each(it):
        key = b.column("key").to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        new = bool(held) and held[-1].column("key")[-1].as_py() != key[0]
        last = int(cuts[-1]) if len(cuts) else (0 if new else None)
        if last is None:
            held.append(b)
            continue
        done = [*held, b.slice(0, last)] if last else held
        held = [b.slice(last)]
        if done:
            yield _grouped(done)
    if held:
        yield _grouped(held)


def _grouped(batches: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
    rows = pa.Table.from_batches(batches)
    begins = lambda x: np.concatenate(([0], np.flatnonzero(pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)) + 1))
    one = rows.combine_chunks().to_batches()[0]
    of_words = begins(one.column("word"))
    if len(of_words) != len(begins(one.column("key"))):  # words that share a hash
        one = rows.sort_by([("key", "ascending"), ("word", "ascending")]).combine_chunks().to_batches()[0]
        of_words = begins(one.column("word"))
    return one, of_words


def _own(shared):
    """Rows of words with their training count over all chunks and their factors; sums of count times factor by tail."""

    def run(it):
        usual = shared.value  # states of a tail class; a word's are drawn to them
        states = usual.shape[1]
        norms = np.zeros((len(usual), states + 1))
        for rows, begins in _by_word(it):
            c, tails = rows.column("c").to_numpy(), rows.column("tail").to_numpy()[begins]
            expected = np.zeros((len(c), states))
            expected[c > 0] = np.frombuffer(b"".join(rows.column("expected").to_pylist()), np.uint16).reshape(-1, states) * (c[c > 0, None] / SHARES)
            of_word, count = np.add.reduceat(expected, begins, axis=0), np.add.reduceat(c, begins)
            q = usual[tails]
            factors = (of_word + OWN * q) / ((of_word.sum(1, keepdims=True) + OWN) * q)
            steps = np.clip(np.rint(np.log2(factors) * STEPS), -32_000, 32_000).astype(np.int16)
            np.add.at(norms, tails, count[:, None] * np.hstack((np.exp2(steps / STEPS), np.ones((len(count), 1)))))
            sizes = np.diff(np.concatenate((begins, [len(c)])))
            every = np.repeat(count, sizes)
            own = packed(np.repeat(steps, sizes, axis=0)[every > 0], every > 0)
            yield rows_of(_OWN, chunk=rows.column("chunk"), place=rows.column("place"), c=every, own=own)
        if norms.any():
            yield from _emit(_OWN, norms, np.zeros(1))

    return run


def baum_welch_words(chunks: DataFrame, model: Model, v: Vocabulary, partitions: int) -> tuple[Model, DataFrame, np.ndarray]:
    """The last iteration over all training texts, with words' own expected counts: the model; of each word outside the top
    in each chunk its training count and factors; by tail and state what shares times factors sum to."""
    spark, states = chunks.sparkSession, len(model.moves)
    with common.batches_of(spark, WORD_ROWS):
        at = common.shared_folder(spark)
        rows = common.written(common.map_arrow(chunks, _expect_words(spark.sparkContext.broadcast((model.relative(v.prior), v))), EXPECTED), at, "zstd")
        counts = gathered(rows.where("block is not null"), states, v.size)
        usual = counts.emissions[v.top : v.end] + 1
        usual /= usual.sum(1, keepdims=True)
        by_word = rows.where("word is not null").select("word", "tail", "chunk", "place", "c", "expected").repartition(partitions, "word").withColumn("key", F.xxhash64("word")).sortWithinPartitions("key")
        own = common.written(common.map_arrow(by_word, _own(spark.sparkContext.broadcast(usual)), OWN_ROWS))
        common.discard(spark, at)
        norms, _ = summed(own.where("block is not null"), states + 1, len(usual), 1)
    norms = np.where(norms[:, -1:] > 0, norms[:, :-1] / np.maximum(norms[:, -1:], 1), 1.0)
    return Model.from_counts(counts, v.prior), own.where("block is null").select("chunk", "place", "c", "own"), norms


# -- scores


def _of_chunks(it):
    """Of each chunk its text row and the columns place, c and own of its words outside the top; rows come sorted by chunk."""
    held, number = [], None

    def both():
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        text = pc.is_valid(rows.column("ids"))
        return rows.filter(text), rows.filter(pc.invert(text)).select(["place", "c", "own"])

    for b in common.each(it):
        ids = b.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for k, to in zip(cuts, cuts[1:]):
            if held and ids[k] != number:
                yield both()
                held = []
            number = ids[k]
            held.append(b.slice(k, to - k))
    if held:
        yield both()


def _score(shared):
    def run(it):
        model, v, norms = shared.value
        states = len(model.moves)
        relative = model.emissions / v.prior[:, None]
        for row, own in _of_chunks(it):
            chunk = Chunk.of(row, 0)
            classes = v.classes(chunk.words)
            emissions = relative[classes]
            place, c = own.column("place").to_numpy(), own.column("c").to_numpy()
            known = c > 0
            steps = np.frombuffer(b"".join(own.column("own").to_pylist()), np.int16).reshape(-1, states)
            tail = classes[place] - v.top
            emissions[place[known]] *= np.exp2(steps / STEPS) / norms[tail[known]]
            # By word: training count, and the log of the class' probability and of the word's share of it.
            count = np.zeros(len(classes))
            top = np.flatnonzero(classes < v.top)
            count[top], count[0], count[place] = v.counts[classes[top]], v.n_texts, c
            logs = np.log10(v.prior)[classes]
            with np.errstate(divide="ignore", invalid="ignore"):
                logs[place] += np.log10(np.where(v.in_tail[tail] == 0, 1.0, np.where(known, (1 - v.unseen[tail]) * c / v.in_tail[tail], v.unseen[tail])))
            base = np.log10((count + 0.1) / v.divisor)
            begins = np.cumsum(chunk.lengths) - chunk.lengths
            sums = lambda x: np.add.reduceat(x[chunk.ids], begins)  # noqa: E731, B023
            score = sums(logs) + likelihoods(chunk.ids, chunk.lengths, emissions, model.start[0], model.moves)
            docs = (np.frombuffer(row.column(c)[0].as_buffer(), t) for c, t in (("doc_id", np.int64), ("has_id", bool)))
            yield common.batch(_SCORED, pa.array(next(docs), mask=~next(docs)), chunk.held_out, chunk.lengths, sums((count > 0).astype(np.int64)), sums(base), score)

    return run


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is written and no longer held, so that disk holds one step's."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def scored(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """Of each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.fold(docs["doc_id"], FOLDS) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    with common.batches_of(spark, TEXT_ROWS):
        split = common.written(common.map_arrow(rows, _split(CHUNK), CHUNKS), codec="zstd")
    chunks = split.where("chunk is not null").drop("word", "c")
    at = [common.shared_folder(spark) for _ in range(2)]
    counts = common.written(split.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")), at[0])
    n_texts, n_chunks = chunks.agg(F.coalesce(F.sum("texts"), F.lit(0)), F.count("texts")).first()
    v = vocabulary(counts, n_texts)
    # As many partitions as there are chunks: what a task gets of words or chunks doesn't grow with the input.
    partitions = max(n_chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    released(spark)
    training = common.written(common.map_arrow(chunks, _lattices(spark.sparkContext.broadcast(v)), LATTICES), at[1])
    model = Model.first(v.prior, states)
    for _ in range(iterations - 1):
        model = baum_welch(training, model, v.prior)
    for path in at:
        common.discard(spark, path)
    model, own, norms = baum_welch_words(chunks, model, v, partitions)
    released(spark)
    both = own.unionByName(chunks.drop("texts"), allowMissingColumns=True).repartition(partitions, "chunk").sortWithinPartitions("chunk")
    with common.batches_of(spark, WORD_ROWS):
        out = common.written(common.map_arrow(both, _score(spark.sparkContext.broadcast((model, v, norms))), SCORED))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.documents(spark, sf_dir))
