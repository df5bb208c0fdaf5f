"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are hashed n-grams of words and of word shapes (case, last character, length, whether the word before is the
same), as a sparse vector of unit length. The weights are fitted with FTRL-Proximal updates, document by document, on a
bounded sample of labelled rows; only non-zero weights go to the scorers, whose score is a sparse dot product.

Cases: null text counts as empty and scores by the bias alone; without labelled rows all weights are 0 and scores are 0.5;
rows repeated under one doc_id are scored each; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled

#: Weights are a table of 2 ** BITS places: 1 MiB, whatever the input.
BITS = 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
THRESHOLD = 0.3

_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
_MODEL = pa.schema([("places", pa.binary()), ("weights", pa.binary())])
_TRAILS = {**dict.fromkeys(b".;:", 1), **dict.fromkeys(b",", 2), **dict.fromkeys(b"!?", 3), **dict.fromkeys(b"#$%&*@^~=+", 4), **dict.fromkeys(b"|/\\<>{}[]()", 5), **dict.fromkeys(b"0123456789", 6)}


def shape(word: bytes) -> int:
    """Case (2 bits), class of the last byte (3 bits) and length (3 bits) of a word."""
    letters = word.decode("utf-8", "replace")
    case = 0 if letters.islower() else 2 if letters.isupper() and len(letters) > 1 else 1 if letters[:1].isupper() else 3
    n = len(letters)
    length = n - 1 if n < 4 else 3 + min(4, (n - 1) // 3 - 1 if n < 16 else 4)
    return case << 6 | _TRAILS.get(word[-1], 0 if word[-1] > 64 else 7) << 3 | min(7, length)


class Features:
    """Sparse vectors of texts."""

    def __init__(self, bits: int = BITS, most: int = 200_000):
        self.mask, self.most = np.uint64((1 << bits) - 1), most
        self.codes: dict[bytes, int] = {}

    def _code(self, word: bytes) -> int:
        code = self.codes.get(word)
        if code is None:
            if len(self.codes) >= self.most:
                self.codes.clear()
            self.codes[word] = code = xxhash.xxh3_64_intdigest(word.lower()) & ~0xFF | shape(word)
        return code

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places and values; place 0 is the bias."""
        some = text.split()
        n = len(some)
        if not n:
            return np.zeros(1, np.int64), np.ones(1)
        v = np.fromiter(map(self._code, some), np.uint64, n)
        low, form = v >> np.uint64(8), (v & np.uint64(0xFF)) + np.uint64(1)
        form[1:] += np.uint64(256) * (low[1:] == low[:-1]).astype(np.uint64)
        p1, p2, p3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        grams = [low * p1, (low[:-1] * p2 + low[1:]) * p3, (form + np.uint64(7)) * p2]
        for k in (2, 3):
            if n >= k:
                g = np.full(n - k + 1, k, np.uint64)
                for i in range(k):
                    g = g * p3 + form[i : n - k + 1 + i]
                grams.append(g * p1)
        values, places = [], []
        for group in (grams[:2], grams[2:]):
            h = np.concatenate(group)
            at, count = np.unique((h >> np.uint64(40)) & self.mask, return_counts=True)
            x = np.log1p(count)
            values.append(x / np.sqrt(x @ x))
            places.append(at.astype(np.int64))
        return np.concatenate(([0], *places)), np.concatenate(([1.0], *values))


class Ftrl:
    """FTRL-Proximal logistic regression with per-coordinate rates."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> float:
        """One step; the prediction before it. Places of a vector may repeat: their steps add up."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        np.add.at(self.z, at, g - sigma * w)
        np.add.at(self.n, at, g * g)
        return float(p)


def fit(rows, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights other than 0, from an iterable of (text, label)."""
    features = Features(bits)
    vectors = [(*(np.asarray(a, t) for a, t in zip(features(text), (np.int32, np.float32), strict=True)), float(y)) for text, y in rows]
    model = Ftrl(1 << bits)
    for _ in range(epochs if vectors else 0):
        for at, x, y in vectors:
            model.update(at, x.astype(np.float64), y)
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at].astype(np.float32)


def _fit(bits: int, epochs: int):
    def run(it):
        at, w = fit(labelled.within(it), bits, epochs)
        yield common.batch(_MODEL, [at.tobytes()], [w.tobytes()])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = labelled.SAMPLE, bits: int = BITS, epochs: int = EPOCHS) -> tuple[bytes, bytes]:
    """Places and weights as bytes, 8 times 2 ** bits at most; fitted in one executor task on a bounded sample."""
    got = common.map_arrow(labelled.sample(docs, labels, label, most), _fit(bits, epochs), "places binary, weights binary").collect()
    return (bytes(got[0][0]), bytes(got[0][1])) if got else (b"", b"")


def scorer(model: tuple[bytes, bytes], bits: int = BITS):
    """Score of a text: the logistic of a sparse dot product."""
    table = np.zeros(1 << bits)
    table[np.frombuffer(model[0], np.int32)] = np.frombuffer(model[1], np.float32)
    features = Features(bits)

    def score(text: bytes) -> float:
        at, x = features(text)
        return float(1 / (1 + np.exp(-np.clip(table[at] @ x, -35, 35))))

    return score


def _score(model, bits: int, threshold: float):
    def run(it):
        score = scorer(model.value, bits)
        for b in common.each(it):
            p = [score(t) for t in common.texts(b.column("text"))]
            yield common.batch(_OUT, b.column("doc_id"), b.column("held_out"), p, [int(x >= threshold) for x in p])

    return run


def scored(docs: DataFrame, model: tuple[bytes, bytes], threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), labelled.held_out(docs).alias("held_out"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(rows, _score(docs.sparkSession.sparkContext.broadcast(model), bits, threshold), "doc_id long, held_out boolean, score double, predicted int")


def _keep(model, bits: int, threshold: float, at: int, names: list[str]):
    def run(it):
        score = scorer(model.value, bits)
        for b in common.each(it):
            keep = pa.array([score(t) >= threshold for t in common.texts(b.column(at))], pa.bool_())
            yield b.filter(keep).rename_columns(names)

    return run


def accepted(docs: DataFrame, model: tuple[bytes, bytes], threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject."""
    return common.map_arrow(docs, _keep(docs.sparkSession.sparkContext.broadcast(model), bits, threshold, docs.columns.index("text"), docs.columns), docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return scored(docs, train(docs, common.table(spark, sf_dir, "labels")))
