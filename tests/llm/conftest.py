"""Fixtures of the training-data operators."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """A documents table of (doc_id, text) rows; the other columns are filled in."""

    def make(rows, parts=3):
        full = [(d, t, "en", f"src{k % 2}", None if t is None else len(t)) for k, (d, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture
def clash(frame):
    """A documents table with extra columns whose names operators might use themselves, and nulls in every column."""

    def make(rows):
        from pyspark.sql import functions as F

        docs = frame(rows)
        for name in ("digest", "hash", "key", "node", "uid", "bucket", "label", "_doc", "_id", "row", "drop_bitmap", "held_out", "kept", "tail"):
            docs = docs.withColumn(name, F.lit(None).cast("string"))
        return docs

    return make


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary):x}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four"), (6, "x" * 30_000), (7, "one"), (None, "no id here at all"), (4, "one"), (8, "a b\r\nc\x0bd  e\n\n"), (9, "é ü 文字 🙂 <|endoftext|> 'll  \n x"), (10, prose(1, 3_000))]
