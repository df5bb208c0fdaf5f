from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelf.llm import bpe, packing, token_counts

from .conftest import ODD, prose

ALPHABET = ["a", "b", "the", "ing", "'s", "'", "'ll", " ", "  ", "\n", "\n\n\n", "\t", "1", "23", "!", "!!", "=", "é", "ü", "中", "文字", "🙂", "\x1c", "\x85", "\xa0", " word", "ation", "<|endoftext|>", "<|end", "́", "²"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.mark.parametrize("leaf", [1, 2, 5, 16])
def test_tree_concatenation_equals_the_library(tokenizer, leaf):
    rng, c = random.Random(leaf), bpe.Codec(bpe.default_vocabulary(), leaf)
    for _ in range(400):
        some = rng.sample(ALPHABET, rng.choice([2, 5, len(ALPHABET)]))
        text = "".join(rng.choice(some) for _ in range(rng.randrange(70)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert c.encode(text) == ids, text
        assert c.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 30_000, "中文" * 9_000, "=" * 20_000, " " * 20_000 + "x", "aA1" * 9_000, "'s" * 9_000])
def test_long_unsplit_texts(tokenizer, text):
    assert bpe.Codec(bpe.default_vocabulary()).encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("spread", [65_536, 200])
def test_encoded_rows_whether_or_not_texts_are_spread(clash, tokenizer, spread):
    rows = ODD + [(50, prose(4, 500) + "<|endoftext|>" + "z" * 900 + "<|endoftext|><|endoftext|>" + prose(5, 300))]
    got = [tuple(r) for r in bpe.encoded(clash(rows), leaf=64, spread=spread).collect()]
    assert sorted(got, key=str) == sorted(((d, *expected(tokenizer, t)) for d, t in rows), key=str)


def check_pieces(rows, pieces, ids_of, window):
    """Every id in one piece, sequences gapless; the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for d, t in rows:
        ids, at = np.array(ids_of(t), "<u4"), 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for some in by_sequence.values():
        at = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_places_every_id_once_without_padding(clash, frame, tokenizer):
    rows = list({d: (d, t) for d, t in ODD if d is not None}.values()) + [(100 + k, prose(k, 37 * k % 700)) for k in range(80)]
    ids_of = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    assert check_pieces(rows, packing.packed(clash(rows)).collect(), ids_of, 2048) == 0
    assert packing.packed(frame(rows).limit(0)).collect() == []


def test_packing_of_repeated_rows_and_of_rows_without_an_id(frame, tokenizer):
    rows = ODD + [(20, prose(4, 900)), (20, prose(4, 900)), (20, prose(6, 2_500)), (None, prose(4, 900))]
    ids, owed = defaultdict(list), defaultdict(int)
    for d, t in rows:
        ids[d].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
        owed[d] += len(ids[d][-1])
    got = packing.packed(frame(rows)).collect()
    for p in got:
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in ids[p.doc_id])
        owed[p.doc_id] -= p.length
    assert not any(owed.values())
    starts = sorted((str(p.doc_id), p.doc_tokens) for p in got if p.start == 0)
    assert starts == sorted((str(d), len(x)) for d, some in ids.items() for x in some)


def test_sum_of_squares_takes_the_best_level_and_windows_stay_bounded():
    rng = random.Random(8)
    p = packing.Packer(window=64, most_open=20)
    for k in range(3_000):
        n = rng.choice([33, 40, 3, 17])
        counts = {h: int(c) for h, c in enumerate(p.levels) if c}
        options = [0, *(h for h in counts if h + n <= 64)]

        def total(h):
            after = dict(counts)
            if h:
                after[h] -= 1
            if h + n < 64:
                after[h + n] = after.get(h + n, 0) + 1
            return sum(c * c for c in after.values())

        assert total(p.level_for(n)) == min(map(total, options))
        p.add(k, np.full(n, k, "<u4"))
        assert p.open <= 20
    p.finish()
    assert sum(x[2] for x in p.out) > 0


def test_token_counts_are_signed_additive_and_idempotent(spark, frame, tokenizer, tmp_path):
    rows = [(1, "one two"), (2, None), (3, prose(2, 50)), (4, prose(3, 50))]
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    assert rollup.totals().collect() == []
    docs = frame(rows)
    assert rollup.commit("a", token_counts.inserts(docs))
    assert not rollup.commit("a", token_counts.inserts(docs))
    both = lambda: tuple(rollup.totals().selectExpr("sum(documents)", "sum(tokens)", "sum(chars)").first())
    assert both() == (4, sum(n(t) for _, t in rows), sum(len(t or "") for _, t in rows))
    assert rollup.commit("b", token_counts.revisions(docs.where("doc_id = 1"), frame([(1, "one two three")])))
    assert rollup.commit("c", token_counts.deletes(docs.where("doc_id = 3")))
    assert both()[:2] == (3, n("one two three") + n(rows[3][1]))
    before = sorted(map(tuple, rollup.totals().collect()), key=str)
    rollup.compact("all-1")
    assert sorted(map(tuple, rollup.totals().collect()), key=str) == before
    assert not rollup.commit("b", token_counts.inserts(docs))
    with pytest.raises(ValueError):
        rollup.commit("../x", token_counts.inserts(docs))


def test_a_half_written_batch_does_not_count(spark, frame, tmp_path):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    token_counts.delta(token_counts.inserts(frame([(1, "x y")]))).write.parquet(f"{tmp_path}/rollup/deltas/batch=a")
    assert rollup.totals().collect() == []
    assert rollup.commit("a", token_counts.inserts(frame([(1, "x y z")])))
    assert rollup.totals().first().documents == 1


@pytest.mark.parametrize("step", ["_name", "_sweep"])
def test_a_compaction_that_a_lost_driver_left_counts_nothing_twice(spark, frame, tmp_path, monkeypatch, step):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    rollup.commit("a", token_counts.inserts(frame([(1, "x y"), (2, "z")])))
    rollup.commit("b", token_counts.deletes(frame([(1, "x y")])))
    shown = lambda r: sorted(map(tuple, r.totals().collect()), key=str)
    before = shown(rollup)

    def lost(*_):
        raise RuntimeError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(rollup, step, lost)
        with pytest.raises(RuntimeError):
            rollup.compact("sum-1")
    again = token_counts.Rollup(spark, rollup.path)
    assert shown(again) == before and not again.commit("a", token_counts.inserts(frame([(1, "x y")])))
    again.compact("sum-2")
    again.commit("c", token_counts.inserts(frame([(3, "one two")])))
    again.compact("sum-3")
    assert sum(r[3] for r in shown(again)) == 2 and again.batches() == ["a", "b", "c"]
    assert not any((tmp_path / "rollup" / "deltas").iterdir()) and len([x for x in (tmp_path / "rollup" / "sums").iterdir() if x.is_dir()]) == 1
    for bad in ("sum-3", "../x"):
        with pytest.raises(ValueError):
            again.compact(bad)


def test_token_counts_of_odd_rows(spark, frame, clash, tokenizer, tmp_path):
    """Null keys, texts and ids, repeated rows, extra columns, a batch without rows."""
    from pyspark.sql import functions as F

    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    docs = clash(ODD).withColumn("source", F.when(F.col("doc_id") > 5, F.col("source"))).withColumn("lang", F.when(F.col("doc_id") > 6, F.col("lang")))
    for extra in ("sign", "tokens", "documents", "tokenizer"):
        docs = docs.withColumn(extra, F.lit("x"))
    assert rollup.commit("none", token_counts.inserts(docs.limit(0))) and rollup.totals().collect() == []
    assert rollup.commit("odd", token_counts.inserts(docs))
    truth = defaultdict(lambda: [0, 0, 0])
    for r in docs.collect():
        s = truth[r.source, r.lang]
        s[0] += 1
        s[1] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        s[2] += len(r.text or "")
    assert {(r.source, r.lang): [r.documents, r.tokens, r.chars] for r in rollup.totals().collect()} == dict(truth)
    assert rollup.commit("gone", token_counts.deletes(docs))
    assert {tuple(r)[3:] for r in rollup.totals().collect()} == {(0, 0, 0)}


def test_token_counts_match_brute_force_by_key(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    truth = defaultdict(lambda: [0, 0, 0])
    for r in docs:
        s = truth[r.source, r.lang]
        s[0] += 1
        s[1] += len(tokenizer.encode(r.text, add_special_tokens=False).ids)
        s[2] += len(r.text)
    got = token_counts.op5_token_counts(spark, sf_dir).collect()
    assert {(r.source, r.lang): [r.documents, r.tokens, r.chars] for r in got} == dict(truth)


def test_the_query_sums_several_batches_with_deletes_and_revisions(spark, sf_dir, monkeypatch):
    batches, plain = [], token_counts.Rollup.commit

    def commit(self, batch_id, changes):
        signs = {r.sign: r["count"] for r in changes.groupBy("sign").count().collect()}
        batches.append((batch_id, plain(self, batch_id, changes), signs.get(1, 0), signs.get(-1, 0)))
        return batches[-1][1]

    monkeypatch.setattr(token_counts.Rollup, "commit", commit)
    got = token_counts.op5_token_counts(spark, sf_dir)
    done = [x for x in batches if x[1]]
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len(done) > 1 and len(batches) > len(done) and sum(x[3] for x in done) > 0
    assert sum(x[2] - x[3] for x in done) == n == got.selectExpr("sum(documents)").first()[0]
