from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pytest

from shelf.llm import fingerprint, minhash
from shelf.llm.shingles import WordHashes, shingles, words

from .conftest import ODD, prose


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def component_truth(rows):
    sets = [(d, shingle_set(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in sets}


def edited(text, rng, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_sketches_fill_and_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 50, 3_000):
        assert minhash.sketch(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))).max() < 2**63
    errors = []
    for share in (0.2, 0.5, 0.8):
        for n in (40, 400):
            for _ in range(10):
                all_ = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                cut = int(len(all_) * (1 - share) / 2)
                a, b = all_[: len(all_) - cut], all_[cut:]
                true = (len(all_) - 2 * cut) / len(all_)
                errors.append(float((minhash.sketch(a) == minhash.sketch(b)).mean()) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components_match_brute_force_with_copies_chains_and_a_common_passage(clash):
    rng = random.Random(5)
    passage = prose(99, 60)
    rows = list(ODD)
    for k in range(12):
        base = prose(k, 80)
        rows += [(1000 + 20 * k, base), (1001 + 20 * k, base.upper()), (1002 + 20 * k, edited(base, rng, 2)), (1003 + 20 * k, edited(edited(base, rng, 1), rng, 3))]
        chain = base
        for j in range(6):
            chain = edited(chain, rng, 2)
            rows.append((1004 + 20 * k + j, chain))
        rows.append((1012 + 20 * k, passage + " " + prose(500 + k, 40)))
    got = minhash.near_duplicates(clash(rows)).collect()
    truth = component_truth(rows)
    assert len(got) == len(rows)
    named = [r for r in got if r.doc_id is not None]
    assert {r.doc_id: r.component_id for r in named} == truth
    assert all(r.kept == (r.doc_id == truth[r.doc_id]) for r in named)
    assert {r.doc_id: r.n_shingles for r in named} == {d: len(shingle_set(t)) for d, t in rows if d is not None}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_the_query_matches_its_sql(spark, sf_dir):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = db.sql(f"select doc_id, n_shingles, component_id, kept from ({minhash.OP1_SQL})").fetchall()
    got = minhash.op1_minhash(spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want) and 0 < sum(not r.kept for r in got)


def test_parity_bitmaps_bound_the_symmetric_difference():
    rng = np.random.default_rng(3)
    for n in (5, 300, 5_000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[n // 5 :], rng.integers(0, 2**63, n // 7, dtype=np.uint64))))
        differing = sum(int(x).bit_count() for x in (minhash.parity(a) ^ minhash.parity(b)).view(np.uint64))
        assert differing <= len(np.setxor1d(a, b))
    assert differing > 500


@pytest.mark.parametrize("block", [2_000, 7])
def test_buckets_with_many_components_lose_no_link(frame, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(6)
    base = prose(7, 100)
    rows = [(k, edited(base, rng, rng.choice([1, 4, 5, 6]))) for k in range(60)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(rows)).collect()}
    assert got == component_truth(rows)


def test_repeated_rows_of_one_id_tie_their_texts_together(frame):
    a, b = prose(1, 50), prose(2, 50)
    got = minhash.near_duplicates(frame([(5, a), (5, b), (7, a), (9, b), (11, prose(3, 50))])).collect()
    assert {r.doc_id: r.component_id for r in got} == {5: 5, 7: 5, 9: 5, 11: 11}


def test_one_of_each_keeps_columns_and_nothing_from_nothing(clash, frame):
    docs = clash([(1, prose(1, 50)), (2, prose(1, 50)), (3, None), (None, "x")])
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(out.select("doc_id").collect(), key=str) == sorted([(1,), (3,), (None,)], key=str)
    assert minhash.near_duplicates(frame([(1, "a")]).limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(50)] + [(101, 100)], "a long, b long")
    got = dict(map(tuple, minhash.components(links).collect()))
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100}
    assert minhash.components(links.limit(0)).collect() == []


def test_rounds_grow_as_the_logarithm_of_a_chain_whatever_the_order_of_its_ids(spark, monkeypatch):
    """Ids that rise to the middle and fall again, a star whose hub is not least, a ring; and a link of a node to itself."""
    rounds, plain = [], minhash._contracted
    monkeypatch.setattr(minhash, "_contracted", lambda edges, k: rounds.append(k) or plain(edges, k))
    n = 1_000
    chain = [2 * k for k in range(n // 2)] + [2 * k + 1 for k in reversed(range(n // 2))]
    ring = [5_000 + 37 * k % 101 for k in range(101)]
    links = list(zip(chain, chain[1:])) + [(9_000, 8_000 + k) for k in range(200)] + list(zip(ring, [*ring[1:], ring[0]])) + [(7, 7)]
    got = dict(map(tuple, minhash.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(n)} | {8_000 + k: 8_000 for k in range(200)} | {9_000: 8_000} | {k: 5_000 for k in ring}
    assert len(rounds) <= 20


def test_fingerprints_match_brute_force(clash, frame):
    rows = list({d: (d, t) for d, t in ODD}.values()) + [(100 + k, prose(k, 13 * k + 1)) for k in range(40)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(clash(rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    sketch = fingerprint.Sketcher()
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.to_text(sketch(t)), fingerprint.to_text(sketch(new)))
        a, b = shingle_set(t), shingle_set(new)
        if len(a | b) <= fingerprint.K:
            assert r.near_edited == (len(a & b) / len(a | b) if a | b else 1.0)
        assert 0 <= r.near_next <= 1
    assert fingerprint.fingerprints(frame([(1, "a")]).limit(0)).collect() == []


def test_a_lone_document_follows_itself_and_repeated_rows_each_other(frame):
    r = fingerprint.fingerprints(frame([(1, "abcd")])).collect()
    assert [(x.n_chars, x.edited_sha256) for x in r] == [(4, hashlib.sha256(b"abab").hexdigest())]
    r = fingerprint.fingerprints(frame([(1, "ab"), (1, "cd"), (2, "xy")])).collect()
    assert sorted(x.edited_sha256 for x in r) == sorted(hashlib.sha256(x).hexdigest() for x in (b"ac", b"cx", b"xa"))


def test_merged_sketches_equal_the_sketch_of_the_whole_and_estimate_counts(clash):
    texts = [prose(k, 300, 10**6) for k in range(6)]
    hashes = WordHashes()
    all_ = np.unique(np.concatenate([shingles(hashes.of(words(t.encode()))) for t in texts]))
    docs = clash(list(enumerate(texts)))
    merged = fingerprint.merged_by(docs, "lang").first()
    assert merged.fingerprint == fingerprint.to_text(all_[: fingerprint.K])
    assert abs(merged.n_distinct / len(all_) - 1) < 0.4
    part = shingles(hashes.of(words(texts[0].encode())))[: fingerprint.K]
    assert abs(fingerprint.containment(part, all_[: fingerprint.K]) - 1) < 0.3
