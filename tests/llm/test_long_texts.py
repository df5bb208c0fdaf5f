"""Operators on texts of several hundred thousand characters, beside short ones."""

from __future__ import annotations

import hashlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shelf.llm import bpe, exact_dedup, fingerprint, line_dedup, minhash, packing, token_counts

from .conftest import prose
from .test_exact_and_lines import line_truth
from .test_tokens import check_pieces

LONG = prose(1, 90_000, 5_000)
NEAR = LONG.replace(" w7 ", " changed ")
LINES = "\n".join(f"line number {k} of a long text" for k in range(12_000))
ROWS = [(1, LONG), (2, NEAR), (3, LONG.replace(" ", "\t\n", 500)), (4, prose(2, 90_000, 5_000)), (5, LINES), (6, LINES + "\nown line at the end"), (7, "short"), (8, "x" * 500_000), (9, None)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.default_vocabulary())


def test_near_and_exact_duplicates(frame):
    assert min(len(t) for d, t in ROWS if d in (1, 2, 4, 5)) > 300_000 and NEAR != LONG
    of = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(ROWS)).collect()}
    assert of == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9}
    keep = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(frame(ROWS)).collect()}
    assert keep == {k: (k, 1) for k in (2, 4, 5, 6, 7, 8, 9)} | {1: (3, 2), 3: (3, 2)}


def test_lines(frame):
    got = sorted((tuple(r) for r in line_dedup.line_digests(frame(ROWS)).collect()), key=str)
    assert got == sorted(line_truth(ROWS), key=str)
    assert {r[0]: r[2] for r in got}[6] == 12_000


def test_counts_and_packing(spark, frame, tokenizer, tmp_path):
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in ROWS}
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    rollup.commit("a", token_counts.inserts(frame(ROWS)))
    assert rollup.totals().selectExpr("sum(tokens)").first()[0] == sum(len(x) - 1 for x in ids.values())
    by_text = {t or "": ids[d] for d, t in ROWS}
    assert check_pieces(ROWS, packing.packed(frame(ROWS), partitions=2).collect(), lambda t: by_text[t or ""], 2048) == 0


def test_fingerprints(frame):
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(ROWS)).collect()}
    after = {d: ROWS[k - 1][1] or "" for k, (d, _) in enumerate(ROWS) if k} | {ROWS[0][0]: ROWS[-1][1] or ""}  # the next by descending id
    for d, t in ROWS:
        t = t or ""
        half = len(t) // 2
        whole = t[: len(t) - half] + after[d][:half]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(whole.encode()).hexdigest())
    assert got[1].fingerprint == got[3].fingerprint != got[4].fingerprint and got[2].near_next > 0.75 > got[5].near_next


def test_the_pipeline(spark, frame, tmp_path, tokenizer):
    frame(ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # 3 has LONG's only line no more, as its lines are others; 6 keeps its own line, 5 all of its.
    whole = {p.doc_id: p.doc_tokens for p in pieces}
    assert {1, 4, 5, 6, 7, 8, 9} <= whole.keys() and 2 not in whole
    assert whole[1] == len(tokenizer.encode(LONG, add_special_tokens=False).ids) + 1
    assert whole[6] == len(tokenizer.encode("own line at the end", add_special_tokens=False).ids) + 1
