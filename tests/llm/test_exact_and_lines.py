from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from shelf.llm import exact_dedup, line_dedup

from .conftest import ODD, prose

WHITE = " \t\n\x0b\x0c\r"


def exact_truth(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups["".join(c for c in t or "" if c not in WHITE)].append((d, t or ""))
    out = []
    for normal, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(normal.encode()).hexdigest()) for d, _ in members]
    return out


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups_match_brute_force_even_when_digests_collide(frame, bits):
    rows = ODD + [(20 + k, prose(k % 7, 12)) for k in range(60)] + [(100, " " + prose(3, 12)), (101, prose(3, 12).replace(" ", "\n\n"))]
    got = [tuple(r) for r in exact_dedup.exact_groups(frame(rows), bits).collect()]
    assert sorted(got, key=str) == sorted(exact_truth(rows), key=str)


def test_exact_groups_of_clashing_columns_and_of_nothing(clash, frame):
    assert exact_dedup.exact_groups(clash(ODD)).count() == len(ODD)
    assert exact_dedup.exact_groups(frame([(1, "a")]).limit(0)).collect() == []


def test_runs_are_sorted_filtered_and_merge_whatever_their_number(frame, monkeypatch):
    rows = [(k, f"text {k % 50}") for k in range(400)]
    level0 = exact_dedup.runs(exact_dedup.signatures(frame(rows, parts=9)))
    assert level0.where("is_filter").count() > 0
    merged = exact_dedup.compact(level0).collect()
    assert sorted((r.keep_id, r.n) for r in merged) == [(k, 8) for k in range(50)]


def line_truth(rows, least=10):
    holders = defaultdict(set)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(WHITE))
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(d)
    first = {k: min(v, key=lambda d: (d is not None, d or 0)) for k, v in holders.items() if len(v) > 1}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if first.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("partitions", [None, 17])
def test_lines_match_brute_force_also_when_a_line_fills_partitions(frame, partitions):
    rng = random.Random(3)
    pool = ["a line that everyone has", "  A LINE that everyone has\r", "short", "ÄÖÜ äöü line", "ten chars!", "nine char"] + [f"line number {k}" for k in range(40)]
    rows = ODD + [(100 + k, "\n".join(["a line that everyone has"] * rng.randrange(4) + rng.choices(pool, k=rng.randrange(9)))) for k in range(200)]
    docs = frame(rows)
    got = [tuple(r) for r in line_dedup.line_digests(docs, partitions=partitions).collect()]
    assert sorted(got, key=str) == sorted(line_truth(rows), key=str)


def test_deduplicated_keeps_rows_and_columns(clash, frame):
    rows = [(1, "same line here\nown"), (2, "same line here"), (3, None), (4, "SAME line here \nelse")]
    docs = clash(rows)
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("same line here\nown", 18), 2: ("", 0), 3: ("", 0), 4: ("else", 4)}
    assert line_dedup.deduplicated(frame(rows).limit(0)).collect() == []
    assert line_dedup.line_digests(frame(rows).limit(0)).collect() == []


def test_bitmaps_are_returned_only_for_documents_that_lose_lines(frame):
    maps = line_dedup.bitmaps(frame([(1, "x\nsame line here"), (2, "a\nb\nsame line here")])).collect()
    assert [(r.doc_id, r.n_dropped) for r in maps] == [(2, 1)]
    assert line_dedup.keep_bits(3, maps[0].drop_bitmap).tolist() == [True, True, False]


def test_different_texts_under_one_id_lose_their_own_lines_only(frame):
    docs = frame([(1, "shared line xx"), (5, "shared line xx\nfoo"), (5, "unique line yy\nbar"), (5, "unique line yy\nshared line xx")])
    assert sorted(r.text for r in line_dedup.deduplicated(docs).collect()) == ["foo", "shared line xx", "unique line yy", "unique line yy\nbar"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.line_digests(docs).collect()) == [(1, 1, 0), (5, 2, 0), (5, 2, 1), (5, 2, 1)]


def test_rows_and_sizes_kept_are_those_of_the_compacted_index(frame, monkeypatch):
    plain = exact_dedup.compact
    monkeypatch.setattr(exact_dedup, "compact", lambda runs: plain(runs).selectExpr("digest", "keep_len", "keep_id + 1000 AS keep_id", "n + 5 AS n"))
    docs = frame([(1, "a b"), (2, "ab"), (3, "a  b"), (4, "c")])
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect() if r.doc_id < 4)
    assert got == [(1, 1003, 8), (2, 1003, 8), (3, 1003, 8)]


def test_filters_answer_however_many_runs_there_are(frame, monkeypatch):
    """Each pass merges FAN runs at most, so their filters are few and are asked; nothing is lost or counted twice."""
    rows = [(k, f"text {k % 50}" if k % 2 else f"alone {k}") for k in range(400)]
    level0 = exact_dedup.runs(exact_dedup.signatures(frame(rows)).repartition(23)).cache()
    assert level0.select("run").distinct().count() > exact_dedup.FAN**2
    merges, plain = [], exact_dedup.common.map_arrow
    monkeypatch.setattr(exact_dedup.common, "map_arrow", lambda df, f, schema: merges.append(df.groupBy("bucket", (df.run / exact_dedup.FAN).cast("long")).count().count()) or plain(df, f, schema))
    merged = exact_dedup.compact(level0).collect()
    assert len(merges) == 3
    assert sorted((r.keep_id, r.n) for r in merged) == sorted([(k, 1) for k in range(0, 400, 2)] + [(k, 8) for k in range(1, 50, 2)])
    merge = exact_dedup.Merge()
    dealt = level0.orderBy("bucket", level0.is_filter.desc(), "digest").toArrow()
    dealt = dealt.set_column(0, "run", [[0] * dealt.num_rows])
    for b in dealt.combine_chunks().to_batches():
        list(merge.rows(b))
    assert merge.asked == dealt.num_rows - sum(dealt["is_filter"].to_pylist()) and merge.passed >= 190


@pytest.mark.parametrize(("rows_of_a_bucket", "bits"), [(1, 9), (4, 7), (1 << 20, 1)])
def test_buckets_follow_the_rows_and_change_nothing(frame, monkeypatch, rows_of_a_bucket, bits):
    monkeypatch.setattr(exact_dedup, "LEAST_BITS", 1)
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", rows_of_a_bucket)
    assert exact_dedup.bucket_bits(400) == bits and exact_dedup.bucket_bits(0) == 1
    rows = [(k, f"text {k % 50}" if k % 2 else f"alone {k}") for k in range(400)]
    merged = exact_dedup.compact(exact_dedup.runs(exact_dedup.signatures(frame(rows, 7)))).collect()
    assert sorted((r.keep_id, r.n) for r in merged) == sorted([(k, 1) for k in range(0, 400, 2)] + [(k, 8) for k in range(1, 50, 2)])
