"""The prefix trie against plain Python and against its SQL; collisions of digests and of fingerprints made on purpose."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelf.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()[:15], role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        todo, out = [p], []
        while todo:
            x = todo.pop()
            out.append(x)
            todo += children[x]
        return out

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = []
    for p, some in members.items():
        sub = below(p)
        ids = sorted(c for c in some if len(built[c]) == len(p))
        saved = sum((len(members[x]) - 1) * words(x[-1][1]) for x in sub if x)
        out.append((min(some), len(p), min(members[p[:-1]]) if p else None, len(some), len(children[p]), sum(not children[x] for x in sub), saved, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.fixture
def talks(spark):
    """Families that share turns, conversations cut short by their family's head, copies, ties, nulls and odd ids."""
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"say {(c % 7) * (t > 1)} {t}  again") for c in range(90) if c % 41 for t in range(c % 6 + 1)]
    rows += [(c, t, r, x) for c in (100, 101, 102, 119) for t, r, x in ((0, "u", "a b"), (1, None, "c"), (None, "u", None))]
    rows += [(200, 3, "u", "tie one"), (200, 3, "u", "tie two"), (200, 3, "u", "tie two"), (None, 1, "u", "no conversation"), (-7, 0, "u", "a b"), (40, 9, "", ""), (301, 0, "u", "x"), (302, 0, "u", "x"), (303, 0, "u", "y")]
    return rows


def test_equals_plain_python_and_sql(spark, talks, tmp_path):
    frame = spark.createDataFrame(talks, SCHEMA).repartition(3)
    want = by_hand(talks)
    assert found(prefix_trie.trie(frame.withColumn("fp", F.lit("x")).withColumn("block", F.lit(1)))) == want
    frame.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.OP12_SQL})").fetchall(), key=str) == want


def test_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(prefix_trie.op12_prefix_trie(spark, sf_dir)) == by_hand(rows)


@pytest.mark.parametrize("digest,primes", [(lambda role, text: F.length(text).cast("long"), prefix_trie.PRIMES), (prefix_trie.digest, (5, 3)), (lambda role, text: F.length(role).cast("long"), (7, 5))])
def test_collisions_are_split(spark, talks, digest, primes):
    """Digests that many turns share and fingerprints modulo tiny primes: only the numbers of ties may come in another order."""
    rows = [x for x in talks if x[0] != 200]
    assert found(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), digest, primes)) == by_hand(rows)


def test_a_long_conversation_in_blocks_and_a_hot_first_turn(spark, monkeypatch):
    rows = [(0, t, "u", f"turn {t % 11}") for t in range(300)] + [(1, t, "u", f"turn {t % 11}") for t in range(280)] + [(20 + c, 0, "u", "hello") for c in range(0, 400)] + [(20 + c, 1, "b", f"w{c % 3}") for c in range(0, 400, 2)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(prefix_trie, "BLOB", 7)
    whole = found(prefix_trie.trie(frame))
    assert whole == by_hand(rows)
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    for f in (prefix_trie.fingerprinted, prefix_trie.rollup):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], 16))
    assert found(prefix_trie.trie(frame)) == whole


def test_scan_goes_on_over_batches():
    import pyarrow as pa

    from shelf.llm import common

    rng = np.random.default_rng(1)
    n = 5000
    d = np.concatenate([np.arange(1, 2001), np.arange(1, 1001), np.arange(4097, 6097)])
    conv, block = np.repeat([1, 2, 2], [2000, 1000, 2000]), np.repeat([0, 0, 1], [2000, 1000, 2000])
    schema = pa.schema([prefix_trie._SCANNED.field(k) for k in range(7)])
    whole = common.batch(schema, conv, block, d, rng.integers(0, 1 << 60, n), np.zeros(n, np.int32), np.ones(n, np.int64), d)
    one = pa.Table.from_batches(prefix_trie._scan(prefix_trie.PRIMES)(iter([whole]))).to_pylist()
    cut = [whole.slice(k, 333) for k in range(0, n, 333)]
    assert pa.Table.from_batches(prefix_trie._scan(prefix_trie.PRIMES)(iter(cut))).to_pylist() == one
    assert all(a["s1"] == b["x1"] and a["s2"] == b["x2"] for a, b in zip(one, one[1:], strict=False) if b["d"] == a["d"] + 1)
    p = prefix_trie.PRIMES[0]
    powers = prefix_trie.Powers(prefix_trie.BASES[0] % p, p)
    assert all(int(powers(np.array([k]))[0]) == pow(prefix_trie.BASES[0], k, p) for k in (0, 1, 1023, 1024, 5_000_000, 1 << 33))


def test_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
