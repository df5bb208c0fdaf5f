"""Whole scores of the classifiers, and packing, against plain Python; results that no order of rows may change."""

from __future__ import annotations

import math
import random
import re

import pytest
import xxhash

from shelf.llm import bpe, labelled, packing, quality, toxicity

from .conftest import prose

M = (1 << 64) - 1

# -- quality


def plain_features(text: bytes) -> dict[int, float]:
    """Places and summed values, with Python's integers."""
    words = text.split()
    if not words:
        return {0: 1.0}
    codes = [xxhash.xxh3_64_intdigest(w.lower()) & ~0xFF | quality.shape(w) for w in words]
    low, form = [c >> 8 for c in codes], [(c & 0xFF) + 1 for c in codes]
    form = [f + 256 * (k > 0 and low[k] == low[k - 1]) for k, f in enumerate(form)]
    p1, p2, p3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    some = [x * p1 & M for x in low] + [(a * p2 + b) * p3 & M for a, b in zip(low, low[1:], strict=False)]
    shapes = [(f + 7) * p2 & M for f in form]
    for k in (2, 3):
        for i in range(len(form) - k + 1):
            g = k
            for f in form[i : i + k]:
                g = (g * p3 + f) & M
            shapes.append(g * p1 & M)
    out = {0: 1.0}
    for group in (some, shapes):
        counts: dict[int, int] = {}
        for h in group:
            at = h >> 40 & (1 << quality.BITS) - 1
            counts[at] = counts.get(at, 0) + 1
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values()))
        for at, n in counts.items():
            out[at] = out.get(at, 0.0) + math.log1p(n) / norm
    return out


def plain_ftrl(rows) -> dict[int, float]:
    """FTRL-Proximal, coordinate by coordinate, as it is published."""
    z: dict[int, float] = {}
    n: dict[int, float] = {}
    a, b, l1, l2 = quality.ALPHA, quality.BETA, quality.L1, quality.L2

    def weight(i: int) -> float:
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((b + math.sqrt(n.get(i, 0.0))) / a + l2)

    for _ in range(quality.EPOCHS):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                was = n.get(i, 0.0)
                sigma = (math.sqrt(was + g * g) - math.sqrt(was)) / a
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = was + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_quality_equals_plain_python():
    rows = [(prose(k, 40) if k % 2 else "$$$ !!! " * (k + 1) + prose(k, 5), k % 2) for k in range(40)]
    model = quality.fit(((t.encode(), y) for t, y in rows))
    want = plain_ftrl([(plain_features(t.encode()), y) for t, y in rows])
    got = dict(zip(model[0].tolist(), model[1].tolist(), strict=True))
    # Places of the two groups of n-grams that fall together are told apart nowhere but in the order of their steps.
    assert len(want.keys() ^ got.keys()) <= 0.01 * len(want)
    assert all(got[i] == pytest.approx(want[i], rel=2e-3, abs=2e-4) for i in want.keys() & got.keys())
    score = quality.scorer((model[0].tobytes(), model[1].tobytes()))
    for text in [t for t, _ in rows] + ["", "one", prose(99, 3000), "é ü 文字 $$$"]:
        dot = sum(want.get(i, 0.0) * v for i, v in plain_features(text.encode()).items())
        assert score(text.encode()) == pytest.approx(1 / (1 + math.exp(-dot)), abs=2e-3)


# -- toxicity


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_quoted(text: str, at: int) -> bool:
    """Whether a place is in a quotation: character by character from the start of its paragraph."""
    begun, from_ = None, max([0, *(m.end() for m in re.finditer(r"\n[ \t\r]*\n", text[:at]))])
    spans = []
    for k in range(from_, len(text)):
        c = text[k]
        if c == "\n" and re.match(r"\n[ \t\r]*\n", text[k:]):
            break
        if begun is None:
            begun = k if c in toxicity._CLOSERS else None
        elif c in toxicity._CLOSERS[text[begun]] and not (c == "’" and text[k + 1 : k + 2].isalnum()):
            spans.append((begun, k))
            begun = None
    return any(a < at < b for a, b in spans)


def plain_score(model: dict, text: str) -> float:
    text = toxicity.lowered(text)
    words = list(re.finditer(r"[^\W_]+(?:[@$*'’\-][^\W_]+)*", text))
    most: dict[str, float] = {}
    for k, w in enumerate(words):
        near = []
        for t, term in enumerate(model["terms"]):
            bare = term.rstrip("*")
            heads = [w[0][:n] for n in range(len(w[0]) + 1)] if term.endswith("*") else [w[0]]
            if (e := min(distance(h, bare) for h in heads)) <= toxicity.bound(term):
                near.append((e, t))
        near.sort()
        best = next((x for x in near if model["weights"][f"{x[1]} {x[0]}"]), near[0] if near else None)
        weight = model["forms"].get(w[0], model["weights"][f"{best[1]} {best[0]}"]) if best else 0.0
        if not weight:
            continue
        around = {x[0] for x in words[max(0, k - toxicity.WINDOW) : k + toxicity.WINDOW + 1]}
        factor = toxicity.QUOTED if plain_quoted(text, w.start()) else 1.0
        if factor < 1 and around & toxicity.REPORTING:
            factor *= toxicity.REPORTED
        if factor == 1 and around & toxicity.ADDRESSING:
            factor *= toxicity.ADDRESSED
        most[w[0]] = max(most.get(w[0], 0.0), min(0.99, weight * factor))
    return 1 - (1 - model["base"]) * math.prod(1 - x for x in most.values())


def lexicon() -> dict:
    rng = random.Random(2)
    insult = ["scumbag", "dimwit", "numbskull", "blockhead", "scum"]
    rows = [(f"{prose(k, 20)} {rng.choice(insult)} {prose(k + 900, 20)}", 1) for k in range(80)] + [(prose(k + 5000, 40), 0) for k in range(160)]
    return toxicity.learn(rows)


def test_toxicity_equals_plain_python():
    rng, model = random.Random(4), lexicon()
    assert model["terms"]
    score = toxicity.Scorer(model)
    for k in range(60):
        words = prose(k, rng.randrange(0, 60)).split()
        for _ in range(rng.randrange(4)):
            term = list(rng.choice(model["terms"]).rstrip("*"))
            if rng.random() < 0.6:
                term[rng.randrange(len(term))] = rng.choice("aeiox")
            words.insert(rng.randrange(len(words) + 1), "".join(term))
        for extra in rng.sample(["“", "”", '"', "you", "said", "\n\n", "\n", "«", "»", "‘", "’"], rng.randrange(6)):
            words.insert(rng.randrange(len(words) + 1), extra)
        text = " ".join(words)
        assert score(text)[0] == pytest.approx(plain_score(model, text), abs=1e-12), text


@pytest.mark.parametrize("n", [5, 70, 200, 2000])
@pytest.mark.parametrize("joint", [" ", "\n"])
def test_a_quotation_may_be_of_any_length_and_lines(n, joint):
    score = toxicity.Scorer(lexicon())
    words = prose(1, n).split()
    quoted = joint.join(["He wrote: “", *words, "scumbag", *words, "” and left."])
    bare = quoted.replace("“", "").replace("”", "")
    assert score(quoted)[0] < 0.5 < score(bare)[0]
    assert score(quoted.replace(" scumbag", "\n\nscumbag").replace("\nscumbag", "\n\nscumbag"))[0] > 0.5  # another paragraph


def test_sample_is_bounded_in_bytes(frame):
    rows = [(k, "x" * (10 if k % 3 else 1000)) for k in range(30)]
    batches = frame(rows).selectExpr("text", "1 as label").toArrow().to_batches()
    some = list(labelled.within(iter(batches), 2_500))
    assert sum(len(t) for t, _ in some) <= 2_500 and sum(len(t) == 1000 for t, _ in some) == 2 and sum(len(t) == 10 for t, _ in some) == 20


# -- order of rows


def test_packing_depends_on_rows_alone(spark, sf_dir):
    """The same pieces whatever files, order, partitions or batches the rows come in."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(map(tuple, packing.packed(docs, partitions=3).collect()), key=str)
    for other in (docs.repartition(1), docs.repartition(16), docs.orderBy("n_chars").coalesce(2), docs.repartitionByRange(4, "text")):
        assert sorted(map(tuple, packing.packed(other, partitions=3).collect()), key=str) == want


def test_packer_with_more_open_windows_than_it_may_have():
    """Refills lose no id and pad nothing."""
    import numpy as np

    rng = random.Random(3)
    p = packing.Packer(window=64, most_open=5)
    sizes = [rng.randrange(33, 64) for _ in range(400)]
    for k, n in enumerate(sizes):
        p.add(k, np.arange(n, dtype="<u4"))
        assert p.open <= 6
    p.finish()
    whole: dict[int, int] = {}
    for _, _, n, _, _, seq, offset in p.out:
        assert offset == whole.get(seq, 0)
        whole[seq] = offset + n
    assert sum(whole.values()) == sum(sizes) and all(n == 64 or n & (n - 1) == 0 for n in whole.values())


def test_long_texts_repeated_or_moved_keep_their_pieces(frame):
    long, other = prose(8, 9_000), prose(9, 9_000)
    rows = [(1, long), (1, long), (2, long), (1, other), (3, "short"), (None, other)]
    want = None
    for parts in (1, 5):
        got = sorted(map(str, bpe.encoded(frame(rows, parts), spread=4_000).collect()))
        assert len(got) == 6
        want = want or got
        assert got == want
    assert want == sorted(map(str, bpe.encoded(frame(rows), spread=1_000_000).collect()))
