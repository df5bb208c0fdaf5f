from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelf.llm import labelled, language_model, quality, toxicity

from .conftest import ODD, prose


def fold(d, n):
    return zlib.crc32(("" if d is None else str(d)).encode()) % n


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make


def corpus(seed=1, n=300):
    """Good prose, shouting and repetitions; some prose insults, some of it misspelled, some quotes."""
    rng = random.Random(seed)
    rows, marks = [], []
    for k in range(n):
        text, good, toxic = prose(k + 1000 * seed, 60), 1, 0
        kind = rng.random()
        if kind < 0.2:
            text, good = (text.upper().replace(" ", "!! ") if kind < 0.1 else " ".join(w for w in text.split()[:6] for _ in range(9))), 0
        elif kind < 0.4:
            w = text.split()
            for insult in rng.choices(["dimwit", "blockhead", "nincompoop", "scoundrel"], k=3):
                w.insert(rng.randrange(len(w)), insult)
            text, toxic = " ".join(w), 1
        rows.append((k, text))
        marks.append((k, good, toxic))
    return rows, marks


def test_quality_separates_held_out_rows(clash, labels):
    rows, marks = corpus()
    docs = clash(rows + [(None, None)])
    model = quality.train(docs, labels(marks + [(None, 1, 1), (7777, 1, 0)]))
    got = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    assert len(got) == len(rows) + 1
    truth = {d: q for d, q, _ in marks}
    held = [d for d in truth if fold(d, 5) == 0]
    assert all(got[d].held_out == (fold(d, 5) == 0) for d in got)
    assert np.mean([got[d].predicted == truth[d] for d in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.predicted}


def test_quality_scores_are_sparse_dot_products_and_labels_of_the_held_out_fold_are_not_used(frame, labels):
    rows, marks = corpus(2, 120)
    docs = frame(rows)
    model = quality.train(docs, labels(marks))
    assert model == quality.train(docs, labels([(d, q if fold(d, 5) else 1 - q, t) for d, q, t in marks]))
    places, weights = np.frombuffer(model[0], np.int32), np.frombuffer(model[1], np.float32)
    table = dict(zip(places.tolist(), weights.tolist(), strict=True))
    at, x = quality.Features()(rows[0][1].encode())
    z = sum(table.get(p, 0.0) * v for p, v in zip(at.tolist(), x.tolist(), strict=True))
    assert math.isclose(quality.scorer(model)(rows[0][1].encode()), 1 / (1 + math.exp(-z)), rel_tol=1e-6)


def test_classifiers_without_labels_or_documents(frame, labels):
    docs = frame(ODD)
    model = quality.train(docs, labels([]))
    assert {r.score for r in quality.scored(docs, model).collect()} == {0.5}
    lexicon = toxicity.train(docs, labels([]))
    assert {r.predicted for r in toxicity.scored(docs, lexicon).collect()} == {0}
    assert quality.scored(docs.limit(0), model).collect() == []
    assert toxicity.scored(docs.limit(0), lexicon).collect() == []


def test_the_sample_is_bounded_and_the_same_each_time(frame, labels):
    rows, marks = corpus(3, 200)
    docs = frame(rows)
    a = labelled.sample(docs, labels(marks), "quality", 50).collect()
    assert len(a) == 50 and a == labelled.sample(docs.repartition(7), labels(marks), "quality", 50).collect()
    again = frame(rows + [(d, "~" + t) for d, t in rows for _ in range(3)])  # rows repeated under one id are one of the sample
    assert a == labelled.sample(again, labels(marks), "quality", 50).collect()
    split = labels(marks + [(d, 0, 0) for d, _, _ in marks])  # of labels that disagree the larger counts
    assert a == labelled.sample(docs, split, "quality", 50).collect()


def test_lower_case_has_as_many_code_points():
    every = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    assert all(len(toxicity.lowered(c)) == 1 for c in every)
    assert toxicity.tokens("\u0130\u0130 DIMW\u0130T") == ["ii", "dimwit"]


def test_classifiers_score_repeated_and_very_long_texts_whole(frame, labels):
    rows, marks = corpus(7, 200)
    clean, rude = prose(5, 60_000), prose(5, 60_000) + " you dimwit, blockhead and scoundrel"
    docs = frame(rows + [(9001, clean), (9002, rude), (9002, rude), (9003, clean)])
    bad = toxicity.train(docs, labels(marks))
    judge = toxicity.Scorer(bad)
    got = sorted((r.doc_id, r.score, r.predicted) for r in toxicity.scored(docs, bad).collect() if r.doc_id > 9000)
    assert got == sorted((d, judge(t)[0], int(judge(t)[0] >= 0.5)) for d, t in ((9001, clean), (9002, rude), (9002, rude), (9003, clean)))
    assert [p for _, _, p in got] == [0, 1, 1, 0]
    good = quality.train(docs, labels(marks))
    score = quality.scorer(good)
    got = sorted((r.doc_id, r.score) for r in quality.scored(docs, good).collect() if r.doc_id > 9000)
    want = [(9001, clean), (9002, rude), (9002, rude), (9003, clean)]
    # The order of a sum's terms, so its last bit, is up to the arrays' places in memory.
    assert [d for d, _ in got] == [d for d, _ in want] and all(math.isclose(x, score(t.encode()), rel_tol=1e-12) for (_, x), (_, t) in zip(got, want, strict=True))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_the_automaton_finds_what_edit_distance_finds():
    rng = random.Random(4)
    terms = ["abcde", "abcab", "bcdeabcde", "abc", "deab*"]
    machine = toxicity.Automaton(terms)
    for _ in range(3_000):
        word = "".join(rng.choice("abcdex") for _ in range(rng.randrange(12)))
        truth = {}
        for k, t in enumerate(terms):
            stem = t.rstrip("*")
            e = min(edits(stem, word[:n]) for n in range(len(word) + 1)) if t.endswith("*") else edits(stem, word)
            if e <= toxicity.bound(t):
                truth[k] = e
        assert dict(machine.match(word)) == truth, word


def test_toxicity_catches_misspellings_and_leaves_quotes_and_clean_texts(clash, labels):
    rows, marks = corpus(5, 400)
    extra = [(9001, prose(1, 20) + " you blockhaed and nincompop " + prose(2, 20)), (9002, prose(3, 40)), (9003, 'he said the word "dimwit" once'), (9004, "you dimwit"), (9005, None), (9006, "")]
    docs = clash(rows + extra)
    model = toxicity.train(docs, labels(marks))
    assert {"dimwit", "blockhead", "nincompoop", "scoundrel"} <= {t.rstrip("*") for t in model["terms"]} or len(model["terms"]) >= 4
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    truth = {d: t for d, _, t in marks}
    assert np.mean([got[d].predicted == truth[d] for d in truth if fold(d, 5) == 0]) > 0.97
    assert [got[d].predicted for d in (9001, 9002, 9003, 9004, 9005, 9006)] == [1, 0, 0, 1, 0, 0]
    assert got[9003].score > got[9002].score
    hit = got[9004].hits[0]
    assert (hit.found, hit.start) == ("dimwit", 4)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.predicted}


def test_a_misspelled_term_of_four_letters_is_a_hit_unless_the_sample_finds_it_innocent():
    toxic = [(prose(k, 30) + " scum " + prose(k + 500, 30), 1) for k in range(60)]
    clean = [(prose(k + 2_000, 60), 0) for k in range(200)]
    score = toxicity.Scorer(toxicity.learn(toxic + clean))
    assert score("a scum")[0] > 0.5 and score("a skum")[0] > 0.5 and score("a skim")[0] < 0.5
    innocent = [(prose(k + 4_000, 60) + f" the scam and scu{k % 9}", 0) for k in range(60)]
    score = toxicity.Scorer(toxicity.learn(toxic + clean + innocent))
    assert score("a scum")[0] > 0.5 and score("a skum")[0] < 0.5


def normal(x, axis):
    return x / x.sum(axis, keepdims=True)


def paths_of(model, text, start):
    """All paths of states through a text, and their probabilities with it."""
    k = len(model.moves)
    paths = np.stack(np.meshgrid(*[range(k)] * len(text), indexing="ij"), -1).reshape(-1, len(text))
    p = [start[s[0]] * np.prod([model.moves[a, b] for a, b in zip(s[:-1], s[1:], strict=True)]) * np.prod([model.emissions[x, q] for x, q in zip(text, s, strict=True)]) for s in paths.tolist()]
    return paths.tolist(), np.array(p)


@pytest.mark.parametrize(("segment", "group"), [(256, 10_000), (3, 10_000), (3, 4)])
def test_scaled_forward_and_baum_welch_match_enumeration(monkeypatch, segment, group):
    monkeypatch.setattr(language_model, "SEGMENT", segment)
    monkeypatch.setattr(language_model, "GROUP", group)
    rng = np.random.default_rng(2)
    k, size = 3, 6
    model = language_model.Model(normal(rng.random((2, k)), 1), normal(rng.random((k, k)), 1), normal(rng.random((size, k)), 0))
    texts = [rng.integers(0, size, n) for n in (5, 1, 8, 4, 4, 2)]
    prior = np.array([0.3, 0.1, 0.2, 0.15, 0.05, 0.2])
    relative = model.emissions / prior[:, None]
    ids, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    logs = language_model.likelihoods(ids, lengths, relative, model.start[0], model.moves) + np.array([np.log10(prior[t]).sum() for t in texts])
    assert np.allclose(logs, [math.log10(paths_of(model, t, model.start[0])[1].sum()) for t in texts])
    counts, by_class = language_model.Counts(k, 0), np.zeros((k, size))
    for at, n, first in language_model.lattices(lengths):
        language_model.add(by_class, ids[at], language_model.expect(ids[at], n, first.astype(np.int64), model, relative, counts))
    want, emitted = language_model.Counts(k, 0), np.zeros((k, size))
    for t in texts:
        for later, piece in enumerate(t[x : x + segment] for x in range(0, len(t), segment)):
            start = want.start[min(later, 1)]
            paths, p = paths_of(model, piece, model.start[min(later, 1)])
            for s, w in zip(paths, p / p.sum(), strict=True):
                start[s[0]] += w
                for x, q in zip(piece, s, strict=True):
                    emitted[q, x] += w
                for a, b in zip(s[:-1], s[1:], strict=True):
                    want.moves[a, b] += w
    assert np.allclose(by_class, emitted) and np.allclose(counts.start, want.start) and np.allclose(counts.moves, want.moves)


def test_a_very_long_text_is_scored_uncut_and_its_segments_train_side_by_side():
    rng = np.random.default_rng(3)
    model = language_model.Model(normal(rng.random((2, 2)), 1), normal(rng.random((2, 2)), 1), normal(rng.random((5, 2)), 0))
    text = rng.integers(0, 5, 20_000)
    a, log = model.start[0] * model.emissions[text[0]], 0.0
    for x in text[1:]:
        a = (a @ model.moves) * model.emissions[x]
        log, a = log + math.log10(a.sum()), a / a.sum()
    got = language_model.likelihoods(np.concatenate((text, text[:3])), np.array([20_000, 3]), model.emissions, model.start[0], model.moves)
    assert math.isclose(got[0], log + math.log10(a.sum()), rel_tol=1e-9)
    groups = list(language_model.lattices(np.array([20_000, 3])))
    assert max(len(n) for _, n, _ in groups) == language_model.SEGMENT and sorted(np.concatenate([at for at, _, _ in groups]).tolist()) == list(range(20_003))
    assert sum(int(f.sum()) for _, _, f in groups) == 2


def scores_again(rows, states, iterations, top, tails, own, prior_weight, steps):
    """The language model in plain Python, a text and a token at a time: log10 probability of each text."""
    split = lambda t: (t or "").encode().lower().split()
    train = [split(t) for d, t in rows if fold(d, 10)]
    c = Counter(w for t in train for w in t)
    cut = max([n for n in {0, *c.values()} if sum(m > n for m in c.values()) <= top and (n == 0 or sum(m >= n for m in c.values()) > top)], default=0)
    place = {w: k for k, w in enumerate(sorted((w for w in c if c[w] > cut), key=lambda w: (-c[w], w)))}
    klass = lambda w: place[w] if w in place else top + zlib.crc32(w[-3:]) % tails
    size, end = top + tails + 1, top + tails
    in_tail, once = Counter(), Counter()
    for w, n in c.items():
        if w not in place:
            in_tail[klass(w)] += n
            once[klass(w)] += n == 1
    prior = np.full(size, 0.1)
    for w, n in c.items():
        prior[klass(w)] += n
    prior[end] += len(train)
    prior /= prior.sum()
    first = language_model.Model.first(prior, states)
    start, moves, emissions = first.start[0].copy(), first.moves, first.emissions
    factor = {}
    for step in range(iterations):
        s, m, e, by_word = np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), {}
        for t in train:
            x = [*map(klass, t), end]
            alpha = [start * emissions[x[0]]]
            for q in x[1:]:
                alpha.append((alpha[-1] @ moves) * emissions[q])
            beta = [np.ones(states)]
            for q in reversed(x[1:]):
                beta.insert(0, moves @ (emissions[q] * beta[0]))
            total = alpha[-1].sum()
            posterior = [a * b / total for a, b in zip(alpha, beta, strict=True)]
            s += posterior[0]
            for k, q in enumerate(x):
                e[q] += posterior[k]
                if k:
                    m += np.outer(alpha[k - 1], emissions[q] * beta[k]) * moves / total
            for k, w in enumerate(t):
                if w not in place:
                    by_word[w] = by_word.get(w, 0) + posterior[k]
        if step == iterations - 1:
            usual = normal(e + 1, 1)
            for w, n in by_word.items():
                q = usual[klass(w)]
                factor[w] = np.exp2(np.rint(np.log2((n + own * q) / ((n.sum() + own) * q)) * steps) / steps)
        start, moves, emissions = normal(s + 0.1, 0), normal(m + 0.1, 1), normal(e + prior_weight * prior[:, None], 0)
    norm = {k: sum(c[w] * f for w, f in factor.items() if klass(w) == k) / in_tail[k] for k in in_tail}
    out = {}
    for d, t in rows:
        a, log = start, 0.0
        for k, w in enumerate([*split(t), None]):
            q = end if w is None else klass(w)
            p = emissions[q].copy()
            if w is not None and w not in place and in_tail[q]:
                unseen = (once[q] + 1) / (in_tail[q] + 2)
                p *= factor[w] / norm[q] * (1 - unseen) * c[w] / in_tail[q] if w in c else unseen
            a = (a @ moves if k else a) * p
            log, a = log + math.log10(a.sum()), a / a.sum()
        out[d] = log
    return out


def test_scores_match_the_model_in_plain_python(frame, monkeypatch):
    rng = random.Random(11)
    rows = [(d, " ".join(f"{'ab'[d % 2]}{rng.randrange(40)}" for _ in range(rng.randrange(12))) + (f" rare{d}" if d % 4 == 0 else "")) for d in range(120)]
    rows += [(500, None), (501, "never seen words"), (502, "a1"), (503, "A1 a1\ta2")]
    monkeypatch.setattr(language_model, "TOP", 20)
    monkeypatch.setattr(language_model, "TAILS", 16)
    monkeypatch.setattr(language_model, "CHUNK", 300)
    monkeypatch.setattr(language_model, "TEXT_ROWS", 5)
    got = {r.doc_id: r.score for r in language_model.scored(frame(rows), states=2, iterations=3).collect()}
    want = scores_again(rows, 2, 3, 20, 16, language_model.OWN, language_model.PRIOR, language_model.STEPS)
    assert got.keys() == want.keys()
    assert max(abs(got[d] - want[d]) / (1 + abs(want[d])) for d in got) < 2e-4


def test_tails_in_arrays_and_columns_are_crc32_of_the_last_three_bytes(spark):
    words = [b"", b"a", b"ab", b"abc", b"xabc", "é🙂".encode(), b"\xff\xfe\x00z"]
    for array in (pa.array(words, pa.binary()), pa.array([b"skipped", *words], pa.binary())[1:]):
        assert language_model.tails_of(array, 8_192).tolist() == [zlib.crc32(w[-3:]) % 8_192 for w in words]
    frame = spark.createDataFrame([(w,) for w in words], "w binary")
    assert [r[0] for r in frame.select(language_model._tail("w")).collect()] == [zlib.crc32(w[-3:]) % 8_192 for w in words]


def test_words_that_share_a_hash_are_told_apart():
    rows = lambda *ws: pa.RecordBatch.from_pylist([{"key": k, "word": w, "c": n} for n, (k, w) in enumerate(ws)])
    batches = [rows((1, b"a"), (2, b"b")), rows((2, b"c")), rows((2, b"b"), (3, b"d")), rows((3, b"d"))]
    got = [(x.column("word")[k].as_py(), n) for x, begins in language_model._by_word(iter(batches)) for k, n in zip(begins.tolist(), np.diff([*begins, len(x)]).tolist(), strict=True)]
    assert got == [(b"a", 1), (b"b", 2), (b"c", 1), (b"d", 2)]


def test_of_words_of_one_count_all_or_none_are_in_the_top(spark, monkeypatch):
    counts = spark.createDataFrame([(w.encode(), n) for w, n in (("a", 9), ("b", 5), ("c", 5), ("d", 5), ("e", 1))], "word binary, c long")
    for top, want in ((1, 1), (3, 1), (4, 4), (9, 5)):
        monkeypatch.setattr(language_model, "TOP", top)
        v = language_model.vocabulary(counts, 2)
        assert len(v.words) == want and v.n == 27 and v.v == 6 and v.in_tail.sum() == 25 - v.counts.sum()
        assert math.isclose(v.prior.sum(), 1)


def test_base_scores_match_brute_force_and_the_model_is_better(clash, monkeypatch):
    rng = random.Random(9)
    rows = list(ODD)  # with repeated rows
    for k in range(300):
        name = "ab"[k % 2]
        rows.append((100 + k, " ".join(f"{name}{min(int(rng.expovariate(0.05)), 200)}" for _ in range(40)) + (f" Only{k}" if k % 3 == 0 else "")))
    monkeypatch.setattr(language_model, "TOP", 60)
    all_ = language_model.scored(clash(rows), states=3).collect()
    got = {r.doc_id: r for r in all_}
    assert Counter(r.doc_id for r in all_) == Counter(d for d, _ in rows)
    end = object()
    split = lambda t: [*(t or "").encode().lower().split(), end]
    c = Counter(w for d, t in rows if fold(d, 10) for w in split(t))
    n, v = sum(c.values()), len(c)
    for d, t in rows:
        some = split(t)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(d, 10) == 0, len(some), sum(c[w] > 0 for w in some), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in some), rel_tol=1e-9)
    held = [r for d, r in got.items() if r.held_out and d and d >= 100]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_iteration_covers_all_training_texts_long_ones_too(frame, monkeypatch):
    """From the noise of Model.first() on; a text of over 2,000 words takes part from the first iteration."""
    rows = [(d, prose(d, 2_500 if d % 5 == 0 else 20)) for d in range(40)]
    calls, plain = [], language_model.baum_welch
    tokens = lambda rows: sum(len(r.classes) // 2 for r in rows.collect())
    monkeypatch.setattr(language_model, "baum_welch", lambda training, model, prior: calls.append((tokens(training), model, prior)) or plain(training, model, prior))
    gathered = language_model.gathered  # of every iteration, the last among them

    def expected(*a):
        counts = gathered(*a)
        calls.append((round(counts.emissions.sum()), None, None))
        return counts

    monkeypatch.setattr(language_model, "gathered", expected)
    language_model.scored(frame(rows), states=2).count()
    n = sum(len(t.split()) + 1 for d, t in rows if fold(d, 10))
    assert [x for x, _, _ in calls] == [n] * (2 * language_model.ITERATIONS - 1)
    assert np.allclose(calls[0][1].emissions, language_model.Model.first(calls[0][2], 2).emissions, rtol=1e-6)


def test_words_outside_the_top_learn_their_own_states(frame, monkeypatch):
    """Two words of one tail class and one count, each at home in another kind of text, are told apart."""
    rng = random.Random(4)
    rows = []
    for d in range(400):
        name = "ab"[d % 2]
        some = [f"{name}{rng.randrange(5)}" for _ in range(30)]
        if fold(d, 10) and d < 360:
            some.insert(15, f"{name}{name}xyz")
        rows.append((d, " ".join(some)))
    rows += [(d, " ".join(["a1", "a2", "a3", w, "a4", "a0"])) for d, w in zip([d for d in range(1000, 2000) if fold(d, 10) == 0], ("aaxyz", "bbxyz"), strict=False)]
    n = min(sum(w in t.split() for d, t in rows if fold(d, 10)) for w in ("aaxyz", "bbxyz"))
    over = {w: sum(w in t.split() for d, t in rows if fold(d, 10)) - n for w in ("aaxyz", "bbxyz")}
    rows += [(d, w) for w in over for d in [d for d in range(3000 if w == "aaxyz" else 5000, 7000) if fold(d, 10)][: max(over.values()) - over[w]]]
    monkeypatch.setattr(language_model, "TOP", 10)
    got = {r.doc_id: r for r in language_model.scored(frame(rows), states=3).where("doc_id between 1000 and 1999").collect()}
    at_home, away = (got[d] for d in sorted(got))
    assert math.isclose(at_home.base_score, away.base_score) and at_home.n_known == away.n_known == 7
    assert at_home.score > away.score + 0.2


def test_language_model_of_nothing_and_without_training_texts(frame):
    docs = frame([(d, t) for d, t in ODD])
    assert language_model.scored(docs.limit(0)).collect() == []
    only_held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 10 = 0")
    rows = frame([(d, "a b") for d in range(300) if fold(d, 10) == 0][:3]) if only_held.isEmpty() else only_held
    got = language_model.scored(rows).collect()
    assert got and all(r.train_tokens == 0 and r.n_known == 0 and r.score <= 0 for r in got)
