"""Toxicity: a learned lexicon, found in misspelled form too by Levenshtein automata intersected with the lexicon's trie.

Terms (whole words and stems that take any ending) are learned from a bounded sample of labelled rows by greedy cover:
again and again the term that explains most of the toxic documents not yet explained, if it is rare in the others. The
terms form a trie; the product of the trie and the Levenshtein automaton of each term's bound is a deterministic automaton
built while it is used, so a word is given up at its first letter that no term within the bound allows. Each hit weighs by
the precision that its term and distance had in the sample, less inside a quotation (of any length, over any lines of its
paragraph) and less still if words that report speech are near, more where someone is addressed; the score is a noisy or
over the forms found, each by its heaviest hit.

Cases: null text counts as empty and scores the base rate, as does a text without hits; without toxic labelled rows the
lexicon is empty and all rows score the base rate; rows repeated under one doc_id are scored each; an empty table gives no
rows; other columns are never read.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled

THRESHOLD = 0.5
#: Terms of a lexicon at most; letters of a stem; documents that a term must add, and its precision, to be learned.
TERMS, STEM, SUPPORT, PRECISION = 400, (4, 10), 4, 0.85
#: Precision under which a distance or a form is no hit; forms with a weight of their own at most, the commonest of the
#: sample's: a form beyond them weighs as its term and distance do.
LEAST, FORMS = 0.6, 20_000
#: Tokens on either side of a hit that make its context.
WINDOW = 8
#: Factors of a hit's weight by its context.
QUOTED, REPORTED, ADDRESSED = 0.35, 0.6, 1.15
# Words that report speech and words that address someone, in the corpus' languages.
REPORTING = frozenset("said says wrote writes called calls quoted quote reported term word slur insult sagte schrieb nannte zitat wort dit écrit appelé citation mot dijo escribió llamó cita palabra".split())
ADDRESSING = frozenset("you your yours du dich dein deine tu te toi vous votre tú usted ustedes".split())
# Quotation marks that open, and what closes each.
_CLOSERS = {"“": "”“", "”": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’", '"': '"'}

_WORD = re.compile(r"[^\W_]+(?:[@$*'’\-][^\W_]+)*")
_MARK = re.compile(r"[“”„«»‹›‘’\"]|\n[ \t\r]*\n")
_MODEL = pa.schema([("model", pa.string())])
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("hits", pa.list_(pa.struct([("term", pa.string()), ("found", pa.string()), ("start", pa.int64()), ("distance", pa.int32()), ("weight", pa.float64())])))])
OUT = "doc_id long, held_out boolean, score double, predicted int, hits array<struct<term: string, found: string, start: long, distance: int, weight: double>>"


def bound(term: str) -> int:
    """Edits that a term of so many letters may have. A stem of four letters has none: with one, any word on three would do."""
    n = len(term.rstrip("*"))
    return 0 if n < 4 + term.endswith("*") else 1 if n < 9 else 2


class Automaton:
    """Deterministic automaton of all strings within each term's bound, built lazily. Terms that end in * are stems."""

    def __init__(self, terms: list[str], most_states: int = 20_000):
        self.terms, self.most = terms, most_states
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach: list[int] = [0]
        for k, term in enumerate(terms):
            at = 0
            self.reach[0] = max(self.reach[0], bound(term))
            for c in term.rstrip("*"):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                at = self.children[at][c]
                self.reach[at] = max(self.reach[at], bound(term))
            self.ends[at].append(k)
        self.letters = {c for x in self.children for c in x}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[frozenset, frozenset]] = []
        self.ids: dict[tuple[frozenset, frozenset], int] = {}
        self.moves: list[dict[str, int]] = []
        self.found: list[list[tuple[int, int]]] = []
        self.start = self._state(self._closed({0: 0}), {})

    def _closed(self, places: dict[int, int]) -> dict[int, int]:
        """With the places that leaving out letters of a term reaches; of each trie place the fewest edits count."""
        todo = list(places)
        while todo:
            at = todo.pop()
            e = places[at] + 1
            for child in self.children[at].values():
                if e <= self.reach[child] and e < places.get(child, 99):
                    places[child] = e
                    todo.append(child)
        return places

    def _state(self, places: dict[int, int], stems: dict[int, int]) -> int:
        stems = dict(stems)
        for at, e in places.items():
            for k in self.ends[at]:
                if self.terms[k].endswith("*") and e <= bound(self.terms[k]) and e < stems.get(k, 99):
                    stems[k] = e
        key = (frozenset(places.items()), frozenset(stems.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            best = dict(stems)
            for at, e in places.items():
                for k in self.ends[at]:
                    if e <= bound(self.terms[k]):
                        best[k] = min(e, best.get(k, 99))
            self.found.append(sorted(best.items(), key=lambda x: (x[1], x[0])))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        places, stems = self.states[state]
        new: dict[int, int] = {}

        def to(at: int, e: int) -> None:
            if e <= self.reach[at] and e < new.get(at, 99):
                new[at] = e

        for at, e in places:
            to(at, e + 1)
            for x, child in self.children[at].items():
                to(child, e + (x != c))
        if not new and not stems:
            return -1
        return self._state(self._closed(new), dict(stems))

    def match(self, word: str) -> list[tuple[int, int]]:
        """Terms (by number) within their bounds of a word, with the edits, nearest first."""
        if len(self.states) > self.most:
            self._reset()
        state = self.start
        for c in word:
            c = c if c in self.letters else "\0"
            to = self.moves[state].get(c)
            if to is None:
                to = self.moves[state][c] = self._move(state, c)
            if to < 0:
                return []
            state = to
        return self.found[state]


def lowered(text: str) -> str:
    """text in lower case, of as many code points: the dotted capital I is the one letter that would become two."""
    return text.replace("\u0130", "i").lower()


def tokens(text: str) -> list[str]:
    return _WORD.findall(lowered(text))


def quotations(text: str) -> list[tuple[int, int]]:
    """Start and end of each quotation of a text, in order: a mark that opens, up to the first that closes it before a blank
    line, over as many words and lines as it has. Marks within a quotation belong to it; an apostrophe closes nothing."""
    out: list[tuple[int, int]] = []
    begun: tuple[int, str] | None = None
    for m in _MARK.finditer(text):
        mark, at = m[0], m.start()
        if mark[0] == "\n":
            begun = None
        elif begun is None:
            begun = (at, _CLOSERS[mark]) if mark in _CLOSERS else None
        elif mark in begun[1] and not (mark == "’" and text[m.end() : m.end() + 1].isalnum()):
            out.append((begun[0], m.end()))
            begun = None
    return out


def inside(spans: list[tuple[int, int]], at: int) -> bool:
    k = bisect_right(spans, (at, len(spans) and spans[-1][1])) - 1
    return k >= 0 and spans[k][0] < at < spans[k][1]


def _forms(word: str):
    """The word itself and its stems."""
    yield word
    for n in range(STEM[0], min(STEM[1], len(word)) + 1):
        yield word[:n] + "*"


def learn(rows: list[tuple[str, int]]) -> dict:
    """Lexicon, weights and base rate from (text, label) rows."""
    toxic = [set(tokens(t)) for t, y in rows if y == 1]
    clean = [set(tokens(t)) for t, y in rows if y != 1]
    support = min(SUPPORT, max(2, len(toxic) // 20))
    counts = Counter(f for words in toxic for f in {f for w in words for f in _forms(w)})
    usual = Counter(f for words in clean for w in words for f in (w,) if f in counts)
    known = {f: n for f, n in counts.items() if n >= support and n / (n + usual[f] + 1) >= PRECISION * 0.6}
    spread = Counter(f for words in clean for f in {f for w in words for f in _forms(w) if f in known})
    precise = {f: n / (n + spread[f]) for f, n in known.items()}
    precise = {f: p for f, p in precise.items() if p >= PRECISION}
    holders: dict[str, set[int]] = defaultdict(set)
    for k, words in enumerate(toxic):
        for w in words:
            for f in _forms(w):
                if f in precise:
                    holders[f].add(k)
    terms: list[str] = []
    open_ = set(range(len(toxic)))
    heap = {f: len(h) for f, h in holders.items()}
    while heap and len(terms) < TERMS:
        best = max(heap, key=lambda f: (heap[f] * precise[f], not f.endswith("*"), len(f), f))
        gain = len(holders[best] & open_)
        if gain < heap[best]:
            heap[best] = gain
            if gain < support:
                del heap[best]
            continue
        terms.append(best)
        del heap[best]
        open_ -= holders[best]
    # A term that was not needed to cover a document is one all the same if it stands beside others far too often.
    rest = sorted((f for f in holders if f not in terms and not f.endswith("*") and len(holders[f]) >= max(4 * support, 0.05 * len(toxic)) and precise[f] >= 0.98), key=lambda f: -len(holders[f]))
    terms += rest[: TERMS - len(terms)]
    weights: dict[str, float] = {}
    automaton = Automaton(terms)
    seen, alone = (Counter(), Counter()), (Counter(), Counter())
    bare = [0, 0]
    for which, docs in enumerate((clean, toxic)):
        for words in docs:
            found = {w: m[0] for w in words if (m := automaton.match(w))}
            alone[which].update(found.keys())
            seen[which].update(set(found.values()))
            bare[which] += not found
    for k, e in seen[0] | seen[1]:
        a, b = seen[1][k, e], seen[0][k, e]
        weights[f"{k} {e}"] = (a + 0.5) / (a + b + 1)
    for k, term in enumerate(terms):
        for e in range(bound(term) + 1):
            # Edits that the sample never shows weigh the less, the more there are.
            weights.setdefault(f"{k} {e}", (0.97, 0.75, 0.6)[e])
    # Edits or forms that are mostly innocent in the sample are no hits; forms that it shows often weigh as they are there.
    weights = {k: w if w >= LEAST else 0.0 for k, w in weights.items()}
    forms = {w: (p if (p := (alone[1][w] + 0.5) / (n + 1)) >= LEAST else 0.0) for w, n in (alone[0] + alone[1]).most_common(FORMS) if n >= 3}
    base = (bare[1] + 0.5) / (sum(bare) + 2) if rows else 0.01
    return {"terms": terms, "weights": weights, "forms": forms, "base": min(0.45, base)}


class Scorer:
    def __init__(self, model: dict, most: int = 200_000):
        self.terms = model["terms"]
        self.weights = {tuple(map(int, k.split())): w for k, w in model["weights"].items()}
        self.base, self.forms, self.most = model["base"], model["forms"], most
        self.automaton = Automaton(self.terms)
        self.known: dict[str, tuple[int, int, float] | None] = {}

    def _match(self, word: str):
        if word in self.known:
            return self.known[word]
        if len(self.known) >= self.most:
            self.known.clear()
        found = self.automaton.match(word)
        # The nearest term whose weight at that distance makes it a hit; one that was found innocent hides no other.
        best = next((m for m in found if self.weights[m]), found[0]) if found else None
        weight = self.forms.get(word, self.weights[best]) if found else 0.0
        self.known[word] = m = (*best, weight) if weight else None
        return m

    def _context(self, quoted: list[tuple[int, int]], words: list, k: int) -> float:
        """Factor of the hit at token k."""
        factor = QUOTED if inside(quoted, words[k].start()) else 1.0
        near = {w[0] for w in words[max(0, k - WINDOW) : k + WINDOW + 1]}
        if near & REPORTING and factor < 1:
            factor *= REPORTED
        if near & ADDRESSING and factor == 1:
            factor *= ADDRESSED
        return factor

    def __call__(self, text: str) -> tuple[float, list[dict]]:
        """Score of a text, and its hits."""
        lower = lowered(text)
        some = {w: m for w in set(_WORD.findall(lower)) if (m := self._match(w))}
        if not some:
            return self.base, []
        words = list(_WORD.finditer(lower))
        quoted, hits, most = quotations(lower), [], {}
        for k, w in enumerate(words):
            if m := some.get(w[0]):
                weight = min(0.99, m[2] * self._context(quoted, words, k))
                most[w[0]] = max(weight, most.get(w[0], 0.0))
                hits.append({"term": self.terms[m[0]], "found": w[0], "start": w.start(), "distance": m[1], "weight": weight})
        left = 1 - self.base
        for weight in most.values():
            left *= 1 - weight
        return 1 - left, hits


def _learn(it):
    rows = [(t.decode(), y) for t, y in labelled.within(it)]
    yield common.batch(_MODEL, [json.dumps(learn(rows))])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = labelled.SAMPLE) -> dict:
    """Lexicon (400 terms at most), weights of edits and forms, and base rate; learned in one executor task on a bounded sample."""
    got = common.map_arrow(labelled.sample(docs, labels, label, most), _learn, "model string").collect()
    return json.loads(got[0][0]) if got else learn([])


def _score(model: dict, threshold: float):
    def run(it):
        score = Scorer(model)
        for b in common.each(it):
            done = [score(t or "") for t in b.column("text").to_pylist()]
            yield common.batch(_OUT, b.column("doc_id"), b.column("held_out"), [x[0] for x in done], [int(x[0] >= threshold) for x in done], [x[1] for x in done])

    return run


def scored(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and hits (term, found, start in code points, distance, weight) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), labelled.held_out(docs).alias("held_out"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(rows, _score(model, threshold), OUT)


def _keep(model: dict, threshold: float, at: int, names: list[str]):
    def run(it):
        score = Scorer(model)
        for b in common.each(it):
            keep = pa.array([score(t or "")[0] < threshold for t in b.column(at).to_pylist()], pa.bool_())
            yield b.filter(keep).rename_columns(names)

    return run


def accepted(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that don't score as toxic."""
    return common.map_arrow(docs, _keep(model, threshold, docs.columns.index("text"), docs.columns), docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return scored(docs, train(docs, common.table(spark, sf_dir, "labels"))).drop("hits")
