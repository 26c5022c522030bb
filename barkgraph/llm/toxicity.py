"""Toxicity by Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon holds a short fixed list and the words and word beginnings that labelled documents single out.
The trie of all of them and their Levenshtein automata (one error from five letters, two from nine, one in
beginnings) are intersected lazily: a state is a set of (trie node, errors), made once and kept (STATES at most, then all are
made anew), so a word costs a dictionary look-up for each of its letters, up to the one at which no term is near. Every hit is
found by it. Each term has a weight, log-odds with a prior, and a smaller one for misspelled occurrences, the smaller the more
words of clean documents come near; those words themselves are no misspellings.

Around each hit a window of words tells quotation from abuse: quotation marks and reporting words move the
hit's weight to a separate sum. A logistic regression over those sums, their densities and the strongest window
gives the score. The lexicon and the regression are fitted on different parts of at most LABELLED_SAMPLE
labelled documents; scoring covers all rows. labels, lang, source and doc_id are never inputs. Without labels
of both classes the fixed list and fixed coefficients score.

Null and empty texts have no hits. Scores depend on the text alone, so repeated rows agree. A null doc_id is
scored but never learnt from. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .quality_fm import labelled_sample, remainder

#: Labelled documents that the fit sees at most, and the share of them that the lexicon is drawn from.
LABELLED_SAMPLE = 8000
LEXICON_SHARE = 0.65
#: Terms kept at most, letters of a word beginning, documents that must have a term.
TERMS, STEMS, LEAST_DOCS = 400, (5, 6, 7, 8, 9), 5
WINDOW = 12
#: Words and states of the automaton that a task remembers; beyond them both are made anew.
CACHED_WORDS, STATES = 100_000, 50_000
PREDICT = 0.3
#: Terms known before any label is read.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
SEED_WEIGHT, FUZZY_PRIOR = 3.0, 0.6
#: Words of reporting, and the marks that open and close quotations.
REPORTING = frozenset("said says say wrote writes called calls quote quoted quoting reported replied claimed term word slur dit sagte dijo".split())
_QUOTES = "\"“”„«»"
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”’‘…–—¿¡"
#: Coefficients that apply where nothing can be learnt.
_DEFAULT = np.array([-4.0, 1.2, 1.0, 0.8, 0.8, 0.1, 0.0])


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The intersection of the terms' Levenshtein automata with their trie, made state by state. A beginning is a term that
    any letters may follow: once a word has reached it, the state keeps that."""

    def __init__(self, terms: dict[str, int], beginnings: dict[str, int] | None = None):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.begin: list[int] = [0]  # number of the beginning that ends here, from 1
        self.limit, self.starts, self.allowed = terms, [""], [0]
        self.reach = [0]  # errors that a term at the node or below allows
        for t, k in terms.items():
            self.term[self._path(t, k)] = t
        for t, k in (beginnings or {}).items():
            self.begin[self._path(t, k)] = len(self.starts)
            self.starts.append(t)
            self.allowed.append(k)
        self._clear()

    def _path(self, term: str, errors: int) -> int:
        at = 0
        for c in term:
            self.reach[at] = max(self.reach[at], errors)
            if c not in self.child[at]:
                self.child[at][c] = len(self.child)
                for column, empty in ((self.child, {}), (self.term, None), (self.begin, 0), (self.reach, 0)):
                    column.append(empty)
            at = self.child[at][c]
        self.reach[at] = max(self.reach[at], errors)
        return at

    def _clear(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accept: list[tuple[int, bool, str] | None] = []
        self.first = self._state({(0, 0)})

    def _rank(self, kept: tuple[int, int]) -> tuple:
        """Of beginnings the one of the fewest errors, then the longest, then the first counts."""
        return kept[1], -len(self.starts[-kept[0]]), self.starts[-kept[0]]

    def _state(self, nodes) -> int:
        best: dict[int, int] = {}
        front, kept = [x for x in nodes if x[0] >= 0], [x for x in nodes if x[0] < 0]
        while front:  # a letter that the word lacks costs an error and no input
            node, e = front.pop()
            if e > self.reach[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            if self.begin[node] and e <= self.allowed[self.begin[node]]:
                kept.append((-self.begin[node], e))
            front += [(n, e + 1) for n in self.child[node].values()]
        kept = [min(kept, key=self._rank)] if kept else []
        key = frozenset([*best.items(), *kept])
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            ends = [(e, False, self.term[n]) for n, e in best.items() if self.term[n] and e <= self.limit[self.term[n]]]
            self.accept.append(min(ends + [(e, True, self.starts[-n]) for n, e in kept], default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if node < 0:
                out.add((node, e))
                continue
            out.add((node, e + 1))
            for letter, n in self.child[node].items():
                out.add((n, e if letter == c else e + 1))
        new = self.next[state][c] = self._state(out)
        return new

    def nearest(self, word: str) -> tuple[int, bool, str] | None:
        """The errors of the closest term, whether it is a beginning, and the term. Whole words come before beginnings, ties are
        in order."""
        if len(self.sets) > STATES:
            self._clear()
        at, follow, sets = self.first, self.next, self.sets
        for c in word:
            to = follow[at].get(c)
            at = self._step(at, c) if to is None else to
            if not sets[at]:
                return None
        return self.accept[at]

    def match(self, word: str) -> tuple[str, int] | None:
        """The closest term and its distance, or None."""
        found = self.nearest(word)
        return (found[2], found[0]) if found else None


class Lexicon:
    """Weights of words: whole terms, word beginnings, and both misspelled. `clean` are words like terms that are none."""

    def __init__(self, exact: dict[str, float], stems: dict[str, float], fuzzy: dict[str, float], clean: frozenset[str] = frozenset()):
        self.exact, self.stems, self.fuzzy, self.clean = exact, stems, fuzzy, clean

    def start(self, errors: bool = True) -> None:
        """What a task makes for itself: one automaton, by which every term is found, misspelled or not."""
        k = lambda t: errors_allowed(t) if errors and self.fuzzy.get(t, 0) > 0 else 0
        self.automaton = Automaton({t: k(t) for t in self.exact}, {t: min(1, k(t)) for t in self.stems})

    def entry(self, core: str) -> tuple[str, float] | None:
        near = self.automaton.nearest(core)
        if near is None:
            return None
        errors, begins, term = near
        if not errors:
            return term, self.stems[term] if begins else self.exact[term]
        return None if core in self.clean else (term, self.fuzzy[term])


class Weights(dict):
    """Word to its weight, 0 where it isn't in the lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self.lexicon.entry(word.strip(_EDGE))
        w = self[word] = found[1] if found else 0.0
        return w


def quoted(words: list[str], i: int) -> bool:
    """Whether the window before and after word i marks it as quoted or reported."""
    before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW]
    opened = 0
    for w in before:
        if w[0] in _QUOTES:
            opened += 1
        if len(w) > 1 and w.rstrip(".,;:!?")[-1:] in _QUOTES and w is not before[-1]:
            opened -= 1
    closes = any(w.rstrip(".,;:!?")[-1:] in _QUOTES for w in after)
    return (opened > 0 and closes) or any(w.strip(_EDGE) in REPORTING for w in before[-4:])


def features(text: str | None, weights: Weights) -> np.ndarray:
    words = (text or "").lower().split()
    n = len(words)
    w = np.fromiter(map(weights.__getitem__, words), float, n)
    hits = np.flatnonzero(w > 0)
    x = np.zeros(7)
    x[0], x[6] = 1.0, np.log1p(n) / 10
    if len(hits):
        inside = np.array([quoted(words, int(i)) for i in hits])
        abuse, cited = w[hits] * ~inside, w[hits] * inside
        places = np.concatenate([[0.0], np.cumsum(np.where(w > 0, w, 0.0))])
        window = (places[np.minimum(hits + WINDOW, n)] - places[hits]).max()
        x[1] = np.log1p(abuse.sum())
        x[2] = min(10.0, 100 * abuse.sum() / (n + 20)) / 5
        x[3] = min(window, 12.0) / 6
        x[4] = np.log1p(len({words[int(i)].strip(_EDGE) for i in hits}))
        x[5] = np.log1p(cited.sum())
    return x


class Model:
    def __init__(self, lexicon: Lexicon, coefficients: np.ndarray):
        self.lexicon, self.coefficients = lexicon, coefficients

    def score(self, text: str | None, weights: Weights) -> float:
        return float(1 / (1 + np.exp(-np.clip(features(text, weights) @ self.coefficients, -30, 30))))


def _log_odds(pos: float, neg: float, n_pos: float, n_neg: float, prior: float = 0.5) -> float:
    return float(np.log((pos + prior) / (n_pos + 2 * prior)) - np.log((neg + prior * max(1.0, n_neg / max(n_pos, 1))) / (n_neg + 2 * prior)))


def lexicon_of(texts: list[str | None], labels: list[int]) -> Lexicon:
    """Terms and beginnings by occurrences in toxic against other documents. Equal texts count once."""
    once = {t: y for t, y in zip(texts, labels, strict=True) if t}
    sides = []
    for side in (1, 0):
        words, docs = Counter(), Counter()
        for t, y in once.items():
            if y == side:
                own = Counter(w.strip(_EDGE) for w in t.lower().split())
                words.update(own)
                if side:
                    docs.update({w[:k] for w in own for k in (*STEMS, 99) if len(w) >= min(k, 4)})
        sides.append((words, docs))
    (pos, pos_docs), (neg, _) = sides
    n_pos, n_neg = sum(pos.values()) or 1, sum(neg.values()) or 1
    exact = {t: SEED_WEIGHT for t in SEED_TERMS}
    candidates = {w for w, n in pos_docs.items() if n >= LEAST_DOCS}
    begins_pos, begins_neg = Counter(), Counter()
    for words, out in ((pos, begins_pos), (neg, begins_neg)):
        for w, n in words.items():
            for k in STEMS:
                if len(w) >= k and w[:k] in candidates:
                    out[w[:k]] += n
    ranked = sorted(((_log_odds(pos[w], neg[w], n_pos, n_neg), w) for w in candidates if w in pos), reverse=True)
    exact |= {w: min(o, 6.0) for o, w in ranked[:TERMS] if o > 2.0 and len(w) > 3}
    ranked = sorted(((_log_odds(begins_pos[s], begins_neg[s], n_pos, n_neg), s) for s in candidates if len(s) in STEMS and begins_pos[s]), reverse=True)
    stems = {s: min(o, 6.0) - 0.5 for o, s in ranked[:TERMS] if o > 2.5}
    # misspellings: a term that clean words come near counts less, and those words never do
    lexicon = Lexicon(exact, stems, {t: 1.0 for t in {**exact, **stems}})
    lexicon.start()
    near_pos, near_neg, clean = Counter(), Counter(), set()
    for words, out in ((pos, near_pos), (neg, near_neg)):
        for w in words:
            m = lexicon.automaton.nearest(w)
            if m and m[0]:
                out[m[2]] += 1
                if words is neg:
                    clean.add(w)
    fuzzy = {t: min(w, FUZZY_PRIOR * w + float(np.log1p(near_pos[t]) - 2 * np.log1p(near_neg[t]))) for t, w in {**stems, **exact}.items()}
    return Lexicon(exact, stems, {t: w for t, w in fuzzy.items() if w > 0.5}, frozenset(clean))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; the penalty pulls towards the fixed coefficients."""
    b = _DEFAULT.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + ridge * (b - _DEFAULT)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(texts: list[str | None], labels: list[int]) -> Model:
    if len(set(labels)) < 2:
        lexicon = Lexicon({t: SEED_WEIGHT for t in SEED_TERMS}, {}, {t: FUZZY_PRIOR * SEED_WEIGHT for t in SEED_TERMS})
        return Model(lexicon, _DEFAULT)
    part = np.random.default_rng(5).random(len(texts)) < LEXICON_SHARE
    lexicon = lexicon_of([t for t, p in zip(texts, part, strict=True) if p], [y for y, p in zip(labels, part, strict=True) if p])
    lexicon.start()
    weights = Weights(lexicon)
    rest = np.flatnonzero(~part) if (~part).sum() > 20 else np.arange(len(texts))
    x = np.array([features(texts[i], weights) for i in rest])
    model = Model(lexicon, regression(x, np.array([labels[i] for i in rest], float)))
    del lexicon.automaton
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out=None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    return _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), docs, labels, held_out).select("doc_id", F.col("__held").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= PREDICT).cast("int").alias("predicted"))


def _scored(rows: DataFrame, docs: DataFrame, labels: DataFrame, held_out=None) -> DataFrame:
    """rows, which have doc_id and text, with __score and __held; all columns stay."""
    held = F.coalesce(remainder(4) == 2, F.lit(False)) if held_out is None else held_out
    model = fit(*labelled_sample(docs, labels, "toxic", ~held, LABELLED_SAMPLE))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TERMS entries at most
    names = rows.columns
    at = names.index("text")

    def start():
        own = shared.value
        own.lexicon.start()
        weights = Weights(own.lexicon)

        def step(batch):
            scores = [own.score(t, weights) for t in batch.column(at).to_pylist()]
            return pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "__score"])

        return step

    schema = rows.select("*", F.lit(0.0).alias("__score")).schema
    return map_batches(rows, schema, start).withColumn("__held", held)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns."""
    return _scored(docs, docs, labels).where(F.col("__score") < PREDICT).select(*[F.col(f"`{c}`") for c in docs.columns])
