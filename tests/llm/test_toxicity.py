"""Toxicity through the automaton: misspelled terms of held-out documents, and scores against a plain scan."""

import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from barkgraph.llm import toxicity
from barkgraph.llm.quality_fm import labelled_sample, remainder
from barkgraph.llm.queries import queries

SF = "/root/testdata/sf0.1"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def labelled():
    d = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"]).merge(pd.read_parquet(f"{SF}/labels.parquet"))
    held = d.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    return d[~held], d[held]


@pytest.fixture(scope="module")
def model(labelled):
    learnt, _ = labelled
    return toxicity.fit(learnt.text.tolist(), learnt.toxic.astype(int).tolist())


def misspelled(text, letters, rnd):
    """Every known term with one letter (of nine and more: two) changed, left out or doubled."""

    def one(m):
        w = m[0]
        for _ in range(2 if len(w) > 8 else 1):
            k = rnd.randrange(1, len(w))
            w = rnd.choice([w[:k] + rnd.choice(letters) + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:]])
        return w

    return re.sub("|".join(t for t in toxicity.SEED_TERMS if len(t) > 4), one, text, flags=re.I)


def predicted(model, texts, errors=True):
    model.lexicon.start(errors)
    weights = toxicity.Weights(model.lexicon)
    return np.array([model.score(t, weights) for t in texts]) >= toxicity.PREDICT


def test_misspelled_terms_are_caught_by_the_automaton(labelled, model):
    _, held = labelled
    toxic = [t for t, y in zip(held.text, held.toxic, strict=True) if y]
    found = [t for t, p in zip(toxic, predicted(model, toxic), strict=True) if p]
    rnd = random.Random(3)
    changed = [c for t in found if (c := misspelled(t, "xqzv", rnd)) != t]
    assert len(changed) > 50
    caught, without = predicted(model, changed).mean(), predicted(model, changed, errors=False).mean()
    assert caught > 0.9 and without < 0.6, (caught, without)
    clean = [t for t, y in zip(held.text, held.toxic, strict=True) if not y]
    assert predicted(model, clean).mean() < 0.01


def test_beginnings_keep_what_follows():
    a = toxicity.Automaton({"abcde": 1}, {"abcxyz": 1, "abcx": 0})
    assert a.nearest("abcxyzoo") == (0, True, "abcxyz") and a.nearest("abcxoooo") == (0, True, "abcx")
    assert a.nearest("abqxyzoo") == (1, True, "abcxyz") and a.nearest("abcde") == (0, False, "abcde") and a.nearest("abcdd") == (1, False, "abcde")
    assert a.nearest("zzz") is None and toxicity.Automaton({}, {}).nearest("abc") is None


def plain_entry(lexicon, core):
    """The automaton's answer by a scan of all terms."""
    best = None
    k = lambda t: toxicity.errors_allowed(t) if lexicon.fuzzy.get(t, 0) > 0 else 0
    for t in lexicon.exact:
        if abs(len(t) - len(core)) <= k(t) and (e := edit_distance(core, t)) <= k(t):
            best = min(best or (9,), (e, 0, 0, t))
    for t in lexicon.stems:
        most = min(1, k(t))
        e = min(edit_distance(core[:n], t) for n in range(max(0, len(t) - most), len(t) + most + 1))
        if e <= most:
            best = min(best or (9,), (e, 1, -len(t), t))
    if best is None:
        return None
    e, begins, _, t = best
    return (t, (lexicon.stems if begins else lexicon.exact)[t]) if not e else None if core in lexicon.clean else (t, lexicon.fuzzy[t])


def test_registered_scores_as_a_plain_scan(spark):
    """The registered query's scores of some documents, recomputed without the automaton."""
    sf = "/root/testdata/sf0.001"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = queries()["op7_toxicity"](spark, sf).toPandas().set_index("doc_id").score
    d, y = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(*labelled_sample(d, y, "toxic", ~(remainder(4) == 2), toxicity.LABELLED_SAMPLE))
    model.lexicon.start()
    model.lexicon.entry = lambda core: plain_entry(model.lexicon, core)
    weights = toxicity.Weights(model.lexicon)
    for r in docs[docs.text.str.len() < 600].head(40).itertuples():
        assert abs(model.score(r.text, weights) - got[r.doc_id]) < 1e-9
