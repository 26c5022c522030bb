"""Ranked lexical search, hard negatives and repeated strings: against brute force and SQL, and on odd rows."""

import math
import re
import string
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barkgraph.llm import lexical, negatives, suffixes
from barkgraph.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, lang string, n long, item long, term array<string>, score double, `a.b` string"


def documents(spark, rows):
    """documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", 1, 2, ["x"], 0.5, "y") for i, t in rows], DOCS)


def same_as_sql(spark, name, sf=SF):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    row = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)))
    assert row(got) == row(want)
    return got


# --- ranked lexical search ---------------------------------------------------------------------------------------

def ranked(docs, items):
    """The ten best of each item, by the contract's words."""
    words = [TERM.findall((t or "").translate(LOW)) for _, t in docs]
    total, length = sum(map(bool, words)), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, _), w in zip(docs, words, strict=True):
            tf, s = Counter(w), 0
            for t in set(TERM.findall((text or "").translate(LOW))) & set(w):
                m = 10 + (90 * len(w) * total) // length
                s += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:10], 1)]
    return sorted(map(repr, out))


def test_registered_search_as_sql(spark):
    assert len(same_as_sql(spark, "op13_ranked_search")) > 100


@pytest.mark.parametrize("fan, wave, postings", [(16, 64, 2_000_000), (2, 1, 60), (3, 2, 1)])
def test_search_as_brute_force(spark, monkeypatch, fan, wave, postings):
    monkeypatch.setattr(lexical, "FAN", fan)
    monkeypatch.setattr(lexical, "WAVE", wave)
    monkeypatch.setattr(lexical, "RANGE_POSTINGS", postings)
    rng = np.random.default_rng(fan)
    words = ["Äa", "b", "C", "d1", "ñ", "e", "f", "g", "h", "i"]
    docs = [(int(i) % 90, " ".join(rng.choice(words, rng.integers(0, 12), p=np.arange(1, 11) / 55))) for i in range(120)]
    docs += [(None, "b-c"), (None, "b C"), (7, None), (8, ""), (9, " -- "), (3, "b c"), (3, "b c"), (4, "b " * 30000)]
    items = [(1, "b c"), (1, "b c"), (2, None), (3, ""), (None, "ÄA Äa d1!"), (5, "never"), (6, " ".join(words) * 2)]
    got = lexical.search(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in got) == ranked(docs, items)


def test_items_in_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 10)
    docs = [(i, f"a b{i % 3} c") for i in range(40)]
    items = [(i, f"b{i % 4} c") for i in range(9)]
    both = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(*both).collect()
    assert sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in got) == ranked(docs, items)
    assert lexical.search(both[0], both[1].limit(0)).count() == 0
    assert lexical.search(both[0].limit(0), both[1]).count() == 0


def test_search_opens_few_nodes(spark):
    """Branch and bound reads a part of the leaves where scores differ, and every tie where they don't."""
    rng = np.random.default_rng(1)
    doc = np.repeat(np.arange(4096), 8)
    term, value = np.tile(np.arange(8), 4096), rng.integers(1, 20, 8 * 4096)
    value[doc // 16 == 77] += 500
    tree, opened, real = lexical.Tree(term, doc, value, 4096), [], lexical.Tree.children
    counted = lambda self, terms, level, nodes: opened.append(level == 0 and len(nodes)) or real(self, terms, level, nodes)
    lexical.Tree.children = counted
    try:
        found, scores, _ = tree.best(np.arange(8), 1)
    finally:
        lexical.Tree.children = real
    total = np.bincount(doc, value, 4096)
    assert sorted(scores, reverse=True)[:10] == sorted(total, reverse=True)[:10] and set(found // 16) == {77}
    assert sum(opened) <= lexical.WAVE
    flat = lexical.Tree(term, doc, np.ones(8 * 4096, np.int64), 4096)
    assert len(flat.best(np.arange(8), 1)[0]) == 4096


# --- hard negatives ----------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, row long, cell long, q string, `a.b` double"


def mined(rows):
    """By the contract's words."""
    keep = []
    for k, (i, v, y) in enumerate(rows):
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        keep.append((k, i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, q))
    out, last = [], lambda i: (i is None, i or 0)
    for k, i, y, q in keep:
        if i is None or i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p)), *last(j), n, z, j) for n, j, z, p in keep if n != k)
        for s, _, _, _, _, j in [x for x in scored if x[4] == y][:5]:
            inside = [x for x in scored if x[4] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, j, r, x[5], -s, -x[0]) for r, x in enumerate(inside, 1)]
    return sorted(map(repr, out))


def negatives_of(spark, rows):
    df = spark.createDataFrame([(i, v, y, 1, 2, "x", 0.5) for i, v, y in rows], VECTORS)
    return sorted(repr(tuple(r)) for r in negatives.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_registered_negatives_as_sql(spark):
    assert len(same_as_sql(spark, "op11_hard_negatives")) > 20
    same_as_sql(spark, "op11_hard_negatives", "/root/testdata/sf0.01")


@pytest.mark.parametrize("cell, anchors, block", [(16_384, 2_048, 2_048), (40, 3, 7)])
def test_negatives_as_brute_force(spark, monkeypatch, cell, anchors, block):
    for name, value in (("CELL", cell), ("ANCHORS", anchors), ("BLOCK", block), ("BESIDE", block)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 6))
    rows = [(int(i), (centre[i % 4] + rng.normal(scale=0.4, size=6)).tolist(), int(i % 5 % 3)) for i in range(0, 1500, 5)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5, 0.0, 0.0], 1) for i in range(2001, 2060)]  # one vector, many rows
    rows += [(200, None, 1), (300, [1.0, None], 1), (400, [float("nan")] * 6, 1), (500, [float("inf")] * 6, 0), (600, [0.1] * 6, None), (None, [0.4] * 6, 2), (None, [0.4] * 6, 0)]
    rows += [(700, [0.4], 2), (800, [], 1), (100, [0.5] * 6, 1), (100, [0.5] * 6, 1), (900, [1e30] * 6, 0)]
    want = mined([r for r in rows if r[0] != 900 or r[1][0] != 1e30])
    assert negatives_of(spark, rows) == want and len(want) > 300


def test_negatives_of_few_rows(spark):
    assert negatives_of(spark, []) == []
    assert negatives_of(spark, [(0, [1.0], 1)]) == []
    assert negatives_of(spark, [(0, [1.0], 1), (1, [1.0], 2), (2, [0.5], 1)]) == mined([(0, [1.0], 1), (1, [1.0], 2), (2, [0.5], 1)])


def test_products_beyond_doubles(spark):
    rows = [(i, [float(2**18 + i), 1.0 * i], i % 2) for i in range(1, 40)] + [(100, [2.0**18, 0.3], 1)]
    rows += [(200 + i, [0.6 * 2**18 + i], 0) for i in range(1, 30)]
    assert negatives_of(spark, rows) == mined(rows)


# --- repeated strings --------------------------------------------------------------------------------------------

@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=14), min_size=1, max_size=5))
def test_linear_grouping_sorts_suffixes(texts):
    ends, want, base = np.cumsum([len(t) for t in texts]), [], 0
    for t in texts:
        want += [base + i for i in sorted(range(len(t)), key=lambda i: t[i:])]
        base += len(t)
    assert suffixes.sorted_suffixes(np.array(sum(texts, []), np.int16), ends).tolist() == want


def removal(texts):
    """By the contract's words."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(raw[i : i + 200] for raw in raws for i in range(len(raw) - 199))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if count[raw[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((len(raw), sum(gone), len(re.findall(b"\1+", gone)), kept))
    return out


def removed(spark, texts):
    rows = suffixes.without_repeats(documents(spark, list(enumerate(texts)))).collect()
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sorted(rows, key=lambda r: r["doc_id"])]


def mutated(rng, n):
    """Passages in new surroundings, near copies, copies, runs of one letter, umlauts."""
    words = ["".join(rng.choice(list("abcdefghéß"), rng.integers(2, 9))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(words, k))
    passages = [say(k) for k in (20, 32, 33, 34, 36, 40, 80)]
    out = []
    for i in range(n):
        t = say(int(rng.integers(5, 60))) + " " + passages[i % 7] + " " + say(int(rng.integers(1, 60)))
        out.append(t)
        if i % 3 == 0:
            cut = int(rng.integers(0, len(t)))
            out.append(t[:cut] + "#" + t[cut + 1 :])
    return [*out, out[0], out[0], "w " * 700, "x" * 199, "x" * 200, "ab" * 400, passages[6] * 3, None, "", "é" * 150]


@pytest.mark.parametrize("most, widths", [(64, (16, 1)), (2, (16, 1)), (1, (1,)), (3, (50, 7, 1))])
def test_repeats_as_brute_force(spark, monkeypatch, most, widths):
    monkeypatch.setattr(suffixes, "STRETCHES", most)
    monkeypatch.setattr(suffixes, "WIDTHS", widths)
    texts = mutated(np.random.default_rng(most), 60)
    got, want = removed(spark, texts), removal(texts)
    assert got == want and sum(w[1] for w in want) > 10_000 and any(w[2] > 1 for w in want)


def test_repeats_in_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HASHED", 700)
    monkeypatch.setattr(suffixes, "SORTED", 3000)
    texts = mutated(np.random.default_rng(9), 30)
    texts.append(" ".join(t for t in texts if t))
    assert removed(spark, texts) == removal(texts)


def test_repeats_of_odd_rows(spark):
    t = "one passage of its own " * 9 + "and an end"
    rows = [(None, t), (None, t[1:]), (5, None), (5, t), (5, t), (6, "")]
    got = suffixes.digests(suffixes.without_repeats(documents(spark, rows))).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got) == sorted([(len(t), len(t))] * 3 + [(len(t) - 1, len(t) - 1)] + [(0, 0)] * 2)
    assert suffixes.digests(suffixes.without_repeats(documents(spark, rows).limit(0))).count() == 0


def test_registered_repeats_as_sql(spark):
    got = same_as_sql(spark, "op12_suffix_dedup")
    assert (got.n_removed > 0).sum() > 10
