"""Ranked lexical search: every query item's best documents, by branch and bound over max trees.

A term is a maximal run outside the ASCII characters that are neither letters nor digits; only A-Z are lower-cased. With
N documents of at least one term, L their terms, n one document's terms, df the documents that hold a term and tf its
occurrences in the document, an item scores a document by the sum over its distinct terms of
    w * ((1000000000 * tf) div (1000 * tf + 8 * m)),  w = floor(1000 * ln((2N + 2) / (2df + 1))),  m = 10 + (90 * n * N) div L.

  * Postings: one pass counts each document's terms and keeps those that an item asks for, in the tasks that read the texts.
    N, L and df cover all documents.
  * Trees: a task goes through its postings in ranges of at most RANGE_POSTINGS. In a range, documents are leaves and FAN
    nodes have a parent; every node holds, for each term below it, the largest contribution of that term. A bound of an item
    at a node is the sum of its terms' maxima, which no document below exceeds.
  * Search: for each item the nodes of highest bounds are opened first, WAVE at a time, until no closed node's bound
    reaches the item's K-th best score so far. Nodes whose bound equals it are opened too, as a tie may hold a smaller
    doc_id. A task carries the K-th best score from range to range.
  * Every range gives K rows an item at most; a ranking over all ranges keeps the K best.

Items are searched for in blocks of at most BLOCK_BYTES of text (a longer item is a block of its own), so what is sent
to tasks is bounded; each block scans the postings of its own terms.

Null texts have no terms, and neither match nor count; items without terms give no rows. Equal items are answered each, under
their own item_id, and repeated documents are ranked each. Null item_ids stay null, a null doc_id comes last among ties.
Terms beyond the item's count once. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, forget

#: Documents that an item gets.
K = 10
#: UTF-8 bytes of items that one search sends to all tasks.
BLOCK_BYTES = 8_000_000
#: Postings that a task holds as one tree, but for those of a single document.
RANGE_POSTINGS = 2_000_000
#: Documents of such a tree at most.
RANGE_DOCS = 1 << 16
#: Children of a tree's node.
FAN = 16
#: Nodes opened at once.
WAVE = 64

#: Separators become spaces, A-Z small letters; bytes from 128 on are parts of terms.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def _blocks(items: DataFrame) -> DataFrame:
    """(block, item, item_id, terms): item numbers the rows, as ids may repeat or be null."""
    size = cut(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), bytes=F.sum(F.octet_length("text")))
    parts = 1 + int(size.seen["bytes"] or 0) // BLOCK_BYTES

    def run(batches):
        block = held = at = 0
        for batch in batches:
            out = []
            for part, row, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held += len(text or "") * 4
                if held > BLOCK_BYTES and at:
                    block, held = block + 1, len(text or "") * 4
                at += 1
                out.append((part * (1 << 32) + block, row, item_id, sorted(set(terms(text)))))
            b, r, i, t = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(r, pa.int64()), pa.array(i, pa.int64()), pa.array(t, pa.list_(pa.binary()))], ["block", "item", "item_id", "terms"])

    rows = size.coalesce(parts).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("row"), "item_id", "text")
    out = cut(arrow_map(rows, run, "block long, item long, item_id long, terms array<binary>").where(F.size("terms") > 0))
    forget(size)
    return out


def _postings(docs: DataFrame, numbers) -> DataFrame:
    """(doc_id, n, term, tf) of each document that has terms: its number of terms, and the item terms in it. `seen` has N and L."""

    def run(batches):
        number = numbers.value.get
        for batch in batches:
            ids, sizes, lengths, found, counts = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms(text)
                if not words:
                    continue
                held = Counter(map(number, words))
                held.pop(None, None)
                ids.append(doc_id)
                sizes.append(len(words))
                lengths.append(len(held))
                found += held
                counts += held.values()
            at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(found, pa.int32())), pa.ListArray.from_arrays(pa.array(at), pa.array(counts, pa.int64())),
            ], ["doc_id", "n", "term", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(arrow_map(rows, run, "doc_id long, n long, term array<int>, tf array<long>"), n=F.sum("n"))


class Tree:
    """Max tree of a range of documents, by term: level 0 holds the documents' contributions, every further one the maxima of
    FAN nodes of the one below. A level is sorted arrays of term * width + node and of values."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int):
        self.levels, width = [], docs
        order = np.lexsort((doc, term))
        term, node, value = term[order].astype(np.int64), doc[order].astype(np.int64), value[order]
        while True:
            self.levels.append((term * width + node, value, width))
            if width <= FAN:
                break
            width = -(-width // FAN)
            key = term * width + node // FAN
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            term, node, value = term[first], node[first] // FAN, np.maximum.reduceat(value, first) if len(first) else value

    def children(self, terms: np.ndarray, level: int, nodes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The nodes at `level` under the given ones of the level above (None: all), and their bounds. Only nodes of a term."""
        keys, values, width = self.levels[level]
        start = np.zeros(1, np.int64) if nodes is None else nodes * FAN
        stop = np.minimum(start + (width if nodes is None else FAN), width)
        base = terms[:, None] * width
        lo, hi = (np.searchsorted(keys, (base + x).ravel()) for x in (start, stop))
        count = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        child, slot = np.unique(keys[at] % width, return_inverse=True)
        total = np.zeros(len(child), np.int64)
        np.add.at(total, slot, values[at])
        return child, total

    def best(self, terms: np.ndarray, floor: int, k: int = K) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores that may be among the item's k best, all those of at least the k-th score here and `floor`,
        and the k-th score so far."""
        top = len(self.levels) - 1
        heap: list[tuple[int, int, int]] = []
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def meet(level: int, nodes: np.ndarray | None) -> None:
            nonlocal docs, scores, floor
            child, bound = self.children(terms, level, nodes)
            good = bound >= floor
            child, bound = child[good], bound[good]
            if level:
                for node, b in zip(child.tolist(), bound.tolist(), strict=True):
                    heappush(heap, (-b, level, node))
                return
            docs, scores = np.concatenate([docs, child]), np.concatenate([scores, bound])
            if len(scores) >= k:
                floor = max(floor, int(np.partition(scores, -k)[-k]))
                good = scores >= floor
                docs, scores = docs[good], scores[good]

        meet(top, None)
        while heap and -heap[0][0] >= floor:
            wave: dict[int, list[int]] = {}
            for _ in range(WAVE):
                if not heap or -heap[0][0] < floor:
                    break
                _, level, node = heappop(heap)
                wave.setdefault(level, []).append(node)
            for level, nodes in wave.items():
                meet(level - 1, np.array(nodes, np.int64))
        return docs, scores, floor


def _searched(postings: DataFrame, query) -> DataFrame:
    """(item, doc_id, score): of each range of documents those that may be among an item's K best."""

    def run(batches):
        weights, wanted, total, terms_total = query.value
        floors = [1] * len(wanted)  # scores above 0 only
        held: list[tuple[np.ndarray, ...]] = []
        size = docs = 0

        def emit():
            nonlocal held, size, docs
            if not held:
                return None
            ids = pa.concat_arrays([h[0] for h in held])
            n, lengths, term, tf = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
            held, size, docs = [], 0, 0
            order = np.argsort(n, kind="stable")  # neighbours of similar length bound each other tightly
            doc = np.repeat(np.argsort(order), lengths)
            m = np.repeat(10 + (90 * n * total) // terms_total, lengths)
            value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            tree = Tree(term, doc, value, len(n))
            rows: list[tuple[int, np.ndarray, np.ndarray]] = []
            for i, (item, asked) in enumerate(wanted):
                found, scores, floors[i] = tree.best(asked, floors[i])
                if len(found) > K:  # ties: those of the smallest doc_ids
                    these = ids.take(pa.array(order[found])).to_pylist()
                    keep = sorted(range(len(found)), key=lambda j: (-scores[j], these[j] is None, these[j] or 0))[:K]
                    found, scores = found[keep], scores[keep]
                rows.append((item, order[found], scores))
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[1]) for r in rows])), ids.take(pa.array(np.concatenate([r[1] for r in rows]).astype(np.int64))), pa.array(np.concatenate([r[2] for r in rows])),
            ], ["item", "doc_id", "score"])

        for batch in batches:
            ends = np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
            begin = 0
            while begin < batch.num_rows:
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, min(int(np.searchsorted(ends, before + RANGE_POSTINGS - size, "right")), begin + RANGE_DOCS - docs))
                part = batch.slice(begin, end - begin)
                term, tf = part.column(2), part.column(3)
                held.append((part.column(0), part.column(1).to_numpy(), np.diff(term.offsets.to_numpy()), term.flatten().to_numpy(), tf.flatten().to_numpy()))
                size, docs, begin = size + len(held[-1][3]), docs + end - begin, end
                if size >= RANGE_POSTINGS or docs >= RANGE_DOCS:
                    yield emit()
        last = emit()
        if last is not None:
            yield last

    return arrow_map(postings, run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's K highest-scoring documents with a score above 0, ties by doc_id."""
    spark = docs.sparkSession
    blocks = _blocks(items)
    answers = None
    for (block,) in sorted(blocks.select("block").distinct().collect()):  # a number for each 8 MB of items
        rows = blocks.where(F.col("block") == block).select("item", "terms").collect()
        numbers = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
        sent = spark.sparkContext.broadcast(numbers)
        postings = _postings(docs, sent)
        total, length = postings.seen["rows"], postings.seen["n"] or 1
        held = postings.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(total) + 2) / (2 * F.col("df") + 1)))
        weights = np.zeros(len(numbers), np.int64)  # a number for each term of the block
        for r in held.select("term", weight.alias("w")).collect():
            weights[r["term"]] = r["w"]
        wanted = [(r["item"], np.array([n for t in r["terms"] if weights[n := numbers[bytes(t)]]], np.int64)) for r in rows]
        query = spark.sparkContext.broadcast((weights, wanted, total, length))
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = _searched(postings, query).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K)
        found = cut(ranked)
        forget(postings)
        sent.destroy()
        query.destroy()
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return answers.join(blocks.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


#: The same in DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
i AS (
  SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, n_docs),
m AS (SELECT k, doc_id, 10 + (90 * len(terms) * n_docs) // n_terms AS m FROM d, s WHERE len(terms) > 0),
a AS (SELECT q, item_id, unnest(terms) AS term FROM i),
x AS (
  SELECT q, item_id, m.k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM a JOIN w USING (term) JOIN t USING (term) JOIN m USING (k) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST, k) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
