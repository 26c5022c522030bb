"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every text gives a sparse vector: hashed words (lower-cased cores and, apart from them, the punctuation
attached to them), and one-hot bins of structure statistics and of metadata that follow from the text alone
(its length in code points, bytes and lines, its script). The score is
    w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)
through a sigmoid, so a document costs time linear in its distinct features.

The model is fitted on the driver from at most LABELLED_SAMPLE labelled documents, the ones with the
smallest hash of doc_id among those that may be learnt from; scoring covers all rows. labels, lang, source
and doc_id are never inputs. Without labels of both classes every score is 0.5.

Null and empty texts get the score that the model gives to an empty vector of words. Scores depend on the
text alone, so repeated rows agree. A null doc_id is scored but never learnt from. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Labelled documents that the fit sees at most.
LABELLED_SAMPLE = 6000
BUCKETS = 1 << 14
FACTORS = 8
BINS = 12
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.02, 2e-4
CACHED_WORDS = 100_000
PREDICT = 0.3

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”’‘…–—¿¡"
#: Names of the statistics, in the order of statistics().
STATS = ("log_chars", "log_bytes", "log_lines", "non_ascii", "mean_word", "distinct", "top_word", "punct_tail", "alone_punct", "upper", "digit", "alpha", "line_words", "repeated_lines", "end_stop", "repeat_next")


class Buckets(dict):
    """Word to the pair of hashed feature ids as one number: core * (BUCKETS + 1) + punctuation."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        core = word.strip(_EDGE)
        rest = word.replace(core, " ", 1) if core else word
        a = zlib.crc32(core.encode()) % BUCKETS if core else BUCKETS
        b = zlib.crc32(b"\0" + rest.encode()) % BUCKETS if rest.strip() else BUCKETS
        v = self[word] = a * (BUCKETS + 1) + b
        return v


def statistics(text: str, words: list[str], codes: np.ndarray) -> np.ndarray:
    """Structure statistics and metadata of one text, in STATS' order."""
    n, chars = len(words), len(text)
    if not n:
        return np.zeros(len(STATS))
    raw = text.encode()
    tail = codes % (BUCKETS + 1) != BUCKETS
    bare = codes // (BUCKETS + 1) == BUCKETS
    _, counts = np.unique(codes, return_counts=True)
    lines = text.split("\n")
    kept = [x for x in lines if x.strip()] or [""]
    array = np.frombuffer(raw, np.uint8)
    upper = ((array >= 65) & (array <= 90)).sum() / chars
    lower = ((array >= 97) & (array <= 122)).sum() / chars
    digit = ((array >= 48) & (array <= 57)).sum() / chars
    return np.array([
        np.log1p(chars), np.log1p(len(raw)), np.log1p(len(lines)), (array >= 128).sum() / chars, chars / n, len(counts) / n, counts.max() / n, tail.mean(), bare.mean(), upper, digit,
        lower, n / len(kept), 1 - len(set(kept)) / len(kept), sum(x.rstrip()[-1] in ".!?" for x in kept if x.rstrip()) / len(kept), (codes[1:] == codes[:-1]).mean() if n > 1 else 0.0,
    ])


def vector(text: str | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word feature ids, values, statistics)."""
    text = text or ""
    words = text.lower().split()
    codes = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
    stats = statistics(text, words, codes)
    ids = np.concatenate([codes // (BUCKETS + 1), codes % (BUCKETS + 1)])
    ids, counts = np.unique(ids[ids < BUCKETS], return_counts=True)
    values = np.log1p(counts)
    norm = np.sqrt((values**2).sum())
    return ids, (values / norm if norm else values), stats


@dataclass
class Model:
    edges: np.ndarray  # statistics x (BINS - 1)
    bias: float
    w: np.ndarray
    v: np.ndarray

    def bins(self, stats: np.ndarray) -> np.ndarray:
        """Feature ids of the statistics' bins."""
        return BUCKETS + np.arange(len(STATS)) * BINS + (stats[:, None] >= self.edges).sum(axis=1)

    def score(self, text: str | None, buckets: Buckets) -> float:
        ids, values, stats = vector(text, buckets)
        ids, x = np.concatenate([ids, self.bins(stats)]), np.concatenate([values, np.full(len(STATS), 0.5)])
        vx = self.v[ids] * x[:, None]
        z = self.bias + self.w[ids] @ x + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[str | None], labels: list[int], seed: int = 11) -> Model:
    """Logistic loss by Adam over mini-batches; the same rows always give the same model."""
    size, rng, buckets = BUCKETS + len(STATS) * BINS, np.random.default_rng(seed), Buckets()
    y = np.array(labels, float)
    model = Model(np.zeros((len(STATS), BINS - 1)), 0.0, np.zeros(size), rng.normal(0, 0.01, (size, FACTORS)))
    if len(set(labels)) < 2:
        model.v[:] = 0
        return model
    rows = [vector(t, buckets) for t in texts]
    stats = np.array([r[2] for r in rows])
    model.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    ids = [np.concatenate([r[0], model.bins(r[2])]) for r in rows]
    xs = [np.concatenate([r[1], np.full(len(STATS), 0.5)]) for r in rows]
    model.bias = float(np.log(y.mean() / (1 - y.mean())))
    params = np.concatenate([model.w[:, None], model.v], axis=1)
    m, s, step = np.zeros_like(params), np.zeros_like(params), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            flat, x = np.concatenate([ids[k] for k in part]), np.concatenate([xs[k] for k in part])
            lengths = np.array([len(ids[k]) for k in part])
            starts, doc = np.r_[0, np.cumsum(lengths)[:-1]], np.repeat(np.arange(len(part)), lengths)
            p = params[flat]
            vx = p[:, 1:] * x[:, None]
            total = np.add.reduceat(vx, starts)
            z = model.bias + np.add.reduceat(p[:, 0] * x, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            gx = (g[doc] * x)[:, None]
            grads = np.concatenate([gx, gx * (total[doc] - vx)], axis=1)
            seen, at = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(at, grads[:, f], len(seen)) for f in range(FACTORS + 1)], axis=1) + DECAY * params[seen] / 10
            step += 1
            m[seen] = 0.9 * m[seen] + 0.1 * grad
            s[seen] = 0.99 * s[seen] + 0.01 * grad**2
            params[seen] -= RATE * (m[seen] / (1 - 0.9**step)) / (np.sqrt(s[seen] / (1 - 0.99**step)) + 1e-8)
            model.bias -= RATE * float(g.sum())
    model.w, model.v = params[:, 0].copy(), params[:, 1:].copy()
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, size: int) -> tuple[list, list]:
    """Texts and labels of at most size documents, those with the smallest hash of doc_id; learn: a condition on
    doc_id for the rows that may be learnt from. Of rows that repeat a doc_id the smallest text counts."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # at most `size` ids and integers: a bounded broadcast
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    got = sorted(texts.toArrow().to_pylist(), key=lambda r: r["doc_id"])
    return [r["text"] for r in got], [r["y"] for r in got]


def remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def score_quality(docs: DataFrame, labels: DataFrame, held_out=None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    held = F.coalesce(remainder(5) == 0, F.lit(False)) if held_out is None else held_out
    model = fit(*labelled_sample(docs, labels, "quality", ~held, LABELLED_SAMPLE))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x FACTORS numbers, whatever the input

    def start():
        buckets, own = Buckets(), shared.value

        def step(batch):
            scores = [own.score(t, buckets) for t in batch.column(1).to_pylist()]
            return pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = map_batches(rows, "doc_id long, score double", start)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
