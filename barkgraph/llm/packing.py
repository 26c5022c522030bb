"""Token packing by Karmarkar-Karp multiway differencing.

Every document becomes the ids of a public tokenizer (no special tokens added) and a closing id.
Whole runs of `capacity` ids are windows of their own. The rest of each document is cut into pieces
of at most PIECE ids and gathered into groups of a fixed number of ids, whatever the input's size.
Within a group the pieces are dealt to k windows by the largest differencing method: the partial
partitions with the largest imbalances are merged so that the fullest window of one meets the
emptiest of the other. Windows come out nearly equal; where one exceeds the capacity, k rises by one
and the group is dealt again.

Packing happens while a task streams through its input: there is no shuffle, and memory is bounded by a
group. Sequence ids hold the input partition's number in their upper bits, so a retried task makes the
same rows again.

Null and empty texts are the closing id alone. Repeated rows are packed as often as they occur. A null
doc_id stays null. Ties between equal pieces fall in input order. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

CAPACITY = 2048
#: Longest piece of a document's last part: most documents stay whole, and windows still balance closely.
PIECE = 512
#: Windows in a group, and ids that a group leaves free in each of them.
GROUP, SLACK = 128, 20
CLOSING_ID = 1
#: Words without their closing punctuation that a generation of a worker's memory holds; those coded in one call of the
#: tokenizer; bytes of text (and one text) whose words are told apart at once.
CACHED_CORES, CORES_AT_ONCE, TEXT_BYTES = 200_000, 200, 2 << 20
#: Texts on which a vocabulary shows whether the ids of a text are those of its words, one after another.
_PROBES = ("One  two\nthree\tFOUR", "don't it's we'll", "Éçan, mentle. 12,345 x1y2 -- (a_b)", "été ÜBER naïve…", " lead and trail ", "a\n\nb", "“quoted” words: 3.14%")

#: Letters that lower-casing maps one to one, and ASCII punctuation.
_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130)]))
_PUNCTUATION = string.punctuation


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k windows with nearly equal sums."""
    n = len(sizes)
    if k == 1 or n == 0:
        return [list(range(n))] + [[] for _ in range(k - 1)]
    follow = np.full(n, -1)
    heap = []
    for i, s in enumerate(sizes):
        sums, heads = np.zeros(k, np.int64), np.full(k, -1)
        sums[0], heads[0] = s, i
        heap.append((-s, i, sums, heads, heads.copy()))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, ah, at = heapq.heappop(heap)
        _, _, b, bh, bt = heapq.heappop(heap)
        b, bh, bt = b[::-1], bh[::-1], bt[::-1]
        joined = np.flatnonzero((ah >= 0) & (bh >= 0))
        follow[at[joined]] = bh[joined]
        heads, tails = np.where(ah >= 0, ah, bh), np.where(bt >= 0, bt, at)
        sums = a + b
        down = np.argsort(-sums, kind="stable")
        sums = sums[down]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), order, sums, heads[down], tails[down]))
        order += 1
    out = []
    for i in heap[0][3].tolist():
        window = []
        while i >= 0:
            window.append(i)
            i = int(follow[i])
        out.append(window)
    return out


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows within the capacity, as few as differencing finds from the least possible number on."""
    k = -(-sum(sizes) // capacity)
    while True:
        windows = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        k += 1


class Generations(dict):
    """What was used of late: a full generation becomes the older one, from which entries come back when they are used."""

    def __init__(self, size: int):
        self.size, self.older = size, {}

    def __missing__(self, key):
        value = self[key] = self.older[key]
        return value

    def unknown(self, keys: list) -> list:
        older = self.older
        return [k for k in keys if k not in self and k not in older]

    def room(self, n: int) -> None:
        if len(self) + n > self.size:
            self.older = dict(self)
            self.clear()


class Words(Generations):
    """Ids of words without closing punctuation, and of punctuation, as little-endian bytes. Where pretokens never span
    white space and letters are lower-cased, a text's ids are its words' ids one after another; a vocabulary file that
    treats the probes otherwise codes every text as a whole. Words are told apart and their ids put together by array:
    Python sees each different one of a call once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for lower-case words of plain letters: the same model without the patterns that would find such words
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        super().__init__(CACHED_CORES)
        self.by_word = True
        self.by_word = self.encode(list(_PROBES)) == self.whole(list(_PROBES))

    def whole(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(x.ids, "<u4").tobytes() for x in encode(texts, add_special_tokens=False)]

    def _learn_cores(self, cores: list[str]) -> None:
        """Ids of lower-case words of plain letters: each is one pretoken, so many are coded as one text and its ids
        told apart by the pretokens' numbers."""
        n = CORES_AT_ONCE
        parts = [cores[i : i + n] for i in range(0, len(cores), n)]
        for part, x in zip(parts, self.plain.encode_batch([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            raw = np.array(x.ids, "<u4").tobytes()
            at = (4 * np.flatnonzero(np.diff(x.word_ids, prepend=-1))).tolist()
            at.append(len(raw))
            self.update(zip(part, [raw[s:e] for s, e in zip(at, at[1:])], strict=True))

    def _coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one after another, and where each word's end. A word of letters and closing ASCII
        punctuation has the ids of both, one after the other: a pretoken holds letters or punctuation, never both (but
        for contractions, which have letters after the apostrophe)."""
        cores, tails, size = pc.utf8_rtrim(words, _PUNCTUATION), pc.utf8_ltrim(words, _LETTERS), pc.binary_length
        # the closing punctuation begins where the letters before it end
        plain = pc.and_(pc.greater(size(cores), 0), pc.equal(pc.add(size(cores), size(tails)), size(words)))
        cores, tails = pc.if_else(plain, pc.utf8_lower(cores), words), pc.if_else(plain, tails, "")
        parts = pa.concat_arrays([cores, tails]).dictionary_encode()
        names, which = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy()
        letters = (size(pc.utf8_ltrim(parts.dictionary, _LETTERS)).to_numpy() == 0).tolist()
        self.room(len(names))
        self._learn_cores(self.unknown([n for n, x in zip(names, letters) if x and n]))
        odd = self.unknown([n for n, x in zip(names, letters) if not x or not n])
        self.update(zip(odd, self.whole(odd), strict=True))
        found = list(map(self.__getitem__, names))
        ids, ends = gathered(np.frombuffer(b"".join(found), "<u4"), _ends(found), which.reshape(2, -1).T.ravel())
        return ids, ends[1::2]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are not null, one after another, and where each text's end."""
        if not self.by_word:
            coded = self.whole(texts.to_pylist())
            return np.frombuffer(b"".join(coded), "<u4"), _ends(coded)
        # other white space stays within words, which the tokenizer then sees
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids, ends = gathered(*self._coded(words.dictionary), words.indices.to_numpy())
        return ids, np.append(0, ends)[np.cumsum(pc.list_value_length(split).to_numpy())]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.flat(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if texts else []


def _ends(coded: list[bytes]) -> np.ndarray:
    return np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))) // 4


def gathered(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values that end at ends[i], for each i of which, one after another, and where each of them ends."""
    n = np.diff(ends, prepend=0)[which]
    out = np.cumsum(n)
    at = np.repeat(ends[which] - out, n)
    at += np.arange(len(at))
    return values[at], out


_WORDS: dict[str, Words] = {}


def _words(path: str) -> Words:
    """One per worker, kept from task to task."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


class _Packer:
    def __init__(self, capacity: int, first: int):
        self.capacity, self.sequence = capacity, first
        self.target = GROUP * (capacity - SLACK)
        self.held, self.size, self.out = [], 0, []

    def add(self, doc, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        whole = total - total % self.capacity
        while at < whole:
            self.out.append((doc, at, self.capacity, total, self.sequence, 0, ids[4 * at : 4 * (at + self.capacity)]))
            self.sequence += 1
            at += self.capacity
        while at < total:
            n = min(PIECE, total - at, self.target - self.size)
            self.held.append((doc, at, n, total, ids[4 * at : 4 * (at + n)]))
            self.size += n
            at += n
            if self.size == self.target:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        for window in balanced([x[2] for x in self.held], self.capacity):
            offset = 0
            for i in window:
                doc, start, n, total, ids = self.held[i]
                self.out.append((doc, start, n, total, self.sequence, offset, ids))
                offset += n
            self.sequence += 1
        self.held, self.size = [], 0

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) if self.out else [[] for _ in _NAMES]
        self.out = []
        types = [pa.int64()] * 6 + [pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_NAMES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, sequence_id, offset, ids): each piece of each document
    and its place; ids as little-endian unsigned 32-bit integers. tokenizer: path of a vocabulary file that
    every executor has."""
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, context = _words(tokenizer), TaskContext.get()
        packer = _Packer(capacity, (context.partitionId() if context else 0) << 36)
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
            # rows of about TEXT_BYTES at a time
            fill = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // TEXT_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(fill)) + 1).tolist(), len(docs)]
            for i, j in zip(cuts, cuts[1:]):
                ids, ends = words.flat(texts.slice(i, j - i))
                for doc, part in zip(docs[i:j], np.split(ids, ends[:-1]), strict=True):
                    packer.add(doc, part.tobytes() + closing)
                yield packer.batch()
        packer.flush()
        yield packer.batch()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, _SCHEMA)


def piece_digests(packed: DataFrame) -> DataFrame:
    """The packed pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
