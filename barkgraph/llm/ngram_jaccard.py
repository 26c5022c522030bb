"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set is its distinct five-word shingles. Words are the runs outside space and
0x09-0x0D of the text with A-Z lowered; a text of fewer words is one shingle, and a text without
words has the empty set, which links with nothing. Two documents link when
100 * |A & B| >= 75 * |A | B|.

How the join works
  * Shingles are 64-bit hashes and their order is the hash order. Documents with equal sets collapse
    into one representative first, so exact copies cost one row whatever their number.
  * The prefix of match share s of a set of n shingles is its n - ceil(0.75 n) + l smallest hashes, with
    l = ceil(s n). If two sets link, their prefixes share at least the smaller l of the two: that many
    shared prefix hashes a pair must have before any verification.
  * Every document starts with the share SHARES[0]. Documents whose prefix is met too rarely in others (all
    ordinary prose, also with quoted passages) leave here. Each of the rest is first compared with the
    document that leads most of its posting lists; this is linear in the postings and joins most copies.
  * From then on a hash counts only if it touches two different components, and documents that have too
    few such hashes for their l leave; this is repeated while it helps. The candidates of what remains are
    estimated from the lengths of the posting lists. A document that costs at most CANDIDATE_COST is joined
    at its present prefix. A dearer one gets the next, longer prefix of SHARES, of which its partners must
    match correspondingly more, and so on up to its whole set, where they must match 75 %.
  * Documents that are dear even then share nearly all they have with many others: large families of
    copies. Each has a hub h there, the document that it shares most hashes with, and s of its hashes lie in
    h. Two documents of one hub share at most min(s_x, s_y) hashes inside h; so only pairs that share hashes
    outside h, or are small beside s, can link, and these are few. A pair across hubs must share 75 %
    of hashes that touch two hubs and two components; documents that have them get hubs of their own, and so on.
  * All links are verified exactly over whole sets. Nothing is sampled or capped.

Partitions of the posting index are arrays in one Python worker, but for long posting lists: where a partition holds more
than CROWDED postings, its lists of more than LONG_LIST stay in Spark. There a list is aggregated
before it is shuffled, and its pairs are made in blocks, so a hash that any share of all documents hold meets in no one task.

Nulls: a null text has the empty set; a null doc_id yields a row with a null component. Rows that repeat a
doc_id are told apart by their sets; equal rows give equal result rows. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_map, cut, forget, sent

SHINGLE = 5
#: Shares of a set by which prefixes are lengthened, step by step, and which partners must match; 0.75 is the whole set.
SHARES = (0.04, 0.25, 0.75)
#: Estimated candidates of a document above which its prefix grows.
CANDIDATE_COST = 8
#: Share of the postings that a round of peeling must remove for another one to follow, and that a level of hubs
#: must settle for another level.
PEEL, SETTLED = 0.1, 0.5
#: UTF-8 bytes of text for each partition of the first posting index, and postings for each of the later ones.
BYTES_PER_PARTITION, POSTS_PER_PARTITION = 24_000_000, 1_000_000
#: Postings above which a partition is crowded, postings of one hash that it then leaves to Spark, and those of each side of
#: a block of their pairs.
CROWDED, LONG_LIST, BLOCK = 2_000_000, 250_000, 4096
#: Bytes of text whose postings a task joins before it publishes them.
HELD_BYTES = 6_000_000
#: Words whose hashes a task remembers, texts and postings that it handles at once.
CACHED_WORDS, TEXTS_AT_ONCE, POSTS_AT_ONCE = 100_000, 128, 500_000
#: New postings that a partition of the first index gathers at least before it settles them.
UNSETTLED = 4_000_000

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class _Words(dict):
    def __init__(self, seed: int = 0):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None, words: _Words) -> np.ndarray:
    """Sorted distinct shingle hashes (int64) of one text in UTF-8."""
    tokens = text.lower().split() if text else []
    n = len(tokens)
    if not n:
        return np.empty(0, np.int64)
    w = np.fromiter(map(words.__getitem__, tokens), np.uint64, n)
    if n < SHINGLE:
        h = np.full(1, n, np.uint64) * _MULT[4]
        for k in range(n):
            h = _mix((h ^ w[k : k + 1]) * _MULT[k])
        return h.view(np.int64)
    m = n - SHINGLE + 1
    h = w[:m] * _MULT[0]
    for k in range(1, SHINGLE):
        h = _mix(h) + w[k : k + m] * _MULT[k]
    return np.unique(_mix(h).view(np.int64))


def least_overlap(n):
    """Shingles that a set of n shares with any set that it links with."""
    return (3 * n + 3) // 4


def match(n: int, share: float) -> int:
    """Prefix hashes that a set of n and its partners must share; whole sets share all their overlap."""
    return min(least_overlap(n), max(1, int(np.ceil(share * n - 1e-9))))


def prefix_length(n: int, share: float) -> int:
    return n - least_overlap(n) + match(n, share)


def _match(n, share: float):
    """match() as a column."""
    return F.least(_least(n), F.greatest(F.lit(1), F.ceil(F.lit(share) * n - 1e-9))).cast("long")


def _least(n):
    return F.floor((3 * n + 3) / 4).cast("long")


def _need(n, share: float):
    """What the smallest possible partner of a set of n must match."""
    return _match(_least(n), share)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def _fingerprint(s: np.ndarray, seed: int) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes(), seed)
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists and the row of each."""
    lengths = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lengths)


def _arrays(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values, pa.int64()))


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, lengths) of the runs of equal values in sorted columns."""
    n = len(columns[0])
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, n])


# --- the first postings --------------------------------------------------------------------------------------------


def _published(docs: DataFrame, partitions: int, seed: int) -> DataFrame:
    """Rows of three kinds in one pass over the texts:
    (key, doc_id, n, check): a document with the two halves of its set's 128-bit fingerprint;
    (key, leader, tokens): prefix hashes met within the task by a set that isn't the smallest of those that
        the task saw with them;
    (part, met, keys, postings): for a partition of the posting index the hashes as int64, and for each the
        smallest set that the task saw with it; met tells whether the task saw others.
    Equal sets have one key, so copies are one member of a list."""
    names = ["key", "doc_id", "n", "check", "leader", "tokens", "part", "met", "keys", "postings"]
    types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]

    def rows(size, **columns):
        return pa.record_batch([columns[k] if k in columns else pa.nulls(size, t) for k, t in zip(names, types, strict=True)], names=names)

    def run(batches):
        words, known, prefixes, size = _Words(seed), [], [], 0

        def emit():
            doc, n, a, b = (np.array(c, np.int64) for c in zip(*[(-1 if i is None else i, *x) for i, *x in known], strict=True))
            null = np.array([i is None for i, *_ in known])
            yield rows(len(n), key=pa.array(a), doc_id=pa.array(doc, mask=null), n=pa.array(n), check=pa.array(b))
            _, once = np.unique(a, return_index=True)
            key = np.repeat(a[once], [len(prefixes[i]) for i in once])
            token = np.concatenate([prefixes[i] for i in once])
            order = np.lexsort((key, token))
            key, token = key[order], token[order]
            first, length = _runs(token)
            smallest = np.zeros(len(key), bool)
            smallest[first] = True
            part = (token[first].view(np.uint64) % np.uint64(partitions)).astype(np.int32) * 2 + (length > 1)
            order = np.argsort(part, kind="stable")
            own, led = token[first][order], key[first][order]
            at, runs = _runs(part[order])
            cells = [(int(part[order[s]]) >> 1, bool(part[order[s]] & 1), led[s : s + m].tobytes(), own[s : s + m].tobytes()) for s, m in zip(at, runs, strict=True)]
            if cells:
                c = list(zip(*cells, strict=True))
                yield rows(len(cells), part=pa.array(c[0], pa.int32()), met=pa.array(c[1]), keys=pa.array(c[2], pa.binary()), postings=pa.array(c[3], pa.binary()))
            leader = np.repeat(key[first], length)[~smallest]
            for k, lead, tokens in _packed(key[~smallest], leader, token[~smallest]):
                yield rows(len(k), key=k, leader=lead, tokens=tokens)

        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(i, TEXTS_AT_ONCE)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                    text = text.as_py()
                    s = shingle_set(text, words)
                    known.append((doc_id, len(s), *_fingerprint(s, seed)))
                    prefixes.append(s[: prefix_length(len(s), SHARES[0])].copy())
                    size += len(text or b"")
                    if size >= HELD_BYTES:
                        yield from emit()
                        known, prefixes, size = [], [], 0
        if known:
            yield from emit()

    schema = "key long, doc_id long, n long, check long, leader long, tokens array<long>, part int, met boolean, keys binary, postings binary"
    return arrow_map(_texts(docs), run, schema)


def _packed(key: np.ndarray, leader: np.ndarray, token: np.ndarray, size=50_000):
    """Columns with one row per (key, leader) and the list of its tokens."""
    order = np.lexsort((leader, key))
    key, leader, token = key[order], leader[order], token[order]
    first, length = _runs(key, leader)
    for i in range(0, len(first), size):
        s, m = first[i : i + size], length[i : i + size]
        yield pa.array(key[s]), pa.array(leader[s]), _arrays(token[s[0] : s[-1] + m[-1]], m)


def _shared(published: DataFrame, partitions: int) -> DataFrame:
    """(key, leader, tokens): the prefix hashes that a set shares with another set, by the smallest set of the posting
    list or of the part of it that one task saw. A worker keeps one posting of each hash, whatever the list's length."""

    def settled(columns, last):
        """Rows for the postings that aren't the smallest of their hash, and the smallest: (keys, hashes, met)."""
        key, token, met = (np.concatenate(c) for c in zip(*columns, strict=True))
        order = np.lexsort((key, token))
        key, token, met = key[order], token[order], met[order]
        first, _ = _runs(key, token)  # a set that several tasks saw, met if any says so
        met = np.logical_or.reduceat(met, first)
        key, token = key[first], token[first]
        first, length = _runs(token)
        near, leader = np.repeat(length > 1, length) | met, np.repeat(key[first], length)
        smallest = (key[first], token[first], near[first])
        if not last:
            near[first] = False
        rows = _packed(key[near], leader[near], token[near])
        return (pa.record_batch(list(c), names=["key", "leader", "tokens"]) for c in rows), smallest

    def run(batches):
        held, fresh, kept = [], 0, 0
        for b in batches:
            for k, t, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = np.frombuffer(k, np.int64)
                held.append((k, np.frombuffer(t, np.int64), np.full(len(k), m)))
                fresh += len(k)
                if fresh > max(UNSETTLED, kept):
                    rows, smallest = settled(held, False)
                    yield from rows
                    held, fresh, kept = [smallest], 0, len(smallest[0])
        if held:
            yield from settled(held, True)[0]

    apart = published.where("part is not null").select("keys", "postings", "met", "part").repartitionById(partitions, "part")
    joined = arrow_map(apart.select("keys", "postings", "met"), run, "key long, leader long, tokens array<long>")
    return published.where("leader is not null").select("key", "leader", "tokens").unionByName(joined)


def _sets(docs: DataFrame, alive: DataFrame, seed: int) -> DataFrame:
    """(key, n, tokens): the whole sets of alive (key, doc_id)."""

    def run(batches):
        words = _Words(seed)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(i, TEXTS_AT_ONCE)
                sets = [(k, s) for k, t in zip(some.column(0).to_pylist(), some.column(1), strict=True) if _fingerprint(s := shingle_set(t.as_py(), words), seed)[0] == k]
                lengths = np.array([len(s) for _, s in sets], np.int64)
                flat = np.concatenate([s for _, s in sets]) if sets else np.empty(0, np.int64)
                yield pa.record_batch([pa.array([k for k, _ in sets], pa.int64()), pa.array(lengths), _arrays(flat, lengths)], names=["key", "n", "tokens"])

    wanted = _texts(docs).join(sent(alive, alive.select("key", "doc_id")), "doc_id").select("key", "text")
    sets = cut(arrow_map(wanted, run, "key long, n long, tokens array<long>"))
    if sets.seen["rows"] > alive.seen["rows"]:  # rows that repeat both the doc_id and the text
        once = cut(sets.dropDuplicates(["key"]))
        forget(sets)
        return once
    return sets


# --- the posting index ---------------------------------------------------------------------------------------------
# Its rows hold (key, comp, n, need, part, tokens): the postings of one set in one partition of the index; comp is the
# set's component so far, need the number of such hashes that it must keep. Postings of long lists have the part LONG.

_ROW = "key long, comp long, n long, need long, part int, tokens array<long>"
_COLUMNS = ["key", "comp", "n", "need", "part", "tokens"]
LONG = -1


def _split(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows of (key, comp, n, need, tokens), dealt to the partitions of the index."""

    def cells(some):
        token, owner = _flat(some.column(4))
        part = (token.view(np.uint64) % np.uint64(partitions)).astype(np.int64)
        order = np.argsort(part * max(some.num_rows, 1) + owner, kind="stable")
        token, owner, part = token[order], owner[order], part[order]
        first, length = _runs(part, owner)
        own = [some.column(k).take(pa.array(owner[first])) for k in range(4)]
        return pa.record_batch([*own, pa.array(part[first], pa.int32()), _arrays(token, length)], names=_COLUMNS)

    def run(batches):
        for batch in batches:
            ends = np.cumsum(np.diff(batch.column(4).offsets.to_numpy()))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POSTS_AT_ONCE, "right")))
                yield cells(batch.slice(at, stop - at))
                at = stop

    return arrow_map(rows.select("key", "comp", "n", "need", "tokens"), run, _ROW)


def _apart(rows: DataFrame) -> DataFrame:
    """rows, which go as scratch, with the long lists of crowded partitions in rows of their own; others
    stay, as a partition that isn't crowded fits a task whatever its lists. There are at most BROADCAST_ROWS long lists."""
    posts = rows.groupBy("part").agg(F.sum(F.size("tokens")).alias("posts"))
    posts = cut(posts, total=F.sum("posts"), most=F.max("posts"))
    if (posts.seen["most"] or 0) <= CROWDED:
        forget(posts)
        return rows
    crowded = sent(posts, posts.where(F.col("posts") > CROWDED).select("part"))
    single = rows.join(crowded, "part", "left_semi").select(*_COLUMNS[:5], F.explode("tokens").alias("token"))
    bound = max(LONG_LIST, posts.seen["total"] // BROADCAST_ROWS)
    long = cut(single.groupBy("token").agg(F.count("*").alias("length")).where(F.col("length") > bound).select("token"))
    if not long.seen["rows"]:
        forget(posts, long)
        return rows
    single = single.join(F.broadcast(long.withColumn("long", F.lit(True))), "token", "left").withColumn("part", F.when(F.col("long"), F.lit(LONG)).otherwise(F.col("part")))
    again = single.groupBy(*_COLUMNS[:5]).agg(F.collect_set("token").alias("tokens"))
    out = cut(rows.join(crowded, "part", "left_anti").select(*_COLUMNS).unionByName(again))
    forget(rows, posts, long)
    return out


def _long(rows: DataFrame, *columns: str) -> DataFrame:
    """The postings of long lists, one a row: (token, columns)."""
    return rows.where(F.col("part") == LONG).select(*columns, F.explode("tokens").alias("token"))


def _in_parts(rows: DataFrame, partitions: int, *columns: str) -> DataFrame:
    """The other postings, each partition of the index in one task."""
    return rows.where(F.col("part") != LONG).select("part", *[c for c in columns if c != "part"], "tokens").repartitionById(partitions, "part").select(*columns, "tokens")


def _any_long(rows: DataFrame) -> bool:
    return not rows.where(F.col("part") == LONG).isEmpty()


def _index(batches):
    """The rows of one partition as arrays, with the postings in the order of their hashes."""
    table = pa.Table.from_batches(batches).combine_chunks()
    if not table.num_rows:
        return None
    columns = {k: table[k].chunk(0).to_numpy(zero_copy_only=False) for k in table.column_names if k != "tokens"}
    token, owner = _flat(table["tokens"].chunk(0))
    order = np.argsort(token, kind="stable")
    first, length = _runs(token[order])
    return columns, token, owner, order, first, length


def _mixed(rows: DataFrame, partitions: int, *labels: str) -> DataFrame:
    """The postings whose hash touches two values of every label, with each row's number of other members in their lists."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        found = _index(held) if held else None
        if found is None:
            return
        columns, token, owner, order, first, length = found
        mixed, sizes = np.ones(len(first), bool), np.empty(len(token), np.int64)
        for label in labels:
            values = columns[label][owner[order]]
            mixed &= np.minimum.reduceat(values, first) < np.maximum.reduceat(values, first)
        sizes[order] = np.repeat(np.where(mixed, length - 1, -1), length)
        keep = sizes >= 0
        n = len(columns["key"])
        left = np.bincount(owner[keep], minlength=n)
        cost = np.bincount(owner[keep], weights=sizes[keep], minlength=n).astype(np.int64)
        some = left > 0
        own = [pa.array(columns[k][some]) for k in columns]
        yield pa.record_batch([*own, _arrays(token[keep], left[some]), pa.array(cost[some])], names=[*columns, "tokens", "cost"])

    kept = [c for c in rows.columns if c in (*_COLUMNS[:5], "hub")]
    schema = ", ".join(f"{c} {'int' if c == 'part' else 'long'}" for c in kept) + ", tokens array<long>, cost long"
    mixed = arrow_map(_in_parts(rows, partitions, *kept), run, schema)
    if not _any_long(rows):
        return mixed
    long = _long(rows, *kept)
    lists = long.groupBy("token").agg((F.count("*") - 1).alias("others"), *[F.min(c).alias("lo_" + c) for c in labels], *[F.max(c).alias("hi_" + c) for c in labels])
    lists = lists.where(" and ".join(f"lo_{c} < hi_{c}" for c in labels)).select("token", "others")
    long = long.join(F.broadcast(lists), "token").groupBy(*kept).agg(F.collect_list("token").alias("tokens"), F.sum("others").alias("cost"))
    return mixed.unionByName(long)


def _peeled(rows: DataFrame, partitions: int, *labels: str) -> tuple[DataFrame, DataFrame, int]:
    """The postings that still count, of the sets that keep as many as they need; (key, n, m, cost) for each of those sets;
    and the number of postings. cost estimates the set's candidates."""
    before = []
    while True:
        kept = cut(_mixed(rows, partitions, *labels))
        enough = F.col("m") >= F.col("need")
        sums = kept.groupBy("key").agg(F.sum(F.size("tokens")).alias("m"), F.sum("cost").alias("cost"), *[F.first(c).alias(c) for c in ("need", "n")])
        sums = cut(sums.withColumn("cost", F.col("cost") / F.col("need")), total=F.sum("m"), left=F.sum(F.when(enough, F.col("m"))))
        total, left = sums.seen["total"] or 0, sums.seen["left"] or 0
        alive = sums.where(enough)
        alive._cut_path, alive.seen = sums._cut_path, sums.seen
        rows = cut(kept.drop("cost").join(sent(alive, alive.select("key")), "key", "left_semi"))
        forget(kept, *before)
        if left >= (1 - PEEL) * total:
            return rows, alive, left
        before = [alive, rows]


def _pairs(rows: DataFrame, partitions: int, share: float, *labels: str) -> DataFrame:
    """Pairs (a, b) with a row that is cheap, which differ in all labels, fit in size and match enough hashes."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        found = _index(held) if held else None
        if found is None:
            return
        columns, _, owner, order, first, length = found
        owner = owner[order].astype(np.int64)
        lists = np.repeat(np.arange(len(first)), length)
        asks = np.flatnonzero(columns["cheap"][owner].astype(bool))
        width = length[lists[asks]]
        at, (n, cheap, rows) = 0, (columns["n"], columns["cheap"].astype(bool), len(columns["key"]))
        ends = np.cumsum(width)
        while at < len(asks):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POSTS_AT_ONCE, "right")))
            some, wide = asks[at:stop], width[at:stop]
            x = np.repeat(owner[some], wide)
            within = np.arange(len(x)) - np.repeat(np.cumsum(wide) - wide, wide)
            y = owner[np.repeat(first[lists[some]], wide) + within]
            fit = (x < y) | ((x != y) & ~cheap[y])  # two cheap ones meet once
            fit &= 4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])
            for label in labels:
                fit &= columns[label][x] != columns[label][y]
            x, y = x[fit], y[fit]
            pair, count = np.unique(np.minimum(x, y) * rows + np.maximum(x, y), return_counts=True)
            a, b = pair // rows, pair % rows
            swap = columns["key"][a] > columns["key"][b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            yield pa.record_batch([pa.array(columns["key"][a]), pa.array(columns["key"][b]), pa.array(n[a]), pa.array(n[b]), pa.array(count.astype(np.int64))], names=["a", "b", "na", "nb", "c"])
            at = stop

    kept = [c for c in rows.columns if c in ("key", "comp", "n", "hub", "cheap")]
    met = arrow_map(_in_parts(rows, partitions, *kept), run, "a long, b long, na long, nb long, c long")
    if _any_long(rows):
        met = met.unionByName(_long_pairs(rows, *labels))
    met = met.groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    more = _least(F.col("nb")) - _least(F.col("na"))
    need = F.least(_match(F.col("na"), share) + F.greatest(more, F.lit(0)), _match(F.col("nb"), share) + F.greatest(-more, F.lit(0)))
    return met.where(F.col("c") >= need).select("a", "b")


def _long_pairs(rows: DataFrame, *labels: str) -> DataFrame:
    """(a, b, na, nb, c): the same pairs from long lists, a row for each hash. A list is cut into blocks by its sets, and a
    pair of blocks meets in one place."""
    long = _long(rows, "key", "n", "cheap", *labels)
    lists = long.groupBy("token").agg(F.count("*").alias("length"), F.count_if("cheap").alias("asks")).where("asks > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    long = long.join(F.broadcast(lists.select("token", blocks("length").alias("across"), blocks("asks").alias("down"))), "token")
    block = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    x = long.where("cheap").withColumn("i", block("down")).select("token", "i", every("across").alias("j"), *[F.col(c).alias("x" + c) for c in ("key", "n", *labels)])
    y = long.withColumn("j", block("across")).select("token", "j", every("down").alias("i"), *[F.col(c).alias("y" + c) for c in ("key", "n", "cheap", *labels)])
    met = x.join(y, ["token", "i", "j"]).where("(xkey < ykey or (xkey > ykey and not ycheap)) and 4 * least(xn, yn) >= 3 * greatest(xn, yn)")
    met = met.where(" and ".join(f"x{c} <> y{c}" for c in labels))
    ends = [F.when(F.col("xkey") < F.col("ykey"), F.col(p)).otherwise(F.col(q)).alias(c) for c, p, q in (("a", "xkey", "ykey"), ("b", "ykey", "xkey"), ("na", "xn", "yn"), ("nb", "yn", "xn"))]
    return met.select(*ends, F.lit(1).cast("long").alias("c"))


# --- verification and components -----------------------------------------------------------------------------------


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection of whole sets. Only sets that occur in pairs move."""
    pairs = cut(pairs)
    if not pairs.seen["rows"]:
        return pairs
    a, b = (_of(sets, pairs, F.col(k)).select(F.col("key").alias(k), F.col("n").alias("n" + k), F.col("tokens").alias("t" + k)) for k in "ab")
    shared = pairs.join(a, "a").join(b, "b").withColumn("o", F.size(F.array_intersect("ta", "tb")))
    linked = cut(shared.where("100 * o >= 75 * (na + nb - o)").select("a", "b"))
    forget(pairs)
    return linked


def _of(sets: DataFrame, table: DataFrame, key) -> DataFrame:
    """The sets whose keys a table has in a column."""
    return sets.join(sent(table, table.select(key.alias("key"))), "key", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(key, comp) for the ends of edges (a, b): the smallest key that links reach.

    Rounds of smallest-neighbour labels and pointer jumping; every step is a join or a partial
    aggregation, so neither stars nor chains meet in one task. Chains of length n take O(log n)."""
    edges = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("key"), "comp"))
    while True:
        seen = edges.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("comp").alias("seen"))
        step = labels.join(seen, "key").select("key", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        root = labels.select(F.col("key").alias("comp"), F.col("comp").alias("root"))
        step = step.join(root, "comp", "left").select("key", "old", F.least("comp", F.coalesce("root", "comp")).alias("comp"))
        jumped = cut(step, changed=F.count_if(F.col("comp") != F.col("old")))
        forget(labels)
        labels = jumped.select("key", "comp")
        labels._cut_path, labels.seen = jumped._cut_path, jumped.seen
        if not jumped.seen["changed"]:
            forget(edges)
            return labels


class _Components:
    """The components so far: (key, comp) for the sets that have a link."""

    def __init__(self):
        self.found = None

    def label(self, df: DataFrame) -> DataFrame:
        """df, which has key, with comp: the set itself where it has no link."""
        df = df.drop("comp")
        if self.found is None:
            return df.withColumn("comp", F.col("key"))
        return df.join(sent(self.found), "key", "left").withColumn("comp", F.coalesce("comp", "key"))

    def link(self, more: DataFrame) -> bool:
        """Join components by more edges (a, b), which go if they are scratch; tells whether any did."""
        given = [more] if hasattr(more, "seen") else []
        if given and not more.seen["rows"]:
            forget(more)
            return False
        for end in ("a", "b"):
            more = self.label(more.withColumnRenamed(end, "key")).drop("key").withColumnRenamed("comp", end)
        more = cut(more.where("a <> b").distinct())
        forget(*given)
        if not more.seen["rows"]:
            forget(more)
            return False
        roots, older = components(more), self.found
        forget(more)
        if older is None:
            self.found = roots
            return True
        moved = older.join(roots.select(F.col("key").alias("comp"), F.col("comp").alias("root")), "comp", "left")
        moved = moved.select("key", F.coalesce("root", "comp").alias("comp"))
        fresh = roots.join(older.select("key"), "key", "left_anti")
        self.found = cut(moved.unionByName(fresh.select("key", "comp")))
        forget(older, roots)
        return True


# --- families ------------------------------------------------------------------------------------------------------


def _hubs(rows: DataFrame, alive: DataFrame, partitions: int) -> DataFrame:
    """(key, hub): the set that each set shares most hashes with, of those that lead its posting lists. A list is led by
    its member with the most such hashes; of a family of copies that is the original, if it is there."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        found = _index(held) if held else None
        if found is None:
            return
        columns, token, owner, order, first, length = found
        key, m = columns["key"], columns["m"]
        order = np.lexsort((key[owner], -m[owner], token))
        leads = np.repeat(owner[order[first]], length)
        pair, count = np.unique(owner[order].astype(np.int64) * len(key) + leads, return_counts=True)
        a, b = pair // len(key), pair % len(key)
        yield pa.record_batch([pa.array(key[a]), pa.array(key[b]), pa.array(m[b]), pa.array(count.astype(np.int64))], names=["key", "hub", "m", "s"])

    ranked = rows.join(sent(alive, alive.select("key", "m")), "key")
    led = arrow_map(_in_parts(ranked, partitions, "key", "m"), run, "key long, hub long, m long, s long")
    if _any_long(rows):
        long = _long(ranked, "key", "m")
        lists = long.groupBy("token").agg(F.min(F.struct((-F.col("m")).alias("less"), F.col("key").alias("hub"))).alias("first"))
        lists = lists.select("token", "first.hub", (-F.col("first.less")).alias("of_hub"))
        led = led.unionByName(long.join(F.broadcast(lists), "token").select("key", "hub", F.col("of_hub").alias("m"), F.lit(1).cast("long").alias("s")))
    led = led.groupBy("key", "hub", "m").agg(F.sum("s").alias("s"))
    best = led.groupBy("key").agg(F.max(F.struct("s", "m", "hub")).alias("best"))
    return cut(best.select("key", F.col("best.hub").alias("hub")))


def _beside_hubs(hubs: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, hub, n, nh, s, outside): how many of its hub's hashes each set holds, and its other hashes."""
    own = hubs.join(_of(sets, hubs, F.col("key")), "key")
    of_hub = _of(sets, hubs, F.col("hub"))
    of_hub = of_hub.select(F.col("key").alias("hub"), F.col("n").alias("nh"), F.col("tokens").alias("th"))
    both = own.join(of_hub, "hub").withColumn("outside", F.array_except("tokens", "th"))
    return cut(both.select("key", "hub", "n", "nh", (F.col("n") - F.size("outside")).alias("s"), "outside"))


def _outside(near: DataFrame) -> DataFrame:
    """Pairs of one hub that share hashes outside it and could link: at most min(s) hashes are shared inside."""
    e = near.select("key", "hub", "comp", "n", "s", F.explode("outside").alias("token"))
    two = e.groupBy("hub", "token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("hub", "token")
    e = e.join(two, ["hub", "token"], "left_semi")
    enough = e.groupBy("key").agg(F.count("*").alias("e"), F.first("n").alias("n"), F.first("s").alias("s"))
    e = cut(e.join(enough.where(F.col("e") + F.col("s") >= _least(F.col("n"))).select("key"), "key", "left_semi"))
    a, b = (e.select("hub", "token", F.col("key").alias(k), *[F.col(c).alias(c + k) for c in ("comp", "n", "s")]) for k in "ab")
    met = a.join(b, ["hub", "token"]).where("a < b and compa <> compb and 4 * least(na, nb) >= 3 * greatest(na, nb)")
    met = met.groupBy("a", "b").agg(F.count("*").alias("e"), *[F.first(c).alias(c) for c in ("na", "nb", "sa", "sb")])
    return met.where("7 * (least(sa, sb) + e) >= 3 * (na + nb)").select("a", "b")


def _eligible(near: DataFrame) -> DataFrame:
    """Sets that are small enough beside their hub's other components to link by what lies inside the hub alone:
    f = 7 s - 3 n is three times the largest partner's size."""
    near = near.select("key", "hub", "comp", "n", (7 * F.col("s") - 3 * F.col("n")).alias("f"))
    least = near.groupBy("hub", "comp").agg(F.min("n").alias("n"))
    best = least.groupBy("hub").agg(F.min(F.struct("n", "comp")).alias("best"))
    next_best = least.join(best, "hub").where(F.col("comp") != F.col("best.comp")).groupBy("hub", "best").agg(F.min("n").alias("next"))
    other = F.when(F.col("comp") == F.col("best.comp"), F.col("next")).otherwise(F.col("best.n"))
    return near.join(next_best, "hub").where(3 * other <= F.col("f")).select("key", "hub", "comp", "n", "f")


def _neighbours(eligible: DataFrame, partitions: int) -> DataFrame:
    """Pairs next to each other by size in a hub, within a range of them: tried first, so that chains of ever longer
    extracts join in a number of comparisons that is linear."""

    def run(batches):
        last = None
        for batch in batches:
            hub, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last is not None:
                hub, key = np.r_[last[0], hub], np.r_[last[1], key]
            same = hub[1:] == hub[:-1]
            yield pa.record_batch([pa.array(key[:-1][same]), pa.array(key[1:][same])], names=["a", "b"])
            last = (hub[-1], key[-1]) if len(hub) else last

    ordered = eligible.repartitionByRange(partitions, "hub", "n", "key").sortWithinPartitions("hub", "n", "key")
    return arrow_map(ordered.select("hub", "key"), run, "a long, b long")


def _inside(eligible: DataFrame) -> DataFrame:
    """Pairs of one hub whose bound inside the hub lets them link, met by classes of size."""
    grade = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(4 / 3)) + 1e-9)
    y = eligible.select("hub", F.col("key").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("f").alias("fb"), grade(F.col("n")).alias("grade"))
    span = F.sequence(grade(F.ceil(F.col("n") * 0.75)), grade(F.greatest(F.ceil(F.col("n") * 0.75), F.floor(F.col("f") / 3))))
    x = eligible.select("hub", F.col("key").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("f").alias("fa"), F.explode(span).alias("grade"))
    met = x.join(y, ["hub", "grade"]).where("ca <> cb and 3 * nb <= fa and 3 * na <= fb")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _families(rows: DataFrame, alive: DataFrame, size: int, sets: DataFrame, found: _Components, partitions: int) -> None:
    """Join what is left over whole sets, level by level of hubs; see the module's text."""
    while size:
        hubs = _hubs(rows, alive, partitions)
        near = _beside_hubs(hubs, sets)
        found.link(near.where("key <> hub and 7 * s >= 3 * (n + nh)").select(F.col("key").alias("a"), F.col("hub").alias("b")))
        found.link(verify(_neighbours(_eligible(found.label(near)), partitions), sets))
        known = cut(found.label(near))
        found.link(verify(_inside(_eligible(known)).unionByName(_outside(known)).distinct(), sets))
        across = cut(found.label(rows.drop("hub").join(sent(hubs), "key")).select(*_COLUMNS, "hub"))
        older, before = (rows, alive, hubs, near, known), size
        rows, alive, size = _peeled(across, partitions, "comp", "hub")
        forget(across, *older)
        if size > (1 - SETTLED) * before:
            everyone = rows.withColumn("cheap", F.lit(True))
            found.link(verify(_pairs(everyone, partitions, SHARES[-1], "comp", "hub"), sets))
            break
    forget(rows, alive)


# --- the join ------------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs; see the module's text."""
    spark = docs.sparkSession
    size = _texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = 2 * spark.sparkContext.defaultParallelism
    partitions = max(least, -(-size // BYTES_PER_PARTITION))
    seed = 0
    while True:
        published = cut(_published(docs, partitions, seed))
        ids = published.where("n is not null").select("key", "doc_id", "n", "check")
        groups = ids.where("n > 0 and doc_id is not null").groupBy("key")
        groups = groups.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi"))
        groups = cut(groups, clashes=F.count_if(F.col("lo") != F.col("hi")))
        if not groups.seen["clashes"]:  # no two sets share 64 bits of their fingerprints
            break
        forget(published, groups)
        seed += 1
    shared = cut(_shared(published, partitions), posts=F.sum(F.size("tokens")))
    ids = cut(ids)
    forget(published)

    counted = shared.groupBy("key").agg(F.sum(F.size("tokens")).alias("m")).join(groups, "key").withColumn("need", _peel_need(SHARES[0]))
    alive = cut(counted.where("m >= need").select("key", "doc_id", "n", "need"))
    sets = _sets(docs, alive, seed)
    found = _Components()
    found.link(verify(_stars(shared, alive), sets))

    rows, costs = _by_set(shared, alive), None
    for share in SHARES:
        length = F.col("n") - _least(F.col("n")) + _match(F.col("n"), share)
        if costs is None:
            posts = shared.seen["posts"] or 0
            partitions = max(least, -(-posts // POSTS_PER_PARTITION))
            begun = _apart(cut(_split(found.label(rows), partitions)))
            forget(shared)
        else:
            dear = cut(costs.where(F.col("cost") > CANDIDATE_COST).select("key", "n"), posts=F.sum(length))
            partitions = max(least, -(-(dear.seen["posts"] or 0) // POSTS_PER_PARTITION))
            dear = _of(sets, dear, F.col("key"))
            dear = dear.select("key", "n", _peel_need(share).alias("need"), F.slice("tokens", F.lit(1), length.cast("int")).alias("tokens"))
            begun = _apart(cut(_split(found.label(dear), partitions)))
            forget(rows, costs)
        rows, costs, left = _peeled(begun, partitions, "comp")
        forget(begun)
        if not left:
            break
        if share == SHARES[-1]:
            _families(rows, costs, left, sets, found, partitions)
        else:
            cheap = costs.select("key", (F.col("cost") <= CANDIDATE_COST).alias("cheap"))
            found.link(verify(_pairs(rows.join(sent(costs, cheap), "key"), partitions, share, "comp"), sets))

    label = cut(found.label(groups.select("key", "doc_id")))
    forget(groups, alive, sets, *([found.found] if found.found is not None else []))
    scratch = (ids, label)
    first = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    label = label.join(first, "comp").select("key", "component_id")
    full = ids.where("n > 0 and doc_id is not null").join(label, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = full.unionByName(ids.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    out.scratch = scratch
    return out


def _by_set(shared: DataFrame, alive: DataFrame) -> DataFrame:
    """(key, n, need, tokens): the shared hashes of each set that is alive, each once, in one row. A set has a row for each of its
    leaders and, if copies of it lie in many tasks, each hash from each of them: more and more, the larger the input."""
    rows = shared.join(sent(alive, alive.select("key", "n", "need")), "key").groupBy("key", "n", "need")
    return rows.agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))


def _peel_need(share: float):
    """Hashes that a set of n matches with any set that it links with, whatever that one's size: its l less one for
    rounding, and its least overlap where prefixes are whole sets."""
    n = F.col("n")
    return _least(n) if share == SHARES[-1] else F.greatest(F.lit(1), _match(n, share) - 1).cast("long")


def _stars(shared: DataFrame, alive: DataFrame) -> DataFrame:
    """Each set with the one that leads most of its posting lists: pairs to try first; exactness does not hang on them."""
    led = shared.where("key <> leader").groupBy("key", "leader").agg(F.sum(F.size("tokens")).alias("s"))
    led = led.join(alive.select("key", "n", "need"), "key").join(alive.select(F.col("key").alias("leader"), F.col("n").alias("nb")), "leader")
    led = led.where("s >= need and 4 * least(n, nb) >= 3 * greatest(n, nb)")
    best = led.groupBy("key").agg(F.max(F.struct("s", "leader")).alias("best"))
    return best.select(F.col("key").alias("a"), F.col("best.leader").alias("b"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, that with the smallest doc_id and, of rows that repeat it, the smallest
    text. Rows that repeat a doc_id with different texts are different documents. Documents without words or
    without a doc_id all stay."""
    ident = F.col("doc_id").cast("long")
    repeated = docs.select(ident.alias("doc_id")).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        found = near_duplicates(docs)
        gone = cut(found.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct())
        forget(*found.scratch)
        return docs.join(sent(gone), ident == F.col("__gone"), "left_anti")
    columns, seed = [F.col(f"`{c}`") for c in docs.columns], 0
    while True:
        keyed = cut(docs.select(*columns, F.when(ident.isNotNull(), F.xxhash64(F.lit(seed), ident, "text")).alias("__row")))
        told = F.struct(ident.alias("i"), F.xxhash64(F.lit(-1 - seed), "text").alias("t"))
        if keyed.where("__row is not null").groupBy("__row").agg(F.min(told).alias("lo"), F.max(told).alias("hi")).where("lo <> hi").isEmpty():
            break  # no two documents have one key
        forget(keyed)
        seed += 1
    found = near_duplicates(keyed.select(F.col("__row").alias("doc_id"), "text"))
    comp = cut(found.where("n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("__key"), F.col("component_id").alias("__component")).distinct())
    forget(*found.scratch)
    same = F.col("__row") == F.col("__key")
    first = F.min(F.struct(ident.alias("i"), F.col("text").alias("t"), F.struct(*columns).alias("row"))).alias("__first")
    best = keyed.join(comp, same).groupBy("__component").agg(first).select(*[F.col("__first")["row"].getField(c).alias(c) for c in docs.columns])
    return keyed.join(comp, same, "left_anti").select(*columns).unionByName(best)
