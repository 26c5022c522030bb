"""Removal of repeated strings: bytes that a LENGTH-byte string covers which also starts anywhere else, by suffix arrays built with
linear grouping.

Every window of LENGTH bytes has an anchor, the leftmost of its smallest ANCHOR-byte hashes, which depends on the window's bytes alone. So
equal windows have equal anchors at equal places, and each window belongs to exactly one anchor occurrence. What an occurrence owns is a
stretch of the text: its consecutive windows.

  * Anchors: one pass over the texts gives each occurrence's hash and a digest of its stretch; equal ones of a text are one row with
    many places. Hashes that occur once are dropped after a count with partial sums.
  * Copies: occurrences of equal stretches are all repeated, whole, and their stretch stands in the arrays once.
  * Suffix arrays: stretches of the same anchor that differ are one text, with ends between them. Its suffixes are sorted by
    linear grouping (`sorted_suffixes`); neighbours that agree in LENGTH bytes are repeated windows. Thousands of such texts are sorted
    side by side, each step taking the next group of every one.
  * Anchors with more than STRETCHES different stretches are dealt out anew: stretches are cut into pieces of WIDTHS windows and
    grouped by the bytes which all windows of a piece share, in the end by the window itself. So no group has to be held whole.
  * Every text then takes the union of its repeated windows, judged on the input.

Null texts are empty. Texts of fewer than LENGTH bytes keep everything. Rows that repeat a text, or a whole row, repeat each other.
doc_id may be null or repeated. Equality of stretches within an anchor is by 64 more bits of hash, equality of texts by 128. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, forget

#: Bytes of a string that is removed where it is repeated.
LENGTH = 200
#: Bytes of an anchor.
ANCHOR = 64
#: Different stretches of one anchor that a suffix array takes.
STRETCHES = 64
#: Windows of a piece of an anchor with more, step by step; the last step is the window itself.
WIDTHS = (16, 1)
#: Bytes of texts hashed at once, and of stretches sorted side by side.
HASHED, SORTED = 4_000_000, 1_500_000
#: Texts of a task that are remembered, so that further copies are passed over.
REMEMBERED = 200_000

_FACTOR = 0x9E3779B97F4A7C15
_ROW = "h long, c long, k1 long, k2 long, ext int, at array<int>"
#: ext holds the anchor's place in its stretch and the stretch's length.
_EXT = 1 << 10


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*more, text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


# --- anchors -----------------------------------------------------------------------------------------------------

class Anchors:
    """The owned stretches of texts, in arrays."""

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grown(self, n: int) -> None:
        if len(self.powers) < n:
            powers, inverse = np.full(n, _FACTOR, np.uint64), np.full(n, pow(_FACTOR, -1, 1 << 64), np.uint64)
            powers[0] = inverse[0] = 1
            self.powers, self.inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)

    def __call__(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, begin, end, hash) of each anchor occurrence and its stretch in the joined texts that end at `ends`."""
        data, width, none = np.frombuffer(raw, np.uint8), LENGTH - ANCHOR + 1, np.zeros(0, np.int64)
        n = len(data)
        if n < LENGTH:
            return none, none, none, none
        self._grown(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        h = (sums[ANCHOR:] - sums[:-ANCHOR]) * self.inverse[: n - ANCHOR + 1]
        del sums
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        key = np.full(-(-len(h) // width) * width, ~np.uint64(0))
        key[: len(h)] = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the leftmost
        rows = key.reshape(-1, width)
        right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        left = np.minimum.accumulate(rows, axis=1).ravel()
        windows = n - LENGTH + 1
        least = np.minimum(right[:windows], left[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFFFFF)
        del key, rows, right, left
        starts = np.concatenate([[0], ends[:-1]])
        long = ends - starts >= LENGTH
        inside = np.zeros(n + 1, np.int8)
        inside[starts[long]] += 1
        inside[ends[long] - LENGTH + 1] -= 1  # a text starts after the last window of the one before
        start = np.flatnonzero(np.cumsum(inside[:windows], dtype=np.int8))
        place = least[start].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])) if len(place) else none
        last = np.concatenate([first[1:], [len(place)]]) - 1 if len(place) else none
        return place[first], start[first], start[last] + LENGTH, h[place[first]].view(np.int64)


def _digest(raw: bytes, at: int) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=at.to_bytes(2, "little")).digest(), "little", signed=True)


def _occurrences(keyed: DataFrame) -> DataFrame:
    """A row for each anchor and stretch of a text, with all their places. A task gives a text's rows twice at most: that
    they are repeated shows."""

    def run(batches):
        anchors, seen = Anchors(), {}

        def emit(held, ends):
            raw, stops = b"".join(h[0] for h in held), np.array(ends, np.int64)
            place, begin, end, h = anchors(raw, stops)
            doc = np.searchsorted(stops, place, "right")
            at = place - begin
            c = np.fromiter((_digest(raw[b:e], o) for b, e, o in zip(begin.tolist(), end.tolist(), at.tolist(), strict=True)), np.int64, len(place))
            place = place - np.concatenate([[0], stops[:-1]])[doc] + np.array([x[3] for x in held], np.int64)[doc]
            order = np.lexsort((place, c, h, doc))
            doc, h, c, place = doc[order], h[order], c[order], place[order]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(doc) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            keys = np.array([x[1:3] for x in held], np.int64)[doc[first]].reshape(-1, 2)
            ext = (at * _EXT + end - begin)[order][first]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(doc)]]).astype(np.int32)), pa.array(place.astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(c[first]), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(ext.astype(np.int32)), lists], ["h", "c", "k1", "k2", "ext", "at"])

        held, ends, size = [], [], 0
        for batch in batches:
            for text, k1, k2 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                if len(raw) < LENGTH or seen.get((k1, k2), 0) > 1:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[k1, k2] = seen.get((k1, k2), 0) + 1
                for base in range(0, len(raw) - LENGTH + 1, HASHED):  # a long text in parts; each window is in one
                    part = raw[base : base + HASHED + LENGTH - 1]
                    if held and size + len(part) > HASHED:
                        yield emit(held, ends)
                        held, ends, size = [], [], 0
                    size += len(part)
                    held.append((part, k1, k2, base))
                    ends.append(size)
        if held:
            yield emit(held, ends)

    return cut(arrow_map(keyed.where(F.octet_length("text") >= LENGTH), run, _ROW))


# --- suffix arrays -----------------------------------------------------------------------------------------------

def sorted_suffixes(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix arrays of several texts, one after the other. `symbols` joins the texts, which end at `ends`; a suffix that
    ends is smaller than one that goes on.

    First, suffixes stand in groups by their first symbol. Groups are taken in descending order. Left of a taken suffix its
    nearest suffix of a smaller group is its previous smaller one: in a list of the suffixes not yet taken it is the neighbour to the
    left, once the members of the group that stand side by side are left out. That suffix's Lyndon prefix grows by the prefixes of all
    those members, so it moves behind its group's others, the further the more members it gains. A taken group is complete: its
    suffixes share their Lyndon prefix and no others have it.
    Then groups are gone through in ascending order: suffixes of a group are in the order of what follows their Lyndon prefix, which is a
    suffix of a smaller group, or, among members side by side, the next member."""
    n, starts = len(symbols), np.concatenate([[0], ends[:-1]]).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), ends - starts)
    slots = np.lexsort((symbols, text)).astype(np.int32)
    where = np.empty(n, np.int32)
    where[slots] = np.arange(n)
    change = np.concatenate([[True], (symbols[slots[1:]] != symbols[slots[:-1]]) | (text[slots[1:]] != text[slots[:-1]])])
    first = np.flatnonzero(change)
    begin = np.empty(n, np.int32)  # by suffix: the first slot of its group
    begin[slots] = np.repeat(first, np.diff(np.concatenate([first, [n]])))
    stop = np.zeros(n + 1, np.int32)  # by first slot: the end of the group
    stop[first] = np.concatenate([first[1:], [n]])
    left, right = np.arange(-1, n, dtype=np.int32), np.arange(1, n + 2, dtype=np.int32)
    head = np.zeros(n + 1, bool)
    head[starts] = head[n] = True
    left[starts] = n  # no suffix of the same text
    after, depth = np.empty(n, np.int32), np.empty(n, np.int32)
    flag = np.zeros(n + 1, bool)
    top, base = ends.astype(np.int32).copy(), starts
    active = np.flatnonzero(top > base)
    groups: list[np.ndarray] = []
    while len(active):
        t = top[active]
        g = begin[slots[t - 1]]
        top[active] = g
        groups.append(g)
        size = t - g
        total = np.cumsum(size)
        members = np.sort(slots[np.repeat(g - total + size, size) + np.arange(total[-1])])
        lefts = left[members]
        runs = np.flatnonzero(np.concatenate([[True], lefts[1:] != members[:-1]]))
        bounds = np.concatenate([runs[1:], [len(members)]])
        count = bounds - runs
        tail = members[bounds - 1]
        previous, following = lefts[runs], right[tail]
        after[members] = np.repeat(following, count)
        depth[members] = np.repeat(bounds, count) - np.arange(len(members))
        right[previous] = following
        inner = ~head[following]
        left[following[inner]] = previous[inner]
        moved = previous < n
        p, gain = previous[moved], count[moved]
        if len(p):
            old = begin[p]
            order = np.lexsort((gain, old))
            p, gain, old = p[order], gain[order], old[order]
            other = np.concatenate([[True], old[1:] != old[:-1]])
            one = np.flatnonzero(other)
            many = np.diff(np.concatenate([one, [len(p)]]))
            end = stop[old[one]]
            low = np.repeat(end - many, many)
            slot = low + np.arange(len(p)) - np.repeat(one, many)
            flag[p] = True
            there = slots[slot]
            out = there[~flag[there]]
            flag[p] = False
            was = where[p]
            free = was[was < low]
            slots[free] = out
            where[out] = free
            slots[slot] = p
            where[p] = slot
            stop[old[one]] = end - many
            new = np.flatnonzero(other | np.concatenate([[True], gain[1:] != gain[:-1]]))
            width = np.diff(np.concatenate([new, [len(p)]]))
            begin[p] = np.repeat(slot[new], width)
            stop[slot[new]] = slot[new] + width
        active = active[top[active] > base[active]]
    # ascending order; a group of one is in its place
    rank = np.empty(n + 1, np.int32)
    rank[slots] = np.arange(n)
    rank[n] = -1
    at_end = np.zeros(n + 1, bool)
    at_end[ends] = True
    after[at_end[after]] = n  # nothing follows: smaller than all
    for g in reversed(groups):
        size = stop[g] - g
        g, size = g[size > 1], size[size > 1]
        if not len(g):
            continue
        total = np.cumsum(size)
        slot = np.repeat(g - total + size, size) + np.arange(total[-1])
        members = slots[slot]
        order = np.lexsort((rank[after[members]], depth[members], np.repeat(g, size)))
        members = members[order]
        slots[slot] = members
        rank[members] = slot
    return slots


def repeated_windows(stretches: list[bytes], groups: np.ndarray) -> list[np.ndarray]:
    """For each stretch, of which those of a group stand together, the windows that start elsewhere in the group too."""
    sizes = np.array([len(s) for s in stretches], np.int64)
    raw = b"\0".join(stretches) + b"\0"
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.frombuffer(raw, np.uint8).astype(np.int16) + 1
    symbols[starts[1:] - 1] = 0
    last = np.flatnonzero(np.concatenate([groups[1:] != groups[:-1], [True]]))
    order = sorted_suffixes(symbols, starts[1:][last])
    windows = np.zeros(len(symbols), bool)
    for s, size in zip(starts.tolist(), sizes.tolist(), strict=False):
        windows[s : s + size - LENGTH + 1] = True
    group = np.repeat(groups, sizes + 1)
    order = order[windows[order]]
    a, b = order[:-1], order[1:]
    same = group[a] == group[b]
    a, b = a[same], b[same]
    padded = raw + b"\0" * 8
    words = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8] if LENGTH >= 8 else []:
        equal = words[a + k] == words[b + k]
        a, b = a[equal], b[equal]
    if LENGTH < 8:
        equal = np.array([raw[x : x + LENGTH] == raw[y : y + LENGTH] for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
        a, b = a[equal], b[equal]
    hit = np.zeros(len(symbols), bool)
    hit[a] = hit[b] = True
    return [np.flatnonzero(hit[s : s + size]) for s, size in zip(starts.tolist(), sizes.tolist(), strict=False)]


def spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """The union of the windows at these ascending starts."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > LENGTH)
    return list(zip(starts[np.concatenate([[0], breaks + 1])].tolist(), (starts[np.concatenate([breaks, [len(starts) - 1]])] + LENGTH).tolist(), strict=True))


# --- on tables ---------------------------------------------------------------------------------------------------

_STRETCH = "h long, c long, n long, k1 long, k2 long, at int, raw binary, before int"
_SPANS = "k1 long, k2 long, ext int, at array<int>, spans array<struct<lo: int, hi: int>>"
_KINDS = [pa.int64()] * 5 + [pa.int32(), pa.binary(), pa.int32()]


def _batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f"c{i}" for i in range(len(kinds))])


def _open(classes: DataFrame) -> DataFrame:
    """Of stretches by anchor and digest, with their number n, those of anchors where one stands once and others beside it; m: how
    many stretches the anchor has."""
    anchors = classes.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("h", "m")
    return classes.join(anchors, "h")


def _stretches(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the stretches, one occurrence of each; at: where they begin in the text, before: how far before their anchor."""
    by_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c", "n", "m", "ext", "place")).alias("w"))  # of one text

    def run(batches):
        seen = set()
        for batch in batches:
            rows = []
            for text, k1, k2, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k1, k2) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add((k1, k2))
                raw = text.encode()
                for w in wanted:
                    before, size = divmod(w["ext"], _EXT)
                    begin = w["place"] - before
                    rows.append((w["h"], w["c"], w["n"], k1, k2, begin, raw[begin : begin + size], before, w["m"]))
            yield _batch(rows, [*_KINDS, pa.int64()])

    both = keyed.join(by_text, ["k1", "k2"]).select("text", "k1", "k2", "w")
    return cut(arrow_map(both, run, _STRETCH + ", m long"), large=F.count_if(F.col("m") > STRETCHES))


def _arrays(some: DataFrame) -> DataFrame:
    """The repeated spans of stretches that stand once, by suffix arrays over their anchors' stretches."""

    def run(batches):
        def emit(rows):
            unique = {r[:2]: r for r in rows}  # copies of a text give its stretches again
            rows = sorted(unique.values(), key=lambda r: r[:2])
            _, group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
            hits = repeated_windows([r[6] for r in rows], group)
            out = [(r[3], r[4], 0, [r[5]], [{"lo": a, "hi": b} for a, b in spans(x)]) for r, x in zip(rows, hits, strict=True) if r[2] == 1 and len(x)]
            return _batch(out, [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))])

        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SORTED and row[0] != rows[-1][0]:
                    yield emit(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6])
        if rows:
            yield emit(rows)

    return arrow_map(some.drop("m").repartition("h").sortWithinPartitions("h"), run, _SPANS)


def _pieces(large: DataFrame, width: int) -> DataFrame:
    """Stretches cut into pieces of at most so many windows, by the distance from window to anchor, under the hash of the bytes that
    all windows of such distances share and a digest of the piece itself."""

    def run(batches):
        for batch in batches:
            rows = []
            for _, _, n, k1, k2, at, raw, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                windows = len(raw) - LENGTH + 1
                for a, b in pairwise(sorted({0, *range((before + 1) % width, windows, width), windows})):
                    far = (before - a) // width  # windows begin far * width bytes before the anchor, or up to width - 1 more
                    shared = raw[before - far * width : before - far * width - width + 1 + LENGTH]
                    piece = raw[a : b - 1 + LENGTH]
                    rows.append((_digest(shared, far), _digest(piece, 1 << 15 | before - a), n, k1, k2, at + a, piece, before - a))
            yield _batch(rows, _KINDS)

    return cut(arrow_map(large.drop("m"), run, _STRETCH))


def _dealt(stretches: DataFrame) -> list[DataFrame]:
    """The repeated spans of stretches whose anchors have many."""
    found = []
    for width in WIDTHS:
        if not stretches.seen["large"]:
            break
        pieces = _pieces(stretches.where(F.col("m") > STRETCHES), width)
        classes = cut(pieces.groupBy("h", "c").agg(F.sum("n").alias("n")))
        whole = F.array(F.struct(F.lit(0).alias("lo"), F.octet_length("raw").alias("hi")))
        copies = pieces.where("n = 1").join(classes.where("n > 1").select("h", "c"), ["h", "c"])
        found.append(copies.select("k1", "k2", F.lit(0).alias("ext"), F.array("at").alias("at"), whole.alias("spans")))
        one = pieces.drop("n").dropDuplicates(["h", "c"]).join(_open(classes), ["h", "c"])
        stretches = cut(one.select(*[x.split()[0] for x in _STRETCH.split(", ")], "m"), large=F.count_if(F.col("m") > STRETCHES))
        found.append(_arrays(stretches.where(F.col("m") <= STRETCHES) if width > 1 else stretches))
    return found


def repeated(keyed: DataFrame) -> DataFrame:
    """(k1, k2, found): by text, where its repeated windows are: ext and at of whole stretches, or spans from at."""
    rows = _occurrences(keyed)
    often = rows.groupBy("h").agg(F.sum(F.size("at")).alias("n")).where("n > 1").select("h")
    shared = cut(rows.join(often, "h"))
    forget(rows)
    one = F.min(F.struct("k1", "k2", "ext", F.col("at")[0].alias("place"))).alias("one")
    classes = cut(shared.groupBy("h", "c").agg(F.sum(F.size("at")).alias("n"), one))
    stretches = _stretches(keyed, _open(classes).select("h", "c", "n", "m", "one.*"))
    copies = shared.join(classes.where("n > 1").select("h", "c"), ["h", "c"]).select("k1", "k2", "ext", "at", F.lit(None).cast("array<struct<lo: int, hi: int>>").alias("spans"))
    found = copies.unionByName(_arrays(stretches.where(F.col("m") <= STRETCHES)))
    for more in _dealt(stretches):
        found = found.unionByName(more)
    found = cut(found)
    forget(shared, classes, stretches)
    return found.groupBy("k1", "k2").agg(F.collect_set(F.struct("ext", "at", "spans")).alias("found"))  # of one text


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): a row for each document, with the bytes that stay."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                edges = np.zeros(len(raw) + 1, np.int32)
                for f in found or ():
                    before, size = divmod(f["ext"], _EXT)
                    for p in f["at"]:
                        for lo, hi in [(-before, size - before)] if f["spans"] is None else [(s["lo"], s["hi"]) for s in f["spans"]]:
                            edges[p + lo] += 1
                            edges[p + hi] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                rows.append((doc_id, len(raw), len(raw) - len(kept), n_spans, kept))
            yield _batch(rows, [pa.int64()] * 4 + [pa.binary()])

    both = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id")).join(repeated(_keyed(docs)), ["k1", "k2"], "left")
    return arrow_map(both.select("doc_id", "text", "found"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(kept: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in DuckDB; windows are cut from pieces of 1000, as a cut from a long string takes time by its place.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT k, doc_id, x, len(x) // 2 AS n FROM d),
p AS (SELECT k, j, n, substr(x, 2000 * j + 1, 2398) AS y FROM (SELECT *, unnest(range(0, (n - 199 + 999) // 1000)) AS j FROM n WHERE n >= 200)),
w AS (SELECT k, 1000 * j + i AS s, md5(substr(y, 2 * i + 1, 400)) AS h FROM (SELECT *, unnest(range(0, least(1000, n - 199 - 1000 * j))) AS i FROM p)),
t AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
r AS (SELECT k, s FROM w SEMI JOIN t USING (h)),
g AS (SELECT k, s, sum(new) OVER (PARTITION BY k ORDER BY s) AS run FROM (SELECT k, s, CASE WHEN s - lag(s) OVER (PARTITION BY k ORDER BY s) <= 200 THEN 0 ELSE 1 END AS new FROM r)),
o AS (SELECT k, min(s) AS lo, max(s) + 200 AS hi FROM g GROUP BY k, run),
b AS (SELECT k, sum(hi - lo)::BIGINT AS removed, count(*) AS runs FROM o GROUP BY k),
e AS (SELECT k, hi AS lo FROM o UNION ALL SELECT k, 0 FROM n),
f AS (SELECT e.k, e.lo, coalesce(min(o.lo), any_value(n.n)) AS hi FROM e JOIN n ON n.k = e.k LEFT JOIN o ON o.k = e.k AND o.lo >= e.lo GROUP BY e.k, e.lo),
q AS (SELECT f.k, string_agg(substr(x, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS kept FROM f JOIN n ON n.k = f.k GROUP BY f.k)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM n JOIN q USING (k) LEFT JOIN b USING (k)
"""
