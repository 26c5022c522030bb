"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

A test item is short and the document that quotes it may be long, so their resemblance says nothing; what
counts is the share of the item's five-word shingles that the document holds. Both sides are partitioned by their
number of distinct shingles, in powers of two.
  * An item of n shingles may lack `lacks` of them at the threshold. Its signature is its lacks + h smallest
    shingle hashes, where its size partition fixes h; a document at the threshold holds at least h of them, which is the
    containment that the signature estimates, as a bound that no such document misses.
  * A document's signature is its shingle hashes up to a cut-off: the largest one in the signatures of those items that a
    document of its size partition can hold. So short documents look for short items only.
  * Candidates, documents whose signature meets h hashes of an item's, are verified by exact containment.

Words are the runs outside space and 0x09-0x0D of the lower-cased text. An item of fewer than five words is a
single shingle of its own length, looked for among the document's shingles of that length. Items without words
match nothing. Null texts have no shingles. Equal items are reported each, repeated documents too. A
null doc_id or item_id stays null. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut

WORDS = 5
#: Containment from which a document is contaminated, in percent.
PERCENT = 75
#: An item of a size partition must be met by a hash for each so many shingles of the partition's smallest.
PER_HIT = 8
#: Shingles of all items up to which they are sent to all tasks with the candidates (8 bytes each).
BROADCAST_SHINGLES = 4_000_000


def word_hashes(text: Column) -> Column:
    spaced = F.translate(F.lower(text), "\t\n\x0b\f\r", "     ")
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of `width` words."""
    last = F.size(words) - width
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(width), *[F.get(words, i + k) for k in range(width)]))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, width, shingles, n): item numbers the rows, as ids may repeat or be null."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("width", F.least(F.lit(WORDS), F.size("w")))
    each = F.when(F.col("width") == WORDS, shingles(F.col("w"), WORDS))
    for k in range(1, WORDS):
        each = each.when(F.col("width") == k, shingles(F.col("w"), k))
    rows = rows.select("item_id", "width", F.array_sort(F.array_distinct(each)).alias("shingles"))
    return cut(rows.withColumn("n", F.size("shingles")).withColumn("item", F.monotonically_increasing_id()))


def signatures(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item, width, hits, part, hash): each item's smallest hashes, how many of them a document at the threshold holds, and
    the size partition of the smallest such document."""
    lacks = F.floor(F.col("n") * (100 - percent) / 100).cast("int")
    hits = F.floor(F.pow(F.lit(2), F.floor(F.log2("n"))) / PER_HIT).cast("int")
    sized = items.withColumn("lacks", lacks).withColumn("hits", F.greatest(F.lit(1), F.least(hits, F.col("n") - F.col("lacks"))))
    part = F.floor(F.log2(F.col("n") - F.col("lacks"))).cast("int")
    return sized.select("item", "width", "hits", part.alias("part"), F.explode(F.slice("shingles", F.lit(1), F.col("lacks") + F.col("hits"))).alias("hash"))


def cutoffs(signed: DataFrame) -> dict[int, list[int | None]]:
    """By width, for each size partition of documents the largest hash that they need."""
    rows = signed.groupBy("width", "part").agg(F.max("hash").alias("top")).collect()  # one for each width and power of two
    out: dict[int, list[int | None]] = {}
    for width in sorted({r["width"] for r in rows}):
        tops = {r["part"]: r["top"] for r in rows if r["width"] == width}
        out[width] = [max((t for p, t in tops.items() if p <= q), default=None) for q in range(max(tops) + 1)]
    return out


def _signature(distinct: Column, tops: list[int | None]) -> Column:
    """A document's distinct shingles up to the cut-off of its size partition."""
    part = F.least(F.floor(F.log2(F.size(distinct))).cast("int"), F.lit(len(tops) - 1))
    top = F.get(F.array(*[F.lit(t).cast("bigint") for t in tops]), part)
    return F.filter(distinct, lambda h: h <= top)


def contained(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) for each document that holds at least percent of an
    item's distinct shingles."""
    found = _contained(_by_row(docs), benchmark, percent)
    return found.select(F.col("doc_id.doc_id").alias("doc_id"), "item_id", "item_shingles", "shared", "containment")


def _by_row(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where doc_id holds a hash of the text too: rows with one doc_id, or none, don't meet each other's items."""
    text = F.col("text").cast("string")
    return docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text")).alias("doc_id"), text.alias("text"))


def _contained(rows: DataFrame, benchmark: DataFrame, percent: int) -> DataFrame:
    """contained() for rows of (doc_id, text), whatever doc_id's type."""
    items = items_of(benchmark)
    signed = cut(signatures(items, percent))
    tops = cutoffs(signed)

    def held(df: DataFrame, short: bool) -> DataFrame:
        arrays = [F.array_distinct(shingles(F.col("w"), k)).alias(f"s{k}") for k in tops]
        each = df.select("doc_id", word_hashes(F.col("text")).alias("w")).select("doc_id", *arrays)
        parts = [_signature(F.col(f"s{k}"), t) if short else F.col(f"s{k}") for k, t in tops.items()] or [F.array().cast("array<bigint>")]
        return each.select("doc_id", (F.concat(*parts) if len(parts) > 1 else parts[0]).alias("held"))

    # outer: for an inner explode the optimizer adds a filter on the array's size, pushes it below the words'
    # projection and so splits the text anew for every shingle
    met = held(rows, True).select("doc_id", F.explode_outer("held").alias("hash")).join(bounded(signed.select("item", "hits", "hash")), "hash")
    found = cut(met.groupBy("doc_id", "item").agg(F.count("*").alias("met"), F.first("hits").alias("hits")).where("met >= hits").select("doc_id", "item"))
    wanted = found.select(F.col("doc_id").alias("d")).distinct()
    again = held(rows.join(bounded(wanted), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi"), False)
    whole = items.select("item", "item_id", "n", "shingles")
    small = (items.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_SHINGLES
    near = found.withColumnRenamed("doc_id", "d").join(F.broadcast(whole) if small else whole, "item")
    both = again.join(near, F.col("doc_id").eqNullSafe(F.col("d")))
    shared = F.size(F.array_intersect("shingles", "held")).cast("long")
    out = both.select("doc_id", "item_id", F.col("n").cast("long").alias("item_shingles"), shared.alias("shared"))
    return out.where(F.col("shared") * 100 >= F.col("item_shingles") * percent).withColumn("containment", F.col("shared") / F.col("item_shingles"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. Rows that repeat a doc_id, or have none, go or
    stay by their own texts."""
    text = F.col("text").cast("string")
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text"))
    bad = cut(_contained(docs.select(key.alias("doc_id"), text.alias("text")), benchmark, percent).select(F.col("doc_id").alias("__bad")).distinct())
    return docs.join(bounded(bad), key.eqNullSafe(F.col("__bad")), "left_anti")


#: The same in DuckDB.
ORACLE = """
WITH w AS (
  SELECT 'd' AS side, row_number() OVER () AS k, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\v\\f\\r]'), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'b', row_number() OVER (), item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\v\\f\\r]'), lambda x: x <> '') FROM benchmark WHERE text IS NOT NULL),
b AS (SELECT k, id, least(5, len(words)) AS width, unnest(list_distinct(list_transform(range(0, len(words) - least(5, len(words)) + 1), lambda i: words[i + 1 : i + least(5, len(words))]))) AS s FROM w WHERE side = 'b' AND len(words) > 0),
widths AS (SELECT DISTINCT width FROM b),
d AS (SELECT DISTINCT k, id, width, s FROM (SELECT k, id, width, unnest(list_transform(range(0, len(words) - width + 1), lambda i: words[i + 1 : i + width])) AS s FROM w, widths WHERE side = 'd' AND len(words) >= width)),
n AS (SELECT k, id, count(*) AS n FROM b GROUP BY ALL),
o AS (SELECT d.k AS dk, d.id AS doc_id, b.k AS bk, count(*) AS shared FROM d JOIN b ON d.width = b.width AND d.s = b.s GROUP BY ALL)
SELECT doc_id, n.id AS item_id, n.n AS item_shingles, shared, shared / n.n AS containment
FROM o JOIN n ON n.k = o.bk WHERE shared * 100 >= n.n * 75
"""
