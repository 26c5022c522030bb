"""Chat formatting: multi-party perspective rotation, in DataFrame functions only.

For every participant of a dialogue (every speaker but `system`) the dialogue is rendered with that speaker as
the assistant and all others as named users. Loss masks cover exactly the assistant's texts and the marks
that end them, as character spans of the rendering.

A dialogue is rendered in chunks, so that a dialogue of any length never meets in one row: a chunk holds CHUNK turn
numbers, and those of more than CHUNK_CHARS characters (many equal turn numbers, or very long turns) are cut again
after the turn that exceeds them. `start` is the chunk's first character in the whole rendering; it is found
from the turns' lengths before anything is rendered, so rendered texts never move. Spans count from the chunk's
start. Joined by start, the chunks are the rendering.

Turns are ordered by number (null last), speaker and text; equal rows are turns each. A null speaker is
`unknown`, a null text is empty, a null conv_id is a dialogue of its own. Control marks inside texts and names
are broken up, so a text can't close its own turn. Dialogues of system turns only have no perspective.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK, CHUNK_CHARS = 256, 4_000_000
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"
#: Chunk of the turns without a number: after all others.
_LAST = 1 << 40


def _plain(c):
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _head(speaker, own):
    """What stands before a turn's text."""
    name = F.translate(_plain(speaker), " \n\r\t", "____")
    role = F.when(own, F.lit("assistant")).when(speaker == SYSTEM, F.lit("system")).otherwise(F.concat(F.lit("user name="), name))
    return F.concat(F.lit(START), role, F.lit("\n"))


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose keys may be null; right's columns of these names go."""
    marked = right.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(marked, on, how).drop(*[f"__{k}" for k in keys])


def _chunks(turns: DataFrame, speaker: str) -> DataFrame:
    """(conv_id, chunk, sub, said): each chunk's turns in order."""
    rows = turns.select(
        F.col("conv_id"),
        F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(_LAST)).cast("long").alias("chunk"),
        F.col("turn").isNull().alias("late"),
        F.col("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"),
        _plain(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("said"),
    )
    before = Window.partitionBy("conv_id", "chunk").orderBy("late", "turn", "speaker", "said").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length(_head(F.col("speaker"), F.lit(False))) + F.char_length("said")
    rows = rows.withColumn("sub", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / CHUNK_CHARS))
    return rows.groupBy("conv_id", "chunk", "sub").agg(F.array_sort(F.collect_list(F.struct("late", "turn", "speaker", "said"))).alias("said"))


def _places(said: DataFrame) -> DataFrame:
    """(conv_id, chunk, sub, perspective, start): where each chunk of each rendering begins."""
    length = lambda t, own: F.char_length(_head(t["speaker"], F.lit(own))) + F.char_length(t["said"]) + len(END) + 1
    each = said.select("conv_id", "chunk", "sub", F.explode(F.transform("said", lambda t: F.struct(t["speaker"].alias("speaker"), length(t, False).alias("other"), length(t, True).alias("own")))).alias("t"))
    spoken = each.groupBy("conv_id", "chunk", "sub", F.col("t.speaker").alias("perspective")).agg(F.sum("t.other").alias("other"), F.sum("t.own").alias("own"))
    whole = spoken.groupBy("conv_id", "chunk", "sub").agg(F.sum("other").alias("whole"))
    parts = spoken.where(F.col("perspective") != SYSTEM).select("conv_id", "perspective").distinct()
    grid = _same(_same(whole, parts, ["conv_id"]), spoken, ["conv_id", "chunk", "sub", "perspective"], "left")
    grid = grid.withColumn("length", F.col("whole") + F.coalesce(F.col("own") - F.col("other"), F.lit(0)))
    before = Window.partitionBy("conv_id", "perspective").orderBy("chunk", "sub").rowsBetween(Window.unboundedPreceding, -1)
    return grid.select("conv_id", "chunk", "sub", "perspective", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("start"))


def rotate(turns: DataFrame, speaker: str = "role") -> DataFrame:
    """(conv_id, perspective, chunk, turns, start, text, mask): mask holds (start, end) spans."""
    said = _chunks(turns, speaker)
    pairs = _same(said, _places(said), ["conv_id", "chunk", "sub"])
    own = lambda t: t["speaker"] == F.col("perspective")
    pieces = F.transform("said", lambda t: F.struct(_head(t["speaker"], own(t)).alias("head"), F.concat(t["said"], F.lit(END)).alias("body"), own(t).alias("own")))
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))
    return pairs.withColumn("pieces", pieces).select(
        "conv_id",
        "perspective",
        "chunk",
        F.size("pieces").cast("long").alias("turns"),
        "start",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("pieces", nothing, _masked, lambda acc: acc["mask"]).alias("mask"),
    )


def _masked(acc, p):
    begin = acc["at"] + F.char_length(p["head"])
    end = begin + F.char_length(p["body"])
    span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
    return F.struct((end + 1).cast("long").alias("at"), F.when(p["own"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))


def flat(rotated: DataFrame) -> DataFrame:
    """The mask as text, for tables without nested types."""
    return rotated.withColumn("mask", F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","))


#: The same in DuckDB, for flat(rotate(conversations)), where no chunk exceeds CHUNK_CHARS.
ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(CAST(floor(turn / {CHUNK}.0) AS BIGINT), {_LAST}) AS chunk, turn IS NULL AS late, turn,
         coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS said
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
r AS (
  SELECT t.conv_id, p.perspective, t.chunk, t.speaker = p.perspective AS own, said || '{END}' AS body,
         row_number() OVER (PARTITION BY t.conv_id, p.perspective, t.chunk ORDER BY late, turn, speaker, said) AS k,
         '{START}' || CASE WHEN t.speaker = p.perspective THEN 'assistant' WHEN t.speaker = '{SYSTEM}' THEN 'system'
           ELSE 'user name=' || translate(replace(t.speaker, '<|', '< |'), ' ' || chr(10) || chr(13) || chr(9), '____') END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, chunk ORDER BY k
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS s
  FROM r),
c AS (
  SELECT conv_id, perspective, chunk, count(*) AS turns, string_agg(head || body || chr(10), '' ORDER BY k) AS text,
         coalesce(string_agg(CASE WHEN own THEN CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY k), '') AS mask
  FROM o GROUP BY ALL)
SELECT conv_id, perspective, chunk, turns,
       CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       text, mask
FROM c
"""
