"""Strings and numbers from loosely typed input as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A finite double, or null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b))


#: Spellings of the two vocal states.
BARKING = ("bark", "barking")
SILENT = ("silent", "not_barking", "notbarking")


def state(c: Column) -> Column:
    """barking, not_barking, or the cleaned text itself."""
    s = F.translate(F.lower(F.trim(c)), " -", "__")
    return F.when(s.isin(*BARKING), "barking").when(s.isin(*SILENT), "not_barking").otherwise(s)


def last_number(c: Column) -> Column:
    """The last run of digits, null if there is none."""
    s = F.regexp_extract(c, r"(\d+)(?!.*\d)", 1)
    return F.when(s != "", s.try_cast("long"))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def palette_index(c: Column, colors: int) -> Column:
    return F.pmod(c, F.lit(colors))


def json_number(c: Column) -> Column:
    """A double rounded to eight places, in the shortest text: 0.25, 1.0, 5e-05."""
    r = F.round(c, 8)
    fixed = F.regexp_replace(F.regexp_replace(r.cast("decimal(38,8)").cast("string"), "0+$", ""), r"\.$", ".0")
    parts = F.split(r.cast("string"), "E-")  # Spark writes small ones as 5.0E-5
    small = F.concat(F.regexp_replace(F.get(parts, F.lit(0)), r"\.0$", ""), F.lit("e-"), F.lpad(F.get(parts, F.lit(1)), 2, "0"))
    return F.when((r == 0) | (F.abs(r) >= 1e-4), fixed).otherwise(small)


def json_list(numbers: Column) -> Column:
    """[0.25, 1.0] of an array of doubles."""
    return F.concat(F.lit("["), F.array_join(F.transform(numbers, json_number), ", "), F.lit("]"))


def json_map(entries: Column) -> Column:
    """{"12": 0.25, "3": 1.0} of an array of (k string, v double), in the order of the keys' text."""
    text = F.transform(F.sort_array(entries), lambda e: F.concat(F.lit('"'), e["k"], F.lit('": '), json_number(e["v"])))
    return F.concat(F.lit("{"), F.array_join(text, ", "), F.lit("}"))
