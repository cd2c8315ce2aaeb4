"""Positions of regular-expression matches, and folds over them, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Start and end in code points, end exclusive, and the text between.
SPANS = "array<struct<start:int,end:int,m:string>>"
#: Items of an array that are folded at a time.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def exploded(rows: DataFrame, items: Column, name: str) -> DataFrame:
    """``rows`` and ``name``: a row for each item that isn't null.

    For a plain explode the optimizer adds a filter on the array's size below, and so computes the
    array, with all its regular expressions, more than once. For an outer one it doesn't.
    """
    return rows.select("*", F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def no_spans() -> Column:
    return F.array().cast(SPANS)


def scan(items: Column, start: Column, state: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """``array<kind>``: for each item what ``out(state, item)`` gives; ``state(state, item)`` comes next.

    An array that grows is copied with every item. So items are taken in blocks, and only a block's
    array and the list of blocks grow: the copies stay small for texts with a million items.
    """
    nothing, no_parts = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    one = lambda acc, x: F.struct(state(acc["at"], x).alias("at"), F.array_append(acc["out"], out(acc["at"], x)).alias("out"))

    def block(acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(items, k * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), nothing.alias("out")), one)
        return let(part, lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["parts"], r["out"]).alias("parts")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    whole = F.aggregate(blocks, F.struct(start.alias("at"), no_parts.alias("parts")), block, lambda acc: F.flatten(acc["parts"]))
    return F.when(F.size(items) > 0, whole).otherwise(nothing)


def laid_out(gaps: Column, matches: Column) -> Column:
    """Spans of ``matches`` where ``gaps`` and matches alternate, a gap first."""
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("g"), matches.alias("m"))

    def span(at: Column, x: Column) -> Column:
        begin = at + F.length(x["g"])
        return F.struct(begin.alias("start"), (begin + F.length(x["m"])).alias("end"), x["m"].alias("m"))

    return let(parts, lambda p: scan(p, F.lit(0), lambda at, x: at + F.length(x["g"]) + F.length(x["m"]), span, "struct<start:int,end:int,m:string>"))


def find_spans(text: Column, pattern: str | Column) -> Column:
    """All matches of a pattern that never matches nothing, in order."""
    if isinstance(pattern, Column):
        return laid_out(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)))
    found = laid_out(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.when(text.rlike(pattern), found).otherwise(no_spans())


def not_inside(spans: Column, others: Column) -> Column:
    """``spans`` without those that lie in one of ``others``."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"])))


def utf16_length(text: Column) -> Column:
    """UTF-16 code units: two for each character beyond U+FFFF."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def utf16_offset(text: Column, offset: Column) -> Column:
    """A code-point offset in ``text`` as a UTF-16 one."""
    return utf16_length(F.substr(text, F.lit(1), offset))


def normalized(text: Column) -> Column:
    """White space as single spaces, none at the ends. NFC is left to where text comes in."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]+", " "))
