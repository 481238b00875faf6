"""Marks in the text of pages with their places: boxes, signatures and stamps, and spans of any pattern.

Places come from splitting a text at its matches and adding up the lengths of both, so all
of it is built-in functions on one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let, round_half_up
from .review import SPACE

_SPAN = "struct<at:bigint,line:bigint,match:string>"


def running_sums(numbers: Column, block: int = 256) -> Column:
    """Sums of all numbers before each, by blocks, so that long arrays aren't copied for each item."""
    def before(xs: Column, first: Column) -> Column:
        start = F.struct(first.alias("now"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct((a["now"] + x).alias("now"), F.array_append(a["out"], a["now"]).alias("out")))["out"]

    zero = F.lit(0).cast("bigint")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int"))), lambda b: F.slice(numbers, b * block + 1, block))
    return let(blocks, lambda bs: F.flatten(F.zip_with(bs, before(F.transform(bs, lambda b: F.aggregate(b, zero, lambda a, x: a + x)), zero), before)))


def units(c: Column) -> Column:
    """Length in UTF-16 units, as the offsets are."""
    return F.length(c).cast("bigint") + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]")).cast("bigint")


def _places(gaps: Column, hits: Column) -> Column:
    """array of struct(at, line, match) of matches and the text between them."""
    breaks = lambda c: (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).cast("bigint")
    none = F.lit(0).cast("bigint")
    offsets = running_sums(F.zip_with(gaps, hits, lambda g, h: units(g) + F.coalesce(units(h), none)))
    lines = running_sums(F.zip_with(gaps, hits, lambda g, h: breaks(g) + F.coalesce(breaks(h), none)))
    return let(F.struct(offsets.alias("o"), lines.alias("l")), lambda r: F.transform(hits, lambda h, i: F.struct(
        (F.get(r["o"], i) + units(F.get(gaps, i))).alias("at"), (F.get(r["l"], i) + breaks(F.get(gaps, i)) + 1).alias("line"), h.alias("match"))))


def _cut(text: Column, pattern: str) -> list[Column]:
    """The text between the matches of a pattern, and the matches."""
    return [F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")]


def spans(text: Column, pattern: str) -> Column:
    """array of struct(at, line, match) of all matches, which aren't empty: offset from 0 in UTF-16 units, line from 1."""
    def placed(t: Column) -> Column:
        return F.when(t.rlike(pattern), let(F.struct(*_cut(t, pattern)), lambda c: _places(c["gaps"], c["hits"]))).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return let(text, placed)


@dataclass(frozen=True)
class Mark:
    """A pattern and what its matches are; ``group`` holds the label of a box, or what follows that of a signature."""

    pattern: str
    type: str
    group: int | None = None


_S, _REST = f"[{SPACE}]", r"([^\n\r\x{2028}\x{2029}]{0,50})"
# Boxes, signatures and stamps in the order they are looked for.
BOXES = (
    Mark(rf"\[[xX✓✔]\]{_S}*{_REST}", "checked", 1), Mark(rf"\[{_S}*\]{_S}*{_REST}", "unchecked", 1), Mark(rf"☑{_S}*{_REST}", "checked", 1), Mark(rf"☐{_S}*{_REST}", "unchecked", 1),
    Mark(rf"\([xX✓]\){_S}*{_REST}", "checked", 1), Mark(rf"\({_S}*\){_S}*{_REST}", "unchecked", 1), Mark(rf"(?i)\[Y\]{_S}*{_REST}", "checked", 1), Mark(rf"(?i)\[N\]{_S}*{_REST}", "unchecked", 1))
SIGNATURES = (
    Mark(rf"(?i)signature[:{SPACE}]*([^\n]{{0,30}})", "handwritten", 1), Mark(rf"(?i)signed[:{SPACE}]*([^\n]{{0,30}})", "handwritten", 1), Mark(rf"(?i)customer{_S}*signature", "handwritten"),
    Mark(rf"(?i)technician{_S}*signature", "handwritten"), Mark(rf"(?i)authorized{_S}*by[:{SPACE}]*([^\n]{{0,30}})", "handwritten", 1), Mark(rf"(?i)digital{_S}*signature", "digital"), Mark("(?i)e-?sign", "digital"))
STAMPS = (
    Mark("(?i)APPROVED", "approval"), Mark("(?i)REJECTED", "approval"), Mark("(?i)CERTIFIED", "certification"), Mark("(?i)RECEIVED", "date"), Mark(rf"(?i)STAMP[:{SPACE}]*([^\n]{{0,20}})", "unknown"),
    Mark(rf"(?i)SEAL[:{SPACE}]*([^\n]{{0,20}})", "company"), Mark(r"(?i)\[STAMP\]", "unknown"), Mark(r"(?i)\(OFFICIAL\)", "company"))
# By kind the marks, their x, width and height, and the confidence at each sensitivity.
KINDS = {
    "checkbox": (BOXES, 5, 3, 3, {"high": 0.7, "medium": 0.8, "low": 0.9}), "signature": (SIGNATURES, 50, 30, 5, {"high": 0.6, "medium": 0.75, "low": 0.85}),
    "stamp": (STAMPS, 70, 15, 10, {"high": 0.65, "medium": 0.8, "low": 0.9})}
#: What a signature that is there adds to its confidence.
PRESENT = 0.1


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_S}+|{_S}+$", "")


def marks(pages: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", sensitivity: str = "medium") -> DataFrame:
    """(keys, kind, n, at, line, y, x, width, height, type, present, confidence, label, match): a row per mark of a page.

    ``n`` counts a kind's marks of a page from 1, from the top; those of one height stand in
    the order of their patterns, then of their places. ``y`` is the share of the page above,
    of 100 and at most 95. A box's label is what follows to the end of the line, at most 50
    characters; a signature's is what stands before its colon, and it is present if more than
    three characters follow that aren't all ``_``, ``-`` or ``.``. The random part that a
    box's confidence has there is left out. A null text shows nothing; rows that repeat their
    keys are pages of their own.
    """
    def cut(t: Column) -> Column:
        """Of each pattern that the text shows, what it is and how it cuts the text."""
        return F.array_compact(F.array(*[
            F.when(t.rlike(m.pattern), F.struct(
                F.lit(kind).alias("kind"), F.lit(place).alias("place"), F.lit(m.type).alias("type"), F.lit(m.pattern).alias("pattern"), F.lit(m.group is not None).alias("labelled"), F.lit(x).alias("x"), F.lit(width).alias("width"),
                F.lit(height).alias("height"), F.lit(confidences[sensitivity]).cast("double").alias("base"), *_cut(t, m.pattern)))
            for kind, (every, x, width, height, confidences) in KINDS.items() for place, m in enumerate(every)]))

    def placed(c: Column, total: Column) -> Column:
        """Marks of one pattern, sorted by (y, place, i) wherever they are put together."""
        box, signature = c["kind"] == "checkbox", c["kind"] == "signature"

        def row(s: Column, i: Column) -> Column:
            after = F.when(c["labelled"], _trim(F.call_function("regexp_extract", s["match"], c["pattern"], F.lit(1)))).otherwise("")

            def told(a: Column) -> Column:
                there = F.when(box, c["type"] == "checked").when(signature, (F.length(a) > 3) & ~a.rlike(r"^[_\-.]+$"))
                label = F.when(box, F.nullif(a, F.lit(""))).when(signature & s["match"].rlike("^[^:]+:"), _trim(F.regexp_extract(s["match"], "^([^:]+):", 1)))
                return F.struct(
                    F.least(F.lit(95), round_half_up(s["at"] / total * 100)).cast("int").alias("y"), c["place"].alias("place"), i.alias("i"), c["kind"].alias("kind"), s["at"].alias("at"), s["line"].alias("line"), c["x"].alias("x"),
                    c["width"].alias("width"), c["height"].alias("height"), c["type"].alias("type"), there.alias("present"), F.when(signature & there, F.round(c["base"] + PRESENT, 10)).otherwise(c["base"]).alias("confidence"),
                    label.alias("label"), s["match"].alias("match"))

            return let(after, told)

        return F.transform(_places(c["gaps"], c["hits"]), row)

    def every(t: Column) -> Column:
        found = let(units(t), lambda n: F.array_sort(F.flatten(F.transform(cut(t), lambda c: placed(c, n)))))
        return let(found, lambda ms: F.concat(*[F.transform(F.filter(ms, lambda m: m["kind"] == k), lambda m, i: m.withField("n", i + 1)) for k in KINDS]))

    rows = pages.select(*keys, F.explode(let(F.coalesce(F.col(text), F.lit("")), every)).alias("m"))
    return rows.select(*keys, *(F.col(f"m.{c}") for c in ("kind", "n", "at", "line", "y", "x", "width", "height", "type", "present", "confidence", "label", "match")))
