"""Typed fields of pages by keyword: hints, then the label, then aliases, with patterns of dates and sums to fall back on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MONTHS, js_regex, ladder, let, trimmed
from .review import SPACE
from .sheets import typed_confidence

# Patterns to fall back on, their confidence, words of yes and no, and the levels.
DATES = (r"(\d{4}-\d{2}-\d{2})", r"(\d{1,2}/\d{1,2}/\d{2,4})", r"(\d{1,2}-\d{1,2}-\d{2,4})", r"(?i)(\w+ \d{1,2},? \d{4})")
SUMS = (r"(\$[\d,]+(?:\.\d{2})?)", r"(?i)([\d,]+(?:\.\d{2})?\s*(?:USD|dollars?))")
FALLBACK = 0.6
YES, NO = ("yes", "true", "1", "checked", "signed"), ("no", "false", "0", "unchecked", "unsigned")
LEVELS = ((0.8, "high"), (0.5, "medium"), (0.2, "low"))
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


@dataclass(frozen=True)
class KeywordField:
    """``kind`` is string, number, currency, boolean or date."""

    name: str
    label: str
    kind: str = "string"
    hints: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    page_hint: int | None = None


def iso_date(t: Column) -> Column:
    """``2024-01-15``, ``1/15/2024`` (month first) and ``January 15, 2024`` as ISO dates; null for anything else and for days that don't exist."""
    n = lambda p, k: F.regexp_extract(t, p, k).try_cast("int")
    iso, us, named = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", rf"(?i)^({'|'.join(MONTHS)})[a-z]* (\d{{1,2}}),? (\d{{4}})$"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(t, named, 1))).cast("int")
    day = lambda y, m, d: F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    said = F.when(t.rlike(iso), day(n(iso, 1), n(iso, 2), n(iso, 3))).when(t.rlike(us), day(n(us, 3), n(us, 1), n(us, 2))).when(t.rlike(named), day(n(named, 3), month, n(named, 2)))
    return said.try_cast("date").cast("string")


def typed(value: Column, kind: str) -> Column:
    """The value in the usual form of its kind, null if it has none: numbers as doubles, answers as true or false, dates as ISO."""
    if kind in ("number", "currency"):
        bare = F.regexp_replace(value, f"[{'$' if kind == 'currency' else ''},{SPACE}]", "")
        return F.regexp_extract(bare, _NUMBER, 0).try_cast("double").cast("string")
    if kind == "boolean":
        return F.when(F.lower(value).isin(*YES), "true").when(F.lower(value).isin(*NO), "false")
    return iso_date(value) if kind == "date" else F.lit(None).cast("string")


def _found(text: Column, f: KeywordField) -> Column:
    """(raw, method) on one page, null if there is none."""
    hit = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    as_raw = lambda method: lambda v: F.when(v.isNotNull(), F.struct(trimmed(v).alias("raw"), F.lit(method).alias("method")))
    tries = []
    for i, word in enumerate((*f.hints, f.label, *f.aliases)):
        quoted = "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        tries.append(let(F.coalesce(hit(rf"(?i){quoted}[:{SPACE}]+([^\n]+)"), hit(rf"(?i){quoted}[:{SPACE}]*([^\n]+)")), as_raw("keyword")))
        if i == 0 and f.kind in ("date", "currency"):
            tries.append(let(F.coalesce(*[hit(js_regex(p)) for p in (DATES if f.kind == "date" else SUMS)]), as_raw("pattern")))
    return F.coalesce(*tries)


def keyword_fields(docs: DataFrame, fields: Sequence[KeywordField], key: str = "doc_id", pages: str = "pages", least: float = 0.0) -> DataFrame:
    """(key, field, value, raw, normalised, confidence, level, page, method) of each field found, from the first page that shows it.

    ``docs(key, pages array<struct<page,text>>)``: a field's hinted page is searched alone if
    there is one. Of each page the first keyword that shows counts; where the first of all
    doesn't, dates and sums are looked for by pattern. A keyword with nothing behind it gives an
    empty value of confidence 0. Null pages and texts hold nothing; rows that share a key stay apart.
    """
    def one(ps: Column, f: KeywordField) -> Column:
        def on(p: Column) -> Column:
            def told(x: Column) -> Column:
                sure = F.when(x["method"] == "pattern", FALLBACK).otherwise(typed_confidence(x["raw"], f.kind))
                return let(F.struct(typed(x["raw"], f.kind).alias("t"), sure.alias("c")), lambda y: F.when(x.isNotNull(), F.struct(
                    F.lit(f.name).alias("field"), F.coalesce(y["t"], x["raw"]).alias("value"), x["raw"].alias("raw"), y["t"].isNotNull().alias("normalised"), y["c"].alias("confidence"),
                    ladder(y["c"], LEVELS, "none").alias("level"), p["page"].alias("page"), x["method"].alias("method"))))

            return let(_found(F.coalesce(p["text"], F.lit("")), f), told)

        hinted = F.filter(ps, lambda p: p["page"] == f.page_hint) if f.page_hint is not None else None
        searched = ps if hinted is None else let(hinted, lambda h: F.when(F.size(h) > 0, h).otherwise(ps))
        return F.get(F.array_compact(F.transform(searched, on)), 0)

    every = let(F.coalesce(F.col(pages), F.array().cast("array<struct<page:int,text:string>>")), lambda ps: F.array_compact(F.array(*[one(ps, f) for f in fields])))
    return docs.select(key, F.explode(every).alias("f")).select(key, "f.*").filter(F.col("confidence") >= least)
