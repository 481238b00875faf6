"""Choosing a template by four signals of a document: its words, its layout, its regions and its fields.

Profiles are a bounded configuration and become arrays of expressions, so a document is
scored, explained and decided in its own row: no join and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import confidence_band, js_regex, let, names_word, round_half_up, tokens
from .documents import Template
from .sheets import SYNONYMS
from .templates import boosted

# Weights of the signals, scores of a layout, and what a date looks like.
WEIGHTS = {"token": 0.40, "layout": 0.20, "roi": 0.25, "plausibility": 0.15}
NEUTRAL, PAGES_GAIN, SECTIONS_GAIN, FORM_GAIN = 50.0, 20.0, 30.0, 10.0
DATE = r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"
_SIGNAL = "type:string,score:double,weight:double,confidence:string"
_EXPLAINED = f"{_SIGNAL},matched:array<string>,missing:array<string>"


@dataclass(frozen=True)
class Region:
    """A place on a page; its fields are looked for in that page's text, without fields more than 50 characters are enough."""

    name: str
    page: int
    fields: Sequence[str] = ()


@dataclass(frozen=True)
class Profile:
    """A template with what else its documents show. ``fields`` are (field, type, pattern or None)."""

    template: Template
    regions: Sequence[Region] = ()
    fields: Sequence[tuple[str, str, str | None]] = ()
    pages: tuple[int, int] = (1, 10)
    form: str | None = "printed"
    sections: Sequence[str] = ()
    client: str | None = None
    asset_type: str | None = None
    work_type: str | None = None


def field_names(field: str) -> list[str]:
    """A field's name, its words apart and together, and its synonyms, in lower case."""
    words = re.sub("([A-Z])", r" \1", field).split()
    return list(dict.fromkeys(x.lower() for x in (field, " ".join(words), "".join(words), *SYNONYMS.get(field, ()))))


def _mentions(low: Column, field: str) -> Column:
    """Names that hold another of the field's names are found with that one."""
    names = field_names(field)
    return reduce(lambda a, n: a | low.contains(n), [n for n in names if not any(m != n and m in n for m in names)], F.lit(False))


class _Tests:
    """What profiles ask of a document. Equal questions are one column, answered once for all profiles."""

    def __init__(self, text: str, low: str, pages: str):
        self.text, self.low, self.pages = F.col(text), F.col(low), F.col(pages)
        self.page_texts: dict[int, Column] = {}
        self.answers: list[Column] = []
        self.known: dict[tuple, Column] = {}

    def ask(self, question: tuple, test: Callable[[], Column]) -> Column:
        if question not in self.known:
            self.known[question] = F.col(f"_t{len(self.answers)}")
            self.answers.append(F.coalesce(test(), F.lit(False)).alias(f"_t{len(self.answers)}"))
        return self.known[question]

    def word(self, word: str) -> Column:
        return self.ask(("word", word.lower()), lambda: names_word(self.low, word))

    def coded(self, t: Template) -> Column:
        """A form's code that is one whole word is looked for as a word, any other in all words of the text."""
        one = re.match(r"\\b([A-Za-z0-9_]+)\\b\Z", t.form_code)
        return self.word(one[1]) if one else self.ask(("code", t.form_code), lambda: t.coded(F.array_distinct(tokens(self.text))))

    def on_page(self, page: int, field: str) -> Column:
        if page not in self.page_texts:
            self.page_texts[page] = F.lower(F.coalesce(F.get(self.pages, page - 1), F.lit("")))
        return self.ask(("page", page, field), lambda: _mentions(F.col(f"_page{page}"), field))

    def filled(self, page: int) -> Column:
        return self.ask(("filled", page), lambda: F.length(F.get(self.pages, page - 1)) > 50)

    def shown(self, field: str, kind: str, pattern: str | None) -> Column:
        if kind == "date":
            return self.ask((kind,), lambda: self.text.rlike(DATE))
        if kind in ("pattern", "regex"):
            return self.ask(("pattern", pattern), lambda: self.text.rlike("(?i)" + js_regex(pattern))) if pattern else F.lit(False)
        return self.ask(("text", field), lambda: _mentions(self.low, field)) if kind in ("string", "required") else F.lit(False)


def _apart(c: Column) -> Column:
    """The column itself; a projection that holds it is no part of a larger generated method, which Java would leave uncompiled beyond 8000 bytes, but is cut into small ones."""
    return let(c, lambda x: x)


@dataclass(frozen=True)
class Signal:
    """A signal's score, null where it is absent, and its tests as (holds, label if so, label if not); labels may be None."""

    kind: str
    score: Column
    tests: Sequence[tuple[Column, Column | str | None, Column | str | None]]

    def told(self, score: Column, explained: bool) -> Column:
        short = [F.lit(self.kind).alias("type"), score.alias("score"), F.lit(WEIGHTS[self.kind]).alias("weight"), confidence_band(score).alias("confidence")]
        if not explained:
            return F.struct(*short)
        listed = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
        matched = listed([F.when(holds, yes) for holds, yes, _ in self.tests if yes is not None])
        missing = listed([F.when(~holds, no) for holds, _, no in self.tests if no is not None])
        return F.struct(*short, matched.alias("matched"), missing.alias("missing"))


def _share(holds: Sequence[Column]) -> Column:
    """The share of tests that hold, of 100."""
    return round_half_up(reduce(lambda a, h: a + h.cast("int"), holds, F.lit(0)) / float(len(holds)) * 100) if holds else F.lit(NEUTRAL)


def token_signal(ask: _Tests, t: Template) -> Signal:
    some = reduce(lambda a, x: a | ask.word(x), t.required_any, F.lit(not t.required_any))
    tests = [(ask.word(x), x, x) for x in t.required_all] + [(ask.word(x), x, None) for x in t.required_any] + [(some, None, f"ANY({', '.join(t.required_any)})")]
    coded = ask.coded(t) if t.form_code else None
    if t.form_code:
        tests.append((coded, f"REGEX:{t.form_code}", f"REGEX:{t.form_code}"))
    return Signal("token", t.scored(ask.word, coded), tests + [(ask.word(x), f"optional:{x}", None) for x in t.optional])


def layout_signal(page_count: Column, form: Column, sections: Column, p: Profile) -> Signal:
    """Absent where the document's number of pages isn't known."""
    low, high = p.pages
    within = page_count.between(low, high)
    named = [F.coalesce(F.array_contains(sections, s.lower()), F.lit(False)) for s in p.sections]
    counted = F.concat(F.lit("pageCount:"), page_count.cast("string"))
    tests = [(within, F.concat(counted, F.lit(f" (within {low}-{high})")), F.concat(counted, F.lit(f" (expected {low}-{high})")))]
    tests += [(t, f"section:{s}", F.when(sections.isNotNull(), f"section:{s}")) for t, s in zip(named, p.sections)]
    score = NEUTRAL + F.when(within, PAGES_GAIN).otherwise(-PAGES_GAIN)
    if p.sections:
        score = score + reduce(lambda a, t: a + t.cast("double"), named, F.lit(0.0)) / len(named) * SECTIONS_GAIN
    if p.form:
        tests.append((F.coalesce(form == p.form, F.lit(False)), F.concat(F.lit("formType:"), form), F.concat(F.lit("formType:"), form, F.lit(f" (expected {p.form})"))))
        score = score + F.when(form == p.form, FORM_GAIN).when(form.isNotNull(), -FORM_GAIN).otherwise(0.0)
    return Signal("layout", F.when(page_count.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))), tests)


def roi_signal(ask: _Tests, p: Profile) -> Signal:
    """Fields of each region that its page mentions; where none are named, content of the page is enough."""
    tests = []
    for r in p.regions:
        each = [(ask.on_page(r.page, f), f) for f in r.fields] or [(ask.filled(r.page), "content present")]
        found = F.array_join(F.array(*[F.when(t, f) for t, f in each]), ", ")
        tests.append((reduce(lambda a, t: a | t[0], each, F.lit(False)), F.concat(F.lit(f"roi:{r.name} (fields: "), found, F.lit(")")), f"roi:{r.name} (page {r.page})"))
    return Signal("roi", _share([t[0] for t in tests]), tests)


def plausibility_signal(ask: _Tests, p: Profile) -> Signal:
    tests = [(ask.shown(*f), f"field:{f[0]}", f"field:{f[0]}") for f in p.fields]
    return Signal("plausibility", _share([t[0] for t in tests]), tests)


def _number(c: Column) -> Column:
    """A score as it is written: whole ones without a fraction."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def select_by_signals(docs: DataFrame, profiles: Sequence[Profile], key: str = "doc_id", text: str = "text", pages: str = "pages", page_count: str = "page_count", form_type: str = "form_type",
                      sections: str | None = None, metadata: Mapping[str, Column] | None = None, least_gap: float = 10.0, explained: bool = True) -> DataFrame:
    """(key, slug, top_score, runner_up_score, gap, band, selected, block_reason, signals): the best profile of each row, and why it may not be used.

    A profile's score is the weighted mean of its signals over those present (the layout's is
    absent where ``page_count`` is null), rounded, with the boosts for the document's client,
    kind of asset and kind of work. Ties go to the smaller slug. ``pages`` is an array of
    texts; a null one is the text as one page. Repeated rows are decided one by one. Signals
    tell what matched and what is missing if ``explained``.
    """
    # Each step is a projection of its own, so that what several expressions use is made once and in generated code.
    t = F.coalesce(F.col(text), F.lit(""))
    listed = F.transform(F.col(sections), F.lower) if sections else F.lit(None).cast("array<string>")
    boosts = {name: f"_meta_{name}" for name in metadata or {}}
    ask = _Tests("_text", "_low", "_pages")
    signals = [(token_signal(ask, p.template), layout_signal(F.col("_page_count"), F.col("_form"), F.col("_sections"), p), roi_signal(ask, p), plausibility_signal(ask, p)) for p in profiles]
    rows = docs.select(
        key, *(c.alias(boosts[n]) for n, c in (metadata or {}).items()), t.alias("_text"), F.lower(t).alias("_low"), F.coalesce(F.col(pages), F.array(t)).alias("_pages"),
        F.col(page_count).alias("_page_count"), F.col(form_type).alias("_form"), listed.alias("_sections"))
    rows = rows.withColumns({f"_page{n}": c for n, c in ask.page_texts.items()})
    kept = [key, *boosts.values(), "_form", "_sections"]
    pages_known = _apart(F.col("_page_count")).alias("_page_count")
    rows = rows.select(*kept, pages_known, *ask.answers)
    rows = rows.select(*kept, pages_known, *(f"_t{i}" for i in range(len(ask.answers))), *(s.score.alias(f"_{s.kind}{i}") for i, each in enumerate(signals) for s in each))

    def mean(i: int, kinds: Sequence[str]) -> Column:
        total = reduce(lambda a, k: a + F.col(f"_{k}{i}") * WEIGHTS[k], kinds, F.lit(0.0))
        return round_half_up(total / reduce(lambda a, k: a + WEIGHTS[k], kinds, 0.0))

    meta = {n: F.col(c) for n, c in boosts.items()}
    without = [k for k in WEIGHTS if k != "layout"]
    scores = [f"_{s.kind}{i}" for i, each in enumerate(signals) for s in each]
    means = [F.when(F.col("_page_count").isNotNull(), mean(i, list(WEIGHTS))).otherwise(mean(i, without)) for i in range(len(profiles))]
    kept = [key, *scores, *([f"_t{i}" for i in range(len(ask.answers))] + ["_form", "_sections"] if explained else [])]
    rows = rows.select(*kept, *boosts.values(), pages_known, *(m.alias(f"_m{i}") for i, m in enumerate(means)))
    final = [boosted(F.col(f"_m{i}"), {"client": p.client, "asset_type": p.asset_type, "work_type": p.work_type}, meta) for i, p in enumerate(profiles)]
    rows = rows.select(*kept, pages_known, *(m.alias(f"_m{i}") for i, m in enumerate(final)))
    ranked = F.sort_array(F.array(*[F.struct((-F.col(f"_m{i}")).alias("down"), F.lit(p.template.slug).alias("slug"), F.lit(i).alias("place"), F.col(f"_m{i}").alias("score")) for i, p in enumerate(profiles)]))
    rows = rows.select(*kept, pages_known, ranked.alias("_r"))
    top, second = F.get("_r", 0), F.get("_r", 1)

    def told(i: int) -> Column:
        each = {s.kind: s.told(F.col(f"_{s.kind}{i}"), explained) for s in signals[i]}
        return F.when(F.col("_page_count").isNotNull(), F.array(*each.values())).otherwise(F.array(*[each[k] for k in without]))

    # Only the best profile's signals are told.
    told_best = reduce(lambda a, i: a.when(top["place"] == i, told(i)), range(1, len(profiles)), F.when(top["place"] == 0, told(0))).cast(f"array<struct<{_EXPLAINED if explained else _SIGNAL}>>")
    best = rows.select(key, top["slug"].alias("slug"), top["score"].alias("top_score"), F.coalesce(second["score"], F.lit(0.0)).alias("runner_up_score"), second["slug"].alias("_next"), told_best.alias("signals"))
    best = best.withColumn("gap", F.col("top_score") - F.col("runner_up_score")).withColumn("band", confidence_band(F.col("top_score")))
    allowed = (F.col("band") == "HIGH") | ((F.col("band") == "MEDIUM") & (F.col("gap") >= least_gap))
    weak = F.filter("signals", lambda s: s["confidence"] == "LOW")
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    noted = F.when(F.size(weak) > 0, said(" Weak signals: ", F.array_join(F.transform(weak, lambda s: s["type"]), ", "), ".")).otherwise("")
    ambiguous = F.when(F.col("_next").isNull(), "MEDIUM confidence with insufficient candidates").otherwise(
        said("AMBIGUITY_BLOCK: Score gap ", _number(F.col("gap")), f" < {least_gap:g} between \"", F.col("slug"), '" (', _number(F.col("top_score")), ') and "', F.col("_next"), '" (', _number(F.col("runner_up_score")), ").", noted))
    low = F.array_join(F.transform(weak, lambda s: F.concat(s["type"], F.lit(":"), _number(s["score"]))), ", ")
    lowly = F.concat(said('LOW_CONFIDENCE_BLOCK: Top candidate "', F.col("slug"), '" scored ', _number(F.col("top_score"))), F.when(F.size(weak) > 0, said(". Low signals: [", low, "]")).otherwise(" < 50"))
    reason = F.when(allowed, F.lit(None).cast("string")).when(F.col("band") == "MEDIUM", ambiguous).otherwise(lowly)
    return best.select(key, "slug", "top_score", "runner_up_score", "gap", "band", allowed.alias("selected"), reason.alias("block_reason"), "signals")
