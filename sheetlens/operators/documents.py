"""Operators on document text: quality, templates, field extraction, classification."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import confidence_band, fuzzy_ratio, js_regex, let, round_half_up, tokens

# Patterns that betray a poor scan.
ARTIFACTS = (r"[|l1I]{3,}", r"[^A-Za-z0-9_\s]{4,}", r"\b[A-Z]{10,}\b", r"\?\?\?+", r"\.{4,}", r"_{4,}", r"[^\x20-\x7E]{3,}")


def artifact_count(text: Column) -> Column:
    return reduce(lambda a, p: a + F.regexp_count(text, F.lit(js_regex(p))), ARTIFACTS, F.lit(0))


def _bounded(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), c))


def page_quality(pages: DataFrame, text: str = "text") -> DataFrame:
    """Heuristic scores of a page's scan from its text; null texts are empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n")
    p = pages.withColumn("_len", F.length(t)).withColumn("_lines", F.size(F.filter(lines, lambda x: F.trim(x) != ""))).withColumn(
        "_words", F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))).withColumn("artifacts", artifact_count(t)).withColumn("_indented", F.size(F.filter(lines, lambda x: x.startswith(" "))))
    density = F.when(F.col("_words") > 0, F.col("_len") / F.col("_words")).otherwise(0.0)
    one = lambda c, n: F.when(c, n).otherwise(0)
    blur = _bounded(70 + one((density > 5) & (density < 15), 15) + one(F.col("_words") > 50, 10) + one(F.col("artifacts") < 3, 10) - F.col("artifacts") * 5)
    contrast = _bounded(70 + one(F.col("_len") > 200, 10) + one(F.col("_lines") > 5, 10) + one(F.col("artifacts") < 5, 10) - F.col("artifacts") * 3)
    share = F.when(F.col("_lines") > 0, F.col("_indented") / F.col("_lines")).otherwise(0.0)
    skew = F.when(share > 0.5, round_half_up((share - 0.5) * 10, 2)).otherwise(0.0)
    bright = F.when((F.col("_len") < 50) & (F.col("artifacts") < 2), 95).when(F.col("artifacts") > 10, 25).otherwise(70)
    p = p.withColumn("blur", blur).withColumn("contrast", contrast).withColumn("skew", skew).withColumn("brightness", bright)
    overall = round_half_up(F.col("blur") * 0.3 + F.col("contrast") * 0.3 + (100 - F.abs("skew") * 2) * 0.2 + F.col("brightness") * 0.2)
    return p.withColumn("overall", _bounded(overall).cast("long")).drop("_len", "_lines", "_words", "_indented")


def document_quality(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Worst page, rounded mean, and their weighted sum."""
    g = pages.groupBy(key).agg(F.min("overall").alias("lowest"), round_half_up(F.avg("overall")).cast("long").alias("average"), F.count_if((F.col("blur") < 30) | (F.col("contrast") < 20) | (F.col("skew") > 5)).alias("pages_with_issues"))
    return g.withColumn("quality", round_half_up(F.col("lowest") * 0.4 + F.col("average") * 0.6).cast("long")).withColumn("requires_review", (F.col("quality") < 50) | (F.col("pages_with_issues") > 0))


# --- templates ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    """How a template recognises its documents."""

    slug: str
    required_all: Sequence[str] = ()
    required_any: Sequence[str] = ()
    optional: Sequence[str] = ()
    form_code: str | None = None
    weights: Mapping[str, float] = field(default_factory=dict)

    def tokens(self) -> list[str]:
        return [t.lower() for t in (*self.required_all, *self.required_any, *self.optional)]

    def score(self, words: Column, known: Column | None = None) -> Column:
        """0 to 100 for a document's distinct words; ``known`` are those of them that templates name, see ``known_words``."""
        return self.scored(lambda t: F.array_contains(words if known is None else known, t.lower()), self.coded(words) if self.form_code else None)

    def coded(self, words: Column) -> Column:
        """Whether a document's distinct words show the form's code."""
        return F.array_join(words, " ").rlike("(?i)" + js_regex(self.form_code))

    def scored(self, has: Callable[[str], Column], coded: Column | None) -> Column:
        """0 to 100 for the words that ``has`` tells to be there; ``coded`` tells whether the form's code is."""
        gain = lambda ts, default: reduce(lambda a, t: a + F.when(has(t), float(self.weights.get(t, default))).otherwise(0.0), ts, F.lit(0.0))
        s = gain(self.required_all, 10)
        if self.required_all:
            s = F.when(reduce(lambda a, t: a & has(t), self.required_all, F.lit(True)), s).otherwise(F.greatest(F.lit(0.0), s - 50))
        if self.required_any:
            some = reduce(lambda a, t: a | has(t), self.required_any, F.lit(False))
            s = F.when(some, s + gain(self.required_any, 5)).otherwise(F.greatest(F.lit(0.0), s - 30))
        if self.form_code:
            s = s + F.when(coded, 15.0).otherwise(0.0)
        s = s + gain(self.optional, 2)
        most = len(self.required_all) * 10 + min(len(self.required_any), 1) * 5 + (15 if self.form_code else 0) + len(self.optional) * 2
        return F.least(F.lit(100.0), round_half_up(s / most * 100)) if most else F.lit(0.0)


def known_words(words: Column, templates: Sequence[Template]) -> Column:
    """The words that any template names: few, so that each template looks through few."""
    every = sorted({w for t in templates for w in t.tokens()})
    return F.array_intersect(words, F.array(*map(F.lit, every)) if every else F.array().cast("array<string>"))


def _worded(docs: DataFrame, templates: Sequence[Template], key: str, text: str) -> DataFrame:
    words = docs.select(key, F.array_distinct(tokens(F.coalesce(F.col(text), F.lit("")))).alias("_words"))
    return words.withColumn("_known", known_words(F.col("_words"), templates))


def template_scores(docs: DataFrame, templates: Sequence[Template], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, slug, score) of every document and template. The templates are a bounded list, so the scores are one array per row: no join."""
    words = _worded(docs, templates, key, text)
    scores = F.array(*[F.struct(F.lit(t.slug).alias("slug"), t.score(F.col("_words"), F.col("_known")).alias("score")) for t in templates])
    return words.select(key, F.explode(scores).alias("s")).select(key, "s.slug", "s.score")


def select_template(docs: DataFrame, templates: Sequence[Template], key: str = "doc_id", text: str = "text", least_gap: float = 10.0, carry: Sequence[str] = (),
                    boost: Callable[[Template, Column], Column] | None = None, catch_all: str = "standard-maintenance-v1") -> DataFrame:
    """The best template of each document, its band, the gap to the next, and whether it may be processed without review.

    ``boost(template, score)`` raises scores by what is known of a document, see
    ``templates.booster``; it may use the carried columns. Where ``catch_all`` is the only
    template, it is always processed.
    """
    words = docs.select(key, *carry, F.array_distinct(tokens(F.coalesce(F.col(text), F.lit("")))).alias("_words")).withColumn("_known", known_words(F.col("_words"), templates))

    def one(t: Template) -> Column:
        score = t.score(F.col("_words"), F.col("_known"))
        return let(score if boost is None else let(score, lambda s: boost(t, s)), lambda s: F.struct((-s).alias("m"), F.lit(t.slug).alias("slug")))

    ranked = F.array_sort(F.array(*map(one, templates)))
    r = words.select(key, *carry, ranked.alias("_r")).select(
        key, *carry, F.get("_r", F.lit(0))["slug"].alias("slug"), (0 - F.get("_r", F.lit(0))["m"]).alias("top_score"), F.coalesce(0 - F.get("_r", F.lit(1))["m"], F.lit(0.0)).alias("runner_up_score"))
    r = r.withColumn("gap", F.col("top_score") - F.col("runner_up_score")).withColumn("band", confidence_band(F.col("top_score")))
    allowed = (F.col("band") == "HIGH") | ((F.col("band") == "MEDIUM") & (F.col("gap") >= least_gap)) | F.lit([t.slug for t in templates] == [catch_all])
    whole = lambda c: F.col(c).cast("long").cast("string")
    reason = F.when(allowed, F.lit(None).cast("string")).when(F.col("band") == "MEDIUM", F.concat(F.lit("MEDIUM confidence with ambiguous gap ("), whole("gap"), F.lit(f" < {least_gap:g})"))).otherwise(
        F.concat(F.lit("LOW confidence ("), whole("top_score"), F.lit(" < 50)")))
    return r.withColumn("selected", allowed).withColumn("block_reason", reason)


def weighted_signals(signals: DataFrame, key: Sequence[str]) -> DataFrame:
    """Weighted mean over the signals that are present: ``signals(*key, score, weight)``, absent scores null."""
    present = signals.filter("score IS NOT NULL")
    return present.groupBy(*key).agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("score"), F.count("*").alias("signals"))


# --- fields -------------------------------------------------------------------------------


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """The first pattern's first group that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns], F.lit(None).cast("string"))


def extract_with_patterns(docs: DataFrame, fields: Mapping[str, Sequence[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, field, value, confidence) by ordered patterns; long patterns are trusted more."""
    def one(name, patterns):
        hits = [F.when(F.trim(F.regexp_extract(F.col(text), p, 1)) != "", F.struct(F.trim(F.regexp_extract(F.col(text), p, 1)).alias("v"), F.lit(85 if len(p) > 50 else 75).alias("c"))) for p in patterns]
        hit = F.coalesce(*hits)
        return F.struct(F.lit(name).alias("field"), hit["v"].alias("value"), hit["c"].alias("confidence"))

    return docs.select(key, F.explode(F.array(*[one(n, p) for n, p in fields.items()])).alias("f")).select(key, "f.*").filter("value IS NOT NULL")


def extract_fuzzy(docs: DataFrame, labels: Sequence[str], key: str = "doc_id", text: str = "text", least: float = 70.0) -> DataFrame:
    """Values of ``label: value`` lines whose label is like a wanted one; the first line, then the first label, wins."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "_l")).filter(F.col("_l").contains(":"))
    said = lines.select(key, "line", F.trim(F.substring_index("_l", ":", 1)).alias("_label"), F.trim(F.regexp_extract("_l", "^[^:]*:(.*)$", 1)).alias("value"))
    tried = said.select("*", F.posexplode(F.array(*map(F.lit, labels))).alias("n", "label")).withColumn("ratio", fuzzy_ratio(F.col("_label"), F.col("label"))).filter((F.col("ratio") >= least) & (F.col("value") != ""))
    return tried.groupBy(key, "label").agg(F.min_by(F.struct("value", "ratio"), F.struct("line", "n")).alias("b")).select(key, "label", "b.value", "b.ratio")


def extract_by_context(docs: DataFrame, label: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The value after the colon of a line with the label (70), else the next line if it has no colon (60)."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "_l"))
    nxt = F.lead("_l").over(Window.partitionBy(key).orderBy("line"))
    hit = lines.withColumn("_n", nxt).filter(F.lower("_l").contains(label.lower()))
    after = F.nullif(F.trim(F.regexp_extract("_l", "^[^:]*:(.*)$", 1)), F.lit(""))
    below = F.when(~F.col("_n").contains(":"), F.nullif(F.trim("_n"), F.lit("")))
    found = hit.select(key, "line", F.coalesce(after, below).alias("value"), F.when(after.isNotNull(), 70).otherwise(60).alias("confidence")).filter("value IS NOT NULL")
    return found.groupBy(key).agg(F.min_by(F.struct("value", "confidence"), "line").alias("b")).select(key, "b.*")


def extract_by_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """What stands after the first keyword, with or without a separator, to the end of its line."""
    quoted = [f"\\Q{k}\\E" for k in keywords]
    return first_match(text, [p for k in quoted for p in (rf"(?i){k}\s*[:=]\s*([^\n]+)", rf"(?i){k}\s+([^\n]+)")])


def candidates(docs: DataFrame, patterns: Mapping[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """All matches of every pattern, as (key, field, value)."""
    def named(name):
        return lambda v: F.struct(F.lit(name).alias("field"), v.alias("value"))

    every = F.concat(*[F.transform(F.regexp_extract_all(F.col(text), F.lit(js_regex(p)), 0), named(n)) for n, p in patterns.items()])
    return docs.filter(F.col(text).isNotNull()).select(key, F.explode(every).alias("c")).select(key, "c.field", "c.value")


def classify(text: Column, tests: Sequence[tuple[str, str]], otherwise: str = "UNKNOWN") -> Column:
    """The first class whose mark the lower-cased text contains."""
    t, out = F.lower(text), F.lit(otherwise)
    for mark, name in reversed(list(tests)):
        out = F.when(t.contains(mark), name).otherwise(out)
    return out


def keyword_coverage(text: Column, words: Sequence[str]) -> Column:
    """A score from length and the share of words found: at most 50 each."""
    t = F.lower(text)
    found = reduce(lambda a, w: a + F.when(t.contains(w), 1).otherwise(0), words, F.lit(0))
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.least(F.lit(50.0), n / 10.0) + found / float(len(words)) * 50


def process(docs: DataFrame, templates: Sequence[Template], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Text to decision, a row for each document: the scan's quality, the selected template, and what happens next. The text is read once and nothing is joined."""
    quality = page_quality(docs.select(key, text), text).withColumn("_poor", (F.col("overall") < 50) | (F.col("blur") < 30) | (F.col("contrast") < 20) | (F.col("skew") > 5))
    chosen = select_template(quality, templates, key, text, carry=("overall", "_poor"))
    status = F.when(~F.col("selected"), "review_queue").when(F.col("_poor"), "review_queue").otherwise("processed")
    return chosen.select(key, "slug", "band", "overall", status.alias("status"))


def fixture_matrix(cases: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """``cases(case_id, text, expected_slug, expected_selected, required)`` with what happened and whether it was expected."""
    got = select_template(cases, templates, "case_id").select("case_id", "slug", "selected")
    right = (F.col("selected") == F.col("expected_selected")) & (~F.col("expected_selected") | F.col("slug").eqNullSafe(F.col("expected_slug")))
    return cases.join(got, "case_id").select("case_id", "required", "slug", "selected", right.alias("passed"))


def matrix_totals(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(~F.col("passed") & F.col("required")).alias("required_failed"))
