"""Activation of template versions, and routing by what a page's image shows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import Template

# Fields that a template must have, that it should have, and regions that it must place.
CRITICAL_FIELDS = ("jobReference", "assetId", "date", "engineerSignOff")
RECOMMENDED_FIELDS = ("expiryDate", "complianceTickboxes", "customerSignature")
CRITICAL_REGIONS = ("jobReference", "assetId", "date", "expiryDate", "tickboxBlock", "signatureBlock")
# What mends an issue.
FIXES = {
    "SELECTION_CONFIG_EMPTY": "add required tokens or a form code", "MISSING_CRITICAL_FIELD": "define the field", "NO_VALIDATION_RULES": "add a rule",
    "MISSING_FIXTURE_PACK": "create a fixture pack", "FIXTURES_FAILING": "mend the fixtures or the spec", "MISSING_CRITICAL_ROIS": "place the regions",
    "INSUFFICIENT_SELECTION_TOKENS": "add required tokens"}

_ISSUE = "array<struct<code:string,detail:string,fix:string>>"


def _issue(code: str, detail: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit("") if detail is None else detail).alias("detail"), F.lit(FIXES.get(code, "")).alias("fix"))


def _when(test: Column, code: str, detail: Column | None = None) -> Column:
    return F.when(test, F.array(_issue(code, detail))).otherwise(F.array().cast(_ISSUE))


def _each(values: Column, code: str) -> Column:
    return F.transform(values, lambda v: _issue(code, v))


def activation_policy(versions: DataFrame, key: str = "version_id", allowed_missing: Sequence[str] = (), least_tokens: int = 1) -> DataFrame:
    """(key, allowed, violations, warnings): whether a version may go live, what stops it and how to mend that.

    ``versions(key, tokens_all, tokens_any, form_code, fields, rule_fields, regions,
    has_fixtures, required_failed)`` holds arrays of names; null arrays are empty.
    """
    have = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    names = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    tokens = F.size(have("tokens_all")) + F.size(have("tokens_any"))
    critical, placed = names(CRITICAL_FIELDS), F.array_except(names(CRITICAL_REGIONS), have("regions"))
    blocking = F.array_except(placed, names(allowed_missing))
    excused = F.array_intersect(placed, names(allowed_missing))
    violations = F.concat(
        _when((tokens == 0) & (F.coalesce("form_code", F.lit("")) == ""), "SELECTION_CONFIG_EMPTY"), _each(F.array_except(critical, have("fields")), "MISSING_CRITICAL_FIELD"),
        _when(F.size(have("rule_fields")) == 0, "NO_VALIDATION_RULES"), _when(~F.col("has_fixtures"), "MISSING_FIXTURE_PACK"),
        _when(F.col("has_fixtures") & (F.col("required_failed") > 0), "FIXTURES_FAILING", F.col("required_failed").cast("string")),
        _when(F.size(blocking) > 0, "MISSING_CRITICAL_ROIS", F.array_join(blocking, ", ")), _when(tokens < least_tokens, "INSUFFICIENT_SELECTION_TOKENS", tokens.cast("string")))
    warnings = F.concat(
        _each(F.array_except(names(RECOMMENDED_FIELDS), have("fields")), "MISSING_RECOMMENDED_FIELD"),
        _each(F.array_except(F.array_intersect(critical, have("fields")), have("rule_fields")), "CRITICAL_FIELD_NO_RULE"), _when(F.size(excused) > 0, "ALLOWED_MISSING_ROIS", F.array_join(excused, ", ")))
    return versions.select(key, violations.alias("violations"), warnings.alias("warnings")).select(key, (F.size("violations") == 0).alias("allowed"), "violations", "warnings")


def boosted(score: Column, template: dict[str, str | None], metadata: dict[str, Column]) -> Column:
    """A template's score with 10 for the document's client, 5 for its kind of asset and 5 for its kind of work, each up to 100."""
    def step(s: Column, part: tuple[str, float]) -> Column:
        name, gain = part
        if not template.get(name) or name not in metadata:
            return s
        return F.when(metadata[name] == template[name], F.least(F.lit(100.0), s + gain)).otherwise(s)

    return reduce(step, (("client", 10.0), ("asset_type", 5.0), ("work_type", 5.0)), score)


def booster(known: Mapping[str, Mapping[str, str | None]], metadata: dict[str, Column]) -> Callable[[Template, Column], Column]:
    """For ``documents.select_template``: what raises the score of a template, ``known`` giving the client, asset_type and work_type of each slug."""
    return lambda template, score: boosted(score, dict(known.get(template.slug, {})), metadata)


def image_review(documents: DataFrame, required_signatures: Sequence[str], required_boxes: Sequence[str], key: str = "doc_id") -> DataFrame:
    """(key, route, reasons, priority) by the quality of pages and the marks found on them.

    ``documents(key, quality, skewed_pages, signatures, boxes)``, the last two arrays of
    (label, present, confidence). Reasons are in the order of their severity.
    """
    none = "array<struct<severity:string,code:string,detail:string>>"
    why = lambda s, c, d: F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), d.alias("detail"))
    one = lambda test, s, c, d: F.when(test, F.array(why(s, c, d))).otherwise(F.array().cast(none))
    lacking = lambda marks, labels: F.filter(marks, lambda m: ~m["present"] & m["label"].isin(*labels))
    weak = F.size(F.filter(F.concat("signatures", "boxes"), lambda m: m["confidence"] < 0.7))
    reasons = F.concat(
        F.transform(lacking("signatures", required_signatures), lambda m: why("S0", "MISSING_SIGNATURE", m["label"])), one(F.col("quality") < 50, "S1", "LOW_QUALITY", F.col("quality").cast("string")),
        F.transform(lacking("boxes", required_boxes), lambda m: why("S1", "UNCHECKED_REQUIRED", m["label"])), one(F.col("skewed_pages") > 0, "S2", "SKEWED_DOCUMENT", F.col("skewed_pages").cast("string")),
        one(weak > 0, "S3", "LOW_CONFIDENCE", weak.cast("string")))
    worst = F.array_min(F.transform("reasons", lambda r: r["severity"]))
    return documents.select(key, reasons.alias("reasons")).select(
        key, (F.size("reasons") > 0).alias("route"), "reasons", F.when(worst == "S0", "high").when(worst == "S1", "medium").otherwise("low").alias("priority"))
