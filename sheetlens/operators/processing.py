"""From pages to a stored decision: template, analysis or assessment, status, findings; a row per document and no join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let
from . import analyzer, sheets
from .documents import Template, select_template

_FIELD = "array<struct<field:string,value:string,confidence:double,page:int>>"
_FINDING = "array<struct<severity:string,reason:string,field:string,page:int,snippet:string,confidence:double,rule_id:string>>"
#: Confidence of a field that is read from a text whose template isn't known.
UNIVERSAL = 0.7


def gathered(pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(key, pages, carried) from rows of pages; ``carry`` names columns of the document, of which the greatest value stays.

    A document's pages are one row, in their order; a page's text is null if it couldn't be read.
    """
    return pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(page).cast("int").alias("page"), F.col(text).alias("text")))).alias("pages"), *[F.max(c).alias(c) for c in carry])


def whole_text(pages: Column) -> Column:
    """All pages' texts, each under a line with its number."""
    return F.array_join(F.transform(pages, lambda p: F.concat(F.lit("--- Page "), p["page"].cast("string"), F.lit(" ---\n"), F.coalesce(p["text"], F.lit("")))), "\n\n")


def _universal(pages: Column) -> Column:
    """Each kind of field that any document may have, from the first page that shows it."""
    def of(name: str, patterns: Sequence[str]):
        def on(p: Column) -> Column:
            said = F.substring(sheets.trimmed(sheets.first_group(p["text"], patterns, p["low"])), 1, 100)
            return let(said, lambda v: F.when(v.isNotNull(), F.struct(F.lit(name).alias("field"), v.alias("value"), F.lit(UNIVERSAL).alias("confidence"), p["page"].alias("page"))))

        return lambda read: F.get(F.array_compact(F.transform(read, on)), 0)

    kinds = [of(n, p) for n, p in sheets.UNIVERSAL.items()]
    read = F.transform(pages, lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text"), sheets.lowered(p["text"]).alias("low")))
    return let(read, lambda read: F.array_compact(F.array(*[find(read) for find in kinds]))).cast(_FIELD)


def _analysed(text: Column, rules: Sequence[analyzer.Rule]) -> Column:
    """The full mode: fields and findings of the template's rules."""
    def told(a: Column) -> Column:
        fields = F.transform(a["fields"], lambda f: F.struct(f["field"].alias("field"), f["value"].alias("value"), F.lit(float(analyzer.FOUND)).alias("confidence"), F.lit(1).alias("page")))
        findings = F.transform(a["findings"], lambda f: F.struct(f["severity"].alias("severity"), f["reason"].alias("reason"), f["field"].alias("field"), F.lit(1).alias("page"), F.lit("").alias("snippet"),
                                                                 f["confidence"].cast("double").alias("confidence"), f["rule_id"].alias("rule_id")))
        summary = F.format_string("Rule-based analysis completed. Detected %d/%d expected fields. Word count: %d.", a["detected"], a["expected"], a["words"])
        status = F.when(a["result"] == "REVIEW_QUEUE", "review_queue").otherwise("completed")
        return F.struct(status.alias("status"), F.lit("FULL").alias("mode"), F.lower(a["result"]).alias("result"), a["score"].cast("double").alias("score"), F.lit(None).cast("string").alias("review_reason"),
                        summary.alias("summary"), fields.cast(_FIELD).alias("fields"), findings.cast(_FINDING).alias("findings"))

    return let(analyzer.analysis(text, rules), told)


def _assessed(text: Column, pages: Column, top: Column, band: Column) -> Column:
    """The hybrid mode: what any document may have, and why it goes to review; never a failure."""
    reason = F.when(top == 0, "TEMPLATE_NOT_MATCHED").when(band == "LOW", "LOW_TEMPLATE_CONFIDENCE").otherwise("AMBIGUOUS_SELECTION")
    said = reduce(lambda c, kv: c.when(reason == kv[0], kv[1]), list(sheets.REVIEW_REASONS.items())[1:], F.when(reason == "TEMPLATE_NOT_MATCHED", sheets.REVIEW_REASONS["TEMPLATE_NOT_MATCHED"]))

    def told(x: Column) -> Column:
        findings = F.transform(x["f"], lambda f: F.struct(F.lit("S3").alias("severity"), F.lit("VALID").alias("reason"), f["field"].alias("field"), f["page"].alias("page"), f["value"].alias("snippet"), f["confidence"].alias("confidence"), F.lit(None).cast("string").alias("rule_id")))
        hint = F.when(F.size(x["h"]) > 0, F.concat(F.lit("Suggested template: "), F.get(x["h"], 0)))
        summary = F.concat_ws(" ", said, F.concat(F.lit("Extracted "), F.size(x["f"]).cast("string"), F.lit(" universal fields.")), hint)
        return F.struct(F.lit("review_queue").alias("status"), F.lit("HYBRID").alias("mode"), F.lit("review_queue").alias("result"), top.alias("score"), reason.alias("review_reason"), summary.alias("summary"), x["f"].alias("fields"), findings.cast(_FINDING).alias("findings"))

    return let(F.struct(_universal(pages).alias("f"), sheets.template_hints(text).alias("h")), told)


def _chosen(docs: DataFrame, templates: Sequence[Template], key: str, pages: str, version: str, carry: Sequence[str]) -> tuple[DataFrame, Column, Column]:
    """Documents with their whole text and template, whether one fails, and its run's id."""
    readable = F.exists(F.coalesce(F.col(pages), F.array().cast("array<struct<page:int,text:string>>")), lambda p: p["text"].isNotNull())
    names = ",".join([version, *(t.slug for t in templates)])
    base = docs.select(key, *carry, F.col(pages).alias("_pages"), readable.alias("_readable"), F.when(readable, whole_text(F.col(pages))).alias("_text"))
    run = F.sha2(F.concat_ws("\x1f", F.lit(names), F.col(key).cast("string"), F.coalesce("_text", F.lit("\x00"))), 256)
    if not templates:
        chosen = base.select("*", F.lit(None).cast("string").alias("slug"), F.lit(0.0).alias("top_score"), F.lit("LOW").alias("band"), F.lit(False).alias("selected"))
    else:
        chosen = select_template(base, templates, key, "_text", carry=(*carry, "_pages", "_readable", "_text"))
    return chosen, F.lit(not templates) | ~F.col("_readable"), run


def processed(docs: DataFrame, templates: Sequence[Template], rules: Mapping[str, Sequence[analyzer.Rule]], key: str = "doc_id", pages: str = "pages", version: str = "1", carry: Sequence[str] = ()) -> DataFrame:
    """``docs(key, pages array<struct<page,text>>)`` to a row each with what is to be stored.

    A document without a page that could be read fails, as all do where there are no templates.
    Where a template is selected, its rules (``rules`` by slug, else the usual ones) are
    analysed over the whole text (FULL); else the text is assessed for review (HYBRID).
    ``run_id`` is a digest of the key, the pages, the templates' names and ``version``: the same
    document processed again gives the same run. Rows that share a key stay rows of their own.
    """
    chosen, failed, run = _chosen(docs, templates, key, pages, version, carry)
    text = F.col("_text")
    known = {t.slug: _analysed(text, rules.get(t.slug, analyzer.RULES)) for t in templates}
    hybrid = _assessed(text, F.col("_pages"), F.col("top_score"), F.col("band"))
    out = F.when(failed, F.lit(None))
    for slug, full in known.items():
        out = out.when(F.col("selected") & (F.col("slug") == slug), full)
    error = F.when(~F.col("_readable"), "No readable page").when(F.lit(not templates), "No templates")
    rows = chosen.select(key, *carry, run.alias("run_id"), F.when(~failed & F.col("selected"), F.col("slug")).alias("template"), F.when(~failed, F.col("band")).alias("band"),
                         F.coalesce(F.size("_pages"), F.lit(0)).alias("page_count"), error.alias("error"), out.otherwise(hybrid).alias("_o"))
    return rows.select(key, *carry, "run_id", F.coalesce("_o.status", F.lit("failed")).alias("status"), "_o.mode", "_o.result", "_o.score", "template", "band", "_o.review_reason", "_o.summary",
                       F.greatest("page_count", F.lit(0)).alias("page_count"), "_o.fields", "_o.findings", "error")


def outcomes(docs: DataFrame, templates: Sequence[Template], rules: Mapping[str, Sequence[analyzer.Rule]], key: str = "doc_id", pages: str = "pages", carry: Sequence[str] = ()) -> DataFrame:
    """(key, carried, status, template, score) as ``processed`` gives them; fields and findings, which these don't depend on, aren't read."""
    chosen, failed, _ = _chosen(docs, templates, key, pages, "1", carry)
    out = F.when(failed, F.lit(None))
    for t in templates:
        full = let(analyzer.analysis(F.col("_text"), rules.get(t.slug, analyzer.RULES), told=False), lambda a: F.struct(
            F.when(a["result"] == "REVIEW_QUEUE", "review_queue").otherwise("completed").alias("status"), a["score"].cast("double").alias("score")))
        out = out.when(F.col("selected") & (F.col("slug") == t.slug), full)
    out = out.otherwise(F.struct(F.lit("review_queue").alias("status"), F.col("top_score").alias("score")))
    rows = chosen.select(key, *carry, F.when(~failed & F.col("selected"), F.col("slug")).alias("template"), out.alias("_o"))
    return rows.select(key, *carry, F.coalesce("_o.status", F.lit("failed")).alias("status"), "template", "_o.score")
