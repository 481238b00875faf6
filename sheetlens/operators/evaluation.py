"""Metrics of evaluation runs: selection, fields, fusion, second readings, fields of test cases, and two configurations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio, round_half_up
from ..sources.tables import SEVERITIES

# How a fused field was decided.
DECISIONS = ("ocr", "image_qa", "merged", "conflict")


def selection_metrics(results: DataFrame, by: str) -> DataFrame:
    """Counts, accuracy and share of ambiguous ones of ``results(by, correct, ambiguous)``, by value and over all (null)."""
    n, ok, amb = F.count("*"), F.count_if("correct"), F.count_if("ambiguous")
    return results.rollup(by).agg(n.alias("total"), ok.alias("correct"), (n - ok).alias("incorrect"), amb.alias("ambiguous"), ratio(ok, n).alias("accuracy"), ratio(amb, n).alias("ambiguity_rate"))


def critical_field_metrics(fields: DataFrame) -> DataFrame:
    """(by, name, total, correct, missing, accuracy) of ``fields(severity, field, correct, value)``.

    Over all fields, by severity (all four, also those without a field), by field, and over
    the critical ones (S0 and S1). A field is counted once for each of these, in one pass.
    """
    critical = F.col("severity").isin("S0", "S1")
    kinds = F.array_compact(F.array(
        F.struct(F.lit("all").alias("by"), F.lit("").alias("name")), F.struct(F.lit("severity").alias("by"), F.col("severity").alias("name")),
        F.struct(F.lit("field").alias("by"), F.col("field").alias("name")), F.when(critical, F.struct(F.lit("critical").alias("by"), F.lit("").alias("name")))))
    gone = ~F.col("correct") & F.col("value").isNull()
    m = fields.select(F.explode(kinds).alias("k"), "correct", gone.alias("gone")).groupBy("k.by", "k.name").agg(
        F.count("*").alias("total"), F.count_if("correct").alias("correct"), F.count_if("gone").alias("missing"))
    spine = fields.sparkSession.createDataFrame([("severity", s) for s in SEVERITIES], "by string, name string")
    every = m.join(spine, ["by", "name"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.select("by", "name", zero("total"), zero("correct"), zero("missing")).withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def fusion_metrics(fused: DataFrame) -> DataFrame:
    """Agreements, disagreements and decisions of ``fused(field, agreed, decision)``, by field and over all (null)."""
    n, ok = F.count("*"), F.count_if("agreed")
    decided = [F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS]
    return fused.rollup("field").agg(n.alias("total"), ok.alias("agreements"), (n - ok).alias("disagreements"), ratio(ok, n).alias("agreement_rate"), *decided)


def second_pass_metrics(results: DataFrame) -> DataFrame:
    """(by, name, total, triggered, rate) of ``results(template_id, triggered, reason, interpreter, escalated)``.

    By template and over all; and of the triggered ones by reason (``unknown`` if none is
    given), by interpreter, and those that were escalated.
    """
    kind = lambda by, name: F.struct(F.lit(by).alias("by"), name.alias("name"))
    hit = F.col("triggered")
    kinds = F.array_compact(F.array(
        kind("all", F.lit("")), kind("template", F.col("template_id").cast("string")), F.when(hit, kind("reason", F.coalesce("reason", F.lit("unknown")))),
        F.when(hit, kind("interpreter", F.col("interpreter"))), F.when(hit & F.col("escalated"), kind("escalated", F.lit("")))))
    m = results.select(F.explode(kinds).alias("k"), "triggered").groupBy("k.by", "k.name").agg(F.count("*").alias("total"), F.count_if("triggered").alias("triggered"))
    return m.withColumn("rate", ratio(F.col("triggered"), F.col("total")))


def field_metrics(matches: DataFrame, case: str) -> DataFrame:
    """(field, accuracy, extraction_rate, confidence) of ``matches(case, field, match, confidence)``, two decimals.

    Exact and fuzzy matches are right; the rate is against the number of cases.
    """
    cases = matches.agg(F.count_distinct(case).alias("_cases"))
    g = matches.groupBy("field").agg(F.count_if(F.col("match").isin("exact", "fuzzy")).alias("_ok"), F.count("*").alias("_n"), F.avg("confidence").alias("_c"))
    two = lambda c: round_half_up(c, 2)
    return g.crossJoin(F.broadcast(cases)).select("field", two(F.col("_ok") / F.col("_n")).alias("accuracy"), two(F.col("_n") / F.col("_cases")).alias("extraction_rate"), two(F.col("_c")).alias("confidence"))


def ab_summary(results: DataFrame) -> DataFrame:
    """One row of differences (A less B) and the winner of ``results(config, f1, accuracy, latency_ms)``.

    Means less than 0.02 apart in F1 are a tie; more than 0.1 apart are certain.
    """
    mean = lambda c, of: F.avg(F.when(F.col("config") == c, F.col(of)))
    d = results.agg(*[(mean("A", c) - mean("B", c)).alias(c) for c in ("f1", "accuracy", "latency_ms")])
    gap = F.abs(F.col("f1"))
    winner = F.when(gap < 0.02, "tie").when(F.col("f1") > 0, "A").otherwise("B")
    certainty = F.when(gap < 0.02, "low").when(gap > 0.1, "high").otherwise("medium")
    return d.select(round_half_up(F.col("f1"), 2).alias("f1_delta"), round_half_up(F.col("accuracy"), 2).alias("accuracy_delta"), round_half_up(F.col("latency_ms")).alias("latency_delta"),
                    winner.alias("winner"), certainty.alias("certainty"))


def rules_with(rules: DataFrame, tags: list[str] | None = None, only_enabled: bool = False) -> DataFrame:
    """Enabled rules, and rules that share a tag, where asked for; a rule without tags shares none."""
    tests = ([F.col("enabled")] if only_enabled else []) + ([F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False))] if tags else [])
    return rules.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def with_template_metrics(templates: DataFrame, metrics: DataFrame, key: str = "template_id") -> DataFrame:
    """Templates with their metrics; one without audits has none counted, and is taken to be valid and confident."""
    m = templates.join(metrics, key, "left")
    default = {"total_audits": F.lit(0), "ambiguity_rate": F.lit(0.0), "valid_rate": F.lit(1.0), "avg_confidence": F.lit(1.0)}
    return m.select(*templates.columns, *[F.coalesce(F.col(c), d).alias(c) for c, d in default.items()])


def golden_documents(documents: DataFrame) -> DataFrame:
    """One row per validated field of ``documents(doc_id, fields)``, with the severity's importance."""
    f = documents.select("doc_id", F.explode("fields").alias("f")).select("doc_id", "f.*")
    return f.withColumn("is_critical", F.col("severity").isin("S0", "S1"))


def selection_traces(docs: DataFrame, chosen: DataFrame, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """What a selection saw and decided: the number of tokens, the first 20, the length, and the outcome."""
    seen = docs.select(key, F.size(tokens).alias("token_count"), F.slice(tokens, 1, 20).alias("token_sample"), "document_length")
    return seen.join(chosen, key)
