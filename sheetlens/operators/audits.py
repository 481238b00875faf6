"""Scorecards, fix packs, quality metrics and reports over audits, selections and issues.

Every operator takes and returns DataFrames, aggregates partially before it shuffles, has an
explicit as-of time and a total order wherever it ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, period_bounds, r6, rank_of, ratio, round_half_up, trend
from ..sources.tables import ISSUE_TYPES

# What each reason code means, what to do about it, and its category.
REASONS = {
    "MISSING_FIELD": ("Required field was not found in the document", "Ensure all required fields are present and clearly labeled on job sheets", "critical"),
    "INVALID_FORMAT": ("Field value does not match expected format", "Use standard formats for dates, reference numbers, and other structured data", "warning"),
    "LOW_CONFIDENCE": ("Field extraction had low confidence due to unclear or ambiguous content", "Ensure fields are clearly written or typed, avoid handwriting over printed text", "warning"),
    "CONFLICT": ("Multiple conflicting values detected for the same field", "Ensure only one value is provided for each field, avoid corrections without clear marking", "critical"),
    "SPEC_GAP": ("Template specification is missing required ROI or field definition", "Contact admin to update template specification", "info"),
    "OCR_FAILURE": ("Document image quality prevented accurate text extraction", "Ensure documents are scanned clearly without shadows, folds, or low resolution", "warning"),
    "PIPELINE_ERROR": ("System processing error occurred", "Retry the audit or contact support if issue persists", "info"),
}
CATEGORIES = ("critical", "warning", "info")
SEVERITY_WEIGHT = {"S0": 10, "S1": 5, "S2": 2, "S3": 1}


def count_if(c: Column) -> Column:
    return F.count_if(c)


def in_period(df: DataFrame, at: str, as_of: str, period: str) -> DataFrame:
    low, high = period_bounds(as_of, period)
    return df.filter((F.col(at) >= low.cast("timestamp")) & (F.col(at) < F.date_add(high, 1).cast("timestamp")))


def between(df: DataFrame, at: str, low: str, high: str) -> DataFrame:
    """Inclusive on both sides."""
    return df.filter(F.col(at).between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")))


def outcome_counts() -> list[Column]:
    o = F.col("outcome")
    return [
        F.count("*").alias("total_audits"), count_if(o == "VALID").alias("valid_count"), count_if(o == "INVALID").alias("invalid_count"), count_if(o == "REVIEW_QUEUE").alias("review_count"),
        r6(F.avg((o == "VALID").cast("double"))).alias("valid_rate"), r6(F.avg("confidence")).alias("avg_confidence")]


def reason_counts(audits: DataFrame, *by: str) -> DataFrame:
    """Occurrences of each reason code in each group, and their share of the group's codes in percent."""
    n = audits.select(*by, F.explode("reason_codes").alias("reason_code")).groupBy(*by, "reason_code").agg(F.count("*").alias("n"))
    total = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return n.withColumn("share", r6(F.col("n") * 100.0 / F.sum("n").over(total)))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, into: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order; the limit is pushed below the shuffle."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(into) <= k)


def scorecards(audits: DataFrame, key: str) -> DataFrame:
    """One row per value of ``key``: outcomes, rates, field sums and the top reason."""
    sums = [F.sum(c).alias(f"{c}_total") for c in ("fields_extracted", "fields_missing", "fields_low_confidence")]
    cards = audits.groupBy(key).agg(*outcome_counts(), *sums)
    top = top_per_group(reason_counts(audits, key), [key], [F.desc("n"), F.col("reason_code")], 1).select(
        key, F.col("reason_code").alias("top_reason"), F.col("n").alias("top_reason_count"))
    return cards.join(top, key, "left")


def engineer_cards(audits: DataFrame, key: str = "engineer_id", by: str = "template_id", k: int = 5) -> DataFrame:
    """Scorecards with ``reasons``, the ``k`` most frequent with their counts and shares, and ``templates``, the counts by template in order.

    Both are bounded: there are eight reasons, and templates are a small dimension.
    """
    ranked = top_per_group(reason_counts(audits, key), [key], [F.desc("n"), F.col("reason_code")], k)
    reasons = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "reason_code", "n", "share"))).alias("reasons"))
    per = audits.groupBy(key, by).agg(*outcome_counts())
    templates = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[by, *(c for c in per.columns if c not in (key, by))]))).alias("templates"))
    return scorecards(audits, key).join(reasons, key, "left").join(templates, key, "left")


def reason_dimension(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, *v) for k, v in REASONS.items()], "reason_code string, description string, recommendation string, category string")


def fix_packs(audits: DataFrame, key: str, examples: int = 3) -> DataFrame:
    """Per value of ``key`` and reason of audits that aren't valid: occurrences, first audits, what to do.

    The dimension of reasons is a handful of fixed rows and is broadcast.
    """
    codes = audits.filter("outcome <> 'VALID'").select(key, "audit_id", F.explode("reason_codes").alias("reason_code"))
    n = codes.groupBy(key, "reason_code").agg(F.count("*").alias("occurrences"))
    first = top_per_group(codes, [key, "reason_code"], [F.col("audit_id")], examples).groupBy(key, "reason_code").agg(F.array_sort(F.collect_list("audit_id")).alias("_ids"))
    joined = n.join(first, [key, "reason_code"]).join(F.broadcast(reason_dimension(audits)), "reason_code", "left")
    return joined.select(
        key, "reason_code", "occurrences", F.array_join(F.transform("_ids", lambda i: i.cast("string")), ",").alias("example_audits"),
        F.coalesce("category", F.lit("info")).alias("category"), F.coalesce("description", F.lit("Unknown issue")).alias("description"),
        F.coalesce("recommendation", F.lit("Contact support for assistance")).alias("recommendation"))


def template_quality(audits: DataFrame) -> DataFrame:
    ambiguous = F.arrays_overlap("reason_codes", F.array(F.lit("LOW_CONFIDENCE"), F.lit("CONFLICT")))
    return audits.groupBy("template_id").agg(
        F.count("*").alias("total_audits"), r6(F.avg((F.col("outcome") == "VALID").cast("double"))).alias("valid_rate"), r6(F.avg("confidence")).alias("avg_confidence"),
        r6(F.avg(ambiguous.cast("double"))).alias("ambiguity_rate")).withColumn("attention", r6(F.col("valid_rate") - F.col("ambiguity_rate")))


def cockpit_overall(audits: DataFrame) -> DataFrame:
    return template_quality(audits).agg(
        F.count("*").alias("total_templates"), F.sum("total_audits").alias("total_audits"), r6(F.avg("valid_rate")).alias("average_valid_rate"), r6(F.avg("avg_confidence")).alias("average_confidence"),
        count_if(F.col("ambiguity_rate") > 0.2).alias("templates_with_high_ambiguity"), count_if(F.col("valid_rate") < 0.8).alias("templates_needing_attention"))


def cockpit_issues(audits: DataFrame, k: int = 5) -> DataFrame:
    """The k commonest reasons, and how many templates have each among their own k."""
    own = top_per_group(reason_counts(audits, "template_id"), ["template_id"], [F.desc("n"), F.col("reason_code")], k).groupBy("reason_code").agg(F.count("*").alias("affected_templates"))
    top = reason_counts(audits).orderBy(F.desc("n"), "reason_code").limit(k).select("reason_code", F.col("n").alias("total_occurrences"))
    return top.join(own, "reason_code", "left").withColumn("affected_templates", F.coalesce("affected_templates", F.lit(0)))


def breakdown(audits: DataFrame, key: str, default: str, k: int = 3) -> DataFrame:
    """Audits, valid rate and the k top reasons by a looked-up attribute; absent values get the default."""
    a = audits.withColumn(key, F.coalesce(key, F.lit(default)))
    top = top_per_group(reason_counts(a, key), [key], [F.desc("n"), F.col("reason_code")], k).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "reason_code"))).alias("_top"))
    return a.groupBy(key).agg(F.count("*").alias("audits"), r6(F.avg((F.col("outcome") == "VALID").cast("double"))).alias("valid_rate")).join(top, key, "left").select(
        key, "audits", "valid_rate", F.array_join(F.transform("_top", lambda t: t["reason_code"]), ",").alias("top_reasons"))


# --- selections ---------------------------------------------------------------------------


def ambiguous(selections: DataFrame, threshold: float = 0.10) -> DataFrame:
    return selections.filter((F.col("gap") < threshold) & (F.col("candidates") > 1))


def selection_overview(selections: DataFrame, threshold: float = 0.10) -> DataFrame:
    return selections.agg(
        F.count("*").alias("total"), *[count_if(F.col("band") == b).alias(b.lower()) for b in ("HIGH", "MEDIUM", "LOW")], count_if(F.col("auto_processed")).alias("auto_processed"),
        count_if(F.col("overridden")).alias("overridden"), count_if((F.col("gap") < threshold) & (F.col("candidates") > 1)).alias("ambiguous"))


def ambiguous_pairs(selections: DataFrame, k: int = 10) -> DataFrame:
    return ambiguous(selections).filter("template_slug IS NOT NULL").groupBy(F.col("template_slug").alias("template1")).agg(
        F.count("*").alias("n"), r6(F.avg("gap")).alias("avg_gap")).withColumn("template2", F.lit("runner-up")).orderBy(F.desc("n"), "template1").limit(k)


def token_collisions(selections: DataFrame, k: int = 20) -> DataFrame:
    t = ambiguous(selections).select("template_slug", F.explode("tokens").alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("collisions"), F.array_join(F.array_sort(F.collect_set("template_slug")), ",").alias("templates"), F.count_distinct("template_slug").alias("n_templates")).filter("n_templates > 1").orderBy(F.desc("collisions"), "token").limit(k)


def template_summary(selections: DataFrame) -> DataFrame:
    return selections.filter("template_slug IS NOT NULL").groupBy("template_slug").agg(
        F.count("*").alias("total"), *[count_if(F.col("band") == b).alias(b.lower()) for b in ("HIGH", "MEDIUM", "LOW")], count_if(F.col("overridden")).alias("overrides"), r6(F.avg("top_score")).alias("avg_score"),
        F.sum(F.lit(0)).alias("runner_up"))


def ambiguity_alert(selections: DataFrame, threshold_percent: float) -> DataFrame:
    o = selection_overview(selections)
    rate = ratio(F.col("ambiguous"), F.col("total")) * 100
    return o.select(r6(rate).alias("ambiguity_percent"), F.lit(threshold_percent).alias("threshold"), (rate > threshold_percent).alias("alert"))


# --- issues -------------------------------------------------------------------------------


def penalty() -> Column:
    out = F.lit(0)
    for s, w in SEVERITY_WEIGHT.items():
        out = F.when(F.col("severity") == s, w).otherwise(out)
    return out


def issue_score_cards(issues: DataFrame, documents_per_engineer: int, previous: float = 85.0) -> DataFrame:
    by = issues.groupBy("engineer_id").agg(
        F.sum(penalty()).alias("penalty"), F.count_distinct("document_id").alias("documents_with_issues"), *[count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITY_WEIGHT])
    score = clamp(100 - F.col("penalty"), 0, 100)
    return by.select(
        "engineer_id", "penalty", "documents_with_issues", *[s.lower() for s in SEVERITY_WEIGHT], score.cast("long").alias("score"), trend(score - previous, 5).alias("trend"),
        round_half_up(ratio(F.col("documents_with_issues"), F.lit(documents_per_engineer)), 2).alias("issue_rate"))


def issues_by_type(issues: DataFrame, *by: str) -> DataFrame:
    n = issues.groupBy(*by, "issue_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", round_half_up(F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))), 2))


def recurring_issues(issues: DataFrame, as_of: str, k: int = 5) -> DataFrame:
    g = issues.groupBy("engineer_id", "issue_type", "field_name").agg(F.count("*").alias("n"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at")).filter("n >= 2")
    top = top_per_group(g, ["engineer_id"], [F.desc("n"), F.col("issue_type"), F.col("field_name")], k)
    return top.select("engineer_id", F.col("rank").cast("long").alias("rank"), "issue_type", "field_name", "n", F.to_date("first_at").cast("string").alias("first_on"), F.to_date("last_at").cast("string").alias("last_on"),
                      (F.col("last_at") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 30 DAYS")).alias("is_recent"))


def issue_fix_packs(issues: DataFrame, examples: int = 3) -> DataFrame:
    key = ["engineer_id", "issue_type", "field_name"]
    last = top_per_group(issues, key, [F.desc("occurred_at"), F.col("issue_id")], examples).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "document_id"))).alias("_e"))
    return issues.groupBy(*key).agg(F.count("*").alias("n"), F.min("severity").alias("worst")).join(last, key).select(
        *key, "n", "worst", F.array_join(F.transform("_e", lambda e: e["document_id"].cast("string")), ",").alias("examples"))


def focus_areas(issues: DataFrame, k: int = 3) -> DataFrame:
    g = issues.groupBy("engineer_id", "issue_type", "field_name").agg(F.count("*").alias("n"), F.min("severity").alias("worst"))
    top = top_per_group(g, ["engineer_id"], [F.col("worst"), F.desc("n"), F.col("issue_type"), F.col("field_name")], k)
    return top.groupBy("engineer_id").agg(F.array_join(F.array_sort(F.collect_set("issue_type")), ",").alias("focus_areas"))


def trend_series(issues: DataFrame, processed: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """Half-open buckets of so many days from ``start``, without gaps up to ``end``."""
    s, step = F.lit(start).cast("timestamp"), days * 86400
    bucket = lambda c: F.floor((F.unix_timestamp(c) - F.unix_timestamp(s)) / step)
    spark = issues.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.unix_timestamp(F.lit(end).cast("timestamp")) - F.unix_timestamp(s)) / step))).alias("bucket"))
    d = processed.withColumn("bucket", bucket(F.col("processed_at"))).groupBy("bucket").agg(F.count("*").alias("documents"))
    i = issues.withColumn("bucket", bucket(F.col("occurred_at"))).groupBy("bucket").agg(F.count("*").alias("issues"))
    docs, n = F.coalesce("documents", F.lit(0)), F.coalesce("issues", F.lit(0))
    score = F.when(docs > 0, F.greatest(F.lit(0.0), 100 - n / docs * 20)).otherwise(100.0)
    return spine.join(d, "bucket", "left").join(i, "bucket", "left").select(
        "bucket", F.date_add(F.to_date(s), (F.col("bucket") * days).cast("int")).cast("string").alias("date"), docs.alias("documents"), n.alias("issues"),
        round_half_up(ratio(n, docs), 2).alias("issue_rate"), round_half_up(score).cast("long").alias("avg_score"))


def overall_trend(series: DataFrame) -> DataFrame:
    """Mean score of the second half of an ordered series against the first; the halves part at floor(n / 2)."""
    w = Window.partitionBy(F.lit(0))
    s = series.withColumn("_r", F.row_number().over(w.orderBy("bucket"))).withColumn("_first", F.col("_r") <= F.floor(F.count("*").over(w) / 2))
    a = s.agg(F.avg(F.when(F.col("_first"), F.col("avg_score"))).alias("a"), F.avg(F.when(~F.col("_first"), F.col("avg_score"))).alias("b"))
    change = F.when(F.col("a") > 0, round_half_up((F.col("b") - F.col("a")) / F.col("a") * 100)).otherwise(0.0).cast("long")
    return a.select(change.alias("change_percent"), trend(change, 5).alias("direction"))


def issue_type_trends(issues: DataFrame, start: str, end: str) -> DataFrame:
    """Counts before and after the middle of a period, over all issues: a row for each of the eight types, also those that don't occur."""
    mid = F.timestamp_millis(((F.unix_millis(F.lit(start).cast("timestamp")) + F.unix_millis(F.lit(end).cast("timestamp"))) / 2).cast("long"))
    g = issues.groupBy("issue_type").agg(count_if(F.col("occurred_at") < mid).alias("previous"), count_if(F.col("occurred_at") >= mid).alias("current"))
    types = issues.sparkSession.createDataFrame([(t,) for t in ISSUE_TYPES], "issue_type string")
    g = types.join(g, "issue_type", "left").na.fill(0, ["previous", "current"])
    change = F.when(F.col("previous") > 0, round_half_up((F.col("current") - F.col("previous")) / F.col("previous") * 100)).when(F.col("current") > 0, 100.0).otherwise(0.0).cast("long")
    return g.select("issue_type", "previous", "current", change.alias("change_percent"), trend(change, 10, "increasing", "decreasing").alias("trend"))


def coaching(issues: DataFrame, as_of: str) -> DataFrame:
    """Recommendations by rule: critical issues, recent recurring ones, missing signatures."""
    n = issues.groupBy("engineer_id").agg(count_if(F.col("severity") == "S0").alias("_s0"), count_if(F.col("issue_type") == "SIGNATURE_MISSING").alias("_sig"))
    rec = recurring_issues(issues, as_of).filter("is_recent").groupBy("engineer_id").agg(F.count("*").alias("_rec"))
    j = n.join(rec, "engineer_id", "left")
    rules = F.array(
        F.when(F.col("_s0") > 0, F.struct(F.lit("high").alias("priority"), F.lit("Address Critical Quality Issues").alias("title"))),
        F.when(F.coalesce("_rec", F.lit(0)) > 0, F.struct(F.lit("medium").alias("priority"), F.lit("Address Recurring Issue Patterns").alias("title"))),
        F.when(F.col("_sig") >= 2, F.struct(F.lit("medium").alias("priority"), F.lit("Improve Signature Collection Process").alias("title"))))
    return j.select("engineer_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("engineer_id", "r.priority", "r.title")


def prioritised_packs(issues: DataFrame, *by: str, severity: str = "severity", reason: str = "issue_type") -> DataFrame:
    """(by, total_issues, critical, severities, reasons, estimated_impact, priority) of each target: counts as maps.

    More than five issues of S0 or S1 are critical, more than two high. Counts are combined by
    target, severity and reason before they meet, so a target of very many issues is no group.
    """
    n = issues.groupBy(*by, severity, reason).agg(F.count("*").alias("n"))
    each = lambda c: F.aggregate(F.collect_list(F.struct(F.col(c).alias("k"), "n")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], F.coalesce(F.element_at(m, x["k"]), F.lit(0)) + x["n"])))
    g = n.filter(F.col(severity).isNotNull() & F.col(reason).isNotNull()).groupBy(*by).agg(
        F.sum("n").alias("total_issues"), F.sum(F.when(F.col(severity).isin("S0", "S1"), F.col("n")).otherwise(0)).alias("critical"), each(severity).alias("severities"), each(reason).alias("reasons"))
    return g.withColumn("estimated_impact", F.col("total_issues") * 0.5).withColumn("priority", F.when(F.col("critical") > 5, "critical").when(F.col("critical") > 2, "high").otherwise("medium"))


def by_category(packs: DataFrame) -> DataFrame:
    return packs.orderBy(rank_of(F.col("category"), CATEGORIES), F.desc("occurrences"), "reason_code")
