"""Golden against actual, baselines, evaluation, drift, fusion, calibration and rule validation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, grade, lookup, r6, ratio, round_half_up
from ..sources.tables import REASON_CODES, SEVERITIES

# Older reason codes and what they are now called.
LEGACY_CODES = {"OUT_OF_RANGE": "OUT_OF_POLICY", "RANGE_ERROR": "OUT_OF_POLICY", "POLICY_VIOLATION": "OUT_OF_POLICY"}


def canonical_reason(code: Column, default: str = "OUT_OF_POLICY") -> Column:
    return F.when(code.isin(*REASON_CODES), code).otherwise(lookup(code, LEGACY_CODES, default))


# --- parity -------------------------------------------------------------------------------


def compare_fields(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """Each rule of each document on either side: missing, new, same, improved or worse, and what changed.

    Documents that the actual side lacks have only missing rules; ones that the golden side
    lacks are not compared. ``document_found`` says whether the actual side has the document.
    Both sides are joined in full by their rules, and a window over a document tells which
    sides have it, so each side is read once.
    """
    key, cols = ["doc_id", "rule_id"], ["status", "value", "confidence", "severity", "reason_code"]
    g = golden.select(*key, *[F.col(c).alias(f"g_{c}") for c in cols], F.lit(True).alias("_g"))
    a = actual.select(*key, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("_a"))
    document = Window.partitionBy("doc_id")
    j = g.join(a, key, "full_outer").withColumns({"_known": F.bool_or("_g").over(document), "document_found": F.coalesce(F.bool_or("_a").over(document), F.lit(False))}).filter("_known")
    up = ((F.col("g_status") == "failed") & (F.col("a_status") == "passed")) | (F.col("a_confidence") > F.col("g_confidence"))
    down = ((F.col("g_status") == "passed") & (F.col("a_status") == "failed")) | (F.col("a_confidence") < F.col("g_confidence"))
    verdict = F.when(F.col("_a").isNull(), "missing").when(F.col("_g").isNull(), "new").when(up, "improved").when(down, "worse").otherwise("same")
    changed = [(~F.col(f"g_{c}").eqNullSafe(F.col(f"a_{c}")) & F.col("_g") & F.col("_a")).alias(f"{c}_changed") for c in ("status", "value", "severity", "reason_code")]
    return j.select(*key, verdict.alias("verdict"), *[F.coalesce(c, F.lit(False)).alias(n) for c, n in zip(changed, ("status_changed", "value_changed", "severity_changed", "reason_code_changed"), strict=True)], "document_found")


VERDICTS = ("same", "improved", "worse", "new", "missing")


def compare_documents(fields: DataFrame) -> DataFrame:
    """One verdict per golden document from its rules'."""
    g = fields.groupBy("doc_id").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS], F.bool_or("document_found").alias("_there"))
    status = F.when(~F.col("_there"), "missing").when((F.col("worse") > 0) | (F.col("missing") > 0), "worse").when(F.col("improved") > 0, "improved").otherwise("same")
    return g.select("doc_id", *VERDICTS, status.alias("status"))


def parity_summary(documents: DataFrame) -> DataFrame:
    return documents.agg(
        F.count("*").alias("documents"), *[F.count_if(F.col("status") == s).alias(f"documents_{s}") for s in ("same", "improved")], F.count_if(F.col("status").isin("worse", "missing")).alias("documents_worse"),
        F.sum(reduce(lambda a, v: a + F.col(v), VERDICTS, F.lit(0))).alias("fields"), F.sum("same").alias("fields_same"), F.sum("improved").alias("fields_improved"), F.sum(F.col("worse") + F.col("missing")).alias("fields_worse"))


def threshold_violations(summary: DataFrame, most_worse_documents: int = 0, most_worse_fields: int = 0, least_same_percent: float = 100.0) -> DataFrame:
    same = F.when(F.col("fields") > 0, F.col("fields_same") / F.col("fields") * 100).otherwise(100.0)
    v = F.array(
        F.when(F.col("documents_worse") > most_worse_documents, "worse documents"), F.when(F.col("fields_worse") > most_worse_fields, "worse fields"), F.when(same < least_same_percent, "same percentage"))
    return summary.select(F.explode(F.filter(v, lambda x: x.isNotNull())).alias("violation"))


def compare_failures(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected failures matched or missed on rule, field and reason; unexpected ones on the weaker key of rule and field.

    Each side gives a row per key, the two are stacked, and windows over the weaker key, in
    one shuffle, tell what stands on the other side; each side is read once. Repeated rows
    of a side are rows of their own. Null parts of a key match nothing.
    """
    weak = ["doc_id", "rule_id", "field"]
    found = actual.filter("status = 'failed'").select(*weak, canonical_reason(F.coalesce("reason_code", F.lit("OUT_OF_POLICY"))).alias("reason_code"), F.lit(False).alias("_e"))
    both = expected.select(*weak, "reason_code", F.lit(True).alias("_e")).unionByName(found)
    by_reason, by_field = Window.partitionBy(*weak, "reason_code"), Window.partitionBy(*weak)
    whole = reduce(lambda a, c: a & F.col(c).isNotNull(), weak, F.lit(True))
    seen = both.repartition(*weak).withColumns({"_f": F.bool_or(~F.col("_e")).over(by_reason) & whole & F.col("reason_code").isNotNull(), "_x": F.bool_or("_e").over(by_field) & whole})
    kind = F.when(F.col("_e") & F.col("_f"), "matched").when(F.col("_e"), "missed").when(~F.col("_x"), "unexpected")
    return seen.select(*weak, kind.alias("kind")).filter("kind IS NOT NULL")


def baseline_gate(baseline: DataFrame, current: DataFrame, key: str, band: float = 0.1) -> DataFrame:
    """Pass rates of each key on both sides: ``baseline(key, passed, total)``, ``current(key, passed, total)``; absent sides are new or removed."""
    side = lambda df, p: df.select(key, F.col("passed").alias(f"{p}_passed"), F.col("total").alias(f"{p}_total"))
    j = side(baseline, "b").join(side(current, "c"), key, "full_outer")
    rate = lambda p: r6(ratio(F.coalesce(f"{p}_passed", F.lit(0)), F.coalesce(f"{p}_total", F.lit(0))) * 100)
    d = j.withColumn("baseline_rate", rate("b")).withColumn("current_rate", rate("c")).withColumn("delta", r6(F.col("current_rate") - F.col("baseline_rate")))
    status = F.when(F.col("b_total").isNull(), "new").when(F.col("c_total").isNull(), "removed").when(F.col("delta") > band, "improved").when(F.col("delta") < -band, "regressed").otherwise("unchanged")
    return d.select(key, "baseline_rate", "current_rate", "delta", status.alias("status"))


def document_rates(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, status, pass_rate) of each document from its fields: ``pass`` if all passed, the rate in percent."""
    g = fields.groupBy(key).agg(F.count_if(F.col("status") == "passed").alias("_p"), F.count("*").alias("_n"))
    return g.select(key, F.when(F.col("_p") == F.col("_n"), "pass").otherwise("fail").alias("status"), r6(F.col("_p") / F.col("_n") * 100).alias("pass_rate"))


def baseline_documents(baseline: DataFrame, current: DataFrame, key: str = "doc_id", band: float = 0.1) -> DataFrame:
    """Documents of two reports ``(key, status, pass_rate)``: ones that are gone have regressed, ones without a baseline are new."""
    side = lambda df, p: df.select(key, F.col("status").alias(f"{p}_status"), F.col("pass_rate").alias(f"{p}_rate"), F.lit(True).alias(f"_{p}"))
    j = side(baseline, "baseline").join(side(current, "current"), key, "full_outer")
    delta = r6(F.coalesce("current_rate", F.lit(0.0)) - F.coalesce("baseline_rate", F.lit(0.0)))
    status = F.when(F.col("_baseline").isNull(), "new").when(F.col("_current").isNull(), "regressed").when(delta > band, "improved").when(delta < -band, "regressed").otherwise("same")
    return j.select(key, F.when(F.col("_baseline").isNull(), "N/A").otherwise(F.col("baseline_status")).alias("baseline_status"), F.when(F.col("_current").isNull(), "removed").otherwise(F.col("current_status")).alias("current_status"),
                    F.coalesce("baseline_rate", F.lit(0.0)).alias("baseline_rate"), F.coalesce("current_rate", F.lit(0.0)).alias("current_rate"), delta.alias("delta"), status.alias("status"))


_VIOLATION = "kind string, severity string, value double, least double"


def baseline_violations(pass_rate: float | DataFrame, severities: DataFrame, documents: DataFrame, thresholds: Mapping) -> DataFrame:
    """(kind, severity, value, least): what breaks the thresholds ``{overall: {minPassRate, maxWorseCount}, bySeverity: {S0: {minPassRate}}}``.

    ``pass_rate`` is the current one in percent, or a table of one row with it; ``severities``
    come from ``baseline_gate``, ``documents`` from ``baseline_documents``. For regressions,
    ``least`` is how many are allowed.
    """
    spark, overall = documents.sparkSession, thresholds["overall"]
    rate = pass_rate if isinstance(pass_rate, DataFrame) else spark.createDataFrame([(float(pass_rate),)], "pass_rate double")
    row = lambda kind, severity, value, least: [F.lit(kind).alias("kind"), severity.cast("string").alias("severity"), r6(value).alias("value"), least.cast("double").alias("least")]
    low = rate.select(*row("overall", F.lit(None), F.col("pass_rate"), F.lit(overall["minPassRate"] * 100))).filter("value < least")
    worse = documents.agg(F.count_if(F.col("status") == "regressed").alias("n")).select(*row("regressions", F.lit(None), F.col("n"), F.lit(overall["maxWorseCount"]))).filter("value > least")
    limits = {s: float(t["minPassRate"]) * 100 for s, t in thresholds.get("bySeverity", {}).items()}
    if not limits:
        return low.unionByName(worse)
    least = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("severity")]
    return low.unionByName(worse).unionByName(severities.select(*row("severity", F.col("severity"), F.col("current_rate"), least)).filter("value < least"))


# Names of severities of older reports.
LEGACY_SEVERITIES = ("critical", "high", "medium", "low", "major", "minor", "info")


def unusual_severities(by_severity: DataFrame) -> DataFrame:
    """(kind, severity, value, least): severities that aren't canonical; if there are legacy ones, only these are told."""
    legacy = F.lower("severity").isin(*LEGACY_SEVERITIES)
    odd = by_severity.filter(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))).select("severity", F.coalesce(legacy, F.lit(False)).alias("_old"))
    any_old = odd.agg(F.coalesce(F.bool_or("_old"), F.lit(False)).alias("_any"))
    return odd.join(F.broadcast(any_old), F.col("_old") | ~F.col("_any")).select(  # one row
        F.when(F.col("_old"), "legacy_severity").otherwise("unusual_severity").alias("kind"), "severity", F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("least"))


# --- evaluation and drift -----------------------------------------------------------------

# Metric, mode (a rate, or a drop from the baseline), warning, critical, default baseline.
DRIFT = (
    ("ambiguity_rate", "rate", 0.10, 0.20, 0.0), ("token_collision_rate", "rate", 0.05, 0.15, 0.0), ("override_rate", "rate", 0.15, 0.30, 0.0), ("scan_quality", "drop", 0.05, 0.10, 0.95),
    ("selection_accuracy", "drop", 0.03, 0.05, 0.95), ("field_accuracy", "drop", 0.05, 0.10, 0.92), ("fusion_disagreement_rate", "rate", 0.15, 0.25, 0.12), ("pass2_rate", "rate", 0.20, 0.35, 0.10))


def drift_alerts(metrics: DataFrame, thresholds: Sequence[tuple] = DRIFT) -> DataFrame:
    """``metrics(metric, value, baseline)`` against warning and critical thresholds; rows below both give no alert."""
    t = metrics.sparkSession.createDataFrame(list(thresholds), "metric string, mode string, warning double, critical double, default_baseline double")
    j = metrics.join(F.broadcast(t), "metric").withColumn("baseline", F.coalesce("baseline", "default_baseline"))
    measure = r6(F.when(F.col("mode") == "drop", F.col("baseline") - F.col("value")).otherwise(F.col("value")))
    severity = F.when(measure >= F.col("critical"), "critical").when(measure >= F.col("warning"), "warning")
    return j.select("metric", r6(F.col("value")).alias("value"), r6(F.col("baseline")).alias("baseline"), r6(F.col("value") - F.col("baseline")).alias("deviation"), severity.alias("severity")).filter("severity IS NOT NULL")


def drift_report(alerts: DataFrame) -> DataFrame:
    """One row: how many alerts, critical ones and warnings, the metrics they are about, and whether something must be done at once."""
    return alerts.agg(F.count("*").alias("alerts"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warnings"),
                      F.array_sort(F.collect_set("metric")).alias("categories")).withColumn("requires_action", F.col("critical") > 0)


def overall_score(selection: Column, critical: Column, fusion: Column, pass2_rate: Column, weights: Sequence[float] = (0.30, 0.40, 0.20, 0.10)) -> Column:
    return selection * weights[0] + critical * weights[1] + fusion * weights[2] + (1 - pass2_rate) * weights[3]


def precision_recall(matches: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per case: exact and fuzzy matches count 1, partial ones a half; extra fields are false positives, missing ones false negatives."""
    hit = F.sum(F.when(F.col("match").isin("exact", "fuzzy"), 1.0).when(F.col("match") == "partial", 0.5).otherwise(0.0))
    n = lambda m: F.count_if(F.col("match") == m)
    g = matches.groupBy(*key).agg(hit.alias("_tp"), n("extra").alias("_fp"), n("missing").alias("_fn"))
    p, r = ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")), ratio(F.col("_tp"), F.col("_tp") + F.col("_fn"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return g.withColumn("precision", p).withColumn("recall", r).withColumn("f1", round_half_up(f1, 2)).select(*key, round_half_up(F.col("precision"), 2).alias("precision"), round_half_up(F.col("recall"), 2).alias("recall"), "f1")


# --- fusion and calibration ---------------------------------------------------------------


def fuse(ocr_present: Column, ocr_conf: Column, qa_present: Column, qa_conf: Column) -> tuple[Column, Column]:
    """(outcome, confidence) of two detectors; a null presence means the detector has no result."""
    high, differ = (ocr_conf >= 0.8) & (qa_conf >= 0.85), ocr_present != qa_present
    mean = (ocr_conf + qa_conf) / 2
    valid = lambda c: F.when(c >= 0.7, "VALID").otherwise("LOW_CONFIDENCE")
    outcome = (
        F.when(ocr_present.isNull() & qa_present.isNull(), "MISSING_FIELD").when(qa_present.isNull(), valid(ocr_conf)).when(ocr_present.isNull(), valid(qa_conf))
        .when(differ & high, "CONFLICT").when(differ & ((ocr_conf >= 0.8) | (qa_conf >= 0.85)), "LOW_CONFIDENCE").when(differ, "CONFLICT")
        .when(high, "VALID").when((ocr_conf < 0.6) | (qa_conf < 0.65), "LOW_CONFIDENCE").otherwise(valid(mean)))
    conf = (
        F.when(ocr_present.isNull() & qa_present.isNull(), 0.0).when(qa_present.isNull(), ocr_conf).when(ocr_present.isNull(), qa_conf)
        .when(differ & high, F.least(ocr_conf, qa_conf)).when(differ & (ocr_conf >= 0.8), ocr_conf * 0.7).when(differ & (qa_conf >= 0.85), qa_conf * 0.7).when(differ, F.greatest(ocr_conf, qa_conf) * 0.5)
        .when(high, F.least(F.lit(1.0), mean * 1.1)).otherwise(mean))
    return outcome, conf


def calibrate(fields: DataFrame, profile: DataFrame) -> DataFrame:
    """Confidence less 20 for a method that isn't allowed, 30 for a value off its pattern, 15 for a critical field off its region; accepted, to review, or neither."""
    j = fields.join(profile, "field_id")
    cut = lambda c, cond, n: F.when(cond, F.greatest(F.lit(0.0), c - n)).otherwise(c)
    c = cut(F.col("confidence"), ~F.array_contains("allowed_methods", F.col("source")), 20)
    c = cut(c, F.coalesce(F.col("pattern").isNotNull() & (F.col("value") != "") & ~F.regexp_like(F.col("value"), F.col("pattern")), F.lit(False)), 30)
    c = cut(c, F.col("is_critical") & ~F.coalesce("roi_match", F.lit(True)), 15)
    j = j.withColumn("adjusted", c)
    accepted = (F.col("adjusted") >= F.col("min_confidence")) & F.col("extracted")
    return j.withColumn("accepted", accepted).withColumn("needs_review", ~accepted & (F.col("adjusted") >= F.col("review_threshold")))


def extraction_quality(calibrated: DataFrame, key: str, least: float = 70.0) -> DataFrame:
    """Mean adjusted confidence with missing fields counted as 0, its grade, anomalies and the quality gate."""
    missing = ~F.col("extracted")
    g = calibrated.groupBy(key).agg(
        round_half_up(F.sum(F.when(missing, 0.0).otherwise(F.col("adjusted"))) / F.count("*")).cast("long").alias("score"), F.count_if(missing & F.col("is_critical")).alias("missing_critical"),
        F.count_if(~missing & (F.col("adjusted") < F.col("review_threshold"))).alias("low_confidence"))
    anomaly = (F.col("missing_critical") > 1) | (F.col("score") < 50) | (F.col("low_confidence") > 3)
    return g.withColumn("grade", grade(F.col("score"), ((90, "A"), (80, "B"), (70, "C"), (50, "D")))).withColumn("anomaly", anomaly).withColumn("passed", (F.col("score") >= least) & (F.col("missing_critical") == 0) & ~anomaly)


def anomaly_score(share_missing: Column, mean_confidence: Column, variance: Column) -> Column:
    """Mean of the factors that apply: critical fields missing, a low mean, a high variance."""
    parts = [(F.lit(True), share_missing), (mean_confidence < 50, (50 - mean_confidence) / 50), (variance > 400, F.least(F.lit(1.0), variance / 1000))]
    total = reduce(lambda a, p: a + F.when(p[0], p[1]).otherwise(0.0), parts, F.lit(0.0))
    return total / reduce(lambda a, p: a + F.when(p[0], 1).otherwise(0), parts, F.lit(0))


# --- rules --------------------------------------------------------------------------------

#: Validators by name: each makes a predicate of a value and a parameter.
VALIDATORS: dict[str, Callable[[Column, Column], Column]] = {
    "minLength": lambda v, p: F.length(v) >= F.coalesce(p.try_cast("int"), F.lit(0)),
    "maxLength": lambda v, p: F.length(v) <= F.coalesce(p.try_cast("int"), F.lit(0)),
    "notEmpty": lambda v, p: v != "",
}


def register_validator(name: str, predicate: Callable[[Column, Column], Column]) -> None:
    """Add a validator, as a builder of a boolean Column."""
    VALIDATORS[name] = predicate


def validate_rules(rules: DataFrame, fields: DataFrame, most_rules: int = 10_000) -> DataFrame:
    """The status of each rule on each document: passed, failed, skipped or error.

    ``rules(rule_id, field, type, pattern, min, max, validator, enabled, severity)`` is a
    small dimension; ``fields(doc_id, field, value)``. Rules meet every document: they are
    exploded from one broadcast row, and fields join on document and field. More than
    ``most_rules`` rules, which that row is not meant for, are an error.
    """
    cols = ["rule_id", "field", "type", "pattern", "min", "max", "validator", "enabled", "severity"]
    packed = rules.limit(most_rules + 1).agg(F.collect_list(F.struct(*cols)).alias("_rules")).select(
        F.when(F.size("_rules") > most_rules, F.raise_error(F.lit(f"more than {most_rules} rules"))).otherwise(F.col("_rules")).alias("_rules"))
    every = fields.select("doc_id").distinct().crossJoin(F.broadcast(packed)).select("doc_id", F.explode("_rules").alias("r")).select("doc_id", "r.*")
    j = every.join(fields.select("doc_id", "field", "value"), ["doc_id", "field"], "left")
    v, number = F.col("value"), F.col("value").try_cast("double")
    name, param = F.substring_index("validator", ":", 1), F.nullif(F.regexp_extract("validator", "^[^:]*:(.*)$", 1), F.lit(""))
    known = F.lit(False)
    custom = F.lit("error")
    for n, f in VALIDATORS.items():
        custom = F.when(name == n, F.when(f(v, param), "passed").otherwise("failed")).otherwise(custom)
        known = known | (name == n)
    ok = lambda c: F.when(c, "passed").otherwise("failed")
    within = number.isNotNull() & (F.col("min").isNull() | (number >= F.col("min"))) & (F.col("max").isNull() | (number <= F.col("max")))
    status = (
        F.when(~F.col("enabled"), "skipped").when(v.isNull(), F.when(F.col("type") == "required", "failed").otherwise("skipped"))
        .when(F.col("type") == "required", ok(F.trim(v) != "")).when(F.col("type").isin("format", "pattern"), F.when(F.col("pattern").isNull(), "passed").otherwise(ok(F.regexp_like(v, F.col("pattern")))))
        .when(F.col("type") == "range", F.when(F.col("min").isNull() & F.col("max").isNull(), "passed").otherwise(ok(within)))
        .when(F.col("type") == "custom", F.when(F.col("validator").isNull(), "passed").otherwise(custom)).otherwise("passed"))
    return j.select("doc_id", "rule_id", "field", "severity", status.alias("status"))


def validation_summary(results: DataFrame) -> DataFrame:
    """Counts per document; it passes without a failed or broken rule of severity critical or major."""
    bad = F.col("status").isin("failed", "error")
    return results.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(bad).alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        *[F.count_if(bad & (F.col("severity") == s)).alias(f"failed_{s}") for s in ("critical", "major", "minor", "info")], (F.count_if(bad & F.col("severity").isin("critical", "major")) == 0).alias("ok"))


def reconcile(original: DataFrame, again: DataFrame, key: Sequence[str]) -> DataFrame:
    """A second reading's value where it succeeded with strictly more confidence."""
    a = again.select(*key, F.col("value").alias("_v"), F.col("confidence").alias("_c"), "success")
    better = F.coalesce(F.col("success") & (F.col("_c") > F.col("confidence")), F.lit(False))
    return original.join(a, list(key), "left").select(*key, F.when(better, F.col("_v")).otherwise(F.col("value")).alias("value"), F.when(better, F.col("_c")).otherwise(F.col("confidence")).alias("confidence"),
                                                      F.when(better, "improved").when(F.col("success"), "unchanged").when(F.col("success").isNull(), "kept").otherwise("failed").alias("outcome"))


def reconciliation_summary(reconciled: DataFrame, threshold: Column, *by: str) -> DataFrame:
    """Fields in all, improved, unchanged (also those not read again) and failed, the mean confidence (two decimals, 0 of none), and how many stay below their threshold.

    A second reading that isn't surer has failed, whether it found something or not.
    """
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return reconciled.groupBy(*by).agg(
        F.count("*").alias("fields"), n("improved").alias("improved"), n("kept").alias("unchanged"), n("failed", "unchanged").alias("failed"), round_half_up(F.coalesce(F.avg("confidence"), F.lit(0.0)), 2).alias("average_confidence"),
        F.count_if(F.col("confidence") < threshold).alias("low_confidence"))


# What a report that someone must read holds.
URGENT = r"(?i)\b(?:safety|hazard|incident)\b"


def escalate(confidence: Column, text: Column, urgent: Column, pattern: str = URGENT, least: float = 0.70) -> Column:
    return F.when(urgent, "urgent").when(text.rlike(pattern), "pattern").when(confidence < least, "low_confidence").otherwise("none")


def report_status(waived: Column, failed: Column, review: Column) -> Column:
    return F.when(failed & waived, "WAIVED").when(failed, "FAIL").when(review, "REVIEW_QUEUE").otherwise("PASS")


def problems(checks: Mapping[str, Column]) -> Column:
    """The names of the checks that a row fails, in order: for activation gates and pack validation."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]), lambda x: x.isNotNull())


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def boosted_confidence(best: Column, votes: Column) -> Column:
    return clamp(best + F.least(10 * (votes - 1), F.lit(15)), 0, 100)
