"""Jobs over a user's own JSON and tables: parity, baseline, drift, personal data, determinism and run states.

Each gives what it found as a table and whether that breaks the gate; ``cli`` turns the
second into an exit code.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import comparison as C
from .operators import nested as N
from .operators import review as V
from .sources import files, tables
from .streaming import runs


def _read_text(spark: SparkSession, path: str) -> str:
    """A small JSON file of settings, from any file system that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def parity(spark: SparkSession, golden: str, actual: str, mode: str = "full", most_worse_documents: int = 0, most_worse_fields: int = 0, least_same_percent: float = 100.0) -> tuple[DataFrame, bool]:
    """(suite, doc_id, rule_id, field, result) of every document that counts, and whether a suite fails.

    The positive suite compares the fields of golden documents that are to pass; it fails by
    the thresholds. The negative suite looks for the expected failures of those that are to
    fail, and fails if one is missed; further failures are told as ``unexpected``.
    """
    found, fails = [], False
    if mode in ("positive", "full"):
        fields = C.compare_fields(files.golden_fields(spark, golden, "pass"), files.golden_fields(spark, actual)).checkpoint()
        summary = C.parity_summary(C.compare_documents(fields))
        fails |= not C.threshold_violations(summary, most_worse_documents, most_worse_fields, least_same_percent).isEmpty()
        found.append(fields.select(F.lit("positive").alias("suite"), "doc_id", "rule_id", F.lit(None).cast("string").alias("field"), F.col("verdict").alias("result")))
    if mode in ("negative", "full"):
        wanted = files.golden_failures(spark, golden)
        known = files.golden_documents(spark, golden).filter("expected = 'fail'").select("doc_id")
        failures = C.compare_failures(wanted, files.golden_fields(spark, actual).join(known, "doc_id", "left_semi")).checkpoint()
        fails |= not failures.filter("kind = 'missed'").isEmpty()
        found.append(failures.select(F.lit("negative").alias("suite"), "doc_id", "rule_id", "field", F.col("kind").alias("result")))
    if not found:
        raise ValueError(f"no such mode: {mode}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, fails


def _rates(spark: SparkSession, path: str, at: str) -> tuple[DataFrame, DataFrame, dict]:
    """A stored report's pass rates by severity, its documents, and its own numbers; severities are whatever members it has."""
    report = json.loads(_read_text(spark, path))
    numbers = report
    for part in at.split("."):
        numbers = numbers[part] if part else numbers
    by = [(k, int(x.get("passed", 0)), int(x.get("total", 0))) for k, x in numbers.get("bySeverity", {}).items()]
    docs = files.read_json(spark, path, "docResults ARRAY<STRUCT<id: STRING, name: STRING, status: STRING, passRate: DOUBLE>>").select(F.explode("docResults").alias("d")).select(
        F.col("d.id").alias("doc_id"), F.col("d.status").alias("status"), F.col("d.passRate").alias("pass_rate"))
    return spark.createDataFrame(by, "severity string, passed bigint, total bigint"), docs, {**report, **numbers}


def baseline(spark: SparkSession, stored: str, report: str, thresholds: str, strict: bool = False) -> tuple[DataFrame, bool]:
    """(part, name, baseline, current, delta, status) of a report against a stored baseline, and whether it fails.

    ``part`` is severity, document, version or violation. Severities must be canonical on both
    sides, and with ``strict`` the versions of dataset and thresholds equal; a report that
    isn't so fails.
    """
    by_b, docs_b, b = _rates(spark, stored, "metrics")
    by_c, docs_c, c = _rates(spark, report, "")
    limits: Mapping = json.loads(_read_text(spark, thresholds))["thresholds"]
    severities = C.baseline_gate(by_b, by_c, "severity")
    documents = C.baseline_documents(docs_b, docs_c).checkpoint()
    bad = C.baseline_violations(float(c["passRate"]), severities, documents, limits)
    bad = bad.unionByName(C.unusual_severities(by_b)).unionByName(C.unusual_severities(by_c))
    versions = [(n, str(b.get("sourceReport", {}).get(n)), str(c.get(n))) for n in ("datasetVersion", "thresholdVersion")]
    versions = [(n, x, y, "differs") for n, x, y in versions if x != y]
    text = lambda x: F.col(x).cast("string").alias(x)
    out = severities.select(F.lit("severity").alias("part"), F.col("severity").alias("name"), F.col("baseline_rate").cast("string").alias("baseline"), F.col("current_rate").cast("string").alias("current"), text("delta"), "status")
    out = out.unionByName(documents.select(F.lit("document").alias("part"), F.col("doc_id").alias("name"), F.col("baseline_rate").cast("string").alias("baseline"), F.col("current_rate").cast("string").alias("current"), text("delta"), "status"))
    bad = bad.select(F.lit("violation").alias("part"), F.col("kind").alias("name"), F.col("least").cast("string").alias("baseline"), F.col("value").cast("string").alias("current"), F.col("severity").alias("delta"), F.lit("failed").alias("status")).checkpoint()
    told = spark.createDataFrame([("version", n, x, y, None, s) for n, x, y, s in versions], "part string, name string, baseline string, current string, delta string, status string")
    return out.unionByName(told).unionByName(bad), not bad.isEmpty() or bool(strict and versions)


def drift(spark: SparkSession, metrics: str, stored: str | None = None) -> tuple[DataFrame, bool]:
    """Alerts of ``metrics``, a JSON object of numbers, against a stored report's or the default baselines; critical ones fail.

    The last row, ``summary``, counts critical alerts, warnings and categories.
    """
    names = {m: d for m, _, _, _, d in C.DRIFT}
    values = json.loads(_read_text(spark, metrics))
    now = spark.createDataFrame([(m, float(values[m])) for m in names if values.get(m) is not None], "metric string, value double")
    base = files.baseline_or_defaults(spark, stored, names) if stored else spark.createDataFrame(list(names.items()), "metric string, baseline double")
    alerts = C.drift_alerts(now.join(base, "metric", "left")).checkpoint()
    report = C.drift_report(alerts)
    return alerts.select("metric", "severity", F.col("value").cast("string").alias("value"), F.col("baseline").cast("string").alias("baseline"), F.col("deviation").cast("string").alias("detail")).unionByName(
        report.select(F.lit("summary").alias("metric"), F.when(F.col("critical") > 0, "critical").when(F.col("warnings") > 0, "warning").otherwise("none").alias("severity"), F.col("alerts").cast("string").alias("value"),
                      F.col("critical").cast("string").alias("baseline"), F.array_join("categories", ",").alias("detail"))), not alerts.filter("severity = 'critical'").isEmpty()


def personal_data(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(file, path, pattern, match) of what looks like personal data in the strings of JSON files; any finding fails."""
    texts = spark.read.text(path, wholetext=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), F.col("value").alias("json"))
    found = N.personal_paths(texts, "json", ["file"], V.PERSONAL, V.ALLOWED).checkpoint()
    return found, not found.isEmpty()


def determinism(spark: SparkSession, folder: str) -> tuple[DataFrame, bool]:
    """(entity_type, input_hash, outputs) of inputs that gave different outputs, from the stored checksums; any fails."""
    found = tables.load(spark, folder, "determinism_checksums").groupBy("entity_type", "input_hash").agg(F.count_distinct("output_hash").alias("outputs")).filter("outputs > 1")
    return found, not found.isEmpty()


def transitions(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """Rejected events of a Parquet table (run_id, seq, state); any fails."""
    found = runs.histories(spark.read.parquet(path)).filter(~F.col("accepted"))
    return found, not found.isEmpty()
