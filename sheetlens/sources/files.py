"""Readers of JSON reports, packs and page text, and writers of exports."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import redact_export

FIELD = "ruleId STRING, field STRING, status STRING, value STRING, confidence DOUBLE, pageNumber INT, severity STRING, reasonCode STRING, message STRING"
GOLDEN = f"""version STRING, schemaVersion STRING, documents ARRAY<STRUCT<id STRING, name STRING, expectedResult STRING,
 validatedFields ARRAY<STRUCT<{FIELD.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE').replace(' INT', ': INT')}>>,
 findings ARRAY<STRUCT<id: STRING, ruleId: STRING, field: STRING, severity: STRING, reasonCode: STRING>>,
 expectedFailures ARRAY<STRUCT<ruleId: STRING, field: STRING, reasonCode: STRING, severity: STRING>>>>""".replace("id STRING,", "id: STRING,").replace("name STRING,", "name: STRING,").replace("expectedResult STRING", "expectedResult: STRING").replace("validatedFields ARRAY", "validatedFields: ARRAY").replace("findings ARRAY", "findings: ARRAY").replace("expectedFailures ARRAY", "expectedFailures: ARRAY")
PACK = """packVersion STRING, templates ARRAY<STRUCT<metadata: STRUCT<templateId: STRING, name: STRING, category: STRING>, version: STRING,
 specJson: STRUCT<name: STRING, version: STRING, fields: ARRAY<STRUCT<field: STRING, label: STRING, type: STRING, required: BOOLEAN>>>>>, _corrupt_record STRING"""


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One or more multi-line JSON objects of a declared schema; broken ones are kept in _corrupt_record if the schema has it."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def golden_fields(spark: SparkSession, path: str, expected: str | None = None) -> DataFrame:
    """(doc_id, rule_id, field, status, value, confidence, severity, reason_code, is_critical) of a golden dataset, by expected result if given."""
    d = read_json(spark, path, GOLDEN).select(F.explode("documents").alias("d"))
    if expected:
        d = d.filter(F.col("d.expectedResult") == expected)
    f = d.select(F.col("d.id").alias("doc_id"), F.explode("d.validatedFields").alias("f"))
    return f.select("doc_id", F.col("f.ruleId").alias("rule_id"), "f.field", "f.status", "f.value", "f.confidence", "f.severity", F.col("f.reasonCode").alias("reason_code"), F.col("f.severity").isin("S0", "S1").alias("is_critical"))


def golden_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, expected) of a golden dataset."""
    d = read_json(spark, path, GOLDEN).select(F.explode("documents").alias("d"))
    return d.select(F.col("d.id").alias("doc_id"), F.col("d.name").alias("name"), F.col("d.expectedResult").alias("expected"))


def _part(spark: SparkSession, path: str, part: str) -> DataFrame:
    d = read_json(spark, path, GOLDEN).select(F.explode("documents").alias("d"))
    return d.select(F.col("d.id").alias("doc_id"), F.explode(f"d.{part}").alias("x"))


def golden_failures(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, rule_id, field, reason_code, severity): the failures that documents of a golden dataset are expected to show."""
    return _part(spark, path, "expectedFailures").select("doc_id", F.col("x.ruleId").alias("rule_id"), "x.field", F.col("x.reasonCode").alias("reason_code"), "x.severity")


def golden_findings(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, finding_id, rule_id, field, severity, reason_code): the findings of a golden dataset's documents."""
    return _part(spark, path, "findings").select("doc_id", F.col("x.id").alias("finding_id"), F.col("x.ruleId").alias("rule_id"), "x.field", "x.severity", F.col("x.reasonCode").alias("reason_code"))


def baseline_or_defaults(spark: SparkSession, path: str, defaults: dict[str, float]) -> DataFrame:
    """(metric, baseline) of a stored report; members and reports that are missing get their defaults."""
    from pyspark.errors import AnalysisException

    want = spark.createDataFrame(list(defaults.items()), "metric string, _default double")
    try:
        row = read_json(spark, path, ", ".join(f"{k} DOUBLE" for k in defaults)).limit(1)
        have = row.unpivot([], list(defaults), "metric", "baseline")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = spark.createDataFrame([], "metric string, baseline double")
    return want.join(have, "metric", "left").select("metric", F.coalesce("baseline", "_default").alias("baseline"))


def import_pack(spark: SparkSession, path: str, known_slugs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) templates of packs: known slugs, missing members and broken files are rejected one by one."""
    pack = read_json(spark, path, PACK)
    t = pack.select("packVersion", "_corrupt_record", F.explode_outer("templates").alias("t"))
    slug = F.col("t.metadata.templateId")
    why = F.when(F.col("_corrupt_record").isNotNull(), "unreadable file").when(slug.isNull(), "no template id").when(~F.coalesce(F.col("t.version").rlike(r"^\d+\.\d+\.\d+$"), F.lit(False)), "version").when(F.coalesce(F.size("t.specJson.fields"), F.lit(0)) == 0, "no fields")
    checked = t.select(slug.alias("slug"), F.col("t.metadata.name").alias("name"), F.col("t.version").alias("version"), F.size("t.specJson.fields").alias("fields"), why.alias("error"))
    dup = known_slugs.select(F.col("slug"), F.lit("already known").alias("_dup")).distinct()
    all_ = checked.join(dup, "slug", "left").withColumn("error", F.coalesce("error", "_dup")).drop("_dup")
    return all_.filter("error IS NULL").drop("error"), all_.filter("error IS NOT NULL")


def pages_of_text(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_no, text): pages part at form feeds, blank ones are dropped, numbers keep their place."""
    return texts.select(key, F.posexplode(F.split(text, "\f")).alias("_p", "text")).filter(F.trim("text") != "").select(key, (F.col("_p") + 1).alias("page_no"), "text")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, text) of files of plain text with form feeds; other formats come as a pages table."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "utf-8").alias("_text"))
    return pages_of_text(raw, "path", "_text")


# --- sinks --------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str) -> None:
    """Header, every value quoted, quotes doubled."""
    df.write.option("header", True).option("quoteAll", True).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)


def redacted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with personal data hidden in free-text columns; nulls become empty."""
    return df.withColumns({c: redact_export(F.col(c)) for c in columns})


def export_csv(df: DataFrame, path: str, headers: Mapping[str, str], free_text: Sequence[str], redact: bool = True) -> None:
    """Columns under their headers, in that order, as quoted text; personal data is hidden unless asked otherwise."""
    out = redacted(df, free_text) if redact else df
    write_csv(out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(h) for c, h in headers.items()]), path)


def markdown(report: DataFrame, title: str) -> str:
    """A one-row report of counts as a table for people."""
    row = report.first()
    lines = [f"# {title}", "", "| Metric | Value |", "|-|-|"] + [f"| {n.replace('_', ' ')} | {row[n]} |" for n in report.columns]
    return "\n".join(lines) + "\n"


def save_report(report: DataFrame, folder: str, run_id: str) -> str:
    """A report's rows as JSON under its run; runs are kept side by side."""
    path = f"{folder}/run_id={run_id}"
    report.coalesce(1).write.mode("overwrite").json(path)
    return path


def latest_report(spark: SparkSession, folder: str, schema: str, before: str | None = None) -> DataFrame:
    """The rows of the last run, or of the last one before a run, by the order of run ids."""
    runs = spark.read.schema(f"{schema}, run_id STRING").json(folder)
    runs = runs.filter(F.col("run_id") < before) if before else runs
    last = runs.agg(F.max("run_id").alias("run_id"))
    return runs.join(F.broadcast(last), "run_id").drop("run_id")


def bundle(audits: DataFrame, fields: DataFrame, findings: DataFrame, key: str, free_text: Sequence[str] = (), redact: bool = True) -> DataFrame:
    """One nested document per audit, with its fields and findings in order; personal data in ``free_text`` is hidden unless asked otherwise."""
    if redact and free_text:
        fields, findings = (redacted(d, [c for c in free_text if c in d.columns]) for d in (fields, findings))

    def nested(df, name):
        rest = [c for c in df.columns if c != key]
        return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))

    return audits.join(nested(fields, "fields"), key, "left").join(nested(findings, "findings"), key, "left")


def metric_rows(report: DataFrame) -> DataFrame:
    """A one-row report of numbers as (metric, value)."""
    return report.select([F.col(c).cast("double").alias(c) for c in report.columns]).unpivot([], report.columns, "metric", "value")


def exposition(metrics: DataFrame, prefix: str = "audit") -> DataFrame:
    """``metrics(name, label, value)`` as lines in order, labels escaped."""
    safe = F.replace(F.replace(F.replace(F.col("label"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    line = F.concat(F.lit(f"{prefix}_"), F.col("name"), F.lit('{label="'), safe, F.lit('"} '), F.col("value").cast("string"))
    return metrics.select(line.alias("line")).orderBy("line")


def canonical_json_hash(c: Column, drop: tuple[str, ...] = ()) -> Column:
    """SHA-256 of free-form JSON with keys sorted at every depth, without the named keys; for small dimensions."""
    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in drop}
        return [clean(v) for v in x] if isinstance(x, list) else x

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else hashlib.sha256(json.dumps(clean(json.loads(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest())

    return run(c)


def signed(payload: Column, secret: str) -> Column:
    """HMAC-SHA256 of a payload, for webhook deliveries."""
    @F.pandas_udf("string")
    def run(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in s:
            yield x.map(lambda t: None if t is None else hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest())

    return run(payload)


def deliveries(subscriptions: DataFrame, event: str, payload: str, secret: str) -> DataFrame:
    """One signed delivery for each active subscription to the event."""
    return subscriptions.filter(F.col("active") & F.array_contains("events", event)).select("id", "url", F.lit(payload).alias("payload"), signed(F.lit(payload), secret).alias("signature"))
