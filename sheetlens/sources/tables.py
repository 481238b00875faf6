"""Typed tables: schemas, readers with defaults, and the views that driver tables give."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Reason codes, issue types and severities in their natural order.
REASON_CODES = ("MISSING_FIELD", "INVALID_FORMAT", "OUT_OF_POLICY", "LOW_CONFIDENCE", "CONFLICT", "SPEC_GAP", "OCR_FAILURE", "PIPELINE_ERROR")
ISSUE_TYPES = ("MISSING_FIELD", "INVALID_FORMAT", "OUT_OF_POLICY", "SIGNATURE_MISSING", "DATE_MISMATCH", "PHOTO_QUALITY", "INCOMPLETE_CHECKLIST", "OTHER")
SEVERITIES = ("S0", "S1", "S2", "S3")

#: Spark DDL of the persistent tables.
DDL = {
    "users": "id INT, open_id STRING, name STRING, email STRING, role STRING, created_at TIMESTAMP, updated_at TIMESTAMP, last_signed_in TIMESTAMP",
    "gold_specs": "id INT, name STRING, version STRING, description STRING, schema STRING, spec_type STRING, parent_spec_id INT, is_active BOOLEAN, created_by INT, created_at TIMESTAMP",
    "job_sheets": "id LONG, status STRING, technician_id LONG, site STRING, created_at TIMESTAMP",
    "audit_results": "id INT, job_sheet_id INT, gold_spec_id INT, run_id STRING, result STRING, confidence_score DECIMAL(5,2), created_at TIMESTAMP",
    "audit_findings": "id INT, audit_result_id INT, severity STRING, reason_code STRING, field_name STRING, page_number INT, confidence DECIMAL(5,2), created_at TIMESTAMP",
    "disputes": "id INT, audit_finding_id INT, raised_by INT, status STRING, reason STRING, reviewer_id INT, resolved_at TIMESTAMP, created_at TIMESTAMP",
    "waivers": "id INT, audit_finding_id INT, approver_id INT, reason STRING, expires_at TIMESTAMP, created_at TIMESTAMP",
    "system_audit_log": "id INT, user_id INT, action STRING, entity_type STRING, entity_id INT, details STRING, created_at TIMESTAMP",
    "processing_settings": "id INT, setting_key STRING, setting_value STRING, category STRING, updated_by INT, updated_at TIMESTAMP",
    "templates": "id INT, template_id STRING, name STRING, client STRING, asset_type STRING, work_type STRING, status STRING, created_at TIMESTAMP",
    "template_versions": "id INT, template_id INT, version STRING, hash_sha256 STRING, spec_json STRING, selection_config_json STRING, roi_json STRING, is_active BOOLEAN, created_at TIMESTAMP",
    "selection_traces": "id INT, job_sheet_id INT, template_id INT, confidence_band STRING, top_score DECIMAL(5,2), runner_up_score DECIMAL(5,2), score_gap DECIMAL(5,2), created_at TIMESTAMP",
    "extraction_artifacts": "id INT, correlation_id STRING, job_sheet_id INT, extraction_json STRING, content_hash STRING, created_at TIMESTAMP",
    "validation_artifacts": "id INT, correlation_id STRING, job_sheet_id INT, validation_json STRING, content_hash STRING, overall_result STRING, created_at TIMESTAMP",
    "validated_fields": "id INT, validation_artifact_id INT, rule_id STRING, field STRING, status STRING, extracted_value STRING, confidence DECIMAL(5,4), severity STRING, order_index INT",
    "retention_policies": "id INT, name STRING, entity_type STRING, retention_days INT, is_active BOOLEAN",
    "legal_holds": "id INT, entity_type STRING, entity_id INT, reason STRING, placed_at TIMESTAMP, released_at TIMESTAMP",
    "retention_audit_log": "id INT, action STRING, entity_type STRING, entity_id INT, created_at TIMESTAMP",
    "pipeline_runs": "id INT, correlation_id STRING, job_sheet_id INT, status STRING, started_at TIMESTAMP, completed_at TIMESTAMP",
    "determinism_checksums": "id INT, entity_type STRING, entity_id INT, input_hash STRING, output_hash STRING, created_at TIMESTAMP",
}


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A typed table; an empty one of its schema where nothing is stored yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(DDL[table]).parquet(f"{folder}/{table}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], DDL[table])


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by a key where its scan has fewer tasks than the session has cores, as small files of one row group give; else as it is."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least, key) if df.rdd.getNumPartitions() < least else df


class Views:
    """The domain's tables as views of the driver's tables in one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A table; texts, which cost much per row, are dealt out where their files give too few tasks."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df, "doc_id") if name == "documents" else df

    @cached_property
    def _keyed_events(self) -> DataFrame:
        e = self.table("events")
        return e.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def audits(self) -> DataFrame:
        codes = F.array(*map(F.lit, REASON_CODES))
        bad = F.col("event_type").isin("error", "signup")
        first, second = F.get(codes, F.col("k") % 8), F.get(codes, (F.col("k") + 3) % 8)
        return self._keyed_events.select(
            F.col("event_id").alias("audit_id"), F.col("user_id").alias("engineer_id"), (F.col("k") % 7).alias("template_id"), F.col("ts").alias("audited_at"),
            F.when(F.col("event_type") == "error", "INVALID").when(F.col("event_type") == "signup", "REVIEW_QUEUE").otherwise("VALID").alias("outcome"),
            F.when(bad & (F.col("k") % 3 == 0), F.array(first, second)).when(bad, F.array(first)).otherwise(F.array().cast("array<string>")).alias("reason_codes"),
            F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), (F.col("k") % 11).alias("fields_extracted"), (F.col("k") % 3).alias("fields_missing"),
            (F.col("k") % 2).alias("fields_low_confidence"), F.concat(F.lit("cust_"), (F.col("k") % 6).cast("string")).alias("customer_id"),
            F.when(F.col("k") % 4 > 0, F.concat(F.lit("asset_"), (F.col("k") % 4).cast("string"))).alias("asset_type"))

    @cached_property
    def selections(self) -> DataFrame:
        score = F.least(F.lit(100.0), F.floor("value").cast("double"))
        return self._keyed_events.select(
            F.col("event_id").alias("id"), "ts", F.when(F.col("k") % 11 > 0, F.concat(F.lit("tpl_"), (F.col("k") % 7).cast("string"))).alias("template_slug"),
            F.when(score >= 80, "HIGH").when(score >= 50, "MEDIUM").otherwise("LOW").alias("band"), score.alias("top_score"), ((F.col("k") % 20) / 100.0).alias("gap"),
            (score >= 80).alias("auto_processed"), (F.col("k") % 13 == 0).alias("overridden"), (F.col("k") % 4).alias("candidates"),
            F.array(F.concat(F.lit("tok_"), (F.col("k") % 5).cast("string")), F.concat(F.lit("word_"), (F.col("k") % 9).cast("string"))).alias("tokens"))

    @cached_property
    def issues(self) -> DataFrame:
        li = self.table("lineitem")
        return li.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("issue_id"), F.col("l_suppkey").alias("engineer_id"), F.col("l_orderkey").alias("document_id"),
            F.get(F.array(*map(F.lit, ISSUE_TYPES)), (F.col("l_partkey") % 8).cast("int")).alias("issue_type"),
            F.when(F.col("l_returnflag") == "R", "S0").when(F.col("l_returnflag") == "N", "S3").when(F.col("l_linestatus") == "F", "S1").otherwise("S2").alias("severity"),
            F.concat(F.lit("field_"), F.col("l_linenumber").cast("string")).alias("field_name"), F.col("l_shipdate").cast("timestamp").alias("occurred_at"))

    @cached_property
    def processed(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").cast("timestamp").alias("processed_at"))

    @cached_property
    def job_sheets(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("review_queue").alias("status"),
            F.col("o_custkey").alias("technician_id"), F.concat(F.lit("site_"), (F.col("o_custkey") % 5).cast("string")).alias("site"), F.col("o_orderdate").cast("timestamp").alias("created_at"))

    @cached_property
    def golden(self) -> DataFrame:
        li = self.table("lineitem")
        failed = F.col("l_returnflag") == "R"
        return li.select(
            F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("R"), F.col("l_linenumber").cast("string")).alias("rule_id"), F.concat(F.lit("field_"), F.col("l_linenumber").cast("string")).alias("field"),
            F.when(F.col("l_returnflag") == "N", "passed").when(failed, "failed").otherwise("skipped").alias("status"), F.col("l_quantity").cast("int").cast("string").alias("value"),
            (F.col("l_discount") * 10).alias("confidence"), F.concat(F.lit("S"), (F.col("l_linenumber") % 4).cast("string")).alias("severity"),
            F.when(failed, F.get(F.array(*map(F.lit, REASON_CODES)), (F.col("l_partkey") % 8).cast("int"))).alias("reason_code"), F.col("l_linenumber").alias("_n"))

    @cached_property
    def actual(self) -> DataFrame:
        """The golden rows perturbed: some dropped, some with a flipped status or another confidence, some rules new."""
        g = self.golden
        flip = (F.col("doc_id") + F.col("_n")) % 13 == 0
        shift = F.when(F.col("doc_id") % 7 == 0, 0.1).when(F.col("doc_id") % 11 == 0, -0.1).otherwise(0.0)
        kept = g.filter((F.col("doc_id") + F.col("_n")) % 29 != 0).withColumn(
            "status", F.when(flip & (F.col("status") == "passed"), "failed").when(flip & (F.col("status") == "failed"), "passed").otherwise(F.col("status"))).withColumn("confidence", F.col("confidence") + shift)
        new = g.filter((F.col("_n") == 1) & (F.col("doc_id") % 17 == 0)).withColumn("rule_id", F.lit("R9")).withColumn("field", F.lit("field_9"))
        return kept.unionByName(new).drop("_n")

    @cached_property
    def run_events(self) -> DataFrame:
        c = self.table("conversations")
        states = F.array(*map(F.lit, ("QUEUED", "OCR", "EXTRACT", "VALIDATE", "COMPLETE")))
        return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.get(states, F.least(F.col("turn"), F.lit(4)).cast("int")).alias("state"), F.length("text").alias("ms"))

    @cached_property
    def sheets(self) -> DataFrame:
        """Job sheets as text, a line per field; some lines are missing, some hold what fails a check."""
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
        pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
        d = F.to_date("o_orderdate")
        day = F.when(k % 3 == 0, text(F.dayofmonth(d), "/", F.month(d), "/", F.year(d))).when(k % 3 == 1, text(F.dayofmonth(d), "-", F.month(d), "-", F.year(d))).otherwise(
            text(F.dayofmonth(d), "/", F.month(d), "/", F.date_format(d, "yy")))
        lines = (
            pick(("SERVICE REPORT", "Thorough Examination Report", "Repair Report", "Aztec weighing system", "Sheet"), k), F.when(k % 11 != 0, text("Job No: ", k)),
            F.when(k % 7 != 0, text("Customer Name: ", F.col("c_name"))), text("Date: ", day), F.when(k % 13 != 0, text("Asset No: AS-", c)), text("Make/Model: ", F.col("c_mktsegment")),
            F.when(k % 2 == 0, text("Serial No: S", c * 7)), F.when(k % 4 == 0, text("Mileage: ", k * 37 % 100_000, ".5")), F.when(k % 17 != 0, text("Engineer Name: Eng ", c % 40)),
            text("Issue: unit ", F.col("o_orderpriority"), " fails"), text("Location: site ", c % 5), text("Works fully completed: ", pick(("Yes", "No", "Yes"), k)),
            F.when(k % 19 != 0, text("Return visit required: ", pick(("No", "Yes"), c))), text("Asset safe to use: ", pick(("Yes", "No", "yes"), c)),
            text("Engineer Comments: ", F.when(k % 6 == 0, "ok").otherwise(text("replaced the seal and tested part ", k))), text("Fault Reason: ", pick(("Wear & Tear", "electrical", "Broken"), k)),
            text("Repair Duration: ", c % 130), F.lit("Parts Used: seal kit"), F.when(k % 9 == 0, F.lit("Parts Required: gasket")), text("Overtime: ", pick(("No", "Yes"), k)),
            text("VOR Status: ", pick(("No", "Yes"), c)), F.lit("Technician Signature: ____"), F.when(k % 5 == 0, text("Due date: ", F.year(d) + 1, "-01-02, valid until ", F.dayofmonth(d), "/12/", F.year(d))))
        # Orders are dealt out, not the join: to count a join's tasks would run it.
        j = spread(self.table("orders"), "o_orderkey").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return j.select(k.alias("doc_id"), F.concat_ws("\n", *lines).alias("text"), F.when(k % 3 == 0, F.concat(F.lit("Job No: "), (k + k % 2).cast("string"))).alias("region"))


_CODES = "[" + ", ".join(f"'{c}'" for c in REASON_CODES) + "]"
_TYPES = "[" + ", ".join(f"'{c}'" for c in ISSUE_TYPES) + "]"
#: The same views as common table expressions for the oracle.
VIEW_SQL = {
    "ev": "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events",
    "audits": f"""SELECT event_id AS audit_id, user_id AS engineer_id, k % 7 AS template_id, ts AS audited_at,
      CASE event_type WHEN 'error' THEN 'INVALID' WHEN 'signup' THEN 'REVIEW_QUEUE' ELSE 'VALID' END AS outcome,
      CASE WHEN event_type NOT IN ('error', 'signup') THEN CAST([] AS VARCHAR[]) WHEN k % 3 = 0 THEN [({_CODES})[k % 8 + 1], ({_CODES})[(k + 3) % 8 + 1]] ELSE [({_CODES})[k % 8 + 1]] END AS reason_codes,
      least(1.0::DOUBLE, value / 100) AS confidence, k % 11 AS fields_extracted, k % 3 AS fields_missing, k % 2 AS fields_low_confidence,
      'cust_' || (k % 6) AS customer_id, CASE WHEN k % 4 > 0 THEN 'asset_' || (k % 4) END AS asset_type FROM ev""",
    "selections": """SELECT event_id AS id, ts, CASE WHEN k % 11 > 0 THEN 'tpl_' || (k % 7) END AS template_slug, CASE WHEN s >= 80 THEN 'HIGH' WHEN s >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS band, s AS top_score,
      (k % 20) / 100.0::DOUBLE AS gap, s >= 80 AS auto_processed, k % 13 = 0 AS overridden, k % 4 AS candidates, ['tok_' || (k % 5), 'word_' || (k % 9)] AS tokens FROM (SELECT *, least(100.0::DOUBLE, floor(value)) AS s FROM ev)""",
    "issues": f"""SELECT l_orderkey * 10 + l_linenumber AS issue_id, l_suppkey AS engineer_id, l_orderkey AS document_id, ({_TYPES})[l_partkey % 8 + 1] AS issue_type,
      CASE WHEN l_returnflag = 'R' THEN 'S0' WHEN l_returnflag = 'N' THEN 'S3' WHEN l_linestatus = 'F' THEN 'S1' ELSE 'S2' END AS severity, 'field_' || l_linenumber AS field_name, l_shipdate AS occurred_at FROM lineitem""",
    "processed": "SELECT o_orderkey AS document_id, o_orderdate AS processed_at FROM orders",
    "job_sheets": "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'review_queue' END AS status, o_custkey AS technician_id, 'site_' || (o_custkey % 5) AS site, o_orderdate AS created_at FROM orders",
    "golden": f"""SELECT l_orderkey AS doc_id, 'R' || l_linenumber AS rule_id, 'field_' || l_linenumber AS field, CASE l_returnflag WHEN 'N' THEN 'passed' WHEN 'R' THEN 'failed' ELSE 'skipped' END AS status,
      CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) AS value, l_discount * 10 AS confidence, 'S' || (l_linenumber % 4) AS severity, CASE WHEN l_returnflag = 'R' THEN ({_CODES})[l_partkey % 8 + 1] END AS reason_code, l_linenumber AS _n FROM lineitem""",
    "actual": """SELECT doc_id, rule_id, field, CASE WHEN (doc_id + _n) % 13 = 0 AND status = 'passed' THEN 'failed' WHEN (doc_id + _n) % 13 = 0 AND status = 'failed' THEN 'passed' ELSE status END AS status, value,
      confidence + CASE WHEN doc_id % 7 = 0 THEN 0.1::DOUBLE WHEN doc_id % 11 = 0 THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END AS confidence, severity, reason_code FROM golden WHERE (doc_id + _n) % 29 <> 0
      UNION ALL SELECT doc_id, 'R9', 'field_9', status, value, confidence, severity, reason_code FROM golden WHERE _n = 1 AND doc_id % 17 = 0""",
    "sheets": """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Job No: ' || (o_orderkey + o_orderkey % 2) END AS region, array_to_string(list_filter([
      ['SERVICE REPORT', 'Thorough Examination Report', 'Repair Report', 'Aztec weighing system', 'Sheet'][o_orderkey % 5 + 1], CASE WHEN o_orderkey % 11 <> 0 THEN 'Job No: ' || o_orderkey END,
      CASE WHEN o_orderkey % 7 <> 0 THEN 'Customer Name: ' || c_name END, 'Date: ' || CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%-d/%-m/%Y') WHEN 1 THEN strftime(o_orderdate, '%-d-%-m-%Y')
      ELSE strftime(o_orderdate, '%-d/%-m/%y') END, CASE WHEN o_orderkey % 13 <> 0 THEN 'Asset No: AS-' || o_custkey END, 'Make/Model: ' || c_mktsegment, CASE WHEN o_orderkey % 2 = 0 THEN 'Serial No: S' || o_custkey * 7 END,
      CASE WHEN o_orderkey % 4 = 0 THEN 'Mileage: ' || (o_orderkey * 37 % 100000) || '.5' END, CASE WHEN o_orderkey % 17 <> 0 THEN 'Engineer Name: Eng ' || (o_custkey % 40) END, 'Issue: unit ' || o_orderpriority || ' fails',
      'Location: site ' || (o_custkey % 5), 'Works fully completed: ' || ['Yes', 'No', 'Yes'][o_orderkey % 3 + 1], CASE WHEN o_orderkey % 19 <> 0 THEN 'Return visit required: ' || ['No', 'Yes'][o_custkey % 2 + 1] END,
      'Asset safe to use: ' || ['Yes', 'No', 'yes'][o_custkey % 3 + 1], 'Engineer Comments: ' || CASE WHEN o_orderkey % 6 = 0 THEN 'ok' ELSE 'replaced the seal and tested part ' || o_orderkey END,
      'Fault Reason: ' || ['Wear & Tear', 'electrical', 'Broken'][o_orderkey % 3 + 1], 'Repair Duration: ' || (o_custkey % 130), 'Parts Used: seal kit', CASE WHEN o_orderkey % 9 = 0 THEN 'Parts Required: gasket' END,
      'Overtime: ' || ['No', 'Yes'][o_orderkey % 2 + 1], 'VOR Status: ' || ['No', 'Yes'][o_custkey % 2 + 1], 'Technician Signature: ____',
      CASE WHEN o_orderkey % 5 = 0 THEN 'Due date: ' || (year(o_orderdate) + 1) || '-01-02, valid until ' || day(o_orderdate) || '/12/' || year(o_orderdate) END], lambda x: x IS NOT NULL), chr(10)) AS text
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "run_events": "SELECT conv_id AS run_id, turn AS seq, (['QUEUED', 'OCR', 'EXTRACT', 'VALIDATE', 'COMPLETE'])[least(turn, 4) + 1] AS state, length(text) AS ms FROM conversations",
}
_NEEDS = {"audits": ("ev",), "selections": ("ev",), "actual": ("golden",)}


def oracle(body: str, *views: str) -> str:
    """``body`` with the views it names in front."""
    names = list(dict.fromkeys(n for v in views for n in (*_NEEDS.get(v, ()), v)))
    extra = body.strip()
    head = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    if not names:
        return extra
    return f"WITH {head}{', ' + extra[5:] if extra.upper().startswith('WITH ') else ' ' + extra}"
