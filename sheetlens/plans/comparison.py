"""Parity, baseline, evaluation, drift, fusion, calibration and validation as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import comparison as C
from ..operators import evaluation as E
from .registry import query
from .reports import r

FIELDS = """j AS (SELECT coalesce(g.doc_id, a.doc_id) AS doc_id, coalesce(g.rule_id, a.rule_id) AS rule_id, g.doc_id IS NOT NULL AS ig, a.doc_id IS NOT NULL AS ia, g.status AS gs, a.status AS s, g.value AS gv, a.value AS v, g.confidence AS gc, a.confidence AS c, g.severity AS gse, a.severity AS se, g.reason_code AS gr, a.reason_code AS rc
 FROM golden g FULL JOIN (SELECT * FROM actual WHERE doc_id IN (SELECT doc_id FROM golden)) a ON g.doc_id = a.doc_id AND g.rule_id = a.rule_id),
 f AS (SELECT doc_id, rule_id, CASE WHEN NOT ia THEN 'missing' WHEN NOT ig THEN 'new' WHEN (gs = 'failed' AND s = 'passed') OR c > gc THEN 'improved' WHEN (gs = 'passed' AND s = 'failed') OR c < gc THEN 'worse' ELSE 'same' END AS verdict,
 ig AND ia AND gs IS DISTINCT FROM s AS status_changed, ig AND ia AND gv IS DISTINCT FROM v AS value_changed, ig AND ia AND gse IS DISTINCT FROM se AS severity_changed, ig AND ia AND gr IS DISTINCT FROM rc AS reason_code_changed FROM j)"""
DOCUMENTS = FIELDS + """, d AS (SELECT doc_id, count(*) FILTER (verdict = 'same') AS same, count(*) FILTER (verdict = 'improved') AS improved, count(*) FILTER (verdict = 'worse') AS worse, count(*) FILTER (verdict = 'new') AS new, count(*) FILTER (verdict = 'missing') AS missing FROM f GROUP BY doc_id),
 dd AS (SELECT d.*, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN worse > 0 OR missing > 0 THEN 'worse' WHEN improved > 0 THEN 'improved' ELSE 'same' END AS status FROM d LEFT JOIN (SELECT DISTINCT doc_id FROM actual) a ON d.doc_id = a.doc_id)"""


def parts(v):
    f = C.compare_fields(v.golden, v.actual)
    return f, C.compare_documents(f)


@query("parity_fields", f"WITH {FIELDS} SELECT * FROM f", "golden", "actual")
def _(v):
    return parts(v)[0].drop("document_found")


@query("parity_documents", f"WITH {DOCUMENTS} SELECT * FROM dd", "golden", "actual")
def _(v):
    return parts(v)[1]


SUMMARY = """SELECT count(*) AS documents, count(*) FILTER (status = 'same') AS documents_same, count(*) FILTER (status = 'improved') AS documents_improved, count(*) FILTER (status IN ('worse', 'missing')) AS documents_worse,
 CAST(sum(same + improved + worse + new + missing) AS BIGINT) AS fields, CAST(sum(same) AS BIGINT) AS fields_same, CAST(sum(improved) AS BIGINT) AS fields_improved, CAST(sum(worse + missing) AS BIGINT) AS fields_worse FROM dd"""


@query("parity_summary", f"WITH {DOCUMENTS} {SUMMARY}", "golden", "actual")
def _(v):
    return C.parity_summary(parts(v)[1])


@query("parity_violations", f"WITH {DOCUMENTS}, s AS ({SUMMARY}) SELECT 'worse documents' AS violation FROM s WHERE documents_worse > 0 UNION ALL SELECT 'worse fields' FROM s WHERE fields_worse > 0 UNION ALL SELECT 'same percentage' FROM s WHERE fields_same * 100.0 / fields < 100", "golden", "actual")
def _(v):
    return C.threshold_violations(C.parity_summary(parts(v)[1]))


@query("parity_failures", """WITH e AS (SELECT DISTINCT doc_id, rule_id, field, reason_code FROM golden WHERE status = 'failed'), x AS (SELECT doc_id, rule_id, field, coalesce(reason_code, 'OUT_OF_POLICY') AS reason_code FROM actual WHERE status = 'failed')
 SELECT doc_id, rule_id, field, 'matched' AS kind FROM e SEMI JOIN x USING (doc_id, rule_id, field, reason_code) UNION ALL SELECT doc_id, rule_id, field, 'missed' FROM e ANTI JOIN x USING (doc_id, rule_id, field, reason_code)
 UNION ALL SELECT doc_id, rule_id, field, 'unexpected' FROM x ANTI JOIN e USING (doc_id, rule_id, field)""", "golden", "actual")
def _(v):
    return C.compare_failures(v.golden.filter("status = 'failed'").select("doc_id", "rule_id", "field", "reason_code").distinct(), v.actual)


@query("canonical_reasons", "SELECT event_id, CASE event_type WHEN 'error' THEN 'CONFLICT' ELSE 'OUT_OF_POLICY' END AS reason FROM events")
def _(v):
    old = F.when(F.col("event_type") == "error", "CONFLICT").when(F.col("event_type") == "click", "RANGE_ERROR").otherwise(F.col("event_type"))
    return v.table("events").select("event_id", C.canonical_reason(old).alias("reason"))


RATES = "SELECT severity, CAST(count(*) FILTER (status = 'passed') AS BIGINT) AS passed, count(*) AS total FROM {} GROUP BY severity"


@query("baseline_comparison", f"""WITH b AS ({RATES.format('golden')}), c AS ({RATES.format('actual')}), j AS (SELECT coalesce(b.severity, c.severity) AS severity, b.total AS bt, c.total AS ct, {r('CASE WHEN coalesce(b.total, 0) > 0 THEN b.passed / b.total::DOUBLE * 100 ELSE 0 END')} AS baseline_rate,
 {r('CASE WHEN coalesce(c.total, 0) > 0 THEN c.passed / c.total::DOUBLE * 100 ELSE 0 END')} AS current_rate FROM b FULL JOIN c ON b.severity = c.severity), k AS (SELECT *, {r('current_rate - baseline_rate')} AS delta FROM j)
 SELECT severity, baseline_rate, current_rate, delta, CASE WHEN bt IS NULL THEN 'new' WHEN ct IS NULL THEN 'removed' WHEN delta > 0.1 THEN 'improved' WHEN delta < -0.1 THEN 'regressed' ELSE 'unchanged' END AS status FROM k""", "golden", "actual")
def _(v):
    side = lambda df: df.groupBy("severity").agg(F.count_if(F.col("status") == "passed").alias("passed"), F.count("*").alias("total"))
    return C.baseline_gate(side(v.golden), side(v.actual), "severity")


_DOC_RATES = f"SELECT doc_id, CASE WHEN count(*) FILTER (status = 'passed') = count(*) THEN 'pass' ELSE 'fail' END AS status, {r("count(*) FILTER (status = 'passed') / count(*)::DOUBLE * 100")} AS rate FROM {{0}} GROUP BY doc_id"
_DOC_DIFF = f"""b AS ({_DOC_RATES.format('golden')}), c AS ({_DOC_RATES.format('now')}), dj AS (SELECT coalesce(b.doc_id, c.doc_id) AS doc_id, b.doc_id AS bd, c.doc_id AS cd, coalesce(b.status, 'N/A') AS baseline_status, coalesce(c.status, 'removed') AS current_status, coalesce(b.rate, 0.0) AS baseline_rate, coalesce(c.rate, 0.0) AS current_rate,
 {r('coalesce(c.rate, 0) - coalesce(b.rate, 0)')} AS delta FROM b FULL JOIN c ON b.doc_id = c.doc_id), dd AS (SELECT doc_id, baseline_status, current_status, baseline_rate, current_rate, delta, CASE WHEN bd IS NULL THEN 'new' WHEN cd IS NULL THEN 'regressed' WHEN delta > 0.1 THEN 'improved' WHEN delta < -0.1 THEN 'regressed' ELSE 'same' END AS status FROM dj)"""
#: The current side without some documents, and with some that the golden side lacks.
_NOW = "now AS (SELECT CASE WHEN doc_id % 101 = 0 THEN -doc_id ELSE doc_id END AS doc_id, CASE WHEN doc_id % 37 = 0 THEN 'major' ELSE severity END AS severity, status FROM actual)"


def now(v):
    d = F.col("doc_id")
    return v.actual.select(F.when(d % 101 == 0, -d).otherwise(d).alias("doc_id"), F.when(d % 37 == 0, "major").otherwise(F.col("severity")).alias("severity"), "status")


@query("baseline_documents", f"WITH {_NOW}, {_DOC_DIFF} SELECT * FROM dd", "golden", "actual")
def _(v):
    return C.baseline_documents(C.document_rates(v.golden), C.document_rates(now(v)))


THRESHOLDS = {"overall": {"minPassRate": 0.6, "maxWorseCount": 3}, "bySeverity": {"S0": {"minPassRate": 0.99}, "S1": {"minPassRate": 0.1}, "S2": {"minPassRate": 0.9}}}


@query("baseline_violations", f"""WITH {_NOW}, {_DOC_DIFF}, s AS (SELECT severity, {r("count(*) FILTER (status = 'passed') / count(*)::DOUBLE * 100")} AS rate FROM now GROUP BY 1)
 SELECT 'overall' AS kind, CAST(NULL AS VARCHAR) AS severity, {r("count(*) FILTER (status = 'passed') / count(*)::DOUBLE * 100")} AS value, 60.0::DOUBLE AS least FROM now HAVING value < 60 UNION ALL SELECT 'regressions', NULL, count(*) FILTER (status = 'regressed'), 3 FROM dd HAVING count(*) FILTER (status = 'regressed') > 3
 UNION ALL SELECT 'severity', severity, rate, l.least FROM s JOIN (VALUES ('S0', 99.0), ('S1', 10.0), ('S2', 90.0)) l(sev, least) ON sev = severity WHERE rate < l.least UNION ALL SELECT 'legacy_severity', severity, NULL, NULL FROM s WHERE severity = 'major'""", "golden", "actual")
def _(v):
    side = lambda df: df.groupBy("severity").agg(F.count_if(F.col("status") == "passed").alias("passed"), F.count("*").alias("total"))
    current = side(now(v))
    rate = current.agg((F.sum("passed") / F.sum("total") * 100).alias("pass_rate"))
    documents = C.baseline_documents(C.document_rates(v.golden), C.document_rates(now(v)))
    bad = C.baseline_violations(rate, C.baseline_gate(side(v.golden), current, "severity"), documents, THRESHOLDS)
    return bad.unionByName(C.unusual_severities(current))


# --- evaluation ---------------------------------------------------------------------------


NO_ERRORS = "coalesce(list_contains(reason_codes, 'CONFLICT'), FALSE)"


@query("selection_metrics", f"""SELECT template_id, count(*) AS total, count(*) FILTER (outcome = 'VALID') AS correct, count(*) FILTER (outcome <> 'VALID') AS incorrect, count(*) FILTER ({NO_ERRORS}) AS ambiguous,
 {r("count(*) FILTER (outcome = 'VALID') / count(*)::DOUBLE")} AS accuracy, {r(f'count(*) FILTER ({NO_ERRORS}) / count(*)::DOUBLE')} AS ambiguity_rate FROM audits GROUP BY ROLLUP (template_id)""", "audits")
def _(v):
    e = v.audits.select("template_id", (F.col("outcome") == "VALID").alias("correct"), F.array_contains("reason_codes", "CONFLICT").alias("ambiguous"))
    m = E.selection_metrics(e, "template_id")
    return m.select("template_id", "total", "correct", "incorrect", "ambiguous", S.r6(F.col("accuracy")).alias("accuracy"), S.r6(F.col("ambiguity_rate")).alias("ambiguity_rate"))


_G = "SELECT CASE WHEN severity <> 'S3' THEN severity ELSE 'S2' END AS severity, field, status = 'passed' AS ok, CASE WHEN status <> 'skipped' THEN value END AS value FROM golden"


@query("critical_field_metrics", f"""WITH g AS ({_G}), x AS (SELECT 'all' AS by, '' AS name, * FROM g UNION ALL SELECT 'severity', severity, * FROM g UNION ALL SELECT 'field', field, * FROM g UNION ALL SELECT 'critical', '', * FROM g WHERE severity IN ('S0', 'S1')),
 m AS (SELECT x."by", name, count(*) AS total, count(*) FILTER (ok) AS correct, count(*) FILTER (NOT ok AND value IS NULL) AS missing, {r('count(*) FILTER (ok) / count(*)::DOUBLE')} AS accuracy FROM x GROUP BY ALL)
 SELECT * FROM m UNION ALL SELECT 'severity', s, 0, 0, 0, 0 FROM (VALUES ('S0'), ('S1'), ('S2'), ('S3')) t(s) WHERE s NOT IN (SELECT name FROM m WHERE m."by" = 'severity')""", "golden")
def _(v):
    f = v.golden.select(F.when(F.col("severity") != "S3", F.col("severity")).otherwise("S2").alias("severity"), "field", (F.col("status") == "passed").alias("correct"),
                        F.when(F.col("status") != "skipped", F.col("value")).alias("value"))
    return E.critical_field_metrics(f).withColumn("accuracy", S.r6(F.col("accuracy")))


_AGREED = "l_returnflag = 'N'"
_DECISION = "CASE l_suppkey % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'image_qa' WHEN 2 THEN 'merged' ELSE 'conflict' END"
_COUNTS = f"""count(*) AS total, count(*) FILTER ({_AGREED}) AS agreements, count(*) FILTER (NOT {_AGREED}) AS disagreements, {r(f'count(*) FILTER ({_AGREED}) / count(*)::DOUBLE')} AS agreement_rate,
 count(*) FILTER (d = 'ocr') AS ocr, count(*) FILTER (d = 'image_qa') AS image_qa, count(*) FILTER (d = 'merged') AS merged, count(*) FILTER (d = 'conflict') AS conflict"""


@query("fusion_metrics", f"SELECT field, {_COUNTS} FROM (SELECT 'field_' || l_linenumber AS field, l_returnflag, {_DECISION} AS d FROM lineitem) GROUP BY ROLLUP (field)")
def _(v):
    decision = F.get(F.array(*map(F.lit, E.DECISIONS)), (F.col("l_suppkey") % 4).cast("int"))
    f = v.table("lineitem").select(F.concat(F.lit("field_"), F.col("l_linenumber").cast("string")).alias("field"), (F.col("l_returnflag") == "N").alias("agreed"), decision.alias("decision"))
    m = E.fusion_metrics(f)
    return m.withColumn("agreement_rate", S.r6(F.col("agreement_rate")))


_PASS2 = """SELECT k % 7 AS template_id, event_type IN ('error', 'signup') AS triggered, CASE WHEN event_type = 'error' THEN 'reason_' || (k % 3) END AS reason, CASE WHEN k % 2 = 0 THEN 'fast' ELSE 'strong' END AS interpreter, k % 5 = 0 AS escalated FROM ev"""


@query("second_pass_metrics", f"""WITH ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events), p AS ({_PASS2}) SELECT 'template' AS by, CAST(template_id AS VARCHAR) AS name, count(*) AS total, count(*) FILTER (triggered) AS triggered, {r('count(*) FILTER (triggered) / count(*)::DOUBLE')} AS rate FROM p GROUP BY template_id
 UNION ALL SELECT 'all', '', count(*), count(*) FILTER (triggered), {r('count(*) FILTER (triggered) / count(*)::DOUBLE')} FROM p UNION ALL SELECT 'reason', coalesce(reason, 'unknown'), count(*), count(*), 1.0 FROM p WHERE triggered GROUP BY ALL
 UNION ALL SELECT 'interpreter', interpreter, count(*), count(*), 1.0 FROM p WHERE triggered GROUP BY ALL UNION ALL SELECT 'escalated', '', count(*), count(*), 1.0 FROM p WHERE triggered AND escalated HAVING count(*) > 0""")
def _(v):
    e = v._keyed_events
    p = e.select((F.col("k") % 7).alias("template_id"), F.col("event_type").isin("error", "signup").alias("triggered"), F.when(F.col("event_type") == "error", F.concat(F.lit("reason_"), (F.col("k") % 3).cast("string"))).alias("reason"),
                 F.when(F.col("k") % 2 == 0, "fast").otherwise("strong").alias("interpreter"), (F.col("k") % 5 == 0).alias("escalated"))
    return E.second_pass_metrics(p).withColumn("rate", S.r6(F.col("rate")))


@query("field_metrics", f"""WITH m AS (SELECT 'field_' || l_linenumber AS field, l_orderkey, {{match}} AS m, l_discount AS c FROM lineitem), n AS (SELECT count(DISTINCT l_orderkey) AS cases FROM m)
 SELECT field, {r("count(*) FILTER (m IN ('exact', 'fuzzy')) / count(*)::DOUBLE", 2)} AS accuracy, {r('count(*) / any_value(cases)::DOUBLE', 2)} AS extraction_rate, {r('avg(c)', 2)} AS confidence FROM m, n GROUP BY field""".replace(
    "{match}", "CASE (l_linenumber + l_partkey) % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'partial' WHEN 3 THEN 'extra' ELSE 'missing' END"))
def _(v):
    match = F.get(F.array(*map(F.lit, ("exact", "fuzzy", "partial", "extra", "missing"))), ((F.col("l_linenumber") + F.col("l_partkey")) % 5).cast("int"))
    m = v.table("lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("field_"), F.col("l_linenumber").cast("string")).alias("field"), match.alias("match"), F.col("l_discount").alias("confidence"))
    return E.field_metrics(m, "case_id")


@query("ab_summary", f"""WITH c AS (SELECT avg(confidence) FILTER (engineer_id % 2 = 0) AS fa, avg(confidence) FILTER (engineer_id % 2 = 1) AS fb, avg((outcome = 'VALID')::INT) FILTER (engineer_id % 2 = 0) AS aa, avg((outcome = 'VALID')::INT) FILTER (engineer_id % 2 = 1) AS ab,
 avg(fields_extracted * 50) FILTER (engineer_id % 2 = 0) AS la, avg(fields_extracted * 50) FILTER (engineer_id % 2 = 1) AS lb FROM audits)
 SELECT {r('fa - fb', 2)} AS f1_delta, {r('aa - ab', 2)} AS accuracy_delta, {r('la - lb', 0)} AS latency_delta, CASE WHEN abs(fa - fb) < 0.02 THEN 'tie' WHEN fa > fb THEN 'A' ELSE 'B' END AS winner,
 CASE WHEN abs(fa - fb) < 0.02 THEN 'low' WHEN abs(fa - fb) > 0.1 THEN 'high' ELSE 'medium' END AS certainty FROM c""", "audits")
def _(v):
    a = v.audits.select(F.when(F.col("engineer_id") % 2 == 0, "A").otherwise("B").alias("config"), F.col("confidence").alias("f1"), (F.col("outcome") == "VALID").cast("double").alias("accuracy"), (F.col("fields_extracted") * 50.0).alias("latency_ms"))
    return E.ab_summary(a)


@query("overall_score", f"SELECT {r('a * 0.30::DOUBLE + b * 0.40::DOUBLE + c * 0.20::DOUBLE + (1 - d) * 0.10::DOUBLE')} AS score FROM (SELECT avg((outcome = 'VALID')::INT) AS a, avg(confidence) AS b, avg((fields_missing = 0)::INT) AS c, avg((fields_low_confidence > 0)::INT) AS d FROM audits)", "audits")
def _(v):
    mean = lambda c: F.avg(c.cast("double"))
    m = v.audits.agg(mean(F.col("outcome") == "VALID").alias("a"), F.avg("confidence").alias("b"), mean(F.col("fields_missing") == 0).alias("c"), mean(F.col("fields_low_confidence") > 0).alias("d"))
    return m.select(S.r6(C.overall_score(*map(F.col, "abcd"))).alias("score"))


MATCH = "CASE l_linenumber % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'partial' WHEN 3 THEN 'extra' ELSE 'missing' END"


@query("extraction_precision_recall", f"""WITH g AS (SELECT l_orderkey, sum(CASE WHEN m IN ('exact', 'fuzzy') THEN 1.0::DOUBLE WHEN m = 'partial' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS tp, count(*) FILTER (m = 'extra') AS fp, count(*) FILTER (m = 'missing') AS fn FROM (SELECT l_orderkey, {MATCH} AS m FROM lineitem) GROUP BY 1),
 p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM g) SELECT l_orderkey, {r('p', 2)} AS precision, {r('q', 2)} AS recall, {r('CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END', 2)} AS f1 FROM p""")
def _(v):
    n = F.col("l_linenumber") % 5
    m = v.table("lineitem").select("l_orderkey", F.when(n == 0, "exact").when(n == 1, "fuzzy").when(n == 2, "partial").when(n == 3, "extra").otherwise("missing").alias("match"))
    return C.precision_recall(m, ["l_orderkey"])


@query("agreement_rate", f"SELECT engineer_id, {r('avg((confidence > 0.5) = (outcome = ' + chr(39) + 'VALID' + chr(39) + ')::BOOLEAN)')} AS rate FROM (SELECT engineer_id, confidence, outcome FROM audits) GROUP BY 1".replace("avg((confidence > 0.5) = (outcome = 'VALID')::BOOLEAN)", "avg(((confidence > 0.5) = (outcome = 'VALID'))::INT)"), "audits")
def _(v):
    return v.audits.groupBy("engineer_id").agg(S.r6(F.avg(((F.col("confidence") > 0.5) == (F.col("outcome") == "VALID")).cast("double"))).alias("rate"))


DRIFT_SQL = "(VALUES " + ", ".join(f"('{m}', '{k}', {w}::DOUBLE, {c}::DOUBLE, {b}::DOUBLE)" for m, k, w, c, b in C.DRIFT) + ") t(metric, mode, warning, critical, db)"


@query("drift_alerts", f"""WITH m AS (SELECT 'ambiguity_rate' AS metric, avg((gap < 0.10 AND candidates > 1)::INT) AS value, 0.05::DOUBLE AS baseline FROM selections UNION ALL SELECT 'override_rate', avg(overridden::INT), NULL FROM selections UNION ALL SELECT 'selection_accuracy', avg((band <> 'LOW')::INT), NULL FROM selections UNION ALL SELECT 'scan_quality', avg(top_score) / 100, NULL FROM selections),
 j AS (SELECT m.metric, {r('value')} AS value, {r('coalesce(baseline, db)')} AS baseline, {r('value - coalesce(baseline, db)')} AS deviation, {r("CASE WHEN mode = 'drop' THEN coalesce(baseline, db) - value ELSE value END")} AS x, warning, critical FROM m JOIN {DRIFT_SQL} ON m.metric = t.metric)
 SELECT metric, value, baseline, deviation, CASE WHEN x >= critical THEN 'critical' ELSE 'warning' END AS severity FROM j WHERE x >= warning""", "selections")
def _(v):
    mean = lambda c: F.avg(c.cast("double"))
    one = v.selections.agg(mean((F.col("gap") < 0.10) & (F.col("candidates") > 1)).alias("ambiguity_rate"), mean(F.col("overridden")).alias("override_rate"), mean(F.col("band") != "LOW").alias("selection_accuracy"), (F.avg("top_score") / 100).alias("scan_quality"))
    m = one.unpivot([], list(one.columns), "metric", "value").withColumn("baseline", F.when(F.col("metric") == "ambiguity_rate", 0.05))
    return C.drift_alerts(m)


# --- fusion, calibration, validation ------------------------------------------------------


@query("fused_fields", f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 10 > 0 THEN l_partkey % 2 = 0 END AS op, l_discount * 10 AS oc, CASE WHEN l_suppkey % 10 > 0 THEN l_suppkey % 3 > 0 END AS qp, l_tax * 12 AS qc FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN op IS NULL AND qp IS NULL THEN 'MISSING_FIELD' WHEN qp IS NULL THEN CASE WHEN oc >= 0.7 THEN 'VALID' ELSE 'LOW_CONFIDENCE' END WHEN op IS NULL THEN CASE WHEN qc >= 0.7 THEN 'VALID' ELSE 'LOW_CONFIDENCE' END
 WHEN op <> qp AND oc >= 0.8 AND qc >= 0.85 THEN 'CONFLICT' WHEN op <> qp AND (oc >= 0.8 OR qc >= 0.85) THEN 'LOW_CONFIDENCE' WHEN op <> qp THEN 'CONFLICT' WHEN oc >= 0.8 AND qc >= 0.85 THEN 'VALID' WHEN oc < 0.6 OR qc < 0.65 THEN 'LOW_CONFIDENCE' WHEN (oc + qc) / 2 >= 0.7 THEN 'VALID' ELSE 'LOW_CONFIDENCE' END AS outcome,
 {r('CASE WHEN op IS NULL AND qp IS NULL THEN 0 WHEN qp IS NULL THEN oc WHEN op IS NULL THEN qc WHEN op <> qp AND oc >= 0.8 AND qc >= 0.85 THEN least(oc, qc) WHEN op <> qp AND oc >= 0.8 THEN oc * 0.7::DOUBLE WHEN op <> qp AND qc >= 0.85 THEN qc * 0.7::DOUBLE WHEN op <> qp THEN greatest(oc, qc) * 0.5::DOUBLE WHEN oc >= 0.8 AND qc >= 0.85 THEN least(1.0::DOUBLE, (oc + qc) / 2 * 1.1::DOUBLE) ELSE (oc + qc) / 2 END', 5)} AS confidence FROM x""")
def _(v):
    x = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 10 > 0, F.col("l_partkey") % 2 == 0).alias("op"), (F.col("l_discount") * 10).alias("oc"), F.when(F.col("l_suppkey") % 10 > 0, F.col("l_suppkey") % 3 > 0).alias("qp"), (F.col("l_tax") * 12).alias("qc"))
    outcome, conf = C.fuse(F.col("op"), F.col("oc"), F.col("qp"), F.col("qc"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", outcome.alias("outcome"), S.round_half_up(conf, 5).alias("confidence"))


PROFILE = [(f"field_{i}", 80.0 if i % 2 else 60.0, 50.0, i % 2 == 1, ["ocr", "regex"], "^[1-3]" if i == 3 else None) for i in range(1, 8)]
CALIBRATED = """WITH x AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) AS value, l_discount * 1000 AS c0, l_returnflag <> 'A' AS extracted, CASE WHEN l_partkey % 3 = 0 THEN 'inference' ELSE 'ocr' END AS source, l_suppkey % 4 > 0 AS roi FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7),
 y AS (SELECT *, CASE WHEN source = 'inference' THEN greatest(0, c0 - 20) ELSE c0 END AS c1 FROM x), z AS (SELECT *, CASE WHEN n = 3 AND NOT regexp_matches(value, '^[1-3]') THEN greatest(0, c1 - 30) ELSE c1 END AS c2 FROM y),
 w AS (SELECT *, CASE WHEN n % 2 = 1 AND NOT roi THEN greatest(0, c2 - 15) ELSE c2 END AS adjusted, n % 2 = 1 AS crit, CASE WHEN n % 2 = 1 THEN 80 ELSE 60 END AS least_c FROM z)"""


def calibrated(v):
    li = v.table("lineitem").filter("l_linenumber BETWEEN 1 AND 7")
    fields = li.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("field_"), F.col("l_linenumber").cast("string")).alias("field_id"), F.col("l_quantity").cast("int").cast("string").alias("value"), (F.col("l_discount") * 1000).alias("confidence"),
                       (F.col("l_returnflag") != "A").alias("extracted"), F.when(F.col("l_partkey") % 3 == 0, "inference").otherwise("ocr").alias("source"), (F.col("l_suppkey") % 4 > 0).alias("roi_match"))
    profile = v.spark.createDataFrame(PROFILE, "field_id string, min_confidence double, review_threshold double, is_critical boolean, allowed_methods array<string>, pattern string")
    return C.calibrate(fields, profile)


@query("calibrated_fields", f"{CALIBRATED} SELECT 'field_' || n AS field_id, count(*) AS n_fields, count(*) FILTER (adjusted >= least_c AND extracted) AS accepted, count(*) FILTER (NOT (adjusted >= least_c AND extracted) AND adjusted >= 50) AS review, {r('avg(adjusted)', 4)} AS mean FROM w GROUP BY 1")
def _(v):
    return calibrated(v).groupBy("field_id").agg(F.count("*").alias("n_fields"), F.count_if(F.col("accepted")).alias("accepted"), F.count_if(F.col("needs_review")).alias("review"), S.round_half_up(F.avg("adjusted"), 4).alias("mean"))


@query("extraction_quality", f"""{CALIBRATED}, g AS (SELECT doc_id, CAST(floor(sum(CASE WHEN extracted THEN adjusted ELSE 0 END) / count(*) + 0.5) AS BIGINT) AS score, count(*) FILTER (NOT extracted AND crit) AS missing_critical, count(*) FILTER (extracted AND adjusted < 50) AS low_confidence FROM w GROUP BY 1),
 h AS (SELECT *, missing_critical > 1 OR score < 50 OR low_confidence > 3 AS anomaly FROM g) SELECT doc_id, score, missing_critical, low_confidence, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END AS grade, anomaly, score >= 70 AND missing_critical = 0 AND NOT anomaly AS passed FROM h""")
def _(v):
    return C.extraction_quality(calibrated(v), "doc_id")


RULES = [
    ("R1", "p_name", "required", None, None, None, None, True, "critical"), ("R2", "p_brand", "pattern", "^Brand#[1-3]", None, None, None, True, "major"), ("R3", "p_size", "range", None, 5.0, 40.0, None, True, "minor"),
    ("R4", "p_type", "custom", None, None, None, "minLength:6", True, "info"), ("R5", "p_type", "custom", None, None, None, "nope:1", True, "info"), ("R6", "p_none", "required", None, None, None, None, True, "minor"), ("R7", "p_name", "pattern", "x", None, None, None, False, "minor"), ("R8", "p_none", "pattern", "x", None, None, None, True, "minor")]
RULE_SQL = """WITH v AS (SELECT p_partkey AS doc_id, 'R1' AS rule_id, 'p_name' AS field, 'critical' AS severity, CASE WHEN trim(p_name) <> '' THEN 'passed' ELSE 'failed' END AS status FROM part UNION ALL SELECT p_partkey, 'R2', 'p_brand', 'major', CASE WHEN regexp_matches(p_brand, '^Brand#[1-3]') THEN 'passed' ELSE 'failed' END FROM part
 UNION ALL SELECT p_partkey, 'R3', 'p_size', 'minor', CASE WHEN p_size BETWEEN 5 AND 40 THEN 'passed' ELSE 'failed' END FROM part UNION ALL SELECT p_partkey, 'R4', 'p_type', 'info', CASE WHEN length(p_type) >= 6 THEN 'passed' ELSE 'failed' END FROM part UNION ALL SELECT p_partkey, 'R5', 'p_type', 'info', 'error' FROM part
 UNION ALL SELECT p_partkey, 'R6', 'p_none', 'minor', 'failed' FROM part UNION ALL SELECT p_partkey, 'R7', 'p_name', 'minor', 'skipped' FROM part UNION ALL SELECT p_partkey, 'R8', 'p_none', 'minor', 'skipped' FROM part)"""


def validated(v):
    p = v.table("part")
    fields = p.select(F.col("p_partkey").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("p_name", "p_brand", "p_type", "p_size")]).unpivot(["doc_id"], ["p_name", "p_brand", "p_type", "p_size"], "field", "value")
    rules = v.spark.createDataFrame(RULES, "rule_id string, field string, type string, pattern string, min double, max double, validator string, enabled boolean, severity string")
    return C.validate_rules(rules, fields)


@query("validated_rules", f"{RULE_SQL} SELECT * FROM v")
def _(v):
    return validated(v)


_FAILED = ", ".join(f"count(*) FILTER (status IN ('failed', 'error') AND severity = '{x}') AS failed_{x}" for x in ("critical", "major", "minor", "info"))


@query("validation_summary", f"{RULE_SQL} SELECT doc_id, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status IN ('failed', 'error')) AS failed, count(*) FILTER (status = 'skipped') AS skipped, {_FAILED}, count(*) FILTER (status IN ('failed', 'error') AND severity IN ('critical', 'major')) = 0 AS ok FROM v GROUP BY 1")
def _(v):
    return C.validation_summary(validated(v))


@query("reconciled_fields", f"""WITH o AS (SELECT doc_id, rule_id, any_value(value) AS value, min(confidence) AS confidence FROM golden GROUP BY ALL), a AS (SELECT doc_id, rule_id, any_value(value) AS value, max(confidence) AS confidence, bool_and(status <> 'skipped') AS success FROM actual GROUP BY ALL)
 SELECT o.doc_id, o.rule_id, {r('CASE WHEN success AND a.confidence > o.confidence THEN a.confidence ELSE o.confidence END')} AS confidence, CASE WHEN success AND a.confidence > o.confidence THEN 'improved' WHEN success THEN 'unchanged' WHEN success IS NULL THEN 'kept' ELSE 'failed' END AS outcome FROM o LEFT JOIN a ON o.doc_id = a.doc_id AND o.rule_id = a.rule_id""", "golden", "actual")
def _(v):
    o = v.golden.groupBy("doc_id", "rule_id").agg(F.any_value("value").alias("value"), F.min("confidence").alias("confidence"))
    a = v.actual.groupBy("doc_id", "rule_id").agg(F.any_value("value").alias("value"), F.max("confidence").alias("confidence"), F.bool_and(F.col("status") != "skipped").alias("success"))
    return C.reconcile(o, a, ["doc_id", "rule_id"]).select("doc_id", "rule_id", S.r6(F.col("confidence")).alias("confidence"), "outcome")


_THRESHOLD = "CASE WHEN rule_id = 'R1' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END"


@query("reconciliation_summary", f"""WITH o AS (SELECT doc_id, rule_id, min(confidence) AS confidence FROM golden GROUP BY ALL), a AS (SELECT doc_id, rule_id, max(confidence) AS again FROM actual GROUP BY ALL), j AS (SELECT o.doc_id, o.rule_id, again, greatest(confidence, coalesce(again, confidence)) AS c, coalesce(again > confidence, FALSE) AS up FROM o LEFT JOIN a ON o.doc_id = a.doc_id AND o.rule_id = a.rule_id)
 SELECT rule_id, count(*) AS fields, count(*) FILTER (up) AS improved, count(*) FILTER (again IS NULL) AS unchanged, count(*) FILTER (again IS NOT NULL AND NOT up) AS failed, {r('avg(c)', 2)} AS average_confidence, count(*) FILTER (c < {_THRESHOLD}) AS low_confidence FROM j GROUP BY 1""", "golden", "actual")
def _(v):
    o = v.golden.groupBy("doc_id", "rule_id").agg(F.any_value("value").alias("value"), F.min("confidence").alias("confidence"))
    a = v.actual.groupBy("doc_id", "rule_id").agg(F.any_value("value").alias("value"), F.max("confidence").alias("confidence"), F.lit(True).alias("success"))
    return C.reconciliation_summary(C.reconcile(o, a, ["doc_id", "rule_id"]), F.when(F.col("rule_id") == "R1", 0.5).otherwise(0.3), "rule_id")


@query("report_status", "SELECT document_id, CASE WHEN bool_or(severity = 'S0') AND bool_and(severity <> 'S0' OR issue_id % 3 = 0) THEN 'WAIVED' WHEN bool_or(severity = 'S0') THEN 'FAIL' WHEN bool_or(severity = 'S1') THEN 'REVIEW_QUEUE' ELSE 'PASS' END AS status FROM issues GROUP BY 1", "issues")
def _(v):
    g = v.issues.groupBy("document_id").agg(F.bool_or(F.col("severity") == "S0").alias("f"), F.bool_and((F.col("severity") != "S0") | (F.col("issue_id") % 3 == 0)).alias("w"), F.bool_or(F.col("severity") == "S1").alias("r"))
    return g.select("document_id", C.report_status(F.col("w"), F.col("f"), F.col("r")).alias("status"))


@query("escalations", "SELECT audit_id, CASE WHEN fields_extracted = 0 THEN 'urgent' WHEN list_contains(reason_codes, 'CONFLICT') THEN 'pattern' WHEN confidence < 0.70 THEN 'low_confidence' ELSE 'none' END AS route FROM audits", "audits")
def _(v):
    return v.audits.select("audit_id", C.escalate(F.col("confidence"), F.array_join("reason_codes", " "), F.col("fields_extracted") == 0, r"\bCONFLICT\b").alias("route"))


@query("activation_gates", "SELECT p_partkey, trim(CASE WHEN p_size >= 10 THEN '' ELSE 'size,' END || CASE WHEN p_retailprice > 950 THEN '' ELSE 'price,' END || CASE WHEN contains(p_type, 'STEEL') THEN '' ELSE 'type,' END, ',') AS blocking FROM part")
def _(v):
    gates = C.problems({"size": F.col("p_size") >= 10, "price": F.col("p_retailprice") > 950, "type": F.col("p_type").contains("STEEL")})
    return v.table("part").select("p_partkey", F.array_join(gates, ",").alias("blocking"))
