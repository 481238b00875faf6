"""Filters, pages, look-ups, ranks, joins, set operations, mutations and small state folds as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audits as A
from ..operators import relational as R
from ..streaming.folds import dead_letters, started_once
from .registry import query
from .reports import r

# --- filters and pages --------------------------------------------------------------------


@query("dashboard_stats", """SELECT (SELECT count(*) FROM audits) AS audits, (SELECT count(*) FROM audits WHERE outcome = 'VALID') AS passed, (SELECT count(*) FROM job_sheets WHERE status = 'review_queue') AS review_queue,
 (SELECT count(*) FROM issues WHERE severity IN ('S0', 'S1')) AS critical_findings, (SELECT floor(avg(CASE WHEN outcome = 'VALID' THEN 100.0 ELSE 0 END) * 10 + 0.5) / 10 FROM audits) AS pass_rate""", "audits", "job_sheets", "issues")
def _(v):
    a = v.audits.agg(F.count("*").alias("audits"), F.count_if(F.col("outcome") == "VALID").alias("passed"))
    j = v.job_sheets.agg(F.count_if(F.col("status") == "review_queue").alias("review_queue"))
    i = v.issues.agg(F.count_if(F.col("severity").isin("S0", "S1")).alias("critical_findings"))
    return a.crossJoin(j).crossJoin(i).withColumn("pass_rate", S.round_half_up(S.ratio(F.col("passed"), F.col("audits")) * 100, 1))


@query("job_sheet_by_id", "SELECT id, status, site FROM job_sheets WHERE id = 7 LIMIT 1", "job_sheets")
def _(v):
    return R.find(v.job_sheets, id=7).select("id", "status", "site")


@query("job_sheet_page", "SELECT id, status, site, technician_id FROM job_sheets WHERE status = 'pending' AND site = 'site_2' ORDER BY created_at DESC, id LIMIT 50 OFFSET 10", "job_sheets")
def _(v):
    f = R.where_given(v.job_sheets, status="pending", site="site_2", technician_id=0)
    return R.page(f, [F.desc("created_at"), F.col("id")], 50, 10).select("id", "status", "site", "technician_id")


@query("job_sheet_page_with_total", "SELECT id, count(*) OVER () AS total FROM job_sheets WHERE status = 'completed' ORDER BY created_at DESC, id LIMIT 20", "job_sheets")
def _(v):
    return R.page_with_total(v.job_sheets.filter("status = 'completed'"), [F.desc("created_at"), F.col("id")], 20).select("id", "total")


@query("critical_findings", "SELECT issue_id, severity FROM issues WHERE severity IN ('S0', 'S1') AND occurred_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'", "issues")
def _(v):
    return A.between(v.issues, "occurred_at", "1996-01-01", "1996-06-30").filter(F.col("severity").isin("S0", "S1")).select("issue_id", "severity")


@query("validated_field_tab", "SELECT doc_id, rule_id, status FROM golden WHERE status IN ('failed', 'error')", "golden")
def _(v):
    return v.golden.filter(F.col("status").isin("failed", "error")).select("doc_id", "rule_id", "status")


@query("ambiguous_audits", "SELECT audit_id FROM audits WHERE list_contains(reason_codes, 'LOW_CONFIDENCE') OR list_contains(reason_codes, 'CONFLICT')", "audits")
def _(v):
    return v.audits.filter(F.arrays_overlap("reason_codes", F.array(F.lit("LOW_CONFIDENCE"), F.lit("CONFLICT")))).select("audit_id")


@query("reasons_of_engineer", "SELECT DISTINCT reason_code FROM (SELECT unnest(reason_codes) AS reason_code FROM audits WHERE engineer_id = 3)", "audits")
def _(v):
    return v.audits.filter("engineer_id = 3").select(F.explode("reason_codes").alias("reason_code")).distinct()


@query("search_customers", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00012') OR contains(lower(c_mktsegment), 'auto')")
def _(v):
    return v.table("customer").filter(F.lower("c_name").contains("00012") | F.lower("c_mktsegment").contains("auto")).select("c_custkey", "c_name")


@query("page_hint_filter", """SELECT doc_id, rule_id FROM (SELECT *, max(CASE WHEN rule_id = 'R2' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS hit FROM golden) WHERE hit = 0 OR rule_id = 'R2'""", "golden")
def _(v):
    hit = F.max((F.col("rule_id") == "R2").cast("int")).over(Window.partitionBy("doc_id"))
    return v.golden.withColumn("_hit", hit).filter("_hit = 0 OR rule_id = 'R2'").select("doc_id", "rule_id")


# --- ranks and orders ---------------------------------------------------------------------


@query("latest_audit_per_engineer", "SELECT engineer_id, audit_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY engineer_id ORDER BY audited_at DESC, audit_id DESC) AS rn FROM audits) WHERE rn = 1", "audits")
def _(v):
    return R.latest_per_key(v.audits.select("engineer_id", "audit_id", "outcome", "audited_at"), ["engineer_id"], "audited_at", "audit_id").select("engineer_id", "audit_id", "outcome")


@query("severity_order", "SELECT severity, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'S0' THEN 0 WHEN 'S1' THEN 1 WHEN 'S2' THEN 2 WHEN 'S3' THEN 3 ELSE 99 END, severity) AS BIGINT) AS place FROM (SELECT DISTINCT severity FROM issues)", "issues")
def _(v):
    d = v.issues.select("severity").distinct()
    return d.select("severity", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(S.rank_of(F.col("severity"), ("S0", "S1", "S2", "S3")), "severity")).cast("long").alias("place"))


@query("natural_rule_order", "SELECT rule, CAST(row_number() OVER (ORDER BY regexp_replace(rule, '[0-9]+', '', 'g'), CAST(regexp_extract(rule, '([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS place FROM (SELECT DISTINCT 'R' || (l_linenumber * 5) AS rule FROM lineitem)")
def _(v):
    d = v.table("lineitem").select(F.concat(F.lit("R"), (F.col("l_linenumber") * 5).cast("string")).alias("rule")).distinct()
    return d.select("rule", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*R.natural_order(F.col("rule")))).cast("long").alias("place"))


@query("review_queue_priority", "SELECT id, site FROM job_sheets WHERE status = 'review_queue' ORDER BY site, created_at, id LIMIT 30", "job_sheets")
def _(v):
    return R.page(v.job_sheets.filter("status = 'review_queue'"), [F.col("site"), F.col("created_at"), F.col("id")], 30).select("id", "site")


@query("sortedness_check", "SELECT doc_id, list(rule_id ORDER BY _n) = list_sort(list(rule_id ORDER BY _n)) AS sorted FROM golden GROUP BY doc_id", "golden")
def _(v):
    g = v.golden.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "rule_id"))), lambda x: x["rule_id"]).alias("ids"))
    return g.select("doc_id", (F.col("ids") == F.array_sort("ids")).alias("sorted"))


@query("top_and_runner_up", """WITH n AS (SELECT engineer_id, issue_type, count(*) AS n FROM issues GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY engineer_id ORDER BY n DESC, issue_type) AS rn FROM n)
 SELECT engineer_id, max(issue_type) FILTER (rn = 1) AS top, max(n) FILTER (rn = 1) AS top_score, max(issue_type) FILTER (rn = 2) AS runner_up, coalesce(max(n) FILTER (rn = 2), 0) AS runner_up_score, max(n) FILTER (rn = 1) - coalesce(max(n) FILTER (rn = 2), 0) AS gap FROM w GROUP BY engineer_id""", "issues")
def _(v):
    return R.top_and_runner_up(v.issues.groupBy("engineer_id", "issue_type").agg(F.count("*").alias("n")), "engineer_id", "n", "issue_type")


@query("order_index", "SELECT doc_id, rule_id, row_number() OVER (PARTITION BY doc_id ORDER BY rule_id) - 1 AS order_index FROM golden", "golden")
def _(v):
    return v.golden.select("doc_id", "rule_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("rule_id")) - 1).cast("long").alias("order_index"))


@query("consensus_vote", f"""WITH g AS (SELECT l_orderkey AS doc_id, l_returnflag AS value, count(*) AS n, min(l_linenumber) AS o, max(l_quantity) AS c FROM lineitem GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o, value) AS rn FROM g)
 SELECT doc_id, value, n, {r('least(100.0, c + least(10 * (n - 1), 15))')} AS confidence FROM w WHERE rn = 1""")
def _(v):
    votes = v.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("value"), F.col("l_linenumber").alias("ordinal"), F.col("l_quantity").alias("confidence"))
    return R.consensus(votes, ["doc_id"]).withColumn("confidence", S.r6(F.col("confidence")))


@query("stage_durations", "SELECT run_id, state, t - lag(t) OVER (PARTITION BY run_id ORDER BY seq) AS duration FROM (SELECT *, CAST(sum(ms) OVER (PARTITION BY run_id ORDER BY seq) AS BIGINT) AS t FROM run_events)", "run_events")
def _(v):
    at = F.sum("ms").over(Window.partitionBy("run_id").orderBy("seq"))
    return R.stage_durations(v.run_events.withColumn("at", at)).select("run_id", "state", "duration")


@query("run_over_run_deltas", f"""WITH m AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS run, 'pass2_rate' AS metric, {r("avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END)")} AS value FROM lineitem GROUP BY ALL UNION ALL SELECT CAST(year(l_shipdate) AS INTEGER), 'accuracy', {r("avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0 END)")} FROM lineitem GROUP BY ALL),
 d AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY run) AS previous FROM m), e AS (SELECT *, {r('value - previous')} AS delta FROM d WHERE previous IS NOT NULL)
 SELECT *, {r('CASE WHEN previous > 0 THEN delta / previous * 100 ELSE 0 END')} AS delta_percent, CASE WHEN (CASE WHEN metric = 'pass2_rate' THEN -delta ELSE delta END) > 0.01 THEN 'improving' WHEN (CASE WHEN metric = 'pass2_rate' THEN -delta ELSE delta END) < -0.01 THEN 'degrading' ELSE 'stable' END AS trend FROM e""")
def _(v):
    g = v.table("lineitem").groupBy(F.year("l_shipdate").alias("run")).agg(S.r6(F.avg((F.col("l_returnflag") == "R").cast("double"))).alias("pass2_rate"), S.r6(F.avg((F.col("l_linestatus") == "F").cast("double"))).alias("accuracy"))
    return R.run_deltas(g.unpivot(["run"], ["pass2_rate", "accuracy"], "metric", "value"), ["pass2_rate"])


# --- joins and sets -----------------------------------------------------------------------


@query("template_versions", "SELECT s_suppkey % 5 AS template, count(p_partkey) AS versions, coalesce(max(p_partkey), 0) AS active FROM supplier LEFT JOIN part ON p_partkey % 40 = s_suppkey AND p_size > 10 GROUP BY 1")
def _(v):
    p = v.table("part").filter("p_size > 10").groupBy((F.col("p_partkey") % 40).alias("s_suppkey")).agg(F.count("*").alias("n"), F.max("p_partkey").alias("m"))
    return v.table("supplier").join(p, "s_suppkey", "left").groupBy((F.col("s_suppkey") % 5).alias("template")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("versions"), F.coalesce(F.max("m"), F.lit(0)).alias("active"))


@query("dispute_chain", "SELECT n_name, count(*) AS findings FROM issues JOIN job_sheets ON document_id = id JOIN customer ON technician_id = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE severity = 'S0' GROUP BY n_name", "issues", "job_sheets")
def _(v):
    j = v.issues.filter("severity = 'S0'").join(v.job_sheets, F.col("document_id") == F.col("id")).join(v.table("customer"), F.col("technician_id") == F.col("c_custkey"))
    return j.join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("findings"))


@query("threshold_lookup", "WITH t(ord, name, threshold) AS (VALUES (0, 'field_2', 0.9), (1, '*', 0.7), (2, 'field_3', 0.5)), f AS (SELECT DISTINCT field FROM golden) SELECT field, CAST(arg_min(threshold, ord) AS DOUBLE) AS threshold FROM f JOIN t ON name = field OR name = '*' GROUP BY field", "golden")
def _(v):
    t = v.spark.createDataFrame([(0, "field_2", 0.9), (1, "*", 0.7), (2, "field_3", 0.5)], "ord int, name string, threshold double")
    f = v.golden.select("field").distinct()
    return f.join(F.broadcast(t), (F.col("name") == F.col("field")) | (F.col("name") == "*")).groupBy("field").agg(F.min_by("threshold", "ord").alias("threshold"))


@query("region_overlaps", """WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, l_linenumber AS idx, l_quantity AS x, l_discount * 100 AS y, 5.0 AS w, 4.0 AS h FROM lineitem)
 SELECT a.doc_id, a.page, a.idx AS first, b.idx AS second FROM b a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page AND a.idx < b.idx WHERE NOT (a.x + a.w < b.x OR b.x + b.w < a.x OR a.y + a.h < b.y OR b.y + b.h < a.y)""")
def _(v):
    return R.overlapping(v.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), F.col("l_linenumber").alias("idx"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.lit(5.0).alias("w"), F.lit(4.0).alias("h")))


@query("waived_reports", "SELECT document_id, bool_and(issue_id % 3 = 0) AS waived FROM issues WHERE severity = 'S0' GROUP BY document_id", "issues")
def _(v):
    critical = v.issues.filter("severity = 'S0'")
    open_ = critical.join(critical.filter("issue_id % 3 = 0").select("issue_id"), "issue_id", "left_anti").select("document_id").distinct().withColumn("waived", F.lit(False))
    return critical.select("document_id").distinct().join(open_, "document_id", "left").select("document_id", F.coalesce("waived", F.lit(True)).alias("waived"))


@query("retention_eligible", "SELECT id FROM job_sheets WHERE created_at < TIMESTAMP '1999-01-01' - INTERVAL 365 DAY AND id NOT IN (SELECT id FROM job_sheets WHERE id % 10 = 3)", "job_sheets")
def _(v):
    holds = v.job_sheets.filter("id % 10 = 3").select(F.col("id").alias("entity_id"), F.col("created_at").alias("placed_at"), F.lit(None).cast("timestamp").alias("released_at"))
    return R.eligible_for_retention(v.job_sheets, holds.withColumn("placed_at", F.lit("1990-01-01").cast("timestamp")), "1999-01-01", 365).select("id")


@query("spec_diff", "WITH o AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 7 > 0), n AS (SELECT p_partkey, p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS p_size FROM part WHERE p_partkey % 11 > 0) SELECT p_partkey, CASE WHEN o.p_size IS NULL THEN 'added' WHEN n.p_size IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n USING (p_partkey) WHERE o.p_size IS DISTINCT FROM n.p_size")
def _(v):
    p = v.table("part")
    return R.diff(p.filter("p_partkey % 7 > 0"), p.filter("p_partkey % 11 > 0").withColumn("p_size", F.col("p_size") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)), "p_partkey", "p_size")


@query("spec_layering", """WITH RECURSIVE p AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey >= 5 THEN n_nationkey - 5 END AS parent FROM nation), c(leaf, id, depth) AS (SELECT id, id, 0 FROM p UNION ALL SELECT c.leaf, p.parent, c.depth + 1 FROM c JOIN p ON c.id = p.id WHERE p.parent IS NOT NULL),
 s AS (SELECT n_nationkey AS id, 'f' || (n_nationkey % 3) AS field, 'label' AS property, n_name AS value FROM nation) SELECT leaf, field, property, arg_min(value, depth) AS value FROM c JOIN s USING (id) GROUP BY ALL""")
def _(v):
    n = v.table("nation")
    parents = n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") >= 5, F.col("n_nationkey") - 5).alias("parent"))
    specs = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("f"), (F.col("n_nationkey") % 3).cast("string")).alias("field"), F.lit("label").alias("property"), F.col("n_name").alias("value"))
    return R.layered(specs, parents)


@query("missing_fields", "WITH d AS (SELECT doc_id, list(field) AS have FROM golden GROUP BY doc_id) SELECT doc_id, list_sort(list_filter(['field_1', 'field_2', 'field_3', 'field_4'], lambda x: NOT list_contains(have, x)))::VARCHAR AS missing FROM d", "golden")
def _(v):
    want = F.array(*[F.lit(f"field_{i}") for i in range(1, 5)])
    g = v.golden.groupBy("doc_id").agg(F.array_sort(F.array_except(want, F.collect_set("field"))).alias("m"))
    return g.select("doc_id", F.concat(F.lit("["), F.array_join("m", ", "), F.lit("]")).alias("missing"))


@query("document_key_union", "SELECT doc_id FROM golden UNION SELECT doc_id FROM actual", "golden", "actual")
def _(v):
    return v.golden.select("doc_id").union(v.actual.select("doc_id")).distinct()


@query("findings_one_to_one", "SELECT coalesce(g.reason_code, a.reason_code) AS reason_code, coalesce(g.n, 0) AS expected, coalesce(a.n, 0) AS actual, least(coalesce(g.n, 0), coalesce(a.n, 0)) AS matched FROM (SELECT reason_code, count(*) AS n FROM golden WHERE reason_code IS NOT NULL GROUP BY 1) g FULL JOIN (SELECT reason_code, count(*) AS n FROM actual WHERE reason_code IS NOT NULL GROUP BY 1) a USING (reason_code)", "golden", "actual")
def _(v):
    return R.bag_intersection(v.golden.filter("reason_code IS NOT NULL"), v.actual.filter("reason_code IS NOT NULL"), ["reason_code"])


@query("duplicate_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 20")
def _(v):
    return v.table("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).filter("n > 20")


@query("all_violations", "SELECT 'golden' AS side, doc_id, rule_id FROM golden WHERE status = 'failed' UNION ALL SELECT 'actual', doc_id, rule_id FROM actual WHERE status = 'failed'", "golden", "actual")
def _(v):
    pick = lambda df, side: df.filter("status = 'failed'").select(F.lit(side).alias("side"), "doc_id", "rule_id")
    return pick(v.golden, "golden").unionByName(pick(v.actual, "actual"))


# --- mutations as projections -------------------------------------------------------------


@query("upsert_users", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'admin' ELSE c_mktsegment END AS c_mktsegment, c_name FROM customer UNION ALL SELECT c_custkey + 1000000, 'admin', NULL FROM customer WHERE c_custkey % 50 = 0")
def _(v):
    c = v.table("customer").select("c_custkey", "c_mktsegment", "c_name")
    delta = c.filter("c_custkey % 4 = 0").select("c_custkey", F.lit("admin").alias("c_mktsegment")).unionByName(c.filter("c_custkey % 50 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("admin").alias("c_mktsegment")))
    return R.merge(c, delta, "c_custkey")


@query("activate_spec", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN p_partkey = 5 ELSE p_size > 25 END AS is_active FROM part")
def _(v):
    p = v.table("part").select("p_partkey", "p_brand", (F.col("p_size") > 25).alias("is_active"))
    return R.activate(p, 5, "Brand#11", "p_partkey", "p_brand").select("p_partkey", "is_active")


@query("append_with_ids", "SELECT r_name, (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_name) AS id FROM region")
def _(v):
    return R.with_new_ids(v.table("nation").select(F.col("n_nationkey").cast("long").alias("id")), v.table("region").select("r_name"), ["r_name"]).select("r_name", "id")


@query("close_disputes", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'accepted' WHEN o_orderkey % 3 = 1 THEN 'rejected' ELSE 'open' END AS status, CASE WHEN o_orderkey % 3 < 2 THEN '2024-01-17' END AS resolved_on FROM orders")
def _(v):
    status = F.when(F.col("o_orderkey") % 3 == 0, "accepted").when(F.col("o_orderkey") % 3 == 1, "rejected").otherwise("open")
    return v.table("orders").select("o_orderkey", status.alias("status"), F.when(status.isin("accepted", "rejected"), F.lit("2024-01-17")).alias("resolved_on"))


@query("settings_overlay", "WITH d(k, v) AS (VALUES ('minConfidence', '70'), ('maxPages', '50'), ('retries', '3')), s(k, v) AS (VALUES ('maxPages', '10'), ('unknown', '1')) SELECT d.k AS setting, coalesce(s.v, d.v) AS value FROM d LEFT JOIN s ON d.k = s.k")
def _(v):
    d = v.spark.createDataFrame([("minConfidence", "70"), ("maxPages", "50"), ("retries", "3")], "setting string, _d string")
    s = v.spark.createDataFrame([("maxPages", '{"value": 10}'), ("unknown", '{"value": 1}')], "setting string, _s string")
    return d.join(s, "setting", "left").select("setting", F.coalesce(F.get_json_object("_s", "$.value"), "_s", "_d").alias("value"))


# --- counts by state ----------------------------------------------------------------------


@query("review_queue_stats", "SELECT site, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'review_queue') AS review_queue FROM job_sheets GROUP BY site", "job_sheets")
def _(v):
    return v.job_sheets.groupBy("site").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "pending", "review_queue")])


@query("invalid_transitions", """WITH p AS (SELECT run_id, seq, CASE WHEN run_id % 9 = 0 AND seq = 1 THEN 'COMPLETE' ELSE state END AS state FROM run_events), q AS (SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY seq) AS previous FROM p)
 SELECT run_id, seq, state, previous FROM q WHERE CASE WHEN previous IS NULL THEN state <> 'QUEUED' ELSE (previous, state) NOT IN (('QUEUED', 'OCR'), ('OCR', 'EXTRACT'), ('EXTRACT', 'VALIDATE'), ('VALIDATE', 'COMPLETE'), ('QUEUED', 'FAILED'), ('OCR', 'FAILED'), ('EXTRACT', 'FAILED'), ('VALIDATE', 'FAILED'), ('FAILED', 'QUEUED')) END""", "run_events")
def _(v):
    e = v.run_events.withColumn("state", F.when((F.col("run_id") % 9 == 0) & (F.col("seq") == 1), "COMPLETE").otherwise(F.col("state")))
    return R.invalid_transitions(e).select("run_id", "seq", "state", "previous")


@query("idempotent_starts", """SELECT event_id AS run_id FROM (SELECT *, event_type = 'error' AS failed, user_id % 11 = 0 AS forced, row_number() OVER (PARTITION BY user_id % 50, props, event_type = 'error' OR user_id % 11 = 0 ORDER BY ts, event_id) AS n FROM events)
 WHERE failed OR forced OR n = 1""")
def _(v):
    e = v.table("events")
    runs = e.select(F.concat_ws(":", (F.col("user_id") % 50).cast("string"), "props").alias("input_hash"), F.col("event_id").alias("run_id"), F.col("ts").alias("at"),
                    F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETE").alias("state"), (F.col("user_id") % 11 == 0).alias("forced"))
    return started_once(runs).select("run_id")


@query("determinism_check", "SELECT l_partkey, count(DISTINCT l_returnflag) AS outputs FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def _(v):
    return v.table("lineitem").groupBy("l_partkey").agg(F.count_distinct("l_returnflag").alias("outputs")).filter("outputs > 1")


FAILURES = ("Request TIMEOUT after 30 s", "Rate limit exceeded", "Invalid file", "connect ECONNRESET", "HTTP 404", "HTTP 503")


# The store keeps its latest 1000 failures; that bound is the feature.
@query("dead_letter_stats", f"""SELECT event_type AS stage, count(*) AS n, count(*) FILTER (user_id % 6 IN (0, 1, 3, 5)) AS recoverable, count(*) FILTER (user_id % 6 IN (2, 4)) AS unrecoverable, CAST(min(epoch_us(ts)) AS BIGINT) AS oldest_us
 FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 1000) GROUP BY 1""")
def _(v):
    message = F.get(F.array(*map(F.lit, FAILURES)), (F.col("user_id") % 6).cast("int"))
    f = v.table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("created_at"), message.alias("message"))
    return dead_letters(f).groupBy("stage").agg(F.count("*").alias("n"), F.count_if("recoverable").alias("recoverable"), F.count_if(~F.col("recoverable")).alias("unrecoverable"),
                                                F.min(F.unix_micros("created_at")).alias("oldest_us"))


@query("live_metrics", f"SELECT event_type AS metric, count(*) AS counter, {r('arg_max(value, event_id)')} AS gauge FROM events GROUP BY 1")
def _(v):
    return v.table("events").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("counter"), S.r6(F.max_by("value", "event_id")).alias("gauge"))


@query("latency_percentiles", f"SELECT user_id, {r('quantile_disc(value, 0.5)')} AS p50, {r('quantile_disc(value, 0.95)')} AS p95, {r('quantile_disc(value, 0.99)')} AS p99, {r('avg(value)')} AS mean FROM events GROUP BY 1")
def _(v):
    p = lambda q: S.r6(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)"))
    return v.table("events").groupBy("user_id").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), S.r6(F.avg("value")).alias("mean"))


@query("confidence_statistics", f"SELECT engineer_id, {r('var_pop(confidence * 10)')} AS variance, {r('exp(avg(ln(greatest(confidence, 0.0001))))')} AS geometric_mean, {r('min(confidence) * 0.4 + avg(confidence) * 0.6')} AS quality FROM audits GROUP BY 1", "audits")
def _(v):
    c = F.col("confidence")
    return v.audits.groupBy("engineer_id").agg(S.r6(F.var_pop(c * 10)).alias("variance"), S.r6(F.exp(F.avg(F.ln(F.greatest(c, F.lit(0.0001)))))).alias("geometric_mean"), S.r6(F.min(c) * 0.4 + F.avg(c) * 0.6).alias("quality"))


@query("fixed_window_counts", "SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS win, count(*) AS n, count(*) > 3 AS over_limit FROM events GROUP BY ALL")
def _(v):
    return v.table("events").groupBy("user_id", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("win")).agg(F.count("*").alias("n"), (F.count("*") > 3).alias("over_limit"))


@query("registry_counts", "SELECT 'job_sheets' AS store, count(*) AS n FROM job_sheets UNION ALL SELECT 'issues', count(*) FROM issues UNION ALL SELECT 'audits', count(*) FROM audits", "job_sheets", "issues", "audits")
def _(v):
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
    return n(v.job_sheets, "job_sheets").unionByName(n(v.issues, "issues")).unionByName(n(v.audits, "audits"))
