"""Scorecards, cockpits, periodic reports, selection analytics and issue trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import audits as A
from ..sources.tables import ISSUE_TYPES
from .registry import query

AS_OF = "2024-01-17"
WEEK = "audited_at >= TIMESTAMP '2024-01-14' AND audited_at < TIMESTAMP '2024-01-21'"
MONTH = "audited_at >= TIMESTAMP '2024-01-01' AND audited_at < TIMESTAMP '2024-02-01'"
DAY = "audited_at >= TIMESTAMP '2024-01-17' AND audited_at < TIMESTAMP '2024-01-18'"
START, END = "1995-01-01", "2001-12-31"


def r(x: str, n: int = 6) -> str:
    return f"floor(({x})::DOUBLE * 1e{n} + 0.5) / 1e{n}"


OUTCOMES = f"""CAST(count(*) AS BIGINT) AS total_audits, count(*) FILTER (outcome = 'VALID') AS valid_count, count(*) FILTER (outcome = 'INVALID') AS invalid_count,
 count(*) FILTER (outcome = 'REVIEW_QUEUE') AS review_count, {r("avg(CASE WHEN outcome = 'VALID' THEN 1.0 ELSE 0.0 END)")} AS valid_rate, {r('avg(confidence)')} AS avg_confidence"""


def codes(by: str, where: str) -> str:
    b = f"{by}, " if by else ""
    return f"SELECT {b}reason_code, count(*) AS n FROM (SELECT {b}unnest(reason_codes) AS reason_code FROM audits WHERE {where}) GROUP BY {b}reason_code"


def scorecard_sql(key: str, where: str) -> str:
    return f"""WITH w AS (SELECT * FROM audits WHERE {where}), c AS ({codes(key, where)}),
 t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, reason_code) AS rn FROM c) WHERE rn = 1)
 SELECT w.{key}, {OUTCOMES}, CAST(sum(fields_extracted) AS BIGINT) AS fields_extracted_total, CAST(sum(fields_missing) AS BIGINT) AS fields_missing_total, CAST(sum(fields_low_confidence) AS BIGINT) AS fields_low_confidence_total,
 max(t.reason_code) AS top_reason, max(t.n) AS top_reason_count FROM w LEFT JOIN t ON w.{key} = t.{key} GROUP BY w.{key}"""


def week(v):
    return A.in_period(v.audits, "audited_at", AS_OF, "weekly")


@query("engineer_scorecard", scorecard_sql("engineer_id", WEEK), "audits")
def _(v):
    return A.scorecards(week(v), "engineer_id")


for _key in ("customer_id", "template_id"):
    query(f"scorecard_by_{_key}", scorecard_sql(_key, MONTH), "audits")(
        lambda v, key=_key: A.scorecards(A.in_period(v.audits, "audited_at", AS_OF, "monthly"), key))


@query("reason_distribution", f"SELECT reason_code, n, {r('n * 100.0 / sum(n) OVER ()')} AS share FROM ({codes('', WEEK)})", "audits")
def _(v):
    return A.reason_counts(week(v))


@query("engineer_top_reasons", f"SELECT * FROM (SELECT *, {r('n * 100.0 / sum(n) OVER (PARTITION BY engineer_id)')} AS share, CAST(row_number() OVER (PARTITION BY engineer_id ORDER BY n DESC, reason_code) AS INTEGER) AS rank FROM ({codes('engineer_id', WEEK)})) WHERE rank <= 5", "audits")
def _(v):
    return A.top_per_group(A.reason_counts(week(v), "engineer_id"), ["engineer_id"], [F.desc("n"), F.col("reason_code")], 5)


@query("engineer_cards", f"""WITH w AS (SELECT * FROM audits WHERE {WEEK}), t AS (SELECT *, {r('n * 100.0 / sum(n) OVER (PARTITION BY engineer_id)')} AS share, row_number() OVER (PARTITION BY engineer_id ORDER BY n DESC, reason_code) AS rank FROM ({codes('engineer_id', WEEK)})),
 x AS (SELECT engineer_id, string_agg(reason_code || ':' || n, ',' ORDER BY rank) AS reasons FROM t WHERE rank <= 5 GROUP BY 1), p AS (SELECT engineer_id, template_id, {OUTCOMES} FROM w GROUP BY 1, 2), q AS (SELECT engineer_id, string_agg(template_id || ':' || total_audits, ',' ORDER BY template_id) AS templates FROM p GROUP BY 1)
 SELECT s.*, reasons, templates FROM (SELECT engineer_id, {OUTCOMES} FROM w GROUP BY 1) s LEFT JOIN x ON x.engineer_id = s.engineer_id LEFT JOIN q ON q.engineer_id = s.engineer_id""", "audits")
def _(v):
    cards = A.engineer_cards(week(v))
    said = lambda c, name, n: F.array_join(F.transform(c, lambda x: F.concat(x[name].cast("string"), F.lit(":"), x[n].cast("string"))), ",")
    kept = [c for c in week(v).groupBy("engineer_id").agg(*A.outcome_counts()).columns]
    return cards.select(*kept, said("reasons", "reason_code", "n").alias("reasons"), said("templates", "template_id", "total_audits").alias("templates"))


@query("engineer_template_breakdown", f"SELECT engineer_id, template_id, {OUTCOMES} FROM audits WHERE {WEEK} GROUP BY engineer_id, template_id", "audits")
def _(v):
    return week(v).groupBy("engineer_id", "template_id").agg(*A.outcome_counts())


def _dimension(column: int) -> str:
    return "CASE reason_code " + " ".join(f"WHEN '{k}' THEN '{d[column]}'" for k, d in A.REASONS.items())


@query("engineer_fix_pack", f"""WITH x AS (SELECT engineer_id, audit_id, unnest(reason_codes) AS reason_code FROM audits WHERE {WEEK} AND outcome <> 'VALID'),
 y AS (SELECT *, row_number() OVER (PARTITION BY engineer_id, reason_code ORDER BY audit_id) AS rn FROM x)
 SELECT engineer_id, reason_code, count(*) AS occurrences, string_agg(CAST(audit_id AS VARCHAR), ',' ORDER BY audit_id) FILTER (rn <= 3) AS example_audits,
 {_dimension(2)} ELSE 'info' END AS category, {_dimension(0)} ELSE 'Unknown issue' END AS description, {_dimension(1)} ELSE 'Contact support for assistance' END AS recommendation
 FROM y GROUP BY engineer_id, reason_code""", "audits")
def _(v):
    return A.fix_packs(week(v), "engineer_id")


@query("fix_pack_summary", f"""WITH x AS (SELECT engineer_id, unnest(reason_codes) AS reason_code FROM audits WHERE {WEEK} AND outcome <> 'VALID'), y AS (SELECT *, {_dimension(2)} ELSE 'info' END AS category FROM x)
 SELECT engineer_id, count(*) AS total_issues, count(*) FILTER (category = 'critical') AS critical_issues, count(*) FILTER (category = 'warning') AS warning_issues, count(*) FILTER (category = 'info') AS info_issues FROM y GROUP BY engineer_id""", "audits")
def _(v):
    p = A.fix_packs(week(v), "engineer_id")
    part = lambda c: F.sum(F.when(F.col("category") == c, F.col("occurrences")).otherwise(0))
    return p.groupBy("engineer_id").agg(F.sum("occurrences").alias("total_issues"), *[part(c).alias(f"{c}_issues") for c in A.CATEGORIES])


QUALITY = f"""SELECT template_id, count(*) AS total_audits, {r("avg(CASE WHEN outcome = 'VALID' THEN 1.0 ELSE 0.0 END)")} AS valid_rate, {r('avg(confidence)')} AS avg_confidence,
 {r("avg(CASE WHEN list_contains(reason_codes, 'LOW_CONFIDENCE') OR list_contains(reason_codes, 'CONFLICT') THEN 1.0 ELSE 0.0 END)")} AS ambiguity_rate FROM audits WHERE {WEEK} GROUP BY template_id"""


@query("template_quality", f"SELECT *, {r('valid_rate - ambiguity_rate')} AS attention FROM ({QUALITY})", "audits")
def _(v):
    return A.template_quality(week(v))


@query("template_attention_order", f"SELECT template_id, CAST(row_number() OVER (ORDER BY {r('valid_rate - ambiguity_rate')}, template_id) AS BIGINT) AS place FROM ({QUALITY})", "audits")
def _(v):
    from pyspark.sql import Window

    return A.template_quality(week(v)).select("template_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("attention", "template_id")).cast("long").alias("place"))


@query("cockpit_overall", f"""SELECT count(*) AS total_templates, CAST(sum(total_audits) AS BIGINT) AS total_audits, {r('avg(valid_rate)')} AS average_valid_rate, {r('avg(avg_confidence)')} AS average_confidence,
 count(*) FILTER (ambiguity_rate > 0.2) AS templates_with_high_ambiguity, count(*) FILTER (valid_rate < 0.8) AS templates_needing_attention FROM ({QUALITY})""", "audits")
def _(v):
    return A.cockpit_overall(week(v))


@query("cockpit_top_issues", f"""WITH c AS ({codes('', WEEK)}), o AS (SELECT reason_code, count(*) AS affected_templates FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY n DESC, reason_code) AS rn FROM ({codes('template_id', WEEK)})) WHERE rn <= 5 GROUP BY reason_code)
 SELECT c.reason_code, n AS total_occurrences, coalesce(affected_templates, 0) AS affected_templates FROM (SELECT * FROM c ORDER BY n DESC, reason_code LIMIT 5) c LEFT JOIN o ON c.reason_code = o.reason_code""", "audits")
def _(v):
    return A.cockpit_issues(week(v))


@query("daily_summary", f"SELECT {OUTCOMES} FROM audits WHERE {DAY}", "audits")
def _(v):
    return A.in_period(v.audits, "audited_at", AS_OF, "daily").agg(*A.outcome_counts())


@query("daily_top_lists", f"""WITH d AS (SELECT * FROM audits WHERE {DAY}), g AS (SELECT 'engineer' AS kind, CAST(engineer_id AS VARCHAR) AS name, count(*) AS n FROM d GROUP BY engineer_id UNION ALL SELECT 'template', CAST(template_id AS VARCHAR), count(*) FROM d GROUP BY template_id
 UNION ALL SELECT 'reason', reason_code, count(*) FROM (SELECT unnest(reason_codes) AS reason_code FROM d) GROUP BY reason_code) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS INTEGER) AS rank FROM g) WHERE rank <= 5""", "audits")
def _(v):
    d = A.in_period(v.audits, "audited_at", AS_OF, "daily")
    names = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("name")) for k, c in (("engineer", "engineer_id"), ("template", "template_id"))])
    every = F.concat(names, F.transform("reason_codes", lambda x: F.struct(F.lit("reason").alias("kind"), x.alias("name"))))
    g = d.select(F.explode(every).alias("e")).groupBy("e.kind", "e.name").agg(F.count("*").alias("n"))
    return A.top_per_group(g, ["kind"], [F.desc("n"), F.col("name")], 5)


@query("weekly_fix_packs", f"SELECT engineer_id, CAST(sum(len(reason_codes)) AS BIGINT) AS issues FROM audits WHERE {WEEK} AND outcome <> 'VALID' GROUP BY engineer_id HAVING sum(len(reason_codes)) > 0", "audits")
def _(v):
    return A.fix_packs(week(v), "engineer_id").groupBy("engineer_id").agg(F.sum("occurrences").alias("issues")).filter("issues > 0")


@query("monthly_totals", f"SELECT {OUTCOMES}, count(DISTINCT engineer_id) AS engineers, count(DISTINCT template_id) AS templates FROM audits WHERE {MONTH}", "audits")
def _(v):
    return A.in_period(v.audits, "audited_at", AS_OF, "monthly").agg(*A.outcome_counts(), F.count_distinct("engineer_id").alias("engineers"), F.count_distinct("template_id").alias("templates"))


for _name, _key, _default in (("monthly_by_customer", "customer_id", "Unknown"), ("monthly_by_asset", "asset_type", "Unknown")):
    _m = f"(SELECT * REPLACE (coalesce({_key}, '{_default}') AS {_key}) FROM audits WHERE {MONTH})"
    query(_name, f"""WITH m AS {_m}, c AS (SELECT {_key}, reason_code, count(*) AS n FROM (SELECT {_key}, unnest(reason_codes) AS reason_code FROM m) GROUP BY ALL),
 t AS (SELECT {_key}, string_agg(reason_code, ',' ORDER BY rn) AS top_reasons FROM (SELECT *, row_number() OVER (PARTITION BY {_key} ORDER BY n DESC, reason_code) AS rn FROM c) WHERE rn <= 3 GROUP BY {_key}),
 a AS (SELECT {_key}, count(*) AS audits, {r("avg(CASE WHEN outcome = 'VALID' THEN 1.0 ELSE 0.0 END)")} AS valid_rate FROM m GROUP BY {_key})
 SELECT a.*, top_reasons FROM a LEFT JOIN t ON a.{_key} = t.{_key}""", "audits")(
        lambda v, key=_key, default=_default: A.breakdown(A.in_period(v.audits, "audited_at", AS_OF, "monthly"), key, default))


# --- selections ---------------------------------------------------------------------------

AMB = "gap < 0.10 AND candidates > 1"
BANDS = "count(*) FILTER (band = 'HIGH') AS high, count(*) FILTER (band = 'MEDIUM') AS medium, count(*) FILTER (band = 'LOW') AS low"
OVERVIEW = f"SELECT count(*) AS total, {BANDS}, count(*) FILTER (auto_processed) AS auto_processed, count(*) FILTER (overridden) AS overridden, count(*) FILTER ({AMB}) AS ambiguous FROM selections"


@query("selection_overview", f"{OVERVIEW} WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'", "selections")
def _(v):
    return A.selection_overview(A.between(v.selections, "ts", "2024-01-05", "2024-01-25"))


@query("ambiguous_template_pairs", f"SELECT template_slug AS template1, 'runner-up' AS template2, count(*) AS n, {r('avg(gap)')} AS avg_gap FROM selections WHERE {AMB} AND template_slug IS NOT NULL GROUP BY template_slug ORDER BY n DESC, template1 LIMIT 10", "selections")
def _(v):
    return A.ambiguous_pairs(v.selections)


@query("token_collisions", f"SELECT token, count(*) AS collisions, string_agg(DISTINCT template_slug, ',' ORDER BY template_slug) AS templates, count(DISTINCT template_slug) AS n_templates FROM (SELECT template_slug, unnest(tokens) AS token FROM selections WHERE {AMB}) GROUP BY token HAVING count(DISTINCT template_slug) > 1 ORDER BY collisions DESC, token LIMIT 20", "selections")
def _(v):
    return A.token_collisions(v.selections)


@query("template_selection_summary", f"SELECT template_slug, count(*) AS total, {BANDS}, count(*) FILTER (overridden) AS overrides, {r('avg(top_score)')} AS avg_score, CAST(0 AS BIGINT) AS runner_up FROM selections WHERE template_slug IS NOT NULL GROUP BY template_slug", "selections")
def _(v):
    return A.template_summary(v.selections)


@query("ambiguity_alert", f"SELECT {r('ambiguous * 100.0 / total')} AS ambiguity_percent, 20.0::DOUBLE AS threshold, ambiguous * 100.0 / total > 20 AS alert FROM ({OVERVIEW})", "selections")
def _(v):
    return A.ambiguity_alert(v.selections, 20.0)


@query("selection_record_page", f"SELECT id, template_slug, band, {r('gap')} AS gap, total FROM (SELECT *, count(*) OVER () AS total FROM selections WHERE {AMB} AND band = 'LOW') ORDER BY ts DESC, id LIMIT 25 OFFSET 5", "selections")
def _(v):
    f = A.ambiguous(v.selections).filter("band = 'LOW'")
    page = f.orderBy(F.desc("ts"), "id").offset(5).limit(25)
    return page.crossJoin(F.broadcast(f.agg(F.count("*").alias("total")))).select("id", "template_slug", "band", r6(F.col("gap")).alias("gap"), "total")


@query("overrides_by_confidence", "SELECT band, count(s.id) AS overrides FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) b(band) LEFT JOIN (SELECT * FROM selections WHERE overridden) s USING (band) GROUP BY band", "selections")
def _(v):
    spine = v.spark.createDataFrame([("HIGH",), ("MEDIUM",), ("LOW",)], "band string")
    n = v.selections.filter("overridden").groupBy("band").agg(F.count("*").alias("n"))
    return spine.join(n, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("overrides"))


# --- issues -------------------------------------------------------------------------------

PENALTY = "CASE severity WHEN 'S0' THEN 10 WHEN 'S1' THEN 5 WHEN 'S2' THEN 2 WHEN 'S3' THEN 1 ELSE 0 END"


@query("issue_score_cards", f"""WITH g AS (SELECT engineer_id, CAST(sum({PENALTY}) AS BIGINT) AS penalty, count(DISTINCT document_id) AS documents_with_issues, count(*) FILTER (severity = 'S0') AS s0, count(*) FILTER (severity = 'S1') AS s1,
 count(*) FILTER (severity = 'S2') AS s2, count(*) FILTER (severity = 'S3') AS s3 FROM issues WHERE occurred_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-01-20' GROUP BY engineer_id), h AS (SELECT *, greatest(0, least(100, 100 - penalty)) AS sc FROM g)
 SELECT engineer_id, penalty, documents_with_issues, s0, s1, s2, s3, CAST(sc AS BIGINT) AS score, CASE WHEN sc - 85 > 5 THEN 'improving' WHEN sc - 85 < -5 THEN 'declining' ELSE 'stable' END AS trend, {r('documents_with_issues / 100.0::DOUBLE', 2)} AS issue_rate FROM h""", "issues")
def _(v):
    return A.issue_score_cards(A.between(v.issues, "occurred_at", "1996-01-01", "1996-01-20"), 100)


@query("issues_by_type", f"SELECT issue_type, count(*) AS n, {r('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)', 2)} AS share FROM issues GROUP BY issue_type", "issues")
def _(v):
    return A.issues_by_type(v.issues)


@query("recurring_issues", """WITH g AS (SELECT engineer_id, issue_type, field_name, count(*) AS n, min(occurred_at) AS a, max(occurred_at) AS b FROM issues GROUP BY ALL HAVING count(*) >= 2)
 SELECT * FROM (SELECT engineer_id, row_number() OVER (PARTITION BY engineer_id ORDER BY n DESC, issue_type, field_name) AS rank, issue_type, field_name, n, CAST(CAST(a AS DATE) AS VARCHAR) AS first_on, CAST(CAST(b AS DATE) AS VARCHAR) AS last_on,
 b >= TIMESTAMP '2001-10-01' - INTERVAL 30 DAY AS is_recent FROM g) WHERE rank <= 5""", "issues")
def _(v):
    return A.recurring_issues(v.issues, "2001-10-01")


@query("issue_fix_packs", """WITH y AS (SELECT *, row_number() OVER (PARTITION BY engineer_id, issue_type, field_name ORDER BY occurred_at DESC, issue_id) AS rn FROM issues)
 SELECT engineer_id, issue_type, field_name, count(*) AS n, min(severity) AS worst, string_agg(CAST(document_id AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 3) AS examples FROM y GROUP BY engineer_id, issue_type, field_name""", "issues")
def _(v):
    return A.issue_fix_packs(v.issues)


@query("fix_pack_focus_areas", """WITH g AS (SELECT engineer_id, issue_type, field_name, count(*) AS n, min(severity) AS worst FROM issues GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY engineer_id ORDER BY worst, n DESC, issue_type, field_name) AS rn FROM g)
 SELECT engineer_id, string_agg(DISTINCT issue_type, ',' ORDER BY issue_type) AS focus_areas FROM t WHERE rn <= 3 GROUP BY engineer_id""", "issues")
def _(v):
    return A.focus_areas(v.issues)


def series_sql(days: int) -> str:
    step = days * 86400
    return f"""SELECT b AS bucket, CAST(DATE '{START}' + CAST(b * {days} AS INTEGER) AS VARCHAR) AS date, coalesce(dn, 0) AS documents, coalesce(i_n, 0) AS issues,
 CASE WHEN coalesce(dn, 0) > 0 THEN {r('coalesce(i_n, 0) / dn::DOUBLE', 2)} ELSE 0 END AS issue_rate, CAST(floor(CASE WHEN coalesce(dn, 0) > 0 THEN greatest(0.0, 100 - coalesce(i_n, 0) / dn::DOUBLE * 20) ELSE 100.0 END + 0.5) AS BIGINT) AS avg_score
 FROM (SELECT unnest(range(0, CAST(floor((epoch(TIMESTAMP '{END}') - epoch(TIMESTAMP '{START}')) / {step}) AS BIGINT) + 1)) AS b)
 LEFT JOIN (SELECT CAST(floor((epoch(processed_at) - epoch(TIMESTAMP '{START}')) / {step}) AS BIGINT) AS b, count(*) AS dn FROM processed GROUP BY 1) USING (b)
 LEFT JOIN (SELECT CAST(floor((epoch(occurred_at) - epoch(TIMESTAMP '{START}')) / {step}) AS BIGINT) AS b, count(*) AS i_n FROM issues GROUP BY 1) USING (b)"""


for _name, _days in (("day", 1), ("week", 7), ("month", 30)):
    query(f"issue_trend_by_{_name}", series_sql(_days), "issues", "processed")(lambda v, days=_days: A.trend_series(v.issues, v.processed, START, END, days))


@query("issue_overall_trend", f"""WITH s AS ({series_sql(30)}), q AS (SELECT *, row_number() OVER (ORDER BY bucket) <= floor(count(*) OVER () / 2) AS f FROM s), m AS (SELECT avg(avg_score) FILTER (f) AS a, avg(avg_score) FILTER (NOT f) AS b FROM q),
 c AS (SELECT CAST(CASE WHEN a > 0 THEN floor((b - a) / a * 100 + 0.5) ELSE 0 END AS BIGINT) AS change_percent FROM m) SELECT change_percent, CASE WHEN change_percent > 5 THEN 'improving' WHEN change_percent < -5 THEN 'declining' ELSE 'stable' END AS direction FROM c""", "issues", "processed")
def _(v):
    return A.overall_trend(A.trend_series(v.issues, v.processed, START, END, 30))


@query("issue_type_trends", f"""WITH h AS (SELECT issue_type, count(*) FILTER (occurred_at < m) AS previous, count(*) FILTER (occurred_at >= m) AS current FROM issues, (SELECT epoch_ms(CAST((epoch_ms(TIMESTAMP '{START}') + epoch_ms(TIMESTAMP '{END}')) / 2 AS BIGINT)) AS m) GROUP BY issue_type),
 g AS (SELECT t.issue_type, coalesce(previous, 0) AS previous, coalesce(current, 0) AS current FROM (VALUES {", ".join(f"('{t}')" for t in ISSUE_TYPES)}) t(issue_type) LEFT JOIN h ON h.issue_type = t.issue_type),
 c AS (SELECT *, CAST(CASE WHEN previous > 0 THEN floor((current - previous) / previous::DOUBLE * 100 + 0.5) WHEN current > 0 THEN 100 ELSE 0 END AS BIGINT) AS change_percent FROM g)
 SELECT *, CASE WHEN change_percent > 10 THEN 'increasing' WHEN change_percent < -10 THEN 'decreasing' ELSE 'stable' END AS trend FROM c""", "issues")
def _(v):
    return A.issue_type_trends(v.issues, START, END)


@query("coaching_recommendations", """WITH n AS (SELECT engineer_id, count(*) FILTER (severity = 'S0') AS s0, count(*) FILTER (issue_type = 'SIGNATURE_MISSING') AS sig FROM issues GROUP BY engineer_id),
 g AS (SELECT engineer_id, issue_type, field_name, count(*) AS n, max(occurred_at) AS b FROM issues GROUP BY ALL HAVING count(*) >= 2),
 t AS (SELECT engineer_id, count(*) FILTER (b >= TIMESTAMP '2001-10-01' - INTERVAL 30 DAY) AS rec FROM (SELECT *, row_number() OVER (PARTITION BY engineer_id ORDER BY n DESC, issue_type, field_name) AS rn FROM g) WHERE rn <= 5 GROUP BY engineer_id)
 SELECT engineer_id, 'high' AS priority, 'Address Critical Quality Issues' AS title FROM n WHERE s0 > 0 UNION ALL SELECT engineer_id, 'medium', 'Address Recurring Issue Patterns' FROM t WHERE rec > 0
 UNION ALL SELECT engineer_id, 'medium', 'Improve Signature Collection Process' FROM n WHERE sig >= 2""", "issues")
def _(v):
    return A.coaching(v.issues, "2001-10-01")


@query("training_modules", """WITH m(module, types) AS (VALUES ('signatures', ['SIGNATURE_MISSING']), ('dates', ['DATE_MISMATCH', 'INVALID_FORMAT']), ('photos', ['PHOTO_QUALITY']), ('policy', ['OUT_OF_POLICY', 'INCOMPLETE_CHECKLIST']))
 SELECT DISTINCT engineer_id, module FROM issues, m WHERE occurred_at >= TIMESTAMP '2001-10-01' AND list_contains(types, issue_type)""", "issues")
def _(v):
    m = v.spark.createDataFrame([("signatures", ["SIGNATURE_MISSING"]), ("dates", ["DATE_MISMATCH", "INVALID_FORMAT"]), ("photos", ["PHOTO_QUALITY"]), ("policy", ["OUT_OF_POLICY", "INCOMPLETE_CHECKLIST"])], "module string, types array<string>")
    late = v.issues.filter(F.col("occurred_at") >= "2001-10-01")
    return late.join(F.broadcast(m.select("module", F.explode("types").alias("issue_type"))), "issue_type").select("engineer_id", "module").distinct()


# --- folds and windows --------------------------------------------------------------------


@query("outcome_windows", "SELECT CAST(CAST(audited_at AS DATE) AS VARCHAR) AS day, engineer_id, count(*) AS audits, count(*) FILTER (outcome = 'VALID') AS valid FROM audits GROUP BY ALL", "audits")
def _(v):
    from ..streaming.folds import outcome_windows

    return outcome_windows(v.audits).select(F.to_date("start").cast("string").alias("day"), "engineer_id", "audits", "valid")


@query("user_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
 SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS events FROM s GROUP BY user_id, n""")
def _(v):
    from ..streaming.folds import sessions

    e = v.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "6 hours").select("user_id", F.unix_micros("start").alias("start_us"), "events")


def _steps(key: str, more: str) -> str:
    """Events of each key, numbered in order, for a recursive fold."""
    return f"o AS (SELECT {key} AS key, event_id AS id, epoch_us(ts) // 1000 AS at_ms, {more}row_number() OVER (PARTITION BY {key} ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events)"


@query("rate_limited_requests", f"""WITH RECURSIVE {_steps('user_id', '')}, s AS (SELECT key, id, at_ms, n, at_ms AS start, 1 AS c FROM o WHERE n = 1 UNION ALL
 SELECT o.key, o.id, o.at_ms, o.n, CASE WHEN o.at_ms < s.start + 21600000 THEN s.start ELSE o.at_ms END, CASE WHEN o.at_ms < s.start + 21600000 THEN s.c + 1 ELSE 1 END FROM s JOIN o ON o.key = s.key AND o.n = s.n + 1)
 SELECT key, id, at_ms, c <= 2 AS allowed, CAST(greatest(0, 2 - c) AS BIGINT) AS remaining FROM s""")
def _(v):
    from ..streaming.folds import rate_limited

    e = v.table("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return rate_limited(e, 6 * 3_600_000, 2)


@query("cache_statistics", f"""WITH RECURSIVE {_steps('event_type', 'user_id AS k, ')}, f AS (SELECT *, list_filter(held, lambda x: x.k = k AND at_ms < x.t + 86400000)[1] AS fresh, list_filter(held, lambda x: x.k <> k) AS others FROM
 (SELECT key, k, at_ms, n, CAST([] AS STRUCT(k BIGINT, t BIGINT)[]) AS held, 0 AS hits, 0 AS misses, 0 AS evictions FROM o WHERE n = 1)
 UNION ALL SELECT *, list_filter(held, lambda x: x.k = k AND at_ms < x.t + 86400000)[1], list_filter(held, lambda x: x.k <> k) FROM (SELECT o.key, o.k, o.at_ms, o.n,
 CASE WHEN f.fresh IS NOT NULL THEN list_append(f.others, f.fresh) ELSE list_append(CASE WHEN len(f.others) >= 5 THEN f.others[2:] ELSE f.others END, {{'k': CAST(f.k AS BIGINT), 't': f.at_ms}}) END AS held,
 f.hits + (f.fresh IS NOT NULL)::INT AS hits, f.misses + (f.fresh IS NULL)::INT AS misses, f.evictions + (f.fresh IS NULL AND len(f.others) >= 5)::INT AS evictions FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1))
 SELECT key AS cache, arg_max(hits + (fresh IS NOT NULL)::INT, n)::BIGINT AS hits, arg_max(misses + (fresh IS NULL)::INT, n)::BIGINT AS misses, arg_max(evictions + (fresh IS NULL AND len(others) >= 5)::INT, n)::BIGINT AS evictions FROM f GROUP BY key""")
def _(v):
    from ..streaming.folds import cache_replay

    e = v.table("events").select(F.col("event_type").alias("cache"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("user_id").alias("key"))
    return cache_replay(e, 24 * 3_600_000, 5)


@query("breaker_states", f"""WITH RECURSIVE {_steps('user_id', "event_type <> 'error' AS ok, ")}, s AS (SELECT key, id, at_ms, ok, n, 'CLOSED' AS state, 0 AS bad, CAST(0 AS BIGINT) AS opened FROM o WHERE n = 1 UNION ALL
 SELECT key, id, at_ms, ok, n, CASE WHEN after = 'OPEN' AND at_ms >= opened + 86400000 THEN 'HALF_OPEN' ELSE after END, b, opened FROM (
 SELECT o.*, CASE WHEN s.state = 'OPEN' THEN 'OPEN' WHEN s.ok THEN 'CLOSED' WHEN s.state = 'HALF_OPEN' OR s.bad + 1 >= 2 THEN 'OPEN' ELSE s.state END AS after,
 CASE WHEN s.state = 'OPEN' THEN s.bad WHEN s.ok OR s.state = 'HALF_OPEN' OR s.bad + 1 >= 2 THEN 0 ELSE s.bad + 1 END AS b,
 CASE WHEN s.state <> 'OPEN' AND NOT s.ok AND (s.state = 'HALF_OPEN' OR s.bad + 1 >= 2) THEN s.at_ms ELSE s.opened END AS opened FROM s JOIN o ON o.key = s.key AND o.n = s.n + 1))
 SELECT key, id, at_ms, ok, state FROM s""")
def _(v):
    from ..streaming.folds import breaker_states

    e = v.table("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), (F.col("event_type") != "error").alias("ok"))
    return breaker_states(e, 2, 24 * 3_600_000)
