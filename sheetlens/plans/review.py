"""Review routing, guardrails, regions, detectors and personal data as queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import review as V
from .registry import query
from .reports import r

READ = "SELECT l_orderkey AS doc_id, 'field_' || l_linenumber AS field, min(CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END) AS value, min(l_discount * 10) AS confidence, min(l_tax * 10) AS threshold, bool_or(l_suppkey % 5 > 0) AS has_box FROM lineitem GROUP BY ALL"


def read_fields(v):
    li = v.table("lineitem")
    return li.groupBy(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("field_"), F.col("l_linenumber").cast("string")).alias("field")).agg(
        F.min(F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag"))).alias("value"), F.min(F.col("l_discount") * 10).alias("confidence"), F.min(F.col("l_tax") * 10).alias("threshold"), F.bool_or(F.col("l_suppkey") % 5 > 0).alias("has_box"))


REQUIRED = ("field_1", "field_2")


@query("second_reading", f"WITH f AS ({READ}), g AS (SELECT doc_id, field, CASE WHEN value = '' AND field IN ('field_1', 'field_2') THEN CASE WHEN has_box THEN 'missing' END WHEN confidence < threshold AND has_box THEN 'low_confidence' END AS reason FROM f) SELECT * FROM g WHERE reason IS NOT NULL")
def _(v):
    return V.second_reading(read_fields(v), REQUIRED)


@query("review_routing", f"""WITH f AS ({READ}), x AS (SELECT doc_id, CASE WHEN field IN ('field_1', 'field_2') THEN 'S1' ELSE 'S2' END AS s FROM f WHERE confidence < 0.5 UNION ALL SELECT d.doc_id, 'S0' FROM (SELECT DISTINCT doc_id FROM f) d, (VALUES ('field_1'), ('field_2')) q(field) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = d.doc_id AND f.field = q.field AND value <> '')),
 g AS (SELECT doc_id, min(s) AS w, count(*) AS n FROM x GROUP BY 1) SELECT d.doc_id, w IS NOT NULL AS route, coalesce(n, 0) AS reasons, CASE w WHEN 'S0' THEN 'high' WHEN 'S1' THEN 'medium' ELSE 'low' END AS priority FROM (SELECT DISTINCT doc_id FROM f) d LEFT JOIN g ON d.doc_id = g.doc_id""")
def _(v):
    return V.review_routing(read_fields(v), REQUIRED)


@query("queued_for_review", "WITH x AS (SELECT doc_id, field, 0 AS k FROM golden WHERE status = 'failed' AND severity IN ('S0', 'S1') UNION ALL SELECT doc_id, field, 1 FROM golden WHERE confidence < 0.2) SELECT doc_id, CASE min(k) WHEN 0 THEN 'validation_failure' ELSE 'low_confidence' END AS reason, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM x GROUP BY doc_id", "golden")
def _(v):
    f = v.golden.filter("status = 'failed'").withColumn("severity", F.when(F.col("severity") == "S0", "critical").when(F.col("severity") == "S1", "major").otherwise("minor"))
    return V.queue_for_review(f, v.golden.filter("confidence < 0.2"))


@query("extraction_guardrails", f"""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS field, count(DISTINCT CASE WHEN l_returnflag <> 'A' THEN l_linestatus END) AS v, count(*) FILTER (l_returnflag <> 'A') AS n, count(*) FILTER (l_linenumber % 3 = 0 AND l_returnflag <> 'A' AND l_discount * 1000 < 20) AS low, max(l_tax * 9) AS a FROM lineitem GROUP BY ALL),
 g AS (SELECT doc_id, sum(n) > 0 AS g001, sum(low) = 0 AS g002, count(*) FILTER (v > 1) = 0 AS g003, max(a) <= 0.7 AS g004 FROM p GROUP BY 1) SELECT *, CASE WHEN NOT g001 THEN 'STOP' WHEN NOT (g002 AND g003 AND g004) THEN 'REVIEW_QUEUE' ELSE 'CONTINUE' END AS behaviour FROM g""")
def _(v):
    f = v.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("field"), F.col("l_linestatus").alias("value"), (F.col("l_discount") * 1000).alias("confidence"), (F.col("l_returnflag") != "A").alias("extracted"),
                                   (F.col("l_linenumber") % 3 == 0).alias("is_critical"), F.lit(20.0).alias("review_threshold"), (F.col("l_tax") * 9).alias("anomaly"))
    return V.guardrails(f)


@query("region_processing", f"""WITH f AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS ord, 'field_' || l_linenumber AS field, l_suppkey % 4 > 0 AS hr, l_discount * 10 AS c FROM lineitem),
 g AS (SELECT *, CASE WHEN hr AND c < 0.6 THEN 2 ELSE 0 END AS want FROM f), h AS (SELECT *, CAST(greatest(0, least(want, 3 - coalesce(sum(want) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS attempts FROM g),
 i AS (SELECT *, CASE WHEN attempts > 0 THEN least(c + 0.05::DOUBLE, 0.95::DOUBLE) WHEN hr THEN c WHEN field IN ('field_1', 'field_5') THEN 0 ELSE 0.75 END AS fin FROM h)
 SELECT doc_id, CAST(ord AS BIGINT) AS ord, attempts, CASE WHEN attempts > 0 THEN 'reprocessed' WHEN hr THEN 'roi' ELSE 'fullpage' END AS source, {r('fin')} AS final, CASE WHEN field IN ('field_1', 'field_5') AND NOT hr THEN 'SPEC_GAP' WHEN fin < 0.6 THEN CASE WHEN attempts > 0 THEN 'OCR_FAILURE' ELSE 'LOW_CONFIDENCE' END END AS reason FROM i""")
def _(v):
    from pyspark.sql import Window

    li = v.table("lineitem")
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long")
    f = li.select(F.col("l_orderkey").alias("doc_id"), ord_.alias("ord"), F.concat(F.lit("field_"), F.col("l_linenumber").cast("string")).alias("field"), (F.col("l_suppkey") % 4 > 0).alias("has_region"), (F.col("l_discount") * 10).alias("confidence"))
    return V.region_processing(f, ("field_1", "field_5")).select("doc_id", "ord", "attempts", "source", S.r6(F.col("final")).alias("final"), "reason")


# The oracle's patterns can't look ahead: a company that begins like a placeholder is left out afterwards, names have a query of their own.
_SCANNED = {n: p for n, p in V.PERSONAL.items() if n != "realName"}
_SCAN = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS pattern, unnest(regexp_extract_all(text, '{re.sub(r'[(][?]![^)]*[)]', '', p)}')) AS match FROM sheets2" for n, p in _SCANNED.items())


def personal_texts(v):
    t, d = F.col("text"), F.col("doc_id")
    who = F.when(d % 3 == 0, "Acme Pumps Ltd").when(d % 3 == 1, "see Mary Jones").otherwise("CUSTOMER_A")
    more = F.concat(t, F.lit("\nwrite to u"), d.cast("string"), F.lit("@mail.test or 20"), (100 + d % 900).cast("string"), F.lit("-555-"), (1000 + d % 9000).cast("string"),
                    F.lit(" at "), (d % 90 + 1).cast("string"), F.lit(" Green Mill Road, AB1 2CD; "), who)
    return v.sheets.select("doc_id", more.alias("text"))


_SHEETS2 = """sheets2 AS (SELECT doc_id, text || chr(10) || 'write to u' || doc_id || '@mail.test or 20' || (100 + doc_id % 900) || '-555-' || (1000 + doc_id % 9000) || ' at ' || (doc_id % 90 + 1) || ' Green Mill Road, AB1 2CD; '
 || CASE doc_id % 3 WHEN 0 THEN 'Acme Pumps Ltd' WHEN 1 THEN 'see Mary Jones' ELSE 'CUSTOMER_A' END AS text FROM sheets)"""


@query("personal_data_scan", f"""WITH {_SHEETS2}, found AS ({_SCAN})
 SELECT * FROM found WHERE NOT regexp_matches(match, '^(?i)(CUSTOMER_|VENDOR_|SUPPLIER_|PARTNER_|TECH-|PART-|JS-)') AND NOT ({' OR '.join(f"contains(match, '{a}')" for a in V.ALLOWED)})""", "sheets")
def _(v):
    return V.personal_data(personal_texts(v), _SCANNED, V.ALLOWED)


# Chains of names first; in each, pairs are taken from the left, and a word that begins no name is passed over.
_PAIRS = f"""list_reduce(list_prepend({{'w': '', 'held': '', 'out': []::VARCHAR[]}}, list_transform(regexp_extract_all(chain, '[A-Z][a-z]{{2,}}\\s*'), lambda x: {{'w': x, 'held': '', 'out': []::VARCHAR[]}})), lambda a, x: {{'w': '',
 'held': CASE WHEN a.held = '' AND NOT regexp_matches(x.w, '^({"|".join(V.NO_NAMES)})') THEN x.w ELSE '' END, 'out': CASE WHEN a.held <> '' THEN list_append(a.out, a.held || rtrim(x.w, chr(10) || chr(13) || chr(9) || ' ')) ELSE a.out END}}).out"""


@query("personal_names_scan", f"""WITH {_SHEETS2}, c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]{{2,}}(?:\\s+[A-Z][a-z]{{2,}})+\\b')) AS chain FROM sheets2), p AS (SELECT doc_id, unnest({_PAIRS}) AS match FROM c)
 SELECT doc_id, 'realName' AS pattern, match FROM p WHERE NOT ({' OR '.join(f"contains(match, '{a}')" for a in V.ALLOWED)})""", "sheets")
def _(v):
    return V.personal_data(personal_texts(v), {"realName": V.PERSONAL["realName"]}, V.ALLOWED)


@query("box_counts", """WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10) || CASE doc_id % 4 WHEN 0 THEN '[x] tested [ ] failed Signature: ____' WHEN 1 THEN '☑ ok ☐ Signature: J. Smith' WHEN 2 THEN 'Signature' ELSE '(x) [N] Customer signature  R' END AS text FROM documents)
 SELECT doc_id, len(regexp_extract_all(text, '\\[[xX✓✔]\\]|☑|\\([xX✓]\\)|(?i:\\[Y\\])')) AS ticked, len(regexp_extract_all(text, '\\[\\s*\\]|☐|\\(\\s*\\)|(?i:\\[N\\])')) AS empty,
 len(regexp_extract_all(text, '(?i)signature[: \\t]*([^\\n]{0,30})')) AS signatures, len(list_filter(regexp_extract_all(text, '(?i)signature[: \\t]*([^\\n]{0,30})', 1), lambda s: trim(regexp_replace(s, '_+', '', 'g'), ' ') <> '')) AS signed FROM d""")
def _(v):
    n = F.col("doc_id") % 4
    line = F.when(n == 0, "[x] tested [ ] failed Signature: ____").when(n == 1, "☑ ok ☐ Signature: J. Smith").when(n == 2, "Signature").otherwise("(x) [N] Customer signature  R")
    return V.tick_boxes(v.table("documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line).alias("text")))


def _counted(patterns):
    return " + ".join(f"len(regexp_extract_all(t, '{p}'))" for p in patterns)


@query("signature_marks", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS (SELECT *, list_transform(list_concat(list_concat(regexp_extract_all(t, '{V.LABELLED[0]}', 1), regexp_extract_all(t, '{V.LABELLED[1]}', 1)), regexp_extract_all(t, '{V.LABELLED[2]}', 1)), lambda x: regexp_replace(x, '^[{V.SPACE}]+|[{V.SPACE}]+$', '', 'g')) AS after FROM d)
 SELECT doc_id, {_counted(V.LABELLED + V.NAMED["handwritten"])} AS handwritten, {_counted(V.NAMED["digital"])} AS digital, len(list_filter(after, lambda x: length(x) > 3 AND NOT regexp_full_match(x, '[_.-]+'))) AS present, {", ".join(f"{_counted(p)} AS {n}_stamps" for n, p in V.STAMPS.items())} FROM a""")
def _(v):
    return V.signature_marks(v.table("documents"))


@query("title_cased", "SELECT n_nationkey, array_to_string(list_transform(string_split(trim(n_name), ' '), lambda w: CASE WHEN w IN ('UK', 'LLC', 'LTD', 'PLC', 'HVAC') THEN w ELSE upper(left(w, 1)) || lower(substring(w, 2)) END), ' ') AS name FROM nation")
def _(v):
    return v.table("nation").select("n_nationkey", V.title_case(F.col("n_name")).alias("name"))


@query("template_suggestions", "SELECT doc_id, trim(CASE WHEN contains(text, '@') THEN 'contact,' ELSE '' END || CASE WHEN contains(text, '|') THEN 'table,' ELSE '' END || CASE WHEN contains(text, '###') THEN 'noise,' ELSE '' END, ',') AS hints FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.array_join(V.suggestions(F.col("text"), [(r"###", "noise", 0.3), (r"@", "contact", 0.9), (r"\|", "table", 0.6)]), ",").alias("hints"))


@query("secret_settings", "SELECT p_partkey, CASE WHEN contains(p_brand, '1') THEN '[REDACTED]' ELSE p_type END AS value FROM part")
def _(v):
    key = F.when(F.col("p_brand").contains("1"), "Api-Key").otherwise("label")
    m = V.redact_map(F.create_map(key, F.col("p_type")))
    return v.table("part").select("p_partkey", F.element_at(F.map_values(m), 1).alias("value"))
