"""Queries over job sheets: fields, confidence, universal fields, candidates, gold standard, findings, status."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import sheets as T
from .registry import query
from .reports import r


def _plain(pattern: str) -> str:
    """A block of lines as one line: DuckDB's patterns can't look ahead, and a sheet's blocks are one line each."""
    return pattern.replace(T._BLOCK1, r"([^\n]+)").replace(T._BLOCK2, r"([^\n]+)")


def _first(patterns, text: str = "text") -> str:
    hits = [f"nullif(regexp_extract({text}, '(?i){_plain(p)}', 1), '')" for p in T.with_groups(patterns)]
    return f"coalesce({', '.join([*hits, 'NULL'])})"


SPACE = r"'^\s+|\s+$', '', 'g'"
_MONTH_DAY = "TRY_CAST({m} AS INTEGER) BETWEEN 1 AND 12 AND TRY_CAST({d} AS INTEGER) BETWEEN 1 AND 31"


def _date_case(x: str, pattern: str, y: int, m: int, d: int, year: str = "{}") -> str:
    at = {k: f"regexp_extract({x}, '{pattern}', {n})" for k, n in (("y", y), ("m", m), ("d", d))}
    return f"WHEN {_MONTH_DAY.format(**at)} THEN {year.format(at['y'])} || '-' || lpad({at['m']}, 2, '0') || '-' || lpad({at['d']}, 2, '0')"


def _search_date(x: str) -> str:
    return "CASE " + " ".join((
        _date_case(x, r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", 3, 2, 1), _date_case(x, r"(\d{1,2})[/-](\d{1,2})[/-](\d{2})", 3, 2, 1, "(2000 + CAST({} AS INTEGER))"),
        _date_case(x, r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", 1, 2, 3))) + f" ELSE {x} END"


def _value_sql(f: T.Field) -> str:
    raw = f"r_{f.id}"
    if f.kind == "number":
        return f"CAST(coalesce(TRY_CAST({raw} AS DOUBLE), 0.0) AS VARCHAR)"
    if f.kind == "date":
        return f"CASE WHEN {raw} IS NOT NULL THEN {_search_date(raw)} END"
    if f.kind == "boolean":
        vor = f"contains(lower({raw}), 'vor') OR " if f.id == "vor_status" else ""
        return f"CASE WHEN {raw} IS NOT NULL THEN CAST({vor}lower({raw}) IN {T.YES} AS VARCHAR) END"
    if f.allowed:
        return f"coalesce(list_filter({list(f.allowed)}, lambda a: lower(a) = lower({raw}))[1], {raw})"
    return raw


_RAW = ", ".join(f"regexp_replace({_first(f.patterns)}, {SPACE}) AS r_{f.id}" for f in T.FIELDS)


def _one_sql(f: T.Field) -> str:
    label = " OR ".join(f"contains(lower(text), '{n.lower()}')" for n in f.labels)
    conf = f"least(0.99::DOUBLE, 0.7::DOUBLE + CASE WHEN {label} THEN 0.15::DOUBLE ELSE 0 END + 0.1::DOUBLE)"
    error = f"CASE WHEN r_{f.id} IS NULL THEN 'required' END" if f.required else "NULL"
    if f.allowed:
        known = f"lower(r_{f.id}) IN {tuple(a.lower() for a in f.allowed)}"
        conf = f"least(1.0::DOUBLE, {conf} + CASE WHEN {known} THEN 0.1::DOUBLE ELSE 0 END)"
        error = f"coalesce({error}, CASE WHEN NOT {known} THEN 'allowed' END)"
    return (f"SELECT doc_id, '{f.id}' AS field, '{f.severity}' AS severity, {f.required} AS required, {_value_sql(f)} AS value, r_{f.id} AS raw, "
            f"CASE WHEN r_{f.id} IS NULL THEN 0.0 ELSE {conf} END AS confidence, CAST({error} AS VARCHAR) AS error FROM raws")


_LEVEL = "CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.60 THEN 'MEDIUM' WHEN confidence >= 0.30 THEN 'LOW' ELSE 'UNREADABLE' END"
EXTRACTED = f"WITH raws AS (SELECT doc_id, text, {_RAW} FROM sheets), fields AS (SELECT *, {_LEVEL} AS level FROM (" + " UNION ALL ".join(map(_one_sql, T.FIELDS)) + "))"


def wide(v):
    return T.extract_wide(v.sheets)


@query("sheet_fields", f"{EXTRACTED} SELECT doc_id, field, severity, required, value, raw, {r('confidence')} AS confidence, level, error FROM fields", "sheets")
def _(v):
    return T.long_form(wide(v)).withColumn("confidence", S.r6(F.col("confidence")))


@query("sheet_confidence", f"""{EXTRACTED} SELECT doc_id, count(*) FILTER (required AND raw IS NOT NULL) AS found_required,
 floor((sum(confidence) FILTER (required AND raw IS NOT NULL) / greatest(1, count(*) FILTER (required AND raw IS NOT NULL)) * 0.6::DOUBLE
 + count(*) FILTER (required AND raw IS NOT NULL) / (count(*) FILTER (required))::DOUBLE * 0.4::DOUBLE) * 100 + 0.5) / 100 AS overall FROM fields GROUP BY doc_id""", "sheets")
def _(v):
    return T.overall_confidence(wide(v))


_KINDS = {"make_model": "string", "mileage_hours": "number", "date": "date", "overtime": "boolean"}


@query("typed_confidence", f"""{EXTRACTED} SELECT doc_id, field, {r('''CASE WHEN coalesce(length(raw), 0) = 0 THEN 0 ELSE least(1.0::DOUBLE, 0.7::DOUBLE + CASE WHEN length(raw) > 5 THEN 0.1::DOUBLE ELSE 0 END + CASE
 WHEN field = 'mileage_hours' AND regexp_matches(raw, '^[$]?[0-9,]+([.][0-9]{2})?$') THEN 0.15::DOUBLE WHEN field = 'date' AND regexp_matches(raw, '[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}') THEN 0.15::DOUBLE
 WHEN field = 'overtime' AND lower(raw) IN ('yes', 'no', 'true', 'false', 'signed', 'unsigned') THEN 0.2::DOUBLE ELSE 0 END) END''')} AS confidence
 FROM fields WHERE field IN ('make_model', 'mileage_hours', 'date', 'overtime')""", "sheets")
def _(v):
    w = T.extract_wide(v.sheets, [f for f in T.FIELDS if f.id in _KINDS])
    rows = F.array(*[F.struct(F.lit(n).alias("field"), S.r6(T.typed_confidence(F.col(n)["raw"], k)).alias("confidence")) for n, k in _KINDS.items()])
    return w.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


def pages(v):
    """A sheet's first ten lines are its first page."""
    lines = F.split("text", "\n")
    two = F.array(F.struct(F.lit(1).alias("page"), F.array_join(F.slice(lines, 1, 10), "\n").alias("text")),
                  F.struct(F.lit(2).alias("page"), F.array_join(F.slice(lines, F.lit(11), F.size(lines)), "\n").alias("text")))
    return v.sheets.select("doc_id", F.explode(two).alias("p")).select("doc_id", "p.*")


PAGES = "WITH p AS (SELECT doc_id, 1 AS page, array_to_string(string_split(text, chr(10))[1:10], chr(10)) AS text FROM sheets UNION ALL SELECT doc_id, 2, array_to_string(string_split(text, chr(10))[11:], chr(10)) FROM sheets)"
UNIVERSAL = f"{PAGES}, h AS (" + " UNION ALL ".join(
    f"SELECT doc_id, page, '{n}' AS field, left(regexp_replace({_first(p)}, {SPACE}), 100) AS value FROM p" for n, p in T.UNIVERSAL.items()) + (
    "), u AS (SELECT doc_id, field, arg_min(value, page) AS value, min(page) AS page FROM h WHERE value IS NOT NULL GROUP BY ALL)")


@query("universal_fields", f"{UNIVERSAL} SELECT *, 0.7::DOUBLE AS confidence FROM u", "sheets")
def _(v):
    return T.universal_fields(pages(v))


_HINTS = sorted(T.HINTS, key=lambda h: ("HIGH", "MEDIUM", "LOW").index(h[2]))
_HINT_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for p, n, _ in _HINTS) + "], lambda x: x IS NOT NULL)"


@query("hybrid_assessment", f"""{UNIVERSAL}, n AS (SELECT doc_id, count(*) AS n_fields FROM u GROUP BY 1), a AS (SELECT s.doc_id, {_HINT_SQL} AS hints, coalesce(n_fields, 0) AS n_fields, len(string_split_regex(text, '\\s+')) AS words,
 {_first(T.UNIVERSAL['signature'])} IS NOT NULL AS has_signature, {_first(T.UNIVERSAL['date'])} IS NOT NULL AS has_date FROM sheets s LEFT JOIN n ON s.doc_id = n.doc_id)
 SELECT doc_id, array_to_string(hints, ';') AS hints, n_fields, words, has_signature, has_date, CASE WHEN len(hints) = 0 THEN 'No template matched this document type.' ELSE 'Multiple templates matched with similar scores.' END
 || ' Extracted ' || n_fields || ' universal fields.' || CASE WHEN len(hints) > 0 THEN ' Suggested template: ' || hints[1] ELSE '' END AS explanation FROM a""", "sheets")
def _(v):
    reason = F.when(F.size("hints") == 0, "TEMPLATE_NOT_MATCHED").otherwise("AMBIGUOUS_SELECTION")
    return T.hybrid_assessment(pages(v), reason).select("doc_id", F.array_join("hints", ";").alias("hints"), "n_fields", "words", "has_signature", "has_date", "explanation")


def _parse_date(x: str) -> str:
    full = "CASE WHEN length({0}) = 2 THEN 2000 + CAST({0} AS INTEGER) ELSE CAST({0} AS INTEGER) END"
    months = ", ".join(f"'{m}'" for m in S.MONTHS)
    named = r"(?i)^(\d{1,2})\s+(" + "|".join(S.MONTHS) + r")[a-z]*\s+(\d{2,4})$"
    y, d = f"regexp_extract({x}, '{named}', 3)", f"regexp_extract({x}, '{named}', 1)"
    month = f"list_position([{months}], lower(regexp_extract({x}, '{named}', 2)))"
    return "CASE " + " ".join((
        _date_case(x, r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})$", 1, 2, 3), _date_case(x, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$", 3, 2, 1, full),
        f"WHEN {month} > 0 AND CAST({d} AS INTEGER) BETWEEN 1 AND 31 THEN {full.format(y)} || '-' || lpad({month}::VARCHAR, 2, '0') || '-' || lpad({d}, 2, '0')")) + " END"


def _norm_sql(x: str, kind: str) -> str:
    if kind == "date":
        return _parse_date(f"regexp_replace({x}, {SPACE})")
    return f"CASE WHEN length({x}) BETWEEN {kind[-1]} AND 30 THEN upper({x}) END"


def _matches(name: str, patterns, kind: str, source: str, conf: float) -> str:
    return " UNION ".join(f"SELECT doc_id, '{name}' AS field, {_norm_sql('m', kind)} AS value, {conf}::DOUBLE AS confidence FROM (SELECT doc_id, unnest(regexp_extract_all({source}, '(?i){p}', 1)) AS m FROM sheets)" for p in patterns)


CANDIDATES = "WITH near AS (SELECT * FROM (" + " UNION ".join(_matches(n, p, k, "region", 0.9) for n, (p, k, _) in T.CRITICAL.items()) + (
    ") WHERE value IS NOT NULL), far AS (SELECT * FROM (") + " UNION ".join(_matches(n, p, k, "text", 0.7) for n, (p, k, _) in T.CRITICAL.items()) + (
    ") WHERE value IS NOT NULL), c AS (SELECT * FROM near UNION ALL SELECT * FROM far f WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.doc_id = f.doc_id AND n.field = f.field AND n.value = f.value))")


@query("critical_candidates", f"{CANDIDATES} SELECT * FROM c", "sheets")
def _(v):
    return T.critical_candidates(v.sheets)


SELECTED_CRITICAL = f"""{CANDIDATES}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence DESC, value) AS n FROM c), b AS (SELECT doc_id, field, max(value) FILTER (n = 1) AS value,
 max(confidence) FILTER (n = 1) AS confidence, max(confidence) FILTER (n = 2) AS nxt FROM w GROUP BY ALL), chosen AS (SELECT s.doc_id, q.field, value, confidence, CASE WHEN value IS NULL THEN 'FAIL' WHEN confidence - nxt < 0.1 THEN 'REVIEW_QUEUE' ELSE 'PASS' END AS status,
 CASE WHEN value IS NULL THEN 'MISSING_FIELD' WHEN confidence - nxt < 0.1 THEN 'CONFLICT' END AS reason FROM sheets s CROSS JOIN (VALUES {', '.join(f"('{n}')" for n in T.CRITICAL)}) q(field) LEFT JOIN b ON b.doc_id = s.doc_id AND b.field = q.field)"""


@query("selected_candidates", f"{SELECTED_CRITICAL} SELECT * FROM chosen", "sheets")
def _(v):
    return T.select_candidates(T.critical_candidates(v.sheets), v.sheets)


@query("pipeline_status", f"""{SELECTED_CRITICAL}, f AS (SELECT l_orderkey AS doc_id, bool_or(l_returnflag = 'R' AND l_quantity > 45) AS issue FROM lineitem GROUP BY 1)
 SELECT c.doc_id, CASE WHEN bool_or(status = 'FAIL' AND field IN ('jobReference', 'assetId')) THEN 'FAIL' WHEN coalesce(any_value(issue), FALSE) THEN 'REVIEW_QUEUE' ELSE 'PASS' END AS status
 FROM chosen c LEFT JOIN f ON c.doc_id = f.doc_id GROUP BY 1""", "sheets")
def _(v):
    fused = v.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), "CONFLICT").otherwise("AGREED").alias("outcome"))
    return T.pipeline_status(T.select_candidates(T.critical_candidates(v.sheets), v.sheets), fused, ("jobReference", "assetId"))


@query("parsed_dates", f"SELECT o_orderkey, {', '.join(f'{_parse_date(x)} AS {n}' for n, x in (('a', 'a'), ('b', 'b'), ('c', 'c'), ('d', 'd')))}, {_search_date('d')} AS e FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y.%-m.%-d') AS a, strftime(o_orderdate, '%-d/%-m/%y') AS b, strftime(o_orderdate, '%-d %B %Y') AS c, '31-' || (o_orderkey % 14) || '-' || year(o_orderdate) AS d FROM orders)")
def _(v):
    d = F.to_date("o_orderdate")
    t = v.table("orders").select("o_orderkey", F.date_format(d, "yyyy.M.d").alias("a"), F.date_format(d, "d/M/yy").alias("b"), F.date_format(d, "d MMMM yyyy").alias("c"),
                                 F.concat_ws("-", F.lit("31"), (F.col("o_orderkey") % 14).cast("string"), F.year(d).cast("string")).alias("d"))
    return t.select("o_orderkey", *[S.parse_date(F.col(c)).alias(c) for c in "abcd"], S.search_date(F.col("d")).alias("e"))


_REASONS = tuple(x.lower() for x in (*next(f.allowed for f in T.FIELDS if f.id == "fault_reason"), "Reason"))
CHECKED = f"""{EXTRACTED}, chk AS (SELECT *, coalesce(value, '') <> '' AS present, CASE WHEN coalesce(value, '') = '' THEN NOT required ELSE coalesce(CASE field WHEN 'asset_no' THEN regexp_matches(value, '(?i)^[A-Z0-9_-]+$')
 WHEN 'job_no' THEN regexp_matches(value, '^[0-9]+$') WHEN 'date' THEN regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$|^\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}$') WHEN 'mileage_hours' THEN TRY_CAST(value AS DOUBLE) BETWEEN 0 AND 10000000
 WHEN 'travel_time' THEN TRY_CAST(value AS DOUBLE) BETWEEN 0 AND 24 WHEN 'repair_duration' THEN TRY_CAST(value AS DOUBLE) BETWEEN 0 AND 100 WHEN 'engineer_comments' THEN length(value) >= 20
 WHEN 'fault_reason' THEN lower(value) IN {_REASONS} ELSE TRUE END, FALSE) END AS valid FROM fields),
 piv AS (SELECT doc_id, max(value) FILTER (field = 'vor_status') AS vor, max(value) FILTER (field = 'safe_to_use') AS safe, max(value) FILTER (field = 'parts_required') AS parts, max(value) FILTER (field = 'return_visit_required') AS visit,
 max(value) FILTER (field = 'works_completed') AS works, max(value) FILTER (field = 'engineer_comments') AS said FROM fields GROUP BY 1),
 rul AS (SELECT doc_id, coalesce(vor = 'true' AND safe = 'true', FALSE) AS b1, coalesce(length(parts) > 0 AND visit = 'false', FALSE) AS b2, coalesce(works = 'false' AND visit = 'false', FALSE) AS b3,
 coalesce(length(said) BETWEEN 1 AND 10 OR lower(said) = 'completed', FALSE) AS b5 FROM piv)"""


@query("gold_standard", f"""{CHECKED}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (required) AS need, count(*) FILTER (valid) AS valid_fields, count(*) FILTER (required AND NOT present) AS missing_required,
 count(*) FILTER (required AND present) AS found, count(*) FILTER (NOT valid AND NOT present AND severity = 'S0') + count(*) FILTER (NOT valid AND present AND severity IN ('S0', 'S1')) AS grave,
 count(*) FILTER (NOT valid AND present AND severity NOT IN ('S0', 'S1')) AS minor FROM chk GROUP BY 1), g AS (SELECT s.*, 5 - b1::INT - b2::INT - b3::INT - b5::INT AS kept, grave + b1::INT + b3::INT AS ci, minor + b2::INT + b5::INT AS wa
 FROM s JOIN rul ON s.doc_id = rul.doc_id) SELECT doc_id, valid_fields, missing_required, kept AS rules_passed, ci AS critical_issues, wa AS warnings,
 CAST(floor(valid_fields / n::DOUBLE * 60 + found / need::DOUBLE * 30 + kept / 5::DOUBLE * 10 + 0.5) AS BIGINT) AS score, ci = 0 AND missing_required = 0 AS is_valid FROM g""", "sheets")
def _(v):
    return T.gold_standard(T.validate_wide(wide(v)))


_BROKEN = " UNION ALL ".join(f"SELECT doc_id, '{n}', '{s}', 'BUSINESS_RULE_VIOLATION', '', 1.0 FROM rul WHERE {b}" for n, s, b in (
    ("vor_safety_consistency", "S0", "b1"), ("return_visit_parts_required", "S2", "b2"), ("incomplete_work_return_visit", "S1", "b3"), ("engineer_comments_quality", "S2", "b5")))


@query("sheet_findings", f"""{CHECKED} SELECT doc_id, field, severity, CASE WHEN NOT present AND required THEN 'MISSING_FIELD' WHEN level = 'LOW' THEN 'LOW_CONFIDENCE' WHEN level = 'UNREADABLE' THEN 'UNREADABLE_FIELD' ELSE 'INVALID_FORMAT' END AS reason,
 coalesce(raw, '') AS raw, {r('confidence')} AS confidence FROM chk WHERE NOT valid UNION ALL {_BROKEN}""", "sheets")
def _(v):
    return T.build_findings(T.validate_wide(wide(v))).withColumn("confidence", S.r6(F.col("confidence")))


@query("sheet_review_queue", f"""{CHECKED}, low AS (SELECT doc_id, field, {r('confidence')} AS confidence, CASE level WHEN 'LOW' THEN 'Manual verification required' ELSE 'Review and confirm value' END AS action FROM fields WHERE level IN ('LOW', 'MEDIUM'))
 SELECT * FROM low UNION ALL SELECT doc_id, field, 0.5, 'Review and correct if necessary' FROM chk c WHERE NOT valid AND severity IN ('S2', 'S3') AND NOT EXISTS (SELECT 1 FROM low WHERE low.doc_id = c.doc_id AND low.field = c.field)""", "sheets")
def _(v):
    return T.review_queue(T.validate_wide(wide(v))).withColumn("confidence", S.r6(F.col("confidence")))


_KIND = "CASE " + " ".join(f"WHEN contains(lower(text), '{m}') THEN '{n}'" for m, n in T.KINDS) + " ELSE 'UNKNOWN' END"


@query("sheet_kinds", f"SELECT doc_id, {_KIND} AS kind FROM sheets", "sheets")
def _(v):
    return v.sheets.select("doc_id", T.classify(F.col("text"), T.KINDS).alias("kind"))


@query("sheet_audits", f"""{CHECKED}, a AS (SELECT doc_id, count(*) FILTER (NOT valid) AS bad, count(*) FILTER (level IN ('LOW', 'MEDIUM') OR (NOT valid AND severity IN ('S2', 'S3'))) AS queued,
 bool_or(NOT valid AND severity IN ('S0', 'S1')) AS crit, count(*) FILTER (NOT valid AND NOT present AND severity = 'S0') + count(*) FILTER (NOT valid AND present AND severity IN ('S0', 'S1')) AS grave,
 count(*) FILTER (valid) / count(*)::DOUBLE * 60 + count(*) FILTER (required AND present) / (count(*) FILTER (required))::DOUBLE * 30 AS part,
 floor((sum(confidence) FILTER (required AND raw IS NOT NULL) / greatest(1, count(*) FILTER (required AND raw IS NOT NULL)) * 0.6::DOUBLE
 + count(*) FILTER (required AND raw IS NOT NULL) / (count(*) FILTER (required))::DOUBLE * 0.4::DOUBLE) * 100 + 0.5) / 100 AS overall FROM chk GROUP BY 1)
 SELECT s.doc_id, {_KIND} AS kind, overall, CAST(floor(part + (5 - b1::INT - b2::INT - b3::INT - b5::INT) / 5::DOUBLE * 10 + 0.5) AS BIGINT) AS score, bad + b1::INT + b2::INT + b3::INT + b5::INT AS findings, queued,
 CASE WHEN crit AND s.doc_id % 10 = 0 THEN 'WAIVED' WHEN grave + b1::INT + b3::INT > 0 THEN 'FAIL' WHEN queued > 0 THEN 'REVIEW_QUEUE' ELSE 'PASS' END AS status
 FROM sheets s JOIN a ON a.doc_id = s.doc_id JOIN rul ON rul.doc_id = s.doc_id""", "sheets")
def _(v):
    return T.audit(v.sheets, waived=F.col("doc_id") % 10 == 0)


STATUS = f"""{EXTRACTED}, g AS (SELECT doc_id, count(*) FILTER (value <> '') AS found, count(*) FILTER (required) AS need, count(*) FILTER (required AND value <> '') AS got, count(*) FILTER (NOT required) AS opt,
 count(*) FILTER (NOT required AND value <> '') AS extra, avg(confidence * 100) FILTER (confidence > 0) AS c, count(*) FILTER (confidence > 0 AND confidence * 100 < 70) AS low FROM fields WHERE field <> 'technician_signature' GROUP BY 1),
 q AS (SELECT *, got / need::DOUBLE * 100 * 0.7::DOUBLE + extra / opt::DOUBLE * 100 * 0.3::DOUBLE AS quality FROM g),
 st AS (SELECT doc_id, found, floor(quality * 10 + 0.5) / 10 AS quality, floor(coalesce(c, 0) * 10 + 0.5) / 10 AS confidence, CASE WHEN got < need THEN 'FAIL' WHEN low > 0 THEN 'REVIEW_QUEUE' WHEN quality >= 90 THEN 'PASS' ELSE 'REVIEW_QUEUE' END AS status FROM q)"""
#: A signature is never read from text, so no sheet could pass with it.
WITHOUT_SIGNATURE = tuple(f for f in T.FIELDS if f.id != "technician_signature")


def statuses(v):
    return T.document_status(T.long_form(T.extract_wide(v.sheets, WITHOUT_SIGNATURE), WITHOUT_SIGNATURE))


@query("document_status", f"{STATUS} SELECT * FROM st", "sheets")
def _(v):
    return statuses(v)


@query("batch_summary", f"""{STATUS} SELECT count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'REVIEW_QUEUE') AS review_queue,
 floor(avg(quality) * 10 + 0.5) / 10 AS quality, floor(avg(confidence) * 10 + 0.5) / 10 AS confidence FROM st""", "sheets")
def _(v):
    return T.batch_summary(statuses(v))


@query("redacted_exports", "SELECT doc_id, md5(t) AS digest, t <> coalesce(text, '') AS changed FROM (SELECT doc_id, text, " + "".join("regexp_replace(" for _ in S.EXPORT_REDACTIONS) + "coalesce(text, '')" + "".join(
    f", '{p}', '[REDACTED]', 'g')" for p in S.EXPORT_REDACTIONS) + " AS t FROM documents)")
def _(v):
    d = v.table("documents").select("doc_id", "text").withColumn("t", S.redact_export(F.col("text")))
    return d.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), (F.col("t") != F.coalesce("text", F.lit(""))).alias("changed"))


@query("backoff_delays", "SELECT event_id, least(30000.0::DOUBLE, 1000.0::DOUBLE * pow(2, event_id % 8)) AS delay, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) IS NOT NULL AS is_time FROM events")
def _(v):
    e = v.table("events")
    said = F.when(F.col("event_id") % 3 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", S.backoff_ms(F.col("event_id") % 8).alias("delay"), S.is_timestamp(said).alias("is_time"))
