"""Marks with places, templates chosen by four signals, rule-based analysis and fixtures, and validation of specifications, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyzer as A
from ..operators import marks as M
from ..operators import signals as G
from ..operators import specs as P
from ..operators.documents import Template
from ..operators.review import SPACE
from ..sources.tables import spread
from .registry import query
from .text_queries import TOK, _score_sql

# --- marks --------------------------------------------------------------------------------

_MARKED = """SELECT doc_id, coalesce(text, '') || chr(10) || CASE doc_id % 5 WHEN 0 THEN '[x] tested [ ] failed' || chr(10) || 'Signature: ____ 😀 (OFFICIAL)' WHEN 1 THEN '☑ ok ☐' || chr(10) || 'Customer Signature: J. Smith [STAMP]' WHEN 2 THEN 'Signed: Ann Lee, approved' || chr(10) || '[Y] safe'
 WHEN 3 THEN '(x) one ( ) two e-sign SEAL: ACME Ltd received' ELSE '[ ]' || chr(10) || '[N] authorized by: Bo Certified digital  signature' END AS t FROM documents"""


def marked(v):
    n = F.col("doc_id") % 5
    line = F.when(n == 0, "[x] tested [ ] failed\nSignature: ____ 😀 (OFFICIAL)").when(n == 1, "☑ ok ☐\nCustomer Signature: J. Smith [STAMP]").when(n == 2, "Signed: Ann Lee, approved\n[Y] safe").when(
        n == 3, "(x) one ( ) two e-sign SEAL: ACME Ltd received").otherwise("[ ]\n[N] authorized by: Bo Certified digital  signature")
    return v.table("documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line).alias("text"))


_UNITS = "(length({0}) + len(regexp_extract_all({0}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"
_BREAKS = "(length({0}) - length(replace({0}, chr(10), '')))"


def _trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _mark_rows(kind: str, place: int, m: M.Mark) -> str:
    """Rows of one pattern: gaps and matches in turn, the place is the length of all before."""
    _, x, w, h, conf = M.KINDS[kind]
    after = _trimmed(f"regexp_extract(hit, '{m.pattern}', {m.group})") if m.group else "''"
    return f"""SELECT doc_id, '{kind}' AS kind, {place} AS place, i, gaps[i] AS gap, hits[i] AS hit, total, {x} AS x, {w} AS width, {h} AS height, '{m.type}' AS type, {conf['medium']}::DOUBLE AS base, {after} AS after,
 list_sum(list_transform(gaps[1:i], lambda g: {_UNITS.format('g')})) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: {_UNITS.format('g')})), 0) AS pos,
 list_sum(list_transform(gaps[1:i], lambda g: {_BREAKS.format('g')})) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: {_BREAKS.format('g')})), 0) + 1 AS line
 FROM (SELECT doc_id, total, gaps, hits, unnest(range(1, len(hits) + 1)) AS i, hits[unnest(range(1, len(hits) + 1))] AS hit FROM (SELECT doc_id, {_UNITS.format('t')} AS total, string_split_regex(t, '{m.pattern}') AS gaps, regexp_extract_all(t, '{m.pattern}') AS hits FROM d))"""


@query("page_marks", f"""WITH d AS ({_MARKED}), m AS ({" UNION ALL ".join(_mark_rows(k, i, m) for k, (every, *_) in M.KINDS.items() for i, m in enumerate(every))}),
 y AS (SELECT *, CAST(least(95, floor(pos / total::DOUBLE * 100 + 0.5)) AS INTEGER) AS y, CASE kind WHEN 'signature' THEN length(after) > 3 AND NOT regexp_full_match(after, '[_.-]+') WHEN 'checkbox' THEN type = 'checked' END AS present FROM m)
 SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY y, place, i) AS n, CAST(pos AS BIGINT) AS "at", CAST(line AS BIGINT) AS line, y, x, width, height, type, present, CASE WHEN kind = 'signature' AND present THEN base + {M.PRESENT}::DOUBLE ELSE base END AS confidence,
 CASE kind WHEN 'checkbox' THEN nullif(after, '') WHEN 'signature' THEN CASE WHEN regexp_matches(hit, '^[^:]+:') THEN {_trimmed("regexp_extract(hit, '^([^:]+):', 1)")} END END AS label, hit AS match FROM y""")
def _(v):
    return M.marks(marked(v))


# --- signals ------------------------------------------------------------------------------

PROFILES = (
    G.Profile(Template("loler-v1", ("examination",), ("loler", "thorough"), ("asset", "due")), (G.Region("header", 1), G.Region("jobReference", 1, ("jobNumber", "assetId")), G.Region("signatureBlock", 2, ("customerSignature",))),
              (("date", "date", None), ("jobNumber", "string", None), ("assetId", "pattern", r"AS-\d+")), client="BUILDING", asset_type="lift"),
    G.Profile(Template("repair-v1", ("repair",), ("vor", "fault"), ("parts", "overtime"), r"\bjob\b"), (G.Region("partsUsed", 2, ("partsUsed", "workDescription")), G.Region("notes", 3)),
              (("partsUsed", "required", None), ("serialNumber", "string", None), ("total", "number", None), ("issue", "regex", "issue: unit .* fails")), (2, 4), None, ("Repair Report", "Parts"), None, "pump", "repair"),
    G.Profile(Template("service-v1", ("service",), ("report", "weighing"), ("customer", "mileage")), (), (("customerName", "string", None), ("technicianName", "string", None)), (1, 10), "printed", (), "AUTOMOBILE", None, "service"),
    G.Profile(Template("plain-v1", ("date", "location"), ("engineer", "sheet"), ("issue",)), (G.Region("top", 1),), ()))
_PAGED = """SELECT s.doc_id, text, array_to_string(string_split(text, chr(10))[1:10], chr(10)) AS p1, array_to_string(string_split(text, chr(10))[11:], chr(10)) AS p2, CASE WHEN doc_id % 7 > 0 THEN doc_id % 13 END AS page_count,
 CASE doc_id % 3 WHEN 0 THEN 'printed' WHEN 1 THEN 'handwritten' END AS form_type, CASE WHEN doc_id % 2 = 0 THEN ['repair report', 'summary'] END AS sections, CASE doc_id % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'AUTOMOBILE' END AS client,
 CASE WHEN doc_id % 5 = 0 THEN 'pump' ELSE 'lift' END AS asset, CASE WHEN doc_id % 6 = 0 THEN 'repair' ELSE 'service' END AS work FROM sheets s"""


def paged(v):
    n, first = F.col("doc_id"), F.substring_index("text", "\n", 10)
    return v.sheets.select(
        "doc_id", "text", F.array(first, F.substring(F.col("text"), F.length(first) + 2, F.length("text"))).alias("pages"), F.when(n % 7 > 0, n % 13).alias("page_count"),
        F.when(n % 3 == 0, "printed").when(n % 3 == 1, "handwritten").alias("form_type"), F.when(n % 2 == 0, F.array(F.lit("Repair Report"), F.lit("Summary"))).alias("sections"),
        F.when(n % 4 == 0, "BUILDING").when(n % 4 == 1, "AUTOMOBILE").alias("client"), F.when(n % 5 == 0, "pump").otherwise("lift").alias("asset"), F.when(n % 6 == 0, "repair").otherwise("service").alias("work"))


def _any(column: str, field: str) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{x}')" for x in G.field_names(field)) + ")"


def _signals_sql(p: G.Profile) -> str:
    """(type, score) of each signal of a profile as a list of structs."""
    share = lambda tests: f"floor(({' + '.join(f'({t})::INT' for t in tests)}) / {len(tests)}.0::DOUBLE * 100 + 0.5)" if tests else "50.0"
    low, high = p.pages
    layout = f"50 + CASE WHEN page_count BETWEEN {low} AND {high} THEN 20 ELSE -20 END"
    if p.sections:
        layout += f" + len(list_filter({[s.lower() for s in p.sections]}, lambda x: coalesce(list_contains(sections, x), FALSE))) / {len(p.sections)}.0::DOUBLE * 30"
    if p.form:
        layout += f" + CASE WHEN form_type = '{p.form}' THEN 10 WHEN form_type IS NOT NULL THEN -10 ELSE 0 END"
    page = lambda n: f"p{n}" if n < 3 else "''"
    roi = share(["(" + " OR ".join(_any(page(r.page), f) for f in r.fields) + ")" if r.fields else f"length({page(r.page)}) > 50" for r in p.regions])

    def shown(field, kind, pattern):
        return {"date": f"regexp_matches(text, '{G.DATE}')", "pattern": f"regexp_matches(text, '(?i){pattern}')", "regex": f"regexp_matches(text, '(?i){pattern}')"}.get(kind, _any("text", field) if kind in ("string", "required") else "FALSE")

    return f"""list_filter([{{'type': 'token', 'score': {_score_sql(p.template)}, 'w': 0.40::DOUBLE}}, {{'type': CASE WHEN page_count IS NOT NULL THEN 'layout' END, 'score': greatest(0.0::DOUBLE, least(100.0::DOUBLE, ({layout})::DOUBLE)), 'w': 0.20::DOUBLE}},
 {{'type': 'roi', 'score': {roi}, 'w': 0.25::DOUBLE}}, {{'type': 'plausibility', 'score': {share([shown(*f) for f in p.fields])}, 'w': 0.15::DOUBLE}}], lambda x: x.type IS NOT NULL)"""


def _boosts(p: G.Profile) -> str:
    s = "floor(list_sum(list_transform(signals, lambda x: x.score * x.w)) / list_sum(list_transform(signals, lambda x: x.w)) + 0.5)"
    for column, name, gain in (("client", p.client, 10), ("asset", p.asset_type, 5), ("work", p.work_type, 5)):
        if name:
            s = f"CASE WHEN {column} = '{name}' THEN least(100.0, {s} + {gain}) ELSE {s} END"
    return s


_NUM = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
_CANDIDATES = " UNION ALL ".join(f"SELECT doc_id, '{p.template.slug}' AS slug, {_boosts(p)} AS score, signals FROM (SELECT *, {_signals_sql(p)} AS signals FROM (SELECT *, list_distinct({TOK}) AS w FROM d))" for p in PROFILES)


@query("signal_selection", f"""WITH d AS ({_PAGED}), c AS ({_CANDIDATES}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, slug) AS rn FROM c),
 b AS (SELECT a.doc_id, a.slug, a.score AS s1, b.score AS s2, b.slug AS nxt, a.score - b.score AS gap, a.signals, list_filter(a.signals, lambda x: x.score < 50) AS weak, CASE WHEN a.score >= 80 THEN 'HIGH' WHEN a.score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS band
 FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.rn = 1 AND b.rn = 2), e AS (SELECT *, band = 'HIGH' OR (band = 'MEDIUM' AND gap >= 10) AS selected FROM b)
 SELECT doc_id, slug, CAST(s1 AS DOUBLE) AS top_score, CAST(s2 AS DOUBLE) AS runner_up_score, CAST(gap AS DOUBLE) AS gap, band, selected, CASE WHEN selected THEN NULL WHEN band = 'MEDIUM' THEN 'AMBIGUITY_BLOCK: Score gap ' || {_NUM.format('gap')} || ' < 10 between "' || slug || '" (' || {_NUM.format('s1')} || ') and "'
 || nxt || '" (' || {_NUM.format('s2')} || ').' || CASE WHEN len(weak) > 0 THEN ' Weak signals: ' || array_to_string(list_transform(weak, lambda x: x.type), ', ') || '.' ELSE '' END ELSE 'LOW_CONFIDENCE_BLOCK: Top candidate "' || slug || '" scored ' || {_NUM.format('s1')}
 || CASE WHEN len(weak) > 0 THEN '. Low signals: [' || array_to_string(list_transform(weak, lambda x: x.type || ':' || {_NUM.format('x.score')}), ', ') || ']' ELSE ' < 50' END END AS block_reason,
 array_to_string(list_transform(signals, lambda x: x.type || ':' || {_NUM.format('x.score')}), ', ') AS signals FROM e""", "sheets")
def _(v):
    meta = {"client": F.col("client"), "asset_type": F.col("asset"), "work_type": F.col("work")}
    out = G.select_by_signals(paged(v), PROFILES, sections="sections", metadata=meta, explained=False)
    return out.withColumn("signals", F.array_join(F.transform("signals", lambda s: F.concat(s["type"], F.lit(":"), G._number(s["score"]))), ", "))


# --- analysis and fixtures ----------------------------------------------------------------

_WORDS = f"len(list_filter(string_split_regex(text, '[{SPACE}]+'), lambda x: x <> ''))"
RULES = (A.Rule("R-1", "Customer Name"), A.Rule("R-2", "Job No"), A.Rule("R-3", "Serial No"), A.Rule("R-4", "Mileage"), A.Rule("R-5", "Parts Used"), A.Rule("R-6", "Valid until", False), A.Rule("R-7", "Warranty code"), A.Rule("R-8", "Asset No"))


def _detected(rule: A.Rule) -> str:
    low = rule.field.lower()
    return f"(contains(lower(text), '{low}') OR contains(lower(text), '{low.split(' ')[0]}'))"


def _said(rule: A.Rule) -> str:
    after = f"substring(text, instr(lower(text), '{rule.field.lower()}') + {len(rule.field)}, 100)"
    got = f"left({_trimmed(f'''regexp_extract({after}, '[:=]?[{SPACE}]*([^\\n\\r]+)', 1)''')}, 50)"
    return f"CASE WHEN instr(lower(text), '{rule.field.lower()}') > 0 AND {got} <> '' THEN {got} ELSE '[detected]' END"


#: Whole sheets and their first words only, so that texts with too little content are among them.
_SHORT = "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN left(text, 40) ELSE text END AS text FROM sheets"


def shortened(v):
    return v.sheets.select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.substring("text", 1, 40)).otherwise(F.col("text")).alias("text"))


_HIT = f"SELECT *, {_WORDS} AS words, [{', '.join(map(_detected, RULES))}] AS hit, length({_trimmed('text')}) <= 50 OR {_WORDS} < 10 AS none FROM ({_SHORT})"


@query("rule_analysis", f"""WITH h AS ({_HIT}) SELECT doc_id, CASE WHEN none THEN 'FAIL' ELSE 'PASS' END AS result, CAST(CASE WHEN none THEN 0 ELSE floor(least(50.0::DOUBLE, words / 10.0::DOUBLE) + floor(n / {sum(x.required for x in RULES)}.0::DOUBLE * 50 + 0.5) + 0.5) END AS INTEGER) AS score,
 words, n AS detected, array_to_string(list_filter([{', '.join(f"CASE WHEN hit[{i + 1}] THEN '{x.field}=' || {_said(x)} END" for i, x in enumerate(RULES))}], lambda x: x IS NOT NULL), '|') AS fields,
 array_to_string(list_concat(CASE WHEN none THEN ['S1:OCR_FAILURE:Document Content'] ELSE [] END, list_sort(list_filter([{', '.join(f"CASE WHEN NOT hit[{i + 1}] THEN 'S3:LOW_CONFIDENCE:{x.field}' END" for i, x in enumerate(RULES) if x.required)}], lambda x: x IS NOT NULL))), '|') AS findings
 FROM (SELECT *, len(list_filter(hit, lambda x: x)) AS n FROM h)""", "sheets")
def _(v):
    out = A.analyse(shortened(v), RULES)
    return out.select("doc_id", "result", "score", "words", "detected", F.array_join(F.transform("fields", lambda f: F.concat(f["field"], F.lit("="), f["value"])), "|").alias("fields"),
                      F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["severity"], f["reason"], f["field"])), "|").alias("findings"))


SPECS = {
    "repair": (A.SpecField("jobReference", "Job No", True, True), A.SpecField("serialNumber", "Serial No"), A.SpecField("warrantyCode", "Warranty"), A.SpecField("partsRequired", "Gasket", False)),
    "service": (A.SpecField("mileage", "Mileage", True, False), A.SpecField("assetId", "Asset", True, True))}
_CASES = """SELECT doc_id AS case_id, CASE doc_id % 3 WHEN 0 THEN 'repair' WHEN 1 THEN 'service' ELSE 'other' END AS spec, text AS input_text, CASE doc_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'review_queue' END AS expected_outcome,
 CASE WHEN doc_id % 5 = 0 THEN ['MISSING_FIELD'] WHEN doc_id % 5 = 1 THEN ['MISSING_FIELD', 'INVALID_FORMAT'] END AS codes, doc_id % 2 = 0 AS required FROM sheets"""


def cases(v):
    n = F.col("doc_id")
    return v.sheets.select(
        n.alias("case_id"), F.when(n % 3 == 0, "repair").when(n % 3 == 1, "service").otherwise("other").alias("spec"), F.col("text").alias("input_text"), F.when(n % 4 == 0, "pass").when(n % 4 == 1, "fail").otherwise("review_queue").alias("expected_outcome"),
        F.when(n % 5 == 0, F.array(F.lit("MISSING_FIELD"))).when(n % 5 == 1, F.array(F.lit("MISSING_FIELD"), F.lit("INVALID_FORMAT"))).alias("expected_reason_codes"), (n % 2 == 0).alias("required"))


def _missing(fields, critical: bool) -> str:
    return " + ".join(f"(NOT ({' OR '.join(f'''contains(lower(input_text), '{w}')''' for w in f.words())}))::INT" for f in fields if f.required and (f.critical or not critical)) or "0"


_JUDGED = f"""SELECT *, CASE WHEN spec IN ({', '.join(f"'{s}'" for s in SPECS)}) THEN CASE WHEN grave > 0 THEN 'fail' WHEN n > 0 THEN 'review_queue' ELSE 'pass' END END AS outcome, list_filter(coalesce(codes, []), lambda x: NOT (x = 'MISSING_FIELD' AND coalesce(n, 0) > 0)) AS lacking FROM (SELECT *,
 CASE spec {' '.join(f"WHEN '{s}' THEN {_missing(f, False)}" for s, f in SPECS.items())} END AS n, CASE spec {' '.join(f"WHEN '{s}' THEN {_missing(f, True)}" for s, f in SPECS.items())} END AS grave FROM c)"""
_ERRORS = """array_to_string(list_filter([CASE WHEN outcome IS NULL THEN 'No specification' WHEN outcome <> expected_outcome THEN 'Expected outcome ''' || expected_outcome || ''' but got ''' || outcome || '''' END,
 CASE WHEN len(lacking) > 0 THEN 'Missing expected reason codes: ' || array_to_string(lacking, ', ') END], lambda x: x IS NOT NULL), '; ')"""


@query("fixture_outcomes", f"WITH c AS ({_CASES}), j AS ({_JUDGED}) SELECT case_id, outcome, {_ERRORS} AS errors, {_ERRORS} = '' AS passed FROM j", "sheets")
def _(v):
    return A.expected_outcomes(cases(v), SPECS).select("case_id", "outcome", F.array_join("errors", "; ").alias("errors"), "passed")


@query("fixture_reports", f"WITH c AS ({_CASES}), j AS (SELECT *, {_ERRORS} = '' AS ok FROM ({_JUDGED})) SELECT spec, CASE WHEN count(*) FILTER (NOT ok AND required) = 0 THEN 'PASS' ELSE 'FAIL' END AS result, count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (NOT ok AND required) AS required_failed FROM j GROUP BY spec", "sheets")
def _(v):
    return A.matrix_report(A.expected_outcomes(cases(v), SPECS))


# --- specifications -----------------------------------------------------------------------


def spec_texts(v):
    """Specifications and regions as JSON, with faults by the part's number."""
    k, s = F.col("p_partkey"), F.col("p_size")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def rule(j):
        n = k + j
        kind = F.get(F.array(*map(F.lit, (*P.RULE_TYPES, "other"))), (n % 6).cast("int"))
        more = F.when(n % 6 == 2, F.when(k % 3 > 0, F.when(k % 4 == 1, ',"pattern":"([a-z"').otherwise(',"pattern":"^[(]\\\\d{2,}x?$"')).otherwise("")).when(n % 6 == 3, F.when(k % 2 == 0, ',"minValue":0').otherwise("")).when(
            n % 6 == 4, F.when(k % 4 > 0, ',"allowedValues":[]').otherwise("")).otherwise("")
        ident = F.when((k % 5 == 0) & (j == 1), "R-000").when(k % 9 == 4, text("r", j)).otherwise(text("R-00", j))
        return F.when(n % 17 == 3, "7").otherwise(text('{"id":"', ident, '","field":"f', j, '","type":"', kind, '","required":true', F.when(n % 10 == 3, "").otherwise(',"description":"d"'), more, ',"severity":"S', n % 5, '"}'))

    rules = text('"rules":[', F.array_join(F.when(k % 4 > 0, F.transform(F.sequence(F.lit(0), (k % 4).cast("int") - 1), lambda j: rule(j))).otherwise(F.array().cast("array<string>")), ","), "]")
    name = F.when(k % 17 == 0, F.lit(None)).when(k % 11 == 0, '"name":""').when(k % 13 == 0, '"name":5').when(k % 19 == 0, text('"name":"', F.repeat(F.lit("n"), 201), '"')).otherwise('"name":"spec"')
    version = F.when(k % 7 == 0, '"version":"v1"').when(k % 23 == 0, '"version":null').otherwise(text('"version":"1.0.', s, '"'))
    until = F.when(k % 29 == 1, '"expiryDate":"never"').when(k % 29 == 2, '"expiryDate":"2025-01-31T00:00:00Z"').when(k % 29 == 3, '"expiryDate":""')
    spec = F.when(k % 31 == 0, "[1]").when(k % 37 == 0, "{broken").otherwise(text("{", F.concat_ws(",", name, version, until, F.when(k % 41 == 0, '"rules":"none"').otherwise(rules)), "}"))
    box = lambda x, y, w, h: text('"bounds":{"x":', x, ',"y":', y, ',"width":', w, ',"height":', h, "}")
    first = text('{"name":"', F.when(s % 4 == 0, " ").otherwise("header"), '","page":', s % 3, ",", box(F.when(s % 5 == 0, "1.5").otherwise("0.5"), "0", F.when(s % 7 == 0, "0").otherwise("0.6"), "0.1"), "}")
    second = text('{"name":"', F.when(s % 6 == 0, "header").otherwise("box"), '","page":1', F.when(s % 8 == 0, "").otherwise(text(",", box("0.9", F.when(s % 2 == 0, "0.05").otherwise("0.5"), "0.1", "0.2"))), "}")
    return spread(v.table("part"), "p_partkey").select("p_partkey", spec.alias("spec"), F.when(k % 43 == 0, '{"regions":{}}').otherwise(text('{"regions":[', first, ",", second, "]}")).alias("regions"))


_RULE_AT = "'$.rules[' || j || ']"
_KIND = f"({list(P.RULE_TYPES) + ['other']})[n % 6 + 1]"
#: Each kind of fault from the conditions under which the view plants it: (relation, condition, path, level, code, message, value).
_SPEC_FAULTS = (
    ("a", "k % 31 = 0", "'$'", "error", "type", "'Specification must be a JSON object'", "'object'"), ("a", "k % 31 > 0 AND k % 37 = 0", "'$'", "error", "malformed", "'Specification must be JSON'", "NULL"),
    ("s", "k % 17 = 0", "'$.name'", "error", "required", "'Required field ''name'' is missing'", "NULL"), ("s", "k % 17 > 0 AND k % 11 = 0", "'$.name'", "error", "empty", "'Name cannot be empty'", "NULL"),
    ("s", "k % 17 > 0 AND k % 11 > 0 AND k % 13 = 0", "'$.name'", "error", "type", "'Name must be a string'", "'number'"), ("s", "k % 17 > 0 AND k % 11 > 0 AND k % 13 > 0 AND k % 19 = 0", "'$.name'", "error", "too_long", "'Name cannot exceed 200 characters'", "'201'"),
    ("s", "k % 7 = 0", "'$.version'", "error", "semver", "'Version must follow semantic versioning (e.g., 1.0.0)'", "'v1'"), ("s", "k % 7 > 0 AND k % 23 = 0", "'$.version'", "error", "type", "'Version must be a string'", "'object'"),
    ("s", "k % 29 = 1", "'$.expiryDate'", "error", "invalid_date", "'expiryDate must be a valid ISO 8601 date-time'", "'never'"), ("s", "k % 41 = 0", "'$.rules'", "error", "type", "'Rules must be an array'", "'string'"),
    ("s", "k % 41 > 0 AND k % 4 = 0", "'$.rules'", "error", "empty", "'Rules array cannot be empty'", "NULL"), ("r", "n % 17 = 3", f"{_RULE_AT}'", "error", "type", "'Each rule must be an object'", "NULL"),
    ("o", "n % 10 = 3", f"{_RULE_AT}.description'", "error", "required", "'Required field ''description'' is missing in rule'", "NULL"),
    ("o", "NOT (k % 5 = 0 AND j = 1) AND k % 9 = 4", f"{_RULE_AT}.id'", "warning", "rule_id_form", "'Rule ID should follow pattern X-NNN (e.g., R-001)'", "'r' || j"),
    ("o", "k % 5 = 0 AND j = 1 AND k % 9 <> 4 AND k % 17 <> 3", f"{_RULE_AT}.id'", "error", "duplicate", "'Duplicate rule ID: R-000'", "'R-000'"),
    ("o", "n % 6 = 5", f"{_RULE_AT}.type'", "error", "rule_type", f"'Invalid rule type. Must be one of: {', '.join(P.RULE_TYPES)}'", "'other'"), ("o", "n % 6 = 2 AND k % 3 = 0", f"{_RULE_AT}.pattern'", "error", "required", "'Pattern is required for regex type rules'", "NULL"),
    ("o", "n % 6 = 2 AND k % 3 > 0 AND k % 4 = 1", f"{_RULE_AT}.pattern'", "error", "pattern", "'Invalid regex pattern'", "'([a-z'"), ("o", "n % 6 = 3 AND k % 2 = 1", f"{_RULE_AT}'", "error", "range", "'Range type requires minValue and/or maxValue'", "NULL"),
    ("o", "n % 6 = 4 AND k % 4 = 0", f"{_RULE_AT}.allowedValues'", "error", "required", "'allowedValues is required for enum type rules'", "NULL"),
    ("o", "n % 5 = 4", f"{_RULE_AT}.severity'", "error", "severity", f"'Invalid severity. Must be one of: {', '.join(P.SEVERITIES)}'", "'S4'"))
_AT = "'$.regions[{0}]"
_REGION_FAULTS = (
    ("b", "k % 43 = 0", "'$.regions'", "error", "type", "'regions must be an array'", "NULL"), ("g", "s % 4 = 0", "'$.regions[0].name'", "error", "required", "'Region 0: name is required'", "NULL"),
    ("g", "s % 3 = 0", "'$.regions[0].page'", "error", "page", "'Region 0: page must be >= 1 (1-indexed)'", "'0'"), ("g", "s % 5 = 0", "'$.regions[0].bounds.x'", "error", "bounds", "'Region 0: bounds.x must be 0-1 (normalized)'", "'1.5'"),
    ("g", "s % 7 = 0", "'$.regions[0].bounds.width'", "error", "bounds", "'Region 0: bounds.width must be 0-1 (normalized)'", "'0'"), ("g", "s % 7 > 0 OR s % 5 = 0", "'$.regions[0].bounds'", "warning", "beyond_page", "'Region 0: x + width exceeds page boundary'", "NULL"),
    ("g", "s % 4 = 0", "'$.regions[0].name'", "warning", "unusual_region", "'Region 0: '' '' is not a standard ROI type'", "' '"), ("g", "s % 8 = 0", "'$.regions[1].bounds'", "error", "required", "'Region 1: bounds are required'", "NULL"),
    ("g", "s % 6 > 0 AND s % 8 > 0", "'$.regions[1].name'", "warning", "unusual_region", "'Region 1: ''box'' is not a standard ROI type'", "'box'"), ("g", "s % 6 = 0 AND s % 4 > 0", "'$.regions'", "warning", "duplicate", "'Duplicate region names: header'", "NULL"),
    ("g", "s % 8 > 0 AND s % 3 = 1 AND s % 2 = 0 AND s % 5 > 0 AND s % 7 > 0", "'$.regions'", "warning", "overlap", "'Regions ''' || CASE WHEN s % 4 = 0 THEN ' ' ELSE 'header' END || ''' and ''' || CASE WHEN s % 6 = 0 THEN 'header' ELSE 'box' END || ''' overlap'", "NULL"))


def _fault_rows(part: str, rows) -> str:
    return " UNION ALL ".join(f"SELECT k AS p_partkey, '{part}' AS part, {path} AS path, '{level}' AS level, '{code}' AS code, {message} AS message, {value} AS value FROM {rel} WHERE {test}" for rel, test, path, level, code, message, value in rows)


@query("spec_faults", f"""WITH b AS (SELECT p_partkey AS k, p_size AS s FROM part), a AS (SELECT k FROM b), s AS (SELECT k FROM b WHERE k % 31 > 0 AND k % 37 > 0), r AS (SELECT k, j, k + j AS n FROM (SELECT k, unnest(range(0, k % 4)) AS j FROM s WHERE k % 41 > 0)), o AS (SELECT * FROM r WHERE n % 17 <> 3),
 g AS (SELECT * FROM b WHERE k % 43 > 0) {_fault_rows('spec', _SPEC_FAULTS)} UNION ALL {_fault_rows('regions', _REGION_FAULTS)}""")
def _(v):
    return P.faults(spec_texts(v), "p_partkey", "spec", "regions")
