"""Queries over document text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import documents as D
from .registry import query
from .reports import r

TOK = "list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')"


def docs(v):
    return v.table("documents").select("doc_id", "text")


@query("document_tokens", f"SELECT doc_id, len({TOK}) AS n_tokens, len(list_distinct({TOK})) AS n_distinct FROM documents")
def _(v):
    t = docs(v).withColumn("t", S.tokens(F.col("text")))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query("ocr_corrections", "SELECT doc_id, md5(t) AS digest FROM (SELECT doc_id, " + "".join("regexp_replace(" for _ in S.OCR_CORRECTIONS) + "text" + "".join(f", '\\b{a}\\b', '{b}', 'g')" for a, b in S.OCR_CORRECTIONS) + " AS t FROM documents)")
def _(v):
    return docs(v).select("doc_id", F.md5(S.correct_ocr(F.col("text")).cast("binary")).alias("digest"))


_RULES = [(p, t) for _, p, t in S.REDACTIONS]
REDACTED = "".join("regexp_replace(" for _ in _RULES) + "text" + "".join(f", '{p}', '{t}', 'g')" for p, t in _RULES)


@query("redacted_documents", f"SELECT doc_id, md5(t) AS digest, t <> text AS changed FROM (SELECT doc_id, text, {REDACTED} AS t FROM documents)")
def _(v):
    return docs(v).withColumn("t", S.redact(F.col("text"))).select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), (F.col("t") != F.col("text")).alias("changed"))


TAGS = tuple(dict.fromkeys(tag for _, tag in _RULES))


@query("redaction_counts", "SELECT " + ", ".join(f"sum((length(t) - length(replace(t, '{tag}', ''))) // {len(tag)})::BIGINT AS {tag.strip('[]').lower()}" for tag in TAGS) + f" FROM (SELECT {REDACTED} AS t FROM documents)")
def _(v):
    n = lambda tag: F.sum(((F.length("t") - F.length(F.replace(F.col("t"), F.lit(tag), F.lit("")))) / len(tag)).cast("long")).alias(tag.strip("[]").lower())
    return docs(v).select(S.redact(F.col("text")).alias("t")).agg(*map(n, TAGS))


_ART = " + ".join("len(regexp_extract_all(text, '" + p.replace("'", "''") + "'))" for p in D.ARTIFACTS)
QUALITY = f"""WITH b AS (SELECT doc_id, length(text) AS n, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, ' '))) AS ind,
 len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words, {_ART} AS artifacts FROM documents), c AS (SELECT *, CASE WHEN words > 0 THEN n / words::DOUBLE ELSE 0 END AS density, CASE WHEN lines > 0 THEN ind / lines::DOUBLE ELSE 0 END AS sh FROM b),
 d AS (SELECT *, greatest(0, least(100, 70 + CASE WHEN density > 5 AND density < 15 THEN 15 ELSE 0 END + CASE WHEN words > 50 THEN 10 ELSE 0 END + CASE WHEN artifacts < 3 THEN 10 ELSE 0 END - artifacts * 5)) AS blur,
 greatest(0, least(100, 70 + CASE WHEN n > 200 THEN 10 ELSE 0 END + CASE WHEN lines > 5 THEN 10 ELSE 0 END + CASE WHEN artifacts < 5 THEN 10 ELSE 0 END - artifacts * 3)) AS contrast, CASE WHEN sh > 0.5 THEN floor((sh - 0.5) * 10 * 100 + 0.5) / 100 ELSE 0.0 END AS skew,
 CASE WHEN n < 50 AND artifacts < 2 THEN 95 WHEN artifacts > 10 THEN 25 ELSE 70 END AS brightness FROM c),
 e AS (SELECT doc_id, artifacts, blur, contrast, skew, brightness, CAST(greatest(0, least(100, floor(blur * 0.3::DOUBLE + contrast * 0.3::DOUBLE + (100 - abs(skew) * 2) * 0.2::DOUBLE + brightness * 0.2::DOUBLE + 0.5))) AS BIGINT) AS overall FROM d)"""


@query("page_quality", f"{QUALITY} SELECT doc_id, CAST(artifacts AS BIGINT) AS artifacts, CAST(blur AS BIGINT) AS blur, CAST(contrast AS BIGINT) AS contrast, skew, brightness, overall FROM e")
def _(v):
    return D.page_quality(docs(v)).select("doc_id", F.col("artifacts").cast("long").alias("artifacts"), F.col("blur").cast("long").alias("blur"), F.col("contrast").cast("long").alias("contrast"), "skew", "brightness", "overall")


@query("document_quality", f"{QUALITY}, g AS (SELECT doc_id // 3 AS sheet, min(overall) AS lowest, CAST(floor(avg(overall) + 0.5) AS BIGINT) AS average, count(*) FILTER (blur < 30 OR contrast < 20 OR skew > 5) AS pages_with_issues FROM e GROUP BY 1), h AS (SELECT *, CAST(floor(lowest * 0.4::DOUBLE + average * 0.6::DOUBLE + 0.5) AS BIGINT) AS quality FROM g) SELECT *, quality < 50 OR pages_with_issues > 0 AS requires_review FROM h")
def _(v):
    return D.document_quality(D.page_quality(docs(v)).withColumn("sheet", F.floor(F.col("doc_id") / 3)), "sheet")


#: A pack of templates by words that the languages of the driver's documents use.
TEMPLATES = (
    D.Template("de-sheet", ("der", "die"), ("und", "nicht"), ("das", "mit")), D.Template("en-sheet", ("the", "of"), ("and", "that"), ("with", "for"), r"\bthe\b"),
    D.Template("es-sheet", ("los", "que"), ("el", "una"), ("del", "por")), D.Template("fr-sheet", ("les", "des"), ("est", "une"), ("dans", "pour")))


def _score_sql(t: D.Template) -> str:
    has = lambda w: f"list_contains(w, '{w}')"
    gain = lambda ws, n: " + ".join(f"CASE WHEN {has(w)} THEN {n}.0 ELSE 0.0 END" for w in ws) or "0.0"
    s = f"CASE WHEN {' AND '.join(map(has, t.required_all))} THEN {gain(t.required_all, 10)} ELSE greatest(0.0, {gain(t.required_all, 10)} - 50) END"
    s = f"(CASE WHEN {' OR '.join(map(has, t.required_any))} THEN ({s}) + {gain(t.required_any, 5)} ELSE greatest(0.0, ({s}) - 30) END)"
    if t.form_code:
        s += f" + CASE WHEN regexp_matches(array_to_string(w, ' '), '(?i){t.form_code}') THEN 15.0 ELSE 0.0 END"
    s += " + " + gain(t.optional, 2)
    most = len(t.required_all) * 10 + 5 + (15 if t.form_code else 0) + len(t.optional) * 2
    return f"least(100.0, floor(CAST({s} AS DOUBLE) / {most} * 100 + 0.5))"


SCORES = f"WITH t AS (SELECT doc_id, list_distinct({TOK}) AS w FROM documents), s AS (" + " UNION ALL ".join(f"SELECT doc_id, '{t.slug}' AS slug, {_score_sql(t)} AS score FROM t" for t in TEMPLATES) + ")"


@query("template_scores", f"{SCORES} SELECT doc_id, slug, CAST(score AS DOUBLE) AS score FROM s")
def _(v):
    return D.template_scores(docs(v), TEMPLATES)


@query("selected_templates", f"""{SCORES}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, slug) AS rn FROM s), p AS (SELECT doc_id, max(slug) FILTER (rn = 1) AS slug, max(score) FILTER (rn = 1) AS top_score, max(score) FILTER (rn = 2) AS runner_up_score FROM w GROUP BY doc_id),
 q AS (SELECT *, top_score - runner_up_score AS gap, CASE WHEN top_score >= 80 THEN 'HIGH' WHEN top_score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM p)
 SELECT doc_id, slug, CAST(top_score AS DOUBLE) AS top_score, CAST(runner_up_score AS DOUBLE) AS runner_up_score, CAST(gap AS DOUBLE) AS gap, band, band = 'HIGH' OR (band = 'MEDIUM' AND gap >= 10) AS selected,
 CASE WHEN band = 'HIGH' OR (band = 'MEDIUM' AND gap >= 10) THEN NULL WHEN band = 'MEDIUM' THEN 'MEDIUM confidence with ambiguous gap (' || CAST(gap AS BIGINT) || ' < 10)' ELSE 'LOW confidence (' || CAST(top_score AS BIGINT) || ' < 50)' END AS block_reason FROM q""")
def _(v):
    return D.select_template(docs(v), TEMPLATES)


#: What the templates are for, by slug.
KNOWN = {"de-sheet": {"client": "src0", "asset_type": "a1", "work_type": None}, "en-sheet": {"client": "src1", "asset_type": "a0", "work_type": "w1"}, "fr-sheet": {"client": None, "asset_type": "a1", "work_type": "w0"}}


def _boosted_sql(t: D.Template) -> str:
    s = "score"
    for name, column, gain in (("client", "source", 10), ("asset_type", "asset", 5), ("work_type", "work", 5)):
        if KNOWN.get(t.slug, {}).get(name):
            s = f"CASE WHEN {column} = '{KNOWN[t.slug][name]}' THEN least(100.0, {s} + {gain}) ELSE {s} END"
    return f"WHEN '{t.slug}' THEN {s}"


@query("boosted_selection", f"""{SCORES}, m AS (SELECT doc_id, source, 'a' || (doc_id % 3) AS asset, 'w' || (doc_id % 2) AS work FROM documents), b AS (SELECT s.doc_id, s.slug, CAST(CASE s.slug {' '.join(map(_boosted_sql, TEMPLATES))} END AS DOUBLE) AS score FROM s JOIN m ON m.doc_id = s.doc_id),
 w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, slug) AS rn FROM b), p AS (SELECT doc_id, max(slug) FILTER (rn = 1) AS slug, max(score) FILTER (rn = 1) AS top_score, max(score) FILTER (rn = 2) AS runner_up_score FROM w GROUP BY doc_id)
 SELECT *, top_score >= 80 OR (top_score >= 50 AND top_score - runner_up_score >= 10) AS selected FROM p""")
def _(v):
    from ..operators.templates import booster

    d = v.table("documents").select("doc_id", "text", "source", F.concat(F.lit("a"), F.col("doc_id") % 3).alias("asset"), F.concat(F.lit("w"), F.col("doc_id") % 2).alias("work"))
    meta = {"client": F.col("source"), "asset_type": F.col("asset"), "work_type": F.col("work")}
    return D.select_template(d, TEMPLATES, carry=("source", "asset", "work"), boost=booster(KNOWN, meta)).select("doc_id", "slug", "top_score", "runner_up_score", "selected")


@query("weighted_signals", f"WITH s(signal, weight, score) AS (SELECT * FROM (VALUES ('token', 0.40, 1), ('layout', 0.20, 2), ('roi', 0.25, 3), ('plausibility', 0.15, 4))) SELECT e.user_id, e.event_type, {r('sum(x * weight) / sum(weight)')} AS score, count(*) AS signals FROM (SELECT user_id, event_type, s.signal, s.weight::DOUBLE AS weight, avg(value) FILTER (event_id % 5 = s.score) AS x FROM events, s GROUP BY ALL) e WHERE x IS NOT NULL GROUP BY ALL")
def _(v):
    w = v.spark.createDataFrame([("token", 0.40, 1), ("layout", 0.20, 2), ("roi", 0.25, 3), ("plausibility", 0.15, 4)], "signal string, weight double, n int")
    e = v.table("events").join(F.broadcast(w), F.col("event_id") % 5 == F.col("n")).groupBy("user_id", "event_type", "signal", "weight").agg(F.avg("value").alias("score"))
    return D.weighted_signals(e, ["user_id", "event_type"]).withColumn("score", S.r6(F.col("score")))


PATTERNS = {"email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "date": r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{4}\b"}


@query("field_candidates", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS field, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for n, p in PATTERNS.items()))
def _(v):
    return D.candidates(docs(v), PATTERNS)


@query("pattern_fields", "SELECT doc_id, 'token' AS field, trim(regexp_extract(text, 'token = \"([0-9a-f]+)\"', 1)) AS value, 75 AS confidence FROM documents WHERE trim(regexp_extract(text, 'token = \"([0-9a-f]+)\"', 1)) <> ''")
def _(v):
    return D.extract_with_patterns(docs(v), {"token": [r'token = "([0-9a-f]+)"']})


@query("document_types", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'LICENSED' WHEN contains(lower(text), '|') THEN 'TABLE' WHEN contains(lower(text), '###') THEN 'NOISE' ELSE 'UNKNOWN' END AS kind FROM documents")
def _(v):
    return docs(v).select("doc_id", D.classify(F.col("text"), [("license", "LICENSED"), ("|", "TABLE"), ("###", "NOISE")]).alias("kind"))


@query("keyword_coverage", f"SELECT doc_id, {r(f'''least(50.0, len(list_filter(string_split_regex(text, '{chr(92)}s+'), lambda x: x <> '')) / 10.0::DOUBLE) + (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'der') THEN 1 ELSE 0 END) / 2.0::DOUBLE * 50''')} AS score FROM documents")
def _(v):
    return docs(v).select("doc_id", S.r6(D.keyword_coverage(F.col("text"), ["the", "der"])).alias("score"))


@query("fuzzy_names", f"SELECT c_custkey, {r('(1 - levenshtein(lower(c_name), lower(n_name)) / greatest(length(c_name), length(n_name))::DOUBLE) * 100')} AS ratio FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(v):
    j = v.table("customer").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("c_custkey", S.r6(S.fuzzy_ratio(F.col("c_name"), F.col("n_name"))).alias("ratio"))


@query("file_names", "SELECT p_partkey, left(regexp_replace(list_last(string_split(replace(p_name || '/' || p_type, '\\', '/'), '/')), '[^A-Za-z0-9._-]', '_', 'g'), 255) AS name, sha256(p_name) AS digest, left(sha256(p_partkey || ':' || p_size), 16) AS idempotency FROM part")
def _(v):
    return v.table("part").select("p_partkey", S.safe_file_name(F.concat("p_name", F.lit("/"), "p_type")).alias("name"), F.sha2("p_name", 256).alias("digest"), S.short_hash(F.col("p_partkey").cast("string"), F.col("p_size").cast("string")).alias("idempotency"))


@query("rolling_hash_cohorts", """WITH RECURSIVE s AS (SELECT p_partkey, p_brand AS t, 1 AS i, CAST(0 AS BIGINT) AS h FROM part UNION ALL SELECT p_partkey, t, i + 1, CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END FROM (SELECT p_partkey, t, i, (((h * 31 + ascii(substring(t, i, 1))) % 4294967296) + 4294967296) % 4294967296 AS x FROM s WHERE i <= length(t)))
 SELECT p_partkey, abs(h) AS hash, CASE WHEN abs(h) % 100 / 100.0 < 0.3 THEN 'B' ELSE 'A' END AS cohort FROM s WHERE i = length(t) + 1""")
def _(v):
    return v.table("part").select("p_partkey", S.rolling_hash(F.col("p_brand")).alias("hash"), S.cohort(F.col("p_brand"), 0.3).alias("cohort"))


@query("initials", "SELECT c_custkey, CASE WHEN contains(c_name, ' ') THEN left(c_name, 1) || '. ' || left(list_last(string_split(c_name, ' ')), 1) || '.' ELSE left(c_name, 1) || '.' END AS initials FROM customer")
def _(v):
    return v.table("customer").select("c_custkey", S.initials(F.col("c_name")).alias("initials"))


@query("normalised_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS same FROM orders")
def _(v):
    d = F.to_date("o_orderdate")
    text = F.concat_ws("/", F.dayofmonth(d).cast("string"), F.month(d).cast("string"), F.year(d).cast("string"))
    return v.table("orders").select("o_orderkey", S.normalise_date(text).alias("iso"), S.normalise_date(d.cast("string")).alias("same"))


@query("byte_texts", "SELECT p_partkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10) END AS size FROM (SELECT p_partkey, p_partkey * p_size * 37 AS b FROM part)")
def _(v):
    return v.table("part").select("p_partkey", S.byte_text(F.col("p_partkey") * F.col("p_size") * 37).alias("size"))


SELECTED = "w2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, slug) AS rn FROM s), p2 AS (SELECT doc_id, max(slug) FILTER (rn = 1) AS slug, max(score) FILTER (rn = 1) AS t1, max(score) FILTER (rn = 2) AS t2 FROM w2 GROUP BY doc_id), q2 AS (SELECT doc_id, slug, CASE WHEN t1 >= 80 THEN 'HIGH' WHEN t1 >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS band, t1 >= 80 OR (t1 >= 50 AND t1 - t2 >= 10) AS selected FROM p2)"


@query("document_pipeline", f"{QUALITY}, {SCORES[5:]}, {SELECTED} SELECT q2.doc_id, slug, band, overall, CASE WHEN NOT selected OR overall < 50 OR blur < 30 OR contrast < 20 OR skew > 5 THEN 'review_queue' ELSE 'processed' END AS status FROM q2 JOIN e ON q2.doc_id = e.doc_id")
def _(v):
    return D.process(docs(v), TEMPLATES)


@query("fixture_matrix", f"{SCORES}, {SELECTED}, m AS (SELECT selected = (lang <> 'xx') AND slug = lang || '-sheet' AS ok, q2.doc_id % 2 = 0 AS required FROM q2 JOIN documents d ON d.doc_id = q2.doc_id) SELECT count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (NOT ok AND required) AS required_failed FROM m")
def _(v):
    d = v.table("documents")
    cases = d.select(F.col("doc_id").alias("case_id"), "text", F.concat("lang", F.lit("-sheet")).alias("expected_slug"), F.lit(True).alias("expected_selected"), (F.col("doc_id") % 2 == 0).alias("required"))
    return D.matrix_totals(D.fixture_matrix(cases, TEMPLATES))
