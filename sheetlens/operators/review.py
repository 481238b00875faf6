"""Review routing, guardrails, regions, detectors and personal-data scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import js_regex, rank_of

SEVERITY_ORDER = ("S0", "S1", "S2", "S3")


def worst(severity: str = "severity") -> Column:
    """The worst severity of a group: the smallest, S0 first."""
    return F.min(severity)


def second_reading(fields: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fields worth reading again: ``fields(doc_id, field, value, confidence, threshold, has_box)``; missing required ones, else those below their threshold, if they have a box."""
    blank = F.coalesce(F.col("value"), F.lit("")) == ""
    missing = blank & F.col("field").isin(*required)
    reason = F.when(missing, F.when(F.col("has_box"), "missing")).when((F.col("confidence") < F.col("threshold")) & F.col("has_box"), "low_confidence")
    return fields.select("doc_id", "field", reason.alias("reason")).filter("reason IS NOT NULL")


def review_routing(fields: DataFrame, required: Sequence[str], failed: DataFrame | None = None) -> DataFrame:
    """Per document whether to review, the priority and the number of reasons.

    Reasons: a field below 0.5 (S1 if required, else S2), a required field missing (S0), a
    failed second reading (S2, from ``failed(doc_id)``).
    """
    need = F.array(*map(F.lit, required))
    low = fields.filter("confidence < 0.5").select("doc_id", F.when(F.array_contains(need, F.col("field")), "S1").otherwise("S2").alias("severity"))
    have = fields.groupBy("doc_id").agg(F.collect_set(F.when(F.coalesce("value", F.lit("")) != "", F.col("field"))).alias("_h"))
    gone = have.select("doc_id", F.explode(F.array_except(need, F.col("_h"))).alias("_f")).select("doc_id", F.lit("S0").alias("severity"))
    reasons = low.unionByName(gone)
    if failed is not None:
        reasons = reasons.unionByName(failed.select("doc_id", F.lit("S2").alias("severity")).distinct())
    g = reasons.groupBy("doc_id").agg(worst().alias("worst"), F.count("*").alias("reasons"))
    every = fields.select("doc_id").distinct().join(g, "doc_id", "left")
    return every.select("doc_id", F.col("worst").isNotNull().alias("route"), F.coalesce("reasons", F.lit(0)).alias("reasons"),
                        F.when(F.col("worst") == "S0", "high").when(F.col("worst") == "S1", "medium").otherwise("low").alias("priority"))


def queue_for_review(findings: DataFrame, low_confidence: DataFrame) -> DataFrame:
    """Documents to look at, why, and which fields: critical and major findings first, then ``low_confidence(doc_id, field)``."""
    bad = findings.filter(F.col("severity").isin("critical", "major")).select("doc_id", "field", F.lit(0).alias("_k"))
    low = low_confidence.select("doc_id", "field", F.lit(1).alias("_k"))
    g = bad.unionByName(low).groupBy("doc_id").agg(F.min("_k").alias("_k"), F.array_sort(F.collect_set("field")).alias("_f"))
    return g.select("doc_id", F.when(F.col("_k") == 0, "validation_failure").otherwise("low_confidence").alias("reason"), F.array_join("_f", ",").alias("fields"))


BEHAVIOURS = ("STOP", "REVIEW_QUEUE", "CONTINUE")


def guardrails(fields: DataFrame, anomaly_limit: float = 0.7) -> DataFrame:
    """Four checks per document and the worst behaviour they ask for.

    ``fields(doc_id, field, value, confidence, extracted, is_critical, review_threshold, anomaly)``.
    """
    per = fields.groupBy("doc_id", "field").agg(F.count_distinct(F.when(F.col("extracted"), F.col("value"))).alias("_v"), F.count_if("extracted").alias("_n"),
                                                F.count_if(F.col("is_critical") & F.col("extracted") & (F.col("confidence") < F.col("review_threshold"))).alias("_low"), F.max("anomaly").alias("_a"))
    g = per.groupBy("doc_id").agg((F.sum("_n") > 0).alias("g001"), (F.sum("_low") == 0).alias("g002"), (F.count_if(F.col("_v") > 1) == 0).alias("g003"), (F.max("_a") <= anomaly_limit).alias("g004"))
    behaviour = F.when(~F.col("g001"), "STOP").when(~(F.col("g002") & F.col("g003") & F.col("g004")), "REVIEW_QUEUE").otherwise("CONTINUE")
    return g.withColumn("behaviour", behaviour)


def region_processing(fields: DataFrame, critical: Sequence[str], per_document: int = 3, per_region: int = 2, least: float = 0.6) -> DataFrame:
    """``fields(doc_id, ord, field, has_region, confidence)`` with source, attempts and the reason to review.

    A region below ``least`` is read again, at most ``per_region`` times, and a document's
    attempts stop at ``per_document``: attempts are a running sum in the order of the fields.
    """
    weak = F.col("has_region") & (F.col("confidence") < least)
    want = F.when(weak, per_region).otherwise(0)
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = F.coalesce(F.sum(want).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    f = fields.withColumn("attempts", F.greatest(F.lit(0), F.least(want, per_document - before)).cast("long"))
    is_critical = F.col("field").isin(*critical)
    source = F.when(F.col("attempts") > 0, "reprocessed").when(F.col("has_region"), "roi").otherwise("fullpage")
    conf = F.when(F.col("attempts") > 0, F.least(F.col("confidence") + 0.05, F.lit(0.95))).when(F.col("has_region"), F.col("confidence")).when(is_critical, 0.0).otherwise(0.75)
    f = f.withColumn("source", source).withColumn("final", conf)
    reason = F.when(is_critical & ~F.col("has_region"), "SPEC_GAP").when(F.col("final") < least, F.when(F.col("attempts") > 0, "OCR_FAILURE").otherwise("LOW_CONFIDENCE"))
    return f.withColumn("reason", reason)


# What companies' names end with.
_SUFFIXES = "Inc|LLC|Corp|Corporation|Ltd|Limited|Co|Company|Industries|Solutions|Services|Group|Holdings"
# Words that begin no name.
NO_NAMES = ("TECH-", "CUSTOMER_", "VENDOR_", "PART-", "JS-", "Standard", "Job", "Sheet", "Missing", "Signature", "Low", "Confidence", "OCR", "Table", "Heavy", "Conflicting", "Invalid", "Format",
            "Out", "Policy", "Multiple", "Failures", "Full", "Major", "Complex", "Scheduled")
# What looks like personal data in fixtures.
PERSONAL = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "phone": r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}", "usPostalCode": r"\b\d{5}(?:-\d{4})?\b",
    "ukPostalCode": r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b",
    "streetAddress": r"(?i)\b\d+\s+(?:[A-Z][a-z]+\s+){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Way|Place|Pl)\b",
    "realCompany": rf"\b(?!CUSTOMER_|VENDOR_|SUPPLIER_|PARTNER_)[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:{_SUFFIXES})\b",
    "realName": rf"\b(?!{'|'.join(NO_NAMES)})(?:[A-Z][a-z]{{2,}})\s+(?:[A-Z][a-z]{{2,}})\b"}
# Phrases that are no personal data.
ALLOWED = ("Job Number", "Job Sheet", "Service Date", "Work Description", "Emergency repair", "Quarterly maintenance inspection", "Installation", "Preventive maintenance", "Multiple Failures",
           "Full system replacement", "Repair and calibration", "Complex repair", "Scheduled inspection", "Major overhaul")


#: Where a match of each pattern can begin, looked at before the pattern itself. An e-mail's
#: can't begin inside a run of its characters, but for what the match before it left of one.
_BEGINS = {
    "email": r"(?=[a-zA-Z0-9._%+-])(?:\G|(?<![a-zA-Z0-9._%+-]))", "phone": "(?=[+1(0-9])", "usPostalCode": "(?=[0-9])", "ukPostalCode": "(?=[A-Za-z])", "streetAddress": "(?=[0-9])",
    "realCompany": "(?=[A-Z])", "realName": "(?=[A-Z])"}


#: The same patterns without trying again what cannot match: each begins at one character, whose
#: boundary is looked at next, and a run of letters or blanks that ends at what follows is never given back.
_FASTER = {
    PERSONAL["email"]: _BEGINS["email"] + r"[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", PERSONAL["usPostalCode"]: r"\d(?<!\w\d)\d{4}(?:-\d{4})?(?!\w)",
    PERSONAL["ukPostalCode"]: r"[A-Za-z](?<!\w[A-Za-z])[A-Za-z]?+\d[A-Za-z\d]?\s*+\d[A-Za-z]{2}(?!\w)",
    PERSONAL["streetAddress"]: r"\d(?<!\w\d)\d*+\s++(?i)(?:[A-Z][a-z]++\s++){1,3}" + PERSONAL["streetAddress"].partition("{1,3}")[2].removesuffix(r"\b") + r"(?!\w)",
    PERSONAL["realCompany"]: rf"[A-Z](?<!\w[A-Z])[a-z]++(?:\s++[A-Z][a-z]++)*\s++(?:{_SUFFIXES})(?!\w)"}


def personal_data(texts: DataFrame, patterns: Mapping[str, str], allowed: Sequence[str] = (), key: str | Sequence[str] = "doc_id", text: str = "text") -> DataFrame:
    """(key, pattern, match) of what looks like personal data, without allowed phrases, placeholders, and postal codes that are parts of dates.

    A postal code is one of a date if a year and month stand at most five characters before
    where it first occurs. A null text holds nothing; repeated rows give repeated results.
    """
    keys, t = [key] if isinstance(key, str) else list(key), F.coalesce(F.col(text), F.lit(""))

    def hits(name: str, pattern: str) -> Column:
        def hit(m: Column) -> Column:
            before = F.greatest(F.lit(1), F.position(m, t) - 5)
            dated = F.substring(t, before, F.lit(15)).rlike(r"^\d{4}-\d{2}") if name == "usPostalCode" else F.lit(False)
            return F.struct(F.lit(name).alias("pattern"), m.alias("match"), dated.alias("dated"))

        near = F.array_join(F.filter(F.split(t, " "), lambda w: w.contains("@")), " ") if name == "email" and pattern == PERSONAL["email"] else t  # it holds no blank
        return F.transform(F.regexp_extract_all(near, F.lit(_FASTER.get(pattern) or _BEGINS.get(name, "") + js_regex(pattern)), 0), hit)

    found = texts.select(*keys, F.explode(F.concat(*[hits(n, p) for n, p in patterns.items()])).alias("h")).select(*keys, "h.pattern", "h.match", "h.dated")
    ok = reduce(lambda a, p: a & ~F.col("match").contains(p), allowed, ~F.col("match").rlike("(?i)^(CUSTOMER_|VENDOR_|SUPPLIER_|PARTNER_|TECH-|PART-|JS-)"))
    return found.filter(ok & ~F.col("dated")).drop("dated")


# Parts of names whose values are secret.
SENSITIVE = ("password", "secret", "token", "apikey", "api_key", "authorization", "auth", "credential", "private_key", "privatekey", "ssn", "social_security", "credit_card", "card_number", "cvv", "pin", "dob", "date_of_birth", "birthdate", "national_insurance", "nino")


def redact_map(values: Column, names: Sequence[str] = SENSITIVE) -> Column:
    """A map of texts with the values of sensitive keys hidden; keys are compared in lower case with - as _."""
    def hidden(k: Column) -> Column:
        k = F.replace(F.lower(k), F.lit("-"), F.lit("_"))
        return reduce(lambda a, n: a | k.contains(n), names, F.lit(False))

    return F.transform_values(values, lambda k, v: F.when(hidden(k), "[REDACTED]").otherwise(v))


# Marks of ticked and empty boxes in text.
TICKED, EMPTY = r"(?:\[[xX✓✔]\]|☑|\([xX✓]\)|(?i:\[Y\]))", r"(?:\[\s*\]|☐|\(\s*\)|(?i:\[N\]))"


def tick_boxes(pages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of boxes and signatures per page of text; a signature is present if something follows its label on the line."""
    t = F.coalesce(F.col(text), F.lit(""))
    signs = F.regexp_extract_all(t, F.lit(r"(?i)signature[: \t]*([^\n]{0,30})"), 1)
    return pages.select(
        key, F.regexp_count(t, F.lit(TICKED)).alias("ticked"), F.regexp_count(t, F.lit(EMPTY)).alias("empty"), F.size(signs).alias("signatures"),
        F.size(F.filter(signs, lambda s: F.trim(F.regexp_replace(s, "_+", "")) != "")).alias("signed"))


# White space as trimmed there, and marks of signatures and stamps.
SPACE = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same as a class that rules printable ASCII out first, which most of a text is.
BLANK = f"[[^!-~]&&[{SPACE}]]"
LABELLED = tuple(rf"(?i){label}[:{SPACE}]*([^\n]{{0,30}})" for label in ("signature", "signed", rf"authorized[{SPACE}]*by"))
NAMED = {"handwritten": tuple(rf"(?i){who}[{SPACE}]*signature" for who in ("customer", "technician")), "digital": (rf"(?i)digital[{SPACE}]*signature", "(?i)e-?sign")}
STAMPS = {
    "approval": ("(?i)APPROVED", "(?i)REJECTED"), "certification": ("(?i)CERTIFIED",), "date": ("(?i)RECEIVED",),
    "unknown": (rf"(?i)STAMP[:{SPACE}]*[^\n]{{0,20}}", r"(?i)\[STAMP\]"), "company": (rf"(?i)SEAL[:{SPACE}]*[^\n]{{0,20}}", r"(?i)\(OFFICIAL\)")}


def signature_marks(pages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of signatures by type, of those present, and of stamps by type, per page of text.

    Each pattern counts on its own, so one place may count more than once. A signature is
    present if more than three characters follow its label that are not all of ``_``, ``-``, ``.``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda patterns: sum((F.regexp_count(t, F.lit(p)) for p in patterns), F.lit(0))
    after = F.transform(F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), 1) for p in LABELLED])), lambda x: F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    return pages.select(
        key, count(LABELLED + NAMED["handwritten"]).alias("handwritten"), count(NAMED["digital"]).alias("digital"),
        F.size(F.filter(after, lambda x: (F.length(x) > 3) & ~x.rlike(r"^[_.-]+$"))).alias("present"), *[count(p).alias(f"{n}_stamps") for n, p in STAMPS.items()])


def title_case(c: Column, keep: Sequence[str] = ("UK", "LLC", "LTD", "PLC", "HVAC")) -> Column:
    """Words with a capital first letter and the rest small, but for acronyms."""
    words = F.split(F.trim(c), r"\s+")
    return F.array_join(F.transform(words, lambda w: F.when(F.upper(w).isin(*keep), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000))))), " ")


def yes_no(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("yes", "y", "true", "1", "x", "checked", "✓"), "Yes").when(t.isin("no", "n", "false", "0", "unchecked"), "No").otherwise(c)


def suggestions(text: Column, marks: Sequence[tuple[str, str, float]]) -> Column:
    """Names of the marks (pattern, name, confidence) that a text shows, surest first."""
    hits = F.array(*[F.when(text.rlike(p), F.struct(F.lit(-c).alias("c"), F.lit(n).alias("n"))) for p, n, c in marks])
    return F.transform(F.array_sort(F.filter(hits, lambda h: h.isNotNull())), lambda h: h["n"])


def by_severity(df: DataFrame) -> DataFrame:
    return df.orderBy(rank_of(F.col("severity"), SEVERITY_ORDER), *[c for c in df.columns if c != "severity"])
