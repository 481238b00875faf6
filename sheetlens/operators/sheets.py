"""Job sheets: field extraction with confidence, universal fields, candidates, gold-standard validation, findings and status."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import js_regex, let, lookup, parse_date, ratio, round_half_up, search_date
from .documents import classify


@dataclass(frozen=True)
class Field:
    """What a field is called, how it is found and how much it matters."""

    id: str
    kind: str
    required: bool
    severity: str
    patterns: tuple[str, ...]
    labels: tuple[str, ...]
    allowed: tuple[str, ...] = ()


_YES_NO = "(Yes|No|Y|N|True|False)"
_DATE = r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
_NUMBER = r"(\d+(?:\.\d+)?)"
#: The rest of the line and the lines after it, up to one that begins with a label of one or of two words.
_BLOCK1 = r"([^\n]+(?:\n(?![A-Z][a-z]*:)[^\n]+)*)"
_BLOCK2 = r"([^\n]+(?:\n(?![A-Z][a-z]*(?:\s+[A-Z][a-z]*)?:)[^\n]+)*)"

# The fields of a job sheet: id, kind, required, severity, patterns, labels, allowed values.
FIELDS = (
    Field("asset_no", "string", True, "S0", (r"Asset\s*(?:No|Number|#)?[:\s]*([A-Z0-9\-_]+)", r"(?:Asset|Equipment)\s*ID[:\s]*([A-Z0-9\-_]+)"),
          ("Asset No", "Asset Number", "Asset ID", "Equipment ID")),
    Field("make_model", "string", True, "S1", (r"Make\s*[/&]\s*Model[:\s]*([^\n]+)", r"(?:Make|Manufacturer)[:\s]*([^\n]+)"),
          ("Make/Model", "Make & Model", "Make", "Model", "Equipment Type")),
    Field("serial_no", "string", False, "S2", (r"Serial\s*(?:No|Number|#)?[:\s]*([A-Z0-9\-_]+)", r"S/N[:\s]*([A-Z0-9\-_]+)"), ("Serial No", "Serial Number", "S/N")),
    Field("mileage_hours", "number", False, "S3",
          (rf"(?:Asset\s*)?(?:Mileage|Hours)[/\s]*(?:Hours)?[:\s]*{_NUMBER}", rf"(?:Odometer|Hour\s*Meter)[:\s]*{_NUMBER}"),
          ("Mileage/Hours", "Asset Mileage/Hours", "Hours", "Mileage")),
    Field("job_no", "string", True, "S0", (r"Job\s*(?:No|Number|#)?[:\s]*(\d+)", r"Work\s*Order[:\s]*(\d+)", r"Reference[:\s]*(\d+)"),
          ("Job No", "Job Number", "Work Order", "Reference")),
    Field("customer_name", "string", True, "S0", (r"Customer\s*(?:Name)?[:\s]*([^\n]+)", r"Client[:\s]*([^\n]+)", r"Company[:\s]*([^\n]+)"),
          ("Customer Name", "Customer", "Client", "Company")),
    Field("contact_name", "string", False, "S3", (r"Contact\s*(?:Name)?[:\s]*([^\n]+)", r"Contact\s*Person[:\s]*([^\n]+)"), ("Contact Name", "Contact", "Contact Person")),
    Field("address", "string", False, "S3", (r"(?:Site\s*)?Address[:\s]*([^\n]+)", r"Location[:\s]*([^\n]+)"), ("Address", "Site Address", "Location")),
    Field("date", "date", True, "S0", (rf"Date[:\s]*{_DATE}", rf"(?:Job|Work)\s*Date[:\s]*{_DATE}"), ("Date", "Job Date", "Work Date", "Service Date")),
    Field("travel_time", "number", False, "S3", (rf"Travel\s*Time[:\s]*{_NUMBER}",), ("Travel Time",)),
    Field("engineer_name", "string", True, "S0",
          (r"Engineer\s*(?:Name)?[:\s]*([^\n]+)", r"Technician\s*(?:Name)?[:\s]*([^\n]+)", r"(?:Performed|Completed)\s*(?:By)?[:\s]*([^\n]+)"),
          ("Engineer Name", "Technician", "Performed By", "Completed By")),
    Field("issue_description", "text", True, "S1", (rf"Issue[:\s]*{_BLOCK1}", rf"Problem[:\s]*{_BLOCK1}", rf"Fault[:\s]*{_BLOCK1}"), ("Issue", "Problem", "Fault", "Reason for Call")),
    Field("consumables_used", "boolean", False, "S3", (rf"Consumables\s*Used[:\s]*{_YES_NO}",), ("Consumables Used",)),
    Field("overtime", "boolean", False, "S3", (rf"Overtime[:\s]*{_YES_NO}",), ("Overtime",)),
    Field("works_completed", "boolean", True, "S1",
          (rf"(?:Were\s*)?(?:all\s*)?works?\s*(?:fully\s*)?completed[:?]?\s*{_YES_NO}", rf"Job\s*Completed[:?]?\s*{_YES_NO}"),
          ("Were all works fully completed", "Works Completed", "Job Completed")),
    Field("return_visit_required", "boolean", True, "S1",
          (rf"(?:Is\s*a\s*)?return\s*visit\s*required[:?]?\s*{_YES_NO}", rf"Follow[\s-]*up\s*Required[:?]?\s*{_YES_NO}"),
          ("Is a return visit required", "Return Visit Required", "Follow-up Required")),
    Field("safe_to_use", "boolean", True, "S0",
          (rf"(?:Is\s*the\s*)?asset\s*safe\s*to\s*use[:?]?\s*{_YES_NO}", rf"Safe\s*(?:to\s*)?(?:Use|Operate)[:?]?\s*{_YES_NO}"),
          ("Is the asset safe to use", "Safe to Use", "Safe to Operate")),
    Field("engineer_comments", "text", True, "S1",
          (rf"Engineer\s*Comments?[:\s]*{_BLOCK2}", rf"Technician\s*(?:Notes?|Comments?)[:\s]*{_BLOCK1}", rf"Work\s*(?:Performed|Done|Description)[:\s]*{_BLOCK1}"),
          ("Engineer Comments", "Technician Notes", "Work Performed", "Work Description")),
    Field("fault_reason", "string", False, "S2", (r"Fault\s*Reason[:\s]*([^\n]+)", r"Root\s*Cause[:\s]*([^\n]+)"), ("Fault Reason", "Root Cause", "Cause"),
          ("Wear & Tear", "Routine", "Damage", "Electrical", "Mechanical", "User Error", "Unknown")),
    Field("repair_duration", "number", False, "S2", (rf"Repair\s*Duration[:\s]*{_NUMBER}", rf"Labour\s*(?:Time|Hours)[:\s]*{_NUMBER}"), ("Repair Duration", "Labour Time", "Labour Hours")),
    Field("parts_used", "text", False, "S2", (rf"Parts?\s*Used[:\s]*{_BLOCK2}", r"Components?\s*(?:Used|Replaced)[:\s]*([^\n]+)"), ("Parts Used", "Components Used", "Parts Replaced")),
    Field("parts_required", "text", False, "S2", (rf"Parts?\s*(?:Still\s*)?Required[:\s]*{_BLOCK1}", r"Parts?\s*(?:to\s*)?Order[:\s]*([^\n]+)"),
          ("Parts Still Required", "Parts Required", "Parts to Order")),
    Field("technician_signature", "boolean", True, "S0", (r"Technician\s*Signature", r"Engineer\s*Signature", r"Signed\s*(?:by\s*)?(?:Technician|Engineer)"),
          ("Technician Signature", "Engineer Signature")),
    Field("vor_status", "boolean", False, "S0",
          (r"(?:This\s*)?(?:Vehicle|Asset)\s*(?:is\s*)?marked\s*as\s*VOR", r"VOR\s*Status[:\s]*(Yes|No|True|False)", r"Vehicle\s*Off\s*Road"), ("VOR", "Vehicle Off Road", "VOR Status")),
)
# Words that mean yes.
YES = ("yes", "y", "true", "1", "checked", "✓", "✔")
#: Confidence of a match, what adds to it, and its levels.
BASE, LABEL, EMBEDDED, ALLOWED, MOST = 0.7, 0.15, 0.1, 0.1, 0.99
LEVELS = ((0.85, "HIGH"), (0.60, "MEDIUM"), (0.30, "LOW"))


def trimmed(c: Column) -> Column:
    return scalars.trimmed(c, ascii_only=True)


def with_groups(patterns: Sequence[str]) -> list[str]:
    """Only a pattern with a group yields a value; one without marks a place and finds none."""
    return [p for p in patterns if re.compile(p).groups]


def heads(pattern: str) -> list[str]:
    """The literals, in lower case, one of which a match must begin with but for optional groups; none if that can't be told."""
    flat = re.sub(r"\\.|\[[^]]*\]", "x", pattern)
    while (inner := re.sub(r"\([^()]*\)", "y", flat)) != flat:
        flat = inner
    if "|" in flat:
        return []
    rest = re.sub(r"^(?:\(\?:[^()]*\)\?)+", "", pattern)
    if rest.startswith("(?:") and re.match(r"\)[?*{]", rest[rest.index(")"):]):
        return []
    out = []
    for part in rest[3 : rest.index(")")].split("|") if rest.startswith("(?:") else [rest]:
        word = re.match("[A-Za-z/]*", part)[0]
        if part[len(word) : len(word) + 1] in ("?", "*", "{"):
            word = word[:-1]
        if len(word) < 2:
            return []
        out.append(word.lower())
    return out


def without_lead(pattern: str) -> str:
    """The pattern without optional words in front, which its first group doesn't depend on and which are tried at each place of a text.

    They stay where a match of what follows could begin inside them.
    """
    lead = re.match(r"(?:\(\?:[^()]*\)\?)+", pattern)
    starts = heads(pattern) if lead else []
    words = re.findall("[a-z]+", re.sub(r"\\s[*+]", " ", lead[0]).lower()) if starts else []
    if not starts or re.search(r"[^()?:A-Za-z\\*+]|\\[^s]|[a-z]\*|[a-z]\+", lead[0].replace(r"\s*", "").replace(r"\s+", "")):
        return pattern
    inside = any(h.startswith(w[i:]) or w[i:].startswith(h) for h in starts for w in words for i in range(len(w)))
    return pattern if inside else pattern[lead.end():]


def holds(text: Column, words: Sequence[str]) -> Column:
    """Whether the text holds any of the words. Java's search for a literal of four characters or more skips ahead, which ``contains`` doesn't."""
    return reduce(lambda a, w: a | w, [text.rlike(re.escape(w)) if len(w) > 3 else text.contains(w) for w in words])


def _group(text: Column, pattern: str) -> Column:
    return let(F.regexp_extract(text, "(?i)" + js_regex(without_lead(pattern)), 1), lambda x: F.when(x != "", x))


def found_group(text: Column, pattern: str, low: Column | None = None) -> Column:
    """The pattern's first group, case ignored, null if it is empty.

    ``low`` is the text in lower case, of the same length, or null: the pattern then starts
    where its first literal stands, and isn't tried where none does.
    """
    words = heads(pattern) if low is not None else []
    if not words:
        return _group(text, pattern)
    places = [let(F.locate(w, low), lambda n: F.when(n > 0, n)) for w in words]
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.when(low.isNull(), _group(text, pattern)).when(holds(low, words), let(first, lambda n: _group(F.substring(text, n, F.length(text)), pattern)))


def lowered(text: Column) -> Column:
    """The text in lower case for ``found_group``, null if it isn't as long."""
    return let(F.lower(text), lambda low: F.when(F.length(low) == F.length(text), low))


def first_group(text: Column, patterns: Sequence[str], low: Column | None = None) -> Column:
    """The first pattern's first group that isn't empty, case ignored; null if there is none.

    ``low`` is the text in lower case, or null: patterns then aren't tried where none of their
    first literals stands, which is told at a fraction of the time.
    """
    alike: list[tuple[list[str], list[Column]]] = []
    for p in with_groups(patterns):
        words = heads(p) if low is not None else []
        if not alike or alike[-1][0] != words:
            alike.append((words, []))
        alike[-1][1].append(_group(text, p))
    said = lambda found: F.coalesce(*found) if len(found) > 1 else found[0]
    tried = [F.when(low.isNull() | holds(low, words), said(found)) if words else said(found) for words, found in alike]
    return said(tried) if tried else F.lit(None).cast("string")


def _value(raw: Column, f: Field) -> Column:
    if f.kind == "number":
        return F.coalesce(raw.try_cast("double"), F.lit(0.0)).cast("string")
    if f.kind == "date":
        return search_date(raw)
    if f.kind == "boolean":
        yes = F.lower(trimmed(raw)).isin(*YES)
        return F.when(raw.isNotNull(), (F.lower(raw).contains("vor") | yes if f.id == "vor_status" else yes).cast("string"))
    if f.allowed:
        same = F.filter(F.array(*map(F.lit, f.allowed)), lambda a: F.lower(a) == F.lower(raw))
        return F.when(raw.isNotNull(), F.coalesce(F.get(same, 0), raw))
    return raw


def confidence_level(c: Column) -> Column:
    out = F.lit("UNREADABLE")
    for least, name in reversed(LEVELS):
        out = F.when(c >= least, name).otherwise(out)
    return out


def extract_wide(docs: DataFrame, fields: Sequence[Field] = FIELDS, embedded: bool = True, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """A struct (value, raw, confidence, level, error) per field and row, beside the key and the columns to carry; null texts hold nothing.

    ``error`` is ``required`` for a missing required field, ``allowed`` for a value outside
    the allowed ones.
    """
    def seen(f: Field) -> Column:
        label = holds(F.col("_low"), [n.lower() for n in f.labels]) if f.labels else F.lit(False)
        return let(trimmed(first_group(F.col("_t"), f.patterns, F.col("_low"))), lambda raw: F.when(raw.isNotNull(), F.struct(raw.alias("raw"), label.alias("label"))))

    def one(f: Field) -> Column:
        raw, label = F.col(f"_{f.id}.raw"), F.col(f"_{f.id}.label")
        conf = F.least(F.lit(MOST), F.lit(BASE) + F.when(label, LABEL).otherwise(0.0) + (EMBEDDED if embedded else 0.0))
        known = F.lower(raw).isin(*[a.lower() for a in f.allowed]) if f.allowed else F.lit(True)
        conf = F.least(F.lit(1.0), conf + F.when(known, ALLOWED).otherwise(0.0)) if f.allowed else conf
        missing = F.when(raw.isNull(), "required") if f.required else F.lit(None).cast("string")
        c = F.when(raw.isNotNull(), conf).otherwise(0.0)
        return F.struct(_value(raw, f).alias("value"), raw.alias("raw"), c.alias("confidence"), confidence_level(c).alias("level"),
                        F.coalesce(missing, F.when(raw.isNotNull() & ~known, "allowed")).alias("error"))

    # What a text shows is read into columns first: all else is told from them, and what isn't asked for is left out.
    doc = docs.select(key, *carry, F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_low", F.lower("_t"))
    return doc.select(key, *carry, *[seen(f).alias(f"_{f.id}") for f in fields]).select(key, *carry, *[one(f).alias(f.id) for f in fields])


def long_form(wide: DataFrame, fields: Sequence[Field] = FIELDS, key: str = "doc_id") -> DataFrame:
    """(key, field, severity, required, value, raw, confidence, level, error): a row per field."""
    rows = F.array(*[
        F.struct(F.lit(f.id).alias("field"), F.lit(f.severity).alias("severity"), F.lit(f.required).alias("required"), F.col(f.id).alias("f")) for f in fields])
    return wide.select(key, F.explode(rows).alias("r")).select(key, "r.field", "r.severity", "r.required", "r.f.*")


def overall_confidence(wide: DataFrame, fields: Sequence[Field] = FIELDS, key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """(key, carried, found_required, overall): 0.6 of the mean confidence of found required fields and 0.4 of their share."""
    need = [f.id for f in fields if f.required]
    found = reduce(lambda a, n: a + F.col(n)["raw"].isNotNull().cast("int"), need, F.lit(0))
    total = reduce(lambda a, n: a + F.col(n)["confidence"], need, F.lit(0.0))
    overall = round_half_up(total / F.greatest(F.lit(1), found) * 0.6 + found / float(len(need)) * 0.4, 2)
    return wide.select(key, *carry, found.cast("long").alias("found_required"), overall.alias("overall"))


def typed_confidence(raw: Column, kind: str) -> Column:
    """How far a raw value looks like its kind: 0.7, more if longer than 5 and if its form fits, at most 1."""
    fits = {"number": (r"^\$?[\d,]+(?:\.\d{2})?$", 0.15), "currency": (r"^\$?[\d,]+(?:\.\d{2})?$", 0.15), "date": (r"\d{4}|\d{1,2}/\d{1,2}", 0.15),
            "boolean": ("(?i)^(yes|no|true|false|signed|unsigned)$", 0.2)}.get(kind)
    bonus = F.when(raw.rlike(fits[0]), fits[1]).otherwise(0.0) if fits else F.lit(0.0)
    return F.when(F.coalesce(F.length(raw), F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.7 + F.when(F.length(raw) > 5, 0.1).otherwise(0.0) + bonus))


# --- universal fields ---------------------------------------------------------------------

_CODE = "([A-Z0-9][-A-Z0-9/]{3,20})"
# Fields that any document may have, and their patterns.
UNIVERSAL = {
    "jobReference": (rf"(?:job|work|order|wo|ref|ticket|case)\s*(?:no|number|#|ref)?[:.\s]*{_CODE}", rf"(?:reference|ref)[:.\s]*{_CODE}"),
    "date": (r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})", r"(\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{2,4})", r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})"),
    "signature": (r"signature[:.\s]*([^\n]{2,50})", r"signed[:.\s]*([^\n]{2,50})", r"authorized\s+by[:.\s]*([^\n]{2,50})"),
    "assetIdentifier": (rf"(?:serial|s/n|asset|reg|registration|fleet|plant)\s*(?:no|number|#)?[:.\s]*{_CODE}",),
    "engineerName": (r"(?:engineer|technician|tech|inspector|examiner|completed\s+by|attended\s+by)[:.\s]*([A-Za-z][A-Za-z0-9_\s]{2,40})",),
    "customerName": (r"(?:customer|client|company|site)[:.\s]*([A-Za-z][A-Za-z0-9_\s&.,]{2,60})",),
}
# Marks of templates: pattern, hint, confidence.
HINTS = (
    ("LOLER|thorough examination|lifting equipment|6 month|12 month examination", "LOLER Examination Report", "HIGH"),
    ("VOR|vehicle off road|breakdown|repair report", "VOR/Repair Report", "HIGH"),
    ("PTO|power take-off|power take off", "PTO Service Report", "HIGH"),
    ("aztec|weighing system|onboard weighing", "Aztec Weighing System", "HIGH"),
    ("compliance|checklist|service report", "Compliance/Service Report", "MEDIUM"),
    ("inspection|examination|certificate", "Inspection Certificate", "LOW"),
)
# Why a document is looked at.
REVIEW_REASONS = {
    "TEMPLATE_NOT_MATCHED": "No template matched this document type.", "LOW_TEMPLATE_CONFIDENCE": "Template match confidence was too low for auto-processing.",
    "AMBIGUOUS_SELECTION": "Multiple templates matched with similar scores."}


def universal_fields(pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """(key, field, value, page, confidence): each kind's value on the first page that shows one, at most 100 characters."""
    found = F.array(*[F.struct(F.lit(n).alias("field"), F.substring(trimmed(first_group(F.col(text), p)), 1, 100).alias("value")) for n, p in UNIVERSAL.items()])
    hits = pages.select(key, page, F.explode(found).alias("f")).filter("f.value IS NOT NULL").select(key, page, "f.field", "f.value")
    return hits.groupBy(key, "field").agg(F.min_by("value", page).alias("value"), F.min(page).alias(page)).withColumn("confidence", F.lit(0.7))


def template_hints(text: Column, hints: Sequence[tuple[str, str, str]] = HINTS) -> Column:
    """Hints in the order of their confidence, HIGH first, and of the list."""
    order = sorted(hints, key=lambda h: ("HIGH", "MEDIUM", "LOW").index(h[2]))
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(n)) for p, n, _ in order]))


def hybrid_assessment(pages: DataFrame, reason: Column, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Universal checks over the whole text, hints and an explanation per document.

    ``pages(key, page, text)`` are few per document; their texts are joined in order by line
    feeds. ``reason`` may use the columns key, n_fields and hints.
    """
    fields = universal_fields(pages, key, page, text).groupBy(key).agg(F.count("*").alias("n_fields"))
    whole = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(page, F.col(text).alias("t")))).alias("_p")).select(
        key, F.size("_p").alias("pages"), F.array_join(F.transform("_p", lambda p: p["t"]), "\n").alias("_t"))
    has = {f"has_{n}": first_group(F.col("_t"), p).isNotNull() for n, p in UNIVERSAL.items()}
    out = whole.select(key, "pages", F.size(F.split("_t", r"\s+")).alias("words"), template_hints(F.col("_t")).alias("hints"), *[c.alias(n) for n, c in has.items()])
    out = out.join(fields, key, "left").withColumn("n_fields", F.coalesce("n_fields", F.lit(0))).withColumn("review_reason", reason)
    said = lookup(F.col("review_reason"), REVIEW_REASONS, REVIEW_REASONS["AMBIGUOUS_SELECTION"])
    hint = F.when(F.size("hints") > 0, F.concat(F.lit("Suggested template: "), F.get("hints", 0)))
    return out.withColumn("explanation", F.concat_ws(" ", said, F.concat(F.lit("Extracted "), F.col("n_fields").cast("string"), F.lit(" universal fields.")), hint))


# --- candidates ---------------------------------------------------------------------------

_ID = r"([A-Z0-9]+(?:-[A-Z0-9]+)*)"
_ANY_DATE = r"(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})"
# Critical fields: patterns, kind, least confidence.
CRITICAL = {
    "jobReference": ((rf"job\s+reference\s*[:.\s]+{_ID}", rf"job\s+ref\s*[:.\s]+{_ID}", rf"job\s+(?:no|number|#)\s*[:.\s]+{_ID}", rf"work\s+order\s*[:.\s]+{_ID}", rf"WO\s*[:.\s]+{_ID}"), "code3", 0.7),
    "assetId": ((rf"asset\s+(?:id|no|number|#)\s*:\s*{_ID}", rf"asset\s*:\s*{_ID}", rf"equipment\s+(?:id|no)\s*:\s*{_ID}", rf"plant\s+(?:id|no)\s*:\s*{_ID}", rf"serial\s*:\s*{_ID}"), "code2", 0.7),
    "date": ((rf"date[:.\s]*{_ANY_DATE}", _ANY_DATE, r"(\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2})",
              r"(\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{2,4})"), "date", 0.7),
    "expiryDate": ((rf"expir(?:y|es|ation)\s*(?:date)?[:.\s]*{_ANY_DATE}", rf"valid\s*(?:until|to)[:.\s]*{_ANY_DATE}", rf"next\s*(?:service|inspection)[:.\s]*{_ANY_DATE}",
                    rf"due\s*(?:date)?[:.\s]*{_ANY_DATE}"), "date", 0.7),
}


def _normalised(value: Column, kind: str) -> Column:
    """The value as it is compared, null if it isn't valid."""
    if kind == "date":
        return parse_date(value)
    return let(F.regexp_replace(F.upper(value), r"\s+", "-"), lambda v: F.when(F.length(v).between(int(kind[-1]), 30), v))


def critical_candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", region: str = "region") -> DataFrame:
    """(key, field, value, confidence): every valid match of every pattern, those in the field's region at 0.9, others at 0.7.

    A value found in the region isn't a candidate of the text again; a value that several
    patterns or places of one source show is one candidate.
    """
    def matches(doc: Column, patterns: Sequence[str], kind: str) -> Column:
        """Where a pattern begins with a literal that the text doesn't hold, it isn't tried."""
        none = F.array().cast("array<string>")

        def every(p: str) -> Column:
            found = F.regexp_extract_all(doc["t"], F.lit("(?i)" + js_regex(p)), 1)
            words = heads(p)
            return F.when(reduce(lambda a, w: a | doc["low"].contains(w), words, F.lit(False)), found).otherwise(none) if words else found

        return F.array_distinct(F.array_compact(F.transform(F.array_distinct(F.concat(*map(every, patterns))), lambda m: _normalised(m, kind))))

    def named(name: str, values: Column, confidence: float) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("field"), v.alias("value"), F.lit(confidence).alias("confidence")))

    def one(name: str, region: Column, text: Column) -> Column:
        patterns, kind, _ = CRITICAL[name]
        return let(matches(region, patterns, kind), lambda near: F.concat(named(name, near, 0.9), named(name, F.array_except(matches(text, patterns, kind), near), 0.7)))

    read = lambda c: let(F.coalesce(F.col(c), F.lit("")), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low")))
    both = let(F.struct(read(region).alias("r"), read(text).alias("t")), lambda d: F.concat(*[one(n, d["r"], d["t"]) for n in CRITICAL]))
    return docs.select(key, F.explode(both).alias("c")).select(key, "c.*")


def select_candidates(found: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The best candidate of each critical field and document, with status and reason.

    Ranked by confidence, then by value. None is MISSING_FIELD; one below the field's least
    confidence LOW_CONFIDENCE; another value less than 0.1 behind is a CONFLICT.
    """
    spine = docs.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(least).alias("least")) for n, (_, _, least) in CRITICAL.items()])).alias("s")).select(key, "s.*")
    w = Window.partitionBy(key, "field").orderBy(F.desc("confidence"), "value")
    ranked = found.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    best = ranked.groupBy(key, "field").agg(
        F.max(F.when(F.col("_r") == 1, F.col("value"))).alias("value"), F.max(F.when(F.col("_r") == 1, F.col("confidence"))).alias("confidence"),
        F.max(F.when(F.col("_r") == 2, F.col("confidence"))).alias("_next"))
    j = spine.join(best, [key, "field"], "left")
    conflict = (F.col("_next") >= F.col("least")) & (F.col("confidence") - F.col("_next") < 0.1)
    reason = F.when(F.col("value").isNull(), "MISSING_FIELD").when(F.col("confidence") < F.col("least"), "LOW_CONFIDENCE").when(conflict, "CONFLICT")
    status = F.when(F.col("value").isNull(), "FAIL").when(reason.isNotNull(), "REVIEW_QUEUE").otherwise("PASS")
    return j.select(key, "field", "value", "confidence", status.alias("status"), reason.alias("reason"))


# --- gold standard ------------------------------------------------------------------------


def value_rules() -> dict[str, Column]:
    """What a present value must be; a field not named here needs only to be present where it is required."""
    v = lambda n: F.col(n)["value"]
    within = lambda n, most: v(n).try_cast("double").between(0, most)
    reasons = (*next(f.allowed for f in FIELDS if f.id == "fault_reason"), "Reason")
    return {
        "asset_no": v("asset_no").rlike("(?i)^[A-Z0-9_-]+$"), "job_no": v("job_no").rlike("^[0-9]+$"),
        "date": v("date").rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"),
        "mileage_hours": within("mileage_hours", 10_000_000), "travel_time": within("travel_time", 24), "repair_duration": within("repair_duration", 100),
        "engineer_comments": F.length(v("engineer_comments")) >= 20, "fault_reason": F.lower(v("fault_reason")).isin(*[r.lower() for r in reasons])}


def business_rules() -> list[tuple[str, str, Column]]:
    """(id, severity, passes): what fields must say together. A missing field breaks none."""
    v = lambda n: F.col(n)["value"]
    both = lambda a, x, b, y: F.coalesce((v(a) == x) & (v(b) == y), F.lit(False))
    brief = F.coalesce(trimmed(v("engineer_comments")).rlike(r"(?i)^(ok|done|fixed|completed|n/a|na|none)$|^.{1,10}$"), F.lit(False))
    parts = F.coalesce((F.length(v("parts_required")) > 0) & (v("return_visit_required") == "false"), F.lit(False))
    return [
        ("vor_safety_consistency", "S0", ~both("vor_status", "true", "safe_to_use", "true")), ("return_visit_parts_required", "S2", ~parts),
        ("incomplete_work_return_visit", "S1", ~both("works_completed", "false", "return_visit_required", "false")),
        ("unsafe_asset_vor", "S0", F.lit(True)), ("engineer_comments_quality", "S2", ~brief)]


def validate_wide(wide: DataFrame, fields: Sequence[Field] = FIELDS, key: str = "doc_id") -> DataFrame:
    """``wide`` with ``checks`` (field, severity, required, present, valid) and ``rules`` (id, severity, passed)."""
    rules = value_rules()

    def one(f: Field) -> Column:
        present = F.coalesce(F.col(f.id)["value"], F.lit("")) != ""
        good = F.coalesce(rules[f.id], F.lit(False)) if f.id in rules else F.lit(True)
        valid = F.when(present, good).otherwise(F.lit(not f.required))
        return F.struct(F.lit(f.id).alias("field"), F.lit(f.severity).alias("severity"), F.lit(f.required).alias("required"), present.alias("present"), valid.alias("valid"))

    return wide.select("*", F.array(*[one(f) for f in fields]).alias("checks"),
                       F.array(*[F.struct(F.lit(n).alias("id"), F.lit(s).alias("severity"), c.alias("passed")) for n, s, c in business_rules()]).alias("rules"))


def gold_standard(validated: DataFrame, key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """The result of each document: counts, and a score of 60 for valid fields, 30 for required ones found and 10 for rules kept."""
    n = lambda c, test: F.size(F.filter(c, test)).cast("long")
    grave = lambda x: x["severity"].isin("S0", "S1")
    g = validated.select(
        key, *carry, F.size("checks").alias("_all"), n("checks", lambda c: c["required"]).alias("_need"), F.size("rules").alias("_rules"),
        n("checks", lambda c: c["valid"]).alias("valid_fields"), n("checks", lambda c: c["required"] & ~c["present"]).alias("missing_required"),
        n("checks", lambda c: c["required"] & c["present"]).alias("_found"), n("rules", lambda r: r["passed"]).alias("rules_passed"),
        (n("checks", lambda c: ~c["valid"] & ~c["present"] & (c["severity"] == "S0")) + n("checks", lambda c: ~c["valid"] & c["present"] & grave(c))
         + n("rules", lambda r: ~r["passed"] & grave(r))).alias("critical_issues"),
        (n("checks", lambda c: ~c["valid"] & c["present"] & ~grave(c)) + n("rules", lambda r: ~r["passed"] & ~grave(r))).alias("warnings"))
    score = round_half_up(F.col("valid_fields") / F.col("_all") * 60 + F.col("_found") / F.col("_need") * 30 + F.col("rules_passed") / F.col("_rules") * 10)
    return g.select(key, *carry, "valid_fields", "missing_required", "rules_passed", "critical_issues", "warnings", score.cast("long").alias("score"),
                    ((F.col("critical_issues") == 0) & (F.col("missing_required") == 0)).alias("is_valid"))


def build_findings(validated: DataFrame, fields: Sequence[Field] = FIELDS, key: str = "doc_id") -> DataFrame:
    """(key, field, severity, reason, raw, confidence): failed checks with the evidence of their field, and broken rules.

    Checks and evidence stand in one row, side by side, so nothing is joined.
    """
    evidence = F.create_map(*[x for f in fields for x in (F.lit(f.id), F.col(f.id))])

    def finding(c: Column) -> Column:
        e = evidence[c["field"]]
        reason = F.when(~c["present"] & c["required"], "MISSING_FIELD").when(e["level"] == "LOW", "LOW_CONFIDENCE").when(
            e["level"] == "UNREADABLE", "UNREADABLE_FIELD").otherwise("INVALID_FORMAT")
        return F.struct(c["field"].alias("field"), c["severity"].alias("severity"), reason.alias("reason"), F.coalesce(e["raw"], F.lit("")).alias("raw"),
                        F.coalesce(e["confidence"], F.lit(0.0)).alias("confidence"))

    broken = F.transform(F.filter("rules", lambda r: ~r["passed"]), lambda r: F.struct(
        r["id"].alias("field"), r["severity"].alias("severity"), F.lit("BUSINESS_RULE_VIOLATION").alias("reason"), F.lit("").alias("raw"), F.lit(1.0).alias("confidence")))
    every = F.concat(F.transform(F.filter("checks", lambda c: ~c["valid"]), finding), broken)
    return validated.select(key, F.explode(every).alias("f")).select(key, "f.*")


def review_queue(validated: DataFrame, fields: Sequence[Field] = FIELDS, key: str = "doc_id") -> DataFrame:
    """(key, field, confidence, action): fields of LOW or MEDIUM confidence, and invalid minor ones that are not among them.

    ``checks`` stand in the order of ``fields``, as ``validate_wide`` gives them, so each is
    taken from its place, and checks that nothing depends on aren't made.
    """
    def item(i: int, f: Field) -> Column:
        e = F.col(f.id)
        low = e["level"].isin("LOW", "MEDIUM")
        action = F.when(e["level"] == "LOW", "Manual verification required").when(low, "Review and confirm value").otherwise("Review and correct if necessary")
        asked = low | ~F.get("checks", i)["valid"] if f.severity in ("S2", "S3") else low
        return F.when(asked, F.struct(F.lit(f.id).alias("field"), F.when(low, e["confidence"]).otherwise(0.5).alias("confidence"), action.alias("action")))

    items = validated.select(key, F.array(*[item(i, f) for i, f in enumerate(fields)]).alias("_q"))
    return items.select(key, F.explode(F.array_compact("_q")).alias("q")).select(key, "q.*")


# Marks of kinds of sheets, the first that a text holds counts.
KINDS = (
    ("thorough examination report", "LOLER_COMPLIANCE"), ("loler", "LOLER_COMPLIANCE"), ("compliance report", "COMPLIANCE_REPORT"), ("compliance test", "COMPLIANCE_REPORT"),
    ("repair report", "REPAIR_REPORT"), ("repair duration", "REPAIR_REPORT"), ("service report", "SERVICE_REPORT"), ("service detail", "SERVICE_REPORT"))


def audit(docs: DataFrame, fields: Sequence[Field] = FIELDS, waived: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, overall, score, findings, queued, status): a row for each sheet, its text to its result in one pass, without a join.

    WAIVED where critical checks fail and ``waived`` holds for the document, else FAIL with a
    critical issue, REVIEW_QUEUE with anything to look at, and PASS.
    """
    aside = docs.withColumns({"_kind": classify(F.coalesce(F.col(text), F.lit("")), KINDS), "_waived": F.lit(False) if waived is None else F.coalesce(waived, F.lit(False))})
    v = validate_wide(extract_wide(aside, fields, True, key, text, ("_kind", "_waived")), fields, key)
    evidence = F.create_map(*[x for f in fields for x in (F.lit(f.id), F.col(f.id)["level"])])
    bad = F.filter("checks", lambda c: ~c["valid"])
    queued = F.filter("checks", lambda c: evidence[c["field"]].isin("LOW", "MEDIUM") | (~c["valid"] & c["severity"].isin("S2", "S3")))
    v = v.withColumns({"_findings": F.size(bad) + F.size(F.filter("rules", lambda r: ~r["passed"])), "_queued": F.size(queued), "_critical": F.exists(bad, lambda c: c["severity"].isin("S0", "S1"))})
    aside = ("_kind", "_waived", "_findings", "_queued", "_critical")
    j = gold_standard(overall_confidence(v, fields, key, (*aside, "checks", "rules")), key, (*aside, "overall"))
    status = F.when(F.col("_critical") & F.col("_waived"), "WAIVED").when(F.col("critical_issues") > 0, "FAIL").when(F.col("_queued") > 0, "REVIEW_QUEUE").otherwise("PASS")
    return j.select(key, F.col("_kind").alias("kind"), "overall", "score", F.col("_findings").alias("findings"), F.col("_queued").alias("queued"), status.alias("status"))


# --- status -------------------------------------------------------------------------------


def document_status(extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, found, quality, confidence, status) from the long form.

    A missing required field fails; a field below 0.7 or a quality below 90 is looked at.
    Quality is 70 for required fields found and 30 for the others.
    """
    has = F.coalesce(F.col("value"), F.lit("")) != ""
    g = extracted.groupBy(key).agg(
        F.count_if(has).alias("found"), F.count_if("required").alias("_need"), F.count_if(F.col("required") & has).alias("_got"), F.count_if(~F.col("required")).alias("_opt"),
        F.count_if(~F.col("required") & has).alias("_extra"), F.avg(F.when(F.col("confidence") > 0, F.col("confidence") * 100)).alias("_c"),
        F.count_if((F.col("confidence") > 0) & (F.col("confidence") * 100 < 70)).alias("_low"))
    quality = ratio(F.col("_got"), F.col("_need")) * 100 * 0.7 + F.when(F.col("_opt") > 0, F.col("_extra") / F.col("_opt") * 100).otherwise(100.0) * 0.3
    status = F.when(F.col("_got") < F.col("_need"), "FAIL").when(F.col("_low") > 0, "REVIEW_QUEUE").when(quality >= 90, "PASS").otherwise("REVIEW_QUEUE")
    return g.select(key, "found", round_half_up(quality, 1).alias("quality"), round_half_up(F.coalesce("_c", F.lit(0.0)), 1).alias("confidence"), status.alias("status"))


def batch_summary(statuses: DataFrame) -> DataFrame:
    """Counts by status and the mean quality and confidence, one decimal."""
    n = lambda s: F.count_if(F.col("status") == s)
    mean = lambda c: round_half_up(F.coalesce(F.avg(c), F.lit(0.0)), 1)
    return statuses.agg(F.count("*").alias("total"), n("PASS").alias("passed"), n("FAIL").alias("failed"), n("REVIEW_QUEUE").alias("review_queue"),
                        mean("quality").alias("quality"), mean("confidence").alias("confidence"))


def pipeline_status(critical: DataFrame, fused: DataFrame, required: Sequence[str], key: str = "doc_id") -> DataFrame:
    """(key, status) of ``critical(key, field, status, reason)`` and ``fused(key, outcome)``.

    A missing required field fails; a failed field in conflict or of low confidence, or a
    fused field in either, is looked at.
    """
    failed = F.col("status") == "FAIL"
    c = critical.groupBy(key).agg(F.coalesce(F.bool_or(failed & (F.col("reason") == "MISSING_FIELD") & F.col("field").isin(*required)), F.lit(False)).alias("_missing"),
                                  F.coalesce(F.bool_or(failed & F.col("reason").isin("CONFLICT", "LOW_CONFIDENCE")), F.lit(False)).alias("_doubt"))
    f = fused.groupBy(key).agg(F.bool_or(F.col("outcome").isin("CONFLICT", "LOW_CONFIDENCE")).alias("_issue"))
    status = F.when(F.col("_missing"), "FAIL").when(F.col("_doubt") | F.coalesce("_issue", F.lit(False)), "REVIEW_QUEUE").otherwise("PASS")
    return c.join(f, key, "left").select(key, status.alias("status"))


# Other names of fields on sheets.
SYNONYMS = {
    "customerSignature": ("signature", "sign here", "customer sign", "authorized by"), "dateOfService": ("date", "service date", "date of service"),
    "serialNumber": ("serial", "serial no", "s/n", "sn"), "technicianName": ("technician", "engineer", "tech name"), "workDescription": ("work performed", "description", "work done"),
    "partsUsed": ("parts", "materials", "components"), "timeIn": ("time in", "start time", "arrival"), "timeOut": ("time out", "end time", "departure"),
    "customerName": ("customer", "client", "company"), "jobNumber": ("job no", "job number", "reference")}


def name_patterns(name: Column) -> Column:
    """A field's name, its words apart and together, and its synonyms."""
    apart = trimmed(F.regexp_replace(name, "([A-Z])", " $1"))
    more = reduce(lambda a, kv: F.when(name == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(a), SYNONYMS.items(), F.array().cast("array<string>"))
    return F.concat(F.array(name, apart, F.replace(apart, F.lit(" "), F.lit(""))), more)
