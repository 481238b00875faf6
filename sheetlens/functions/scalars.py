"""Column builders that keep the scalar semantics of JavaScript where results depend on them."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"


_WORD_CLASS = r"\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9_])+\]"
_WORD_BEGINS = re.compile(rf"(?:\\[dw]|{_WORD_CLASS})(?!\??\*|\?|\{{0)|[A-Za-z0-9_](?![?*{{|])")
_WORD_ENDS = re.compile(rf"(?:(?:\\[dw]|{_WORD_CLASS})(?:\{{[1-9]\d*(?:,\d*)?\}}|\+)?|(?<!\\)[A-Za-z0-9_])$")


def js_regex(pattern: str) -> str:
    """A JavaScript pattern for Java: word boundaries look at ASCII letters, digits and underscore only.

    Where the pattern itself tells that a word character stands on one side of a boundary,
    only the other side is looked at, which is several times as fast.
    """
    parts = pattern.split(r"\b")
    out = parts[0]
    for before, after in zip(parts, parts[1:]):
        alternatives = "|" in re.sub(r"\([^()]*\)|\[[^]]*\]", "", pattern)  # a boundary then belongs to one alternative only, which is not looked into
        if not alternatives and _WORD_BEGINS.match(after):
            out += f"(?<!{_W})"
        elif not alternatives and _WORD_ENDS.search(before):
            out += f"(?!{_W})"
        else:
            out += _BOUNDARY
        out += after
    return out


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero; the product is a double, as in Math.round(x * 10^n) / 10^n."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def r6(x: Column) -> Column:
    return round_half_up(x.cast("double"), 6)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where d is 0 or null."""
    return F.when(d > 0, n.cast("double") / d).otherwise(F.lit(0.0))


def ladder(x: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step, from the top, that x reaches."""
    out = F.lit(otherwise)
    for least, name in sorted(steps):
        out = F.when(x >= least, name).otherwise(out)
    return out


def confidence_band(score: Column) -> Column:
    return ladder(score, [(80, "HIGH"), (50, "MEDIUM")], "LOW")


def confidence_level(c: Column) -> Column:
    return ladder(c, [(0.8, "HIGH"), (0.5, "MEDIUM"), (0.2, "LOW")], "NONE")


def grade(score: Column, steps: Sequence[tuple[float, str]] = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))) -> Column:
    return ladder(score, steps, "F")


def trend(delta: Column, band: float, up: str = "improving", down: str = "declining") -> Column:
    return F.when(delta > band, up).when(delta < -band, down).otherwise("stable")


def rank_of(c: Column, order: Sequence[str]) -> Column:
    """Place in a fixed order from 0; whatever is not in it comes last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), c), F.lit(0)) - 1, F.lit(99)).cast("int")


def lookup(c: Column, table: Mapping[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], F.lit(default))


def tokens(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and underscore."""
    # \W is these letters' complement in Java, as a listed class is, at an eighth of its time: that is asked range by range.
    return F.filter(F.split(F.lower(text), r"\W+"), lambda t: t != "")


def names_word(low: Column, word: str) -> Column:
    """Whether ``word`` is among the ``tokens`` of a text, which is given in lower case and isn't cut; the search begins at the word itself."""
    w = word.lower()
    return low.rlike(rf"{w}(?<!\w{w})(?!\w)") if re.match(r"[a-z0-9_]+\Z", w) else F.lit(False)


# Words that OCR misreads and what they stand for, applied in this order.
OCR_CORRECTIONS = (
    ("Narne", "Name"), ("Nurnber", "Number"), ("Cornpleted", "Completed"), ("Requirecl", "Required"), ("Enginee", "Engineer"), ("Custorner", "Customer"),
    ("Ternp", "Temp"), ("Tirne", "Time"), ("rn", "m"), ("cl", "d"), ("vv", "w"),
)


def correct_ocr(text: Column) -> Column:
    return reduce(lambda c, p: where_hinted(c, p[0], lambda t: F.regexp_replace(t, js_regex(rf"\b{p[0]}\b"), p[1])), OCR_CORRECTIONS, text)


# Personal data patterns and their replacements, applied in this order.
REDACTIONS = (
    ("email", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    ("phone", r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b", "[PHONE_REDACTED]"),
    ("uk_phone", r"\b(?:0|\+44)\s?\d{2,4}\s?\d{3,4}\s?\d{3,4}\b", "[PHONE_REDACTED]"),
    ("ssn", r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b", "[SSN_REDACTED]"),
    ("nino", r"(?i)\b[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", "[NINO_REDACTED]"),
    ("credit_card", r"\b(?:\d{4}[-.\s]?){3}\d{4}\b", "[CARD_REDACTED]"),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_REDACTED]"),
    ("dob", r"\b(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)\d{2}\b", "[DOB_REDACTED]"),
    ("bank_account", r"\b\d{8,17}\b", "[ACCOUNT_REDACTED]"),
    ("titled_name", r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b", "[NAME_REDACTED]"),
)
#: What a text must hold for a rule to apply; such a pattern is quicker to rule out than the rule's own.
REDACTION_HINTS = {
    "email": "@", "phone": r"\d{3}[-.\s]?\d{4}", "uk_phone": r"\d{2}\s?\d{3,4}\s?\d{3}", "ssn": r"\d{3}[-.\s]?\d{2}[-.\s]?\d{4}", "nino": r"\d{2}\s?\d{2}\s?\d{2}\s?[A-Da-d]",
    "credit_card": r"\d{4}[-.\s]?\d{4}", "ip_address": r"\d\.\d{1,3}\.\d", "dob": r"\d[-/.][01]?\d[-/.](?:19|20)\d{2}", "bank_account": r"\d{8}", "titled_name": r"(?:Mrs?|Ms|Miss|Dr|Prof)\.?\s+[A-Z]"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used; it also keeps large expressions out of generated code."""
    return F.get(F.transform(F.array(value), use), 0)


# White space as texts are trimmed of.
_WHITE = " \t\n\x0b\f\r"
_ALL_WHITE = _WHITE + "\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column, ascii_only: bool = False) -> Column:
    """The text without white space at its ends; only the ends are looked at. Trimming asks for each kind of white space, and few texts need more than ASCII's."""
    if ascii_only:
        return F.trim(c, F.lit(_WHITE))
    return let(c, lambda x: F.when(F.length(x) == F.octet_length(x), F.trim(x, F.lit(_WHITE))).otherwise(F.trim(x, F.lit(_ALL_WHITE))))


def where_hinted(text: Column, hint: str | None, change: Callable[[Column], Column]) -> Column:
    """``change(text)`` where the text matches ``hint``, else the text; ``text`` is evaluated once."""
    if hint is None:
        return change(text)
    return let(text, lambda t: F.when(t.rlike(hint), change(t)).otherwise(t))


def redact(text: Column, rules: Sequence[tuple[str, str, str]] = REDACTIONS) -> Column:
    """Rules are folded in order, which changes the result; the caller may pass their own."""
    known = {name: pattern for name, pattern, _ in REDACTIONS}

    def step(c: Column, rule: tuple[str, str, str]) -> Column:
        name, pattern, tag = rule
        hint = REDACTION_HINTS.get(name) if known.get(name) == pattern else None
        return where_hinted(c, hint, lambda t: F.regexp_replace(t, js_regex(pattern), tag.replace("$", r"\$")))

    return reduce(step, rules, text)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """(1 - edit distance / longer length) * 100 of the lower-cased texts; 0 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, (1 - F.levenshtein(F.lower(a), F.lower(b)) / longest) * 100).otherwise(0.0)


def rolling_hash(text: Column) -> Column:
    """The absolute value of the 32-bit hash h * 31 + code over a text's characters."""
    def step(h: Column, c: Column) -> Column:
        x = F.pmod(h * 31 + F.ascii(c), F.lit(2**32))
        return F.when(x >= 2**31, x - 2**32).otherwise(x)

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.abs(F.aggregate(chars, F.lit(0).cast("long"), step))


def cohort(key: Column, split: float) -> Column:
    return F.when(F.pmod(rolling_hash(key), F.lit(100)) / 100.0 < split, "B").otherwise("A")


def initials(name: Column) -> Column:
    """``First Last`` to ``F. L.``, a single name to ``F.``."""
    def short(parts: Column) -> Column:
        first, last = F.substring(F.get(parts, F.lit(0)), 1, 1), F.substring(F.element_at(parts, -1), 1, 1)
        return F.when(F.size(parts) >= 2, F.concat(first, F.lit(". "), last, F.lit("."))).when(F.size(parts) == 1, F.concat(first, F.lit("."))).otherwise("")

    return let(F.filter(F.split(F.trim(name), r"\s+"), lambda p: p != ""), short)


def safe_file_name(name: Column, most: int = 255) -> Column:
    base = F.regexp_replace(F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1), r"[^A-Za-z0-9._-]", "_")
    return F.substring(base, 1, most)


def byte_text(n: Column) -> Column:
    return (F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
            .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB")))
            .otherwise(F.concat(F.format_string("%.1f", n / 1048576.0), F.lit(" MB"))))


# File signatures by type: offset and hex digits.
SIGNATURES = (("pdf", 0, "25504446"), ("png", 0, "89504E470D0A1A0A"), ("jpg", 0, "FFD8FF"), ("gif", 0, "47494638"), ("tiff", 0, "49492A00"), ("tiff", 0, "4D4D002A"))


def file_type(content: Column) -> Column:
    out = F.when((F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp")
    for name, offset, digits in SIGNATURES:
        out = out.when(F.hex(F.substring(content, offset + 1, len(digits) // 2)) == digits, name)
    return out


def normalise_date(text: Column) -> Column:
    """D/M/Y, else Y-M-D, to ISO with leading zeros; whatever is neither stays as it is."""
    dmy, ymd = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})$"
    t = F.trim(text)

    def iso(p: str, y: int, m: int, d: int) -> Column:
        return F.concat_ws("-", F.regexp_extract(t, p, y), F.lpad(F.regexp_extract(t, p, m), 2, "0"), F.lpad(F.regexp_extract(t, p, d), 2, "0"))

    return F.when(t.rlike(ymd), iso(ymd, 1, 2, 3)).when(t.rlike(dmy), iso(dmy, 3, 2, 1)).otherwise(text)


# Months by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _iso(year: Column, month: Column, day: Column, width: int = 4) -> Column:
    """The date as text if month and day are possible at all (31 of any month is)."""
    parts = F.concat_ws("-", F.lpad(year.cast("string"), width, "0") if width else year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(month.between(1, 12) & day.between(1, 31), parts)


def digits(text: Column, pattern: str, group: int) -> Column:
    """A group of digits as a number, null where the pattern isn't found. Only what was found is cast: a cast that fails raises, row by row, which costs more than the pattern."""
    return let(F.regexp_extract(text, pattern, group), lambda x: F.when(x != "", x.try_cast("int")))


def parse_date(text: Column) -> Column:
    """Y-M-D, D/M/Y or ``15 January 2024`` to ISO; two-digit years are 2000 and later; null for anything else."""
    full = lambda y: F.when(y < 100, y + 2000).otherwise(y)
    ymd, dmy = r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})$", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$"
    named = rf"(?i)^(\d{{1,2}})\s+({'|'.join(MONTHS)})[a-z]*\s+(\d{{2,4}})$"

    def parsed(t: Column) -> Column:
        n = lambda p, k: digits(t, p, k)
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(t, named, 2))).cast("int")
        form = lambda p, y, m, d, year=lambda y: y: F.when(t.rlike(p), let(F.struct(year(y).alias("y"), m.alias("m"), d.alias("d")), lambda x: _iso(x["y"], x["m"], x["d"])))
        return F.coalesce(form(ymd, n(ymd, 1), n(ymd, 2), n(ymd, 3)), form(dmy, n(dmy, 3), n(dmy, 2), n(dmy, 1), lambda y: let(y, full)), form(named, n(named, 3), month, n(named, 1), lambda y: let(y, full)))

    return let(F.regexp_replace(text, r"^\s+|\s+$", ""), parsed)


def search_date(text: Column) -> Column:
    """The first of D/M/Y, D/M/YY (of this century) and Y-M-D that stands anywhere in the text, as ISO; else the text itself."""
    dmy, short, ymd = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", r"(\d{1,2})[/-](\d{1,2})[/-](\d{2})", r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})"

    def searched(t: Column) -> Column:
        n = lambda p, k: digits(t, p, k)
        form = lambda y, m, d: let(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), lambda x: _iso(x["y"], x["m"], x["d"], 0))
        return F.coalesce(form(n(dmy, 3), n(dmy, 2), n(dmy, 1)), form(2000 + n(short, 3), n(short, 2), n(short, 1)), form(n(ymd, 1), n(ymd, 2), n(ymd, 3)), t)

    return let(text, lambda t: F.when(t.isNotNull(), searched(t)))


def is_timestamp(text: Column) -> Column:
    return F.coalesce(text.try_cast("timestamp").isNotNull(), F.lit(False))


def backoff_ms(attempt: Column, base: float = 1000, factor: float = 2, most: float = 30_000) -> Column:
    """The delay before an attempt (from 0), without jitter, which is random."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(float(factor)), attempt))


# What exports hide, applied in this order.
EXPORT_REDACTIONS = (
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\d{3}[-\s]?\d{2}[-\s]?\d{4}",
    r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b")


def redact_export(text: Column) -> Column:
    """Personal data of exports replaced by one mark; null is empty."""
    hints = ("@", r"\d{3}[-.\s]?\d{4}", r"\d{2}[-\s]?\d{4}", r"\d{4}[-\s]?\d{4}", r"\d\.\d{1,3}\.\d")
    return reduce(lambda c, ph: where_hinted(c, ph[1], lambda t: F.regexp_replace(t, js_regex(ph[0]), "[REDACTED]")), zip(EXPORT_REDACTIONS, hints, strict=True), F.coalesce(text, F.lit("")))


def period_bounds(as_of: str, period: str) -> tuple[Column, Column]:
    """First and last day of the day, the week from Sunday, or the month of ``as_of``."""
    d = F.to_date(F.lit(as_of))
    if period == "daily":
        return d, d
    if period == "weekly":
        start = F.date_sub(d, F.dayofweek(d) - 1)
        return start, F.date_add(start, 6)
    if period == "monthly":
        return F.trunc(d, "month"), F.last_day(d)
    raise ValueError(f"no period {period!r}")


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def short_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)
