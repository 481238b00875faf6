"""Rule-based analysis of texts: which fields of a specification a text mentions, and fixtures of expected outcomes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let, round_half_up, trimmed
from .review import BLANK, SPACE

# Confidences, the least content, and the longest value.
FOUND, MISSING, NO_CONTENT, LEAST_CHARS, LEAST_WORDS, WINDOW, LONGEST = 60, 30, 100, 50, 10, 100, 50
_FIELDS = "array<struct<field:string,value:string>>"
_FINDINGS = "array<struct<severity:string,reason:string,field:string,rule_id:string,confidence:int>>"


@dataclass(frozen=True)
class Rule:
    id: str
    field: str
    required: bool = True


# The rules that hold where a user gives none.
RULES = (
    Rule("R-001", "Customer Signature"), Rule("R-002", "Date of Service"), Rule("R-003", "Equipment Serial Number"), Rule("R-004", "Technician Name"), Rule("R-005", "Work Description"),
    Rule("R-006", "Parts Used", False), Rule("R-007", "Time In"), Rule("R-008", "Time Out"), Rule("R-009", "Customer Name"), Rule("R-010", "Job Number"))


def _sum(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, t: a + t.cast("int"), tests, F.lit(0))


def analyse(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, result, score, words, detected, expected, fields, findings) of each row.

    A field is detected where the text holds its name or the name's first word, case ignored;
    its value is what follows the name (after a colon or equals sign) to the end of that line,
    within 100 characters and at most 50 long, and ``[detected]`` where nothing does. A
    required field not detected is a finding; a text of at most 50 characters or fewer than ten
    words fails, any other passes with a score of half its words' number and half the share of
    fields. Findings are ordered by severity, reason and field. The text is lower-cased and
    cut once for all fields. Null texts are empty; rows that share a key are rows of their own.
    """
    return docs.select(key, analysis(F.col(text), rules).alias("_a")).select(key, "_a.*")


def analysis(text: Column, rules: Sequence[Rule] = RULES, told: bool = True) -> Column:
    """What ``analyse`` gives, as one struct of a text; without fields and findings unless they are ``told``."""
    def one(d: Column) -> Column:
        names = [(r, r.field.lower(), r.field.lower().split(" ")[0]) for r in rules]
        found = F.array(*[d["low"].contains(n) | d["low"].contains(w) for _, n, w in names]) if rules else F.array().cast("array<boolean>")

        def judged(hit: Column) -> Column:
            def value(name: str) -> Column:
                at = F.locate(name, d["low"])
                after = F.substring(d["text"], at + len(name), F.lit(WINDOW))
                said = F.substring(trimmed(F.regexp_extract(after, rf"[:=]?[{SPACE}]*([^\n\r]+)", 1)), 1, LONGEST)
                return F.when((at > 0) & (said != ""), said).otherwise("[detected]")

            each = [F.get(hit, i) for i in range(len(names))]
            none = (F.length(trimmed(d["text"])) <= LEAST_CHARS) | (d["words"] < LEAST_WORDS)
            detected, expected = _sum(each), sum(r.required for r in rules)
            share = round_half_up(detected / float(expected) * 50) if expected else F.lit(50.0)
            score = F.when(none, 0).otherwise(round_half_up(F.least(F.lit(50.0), d["words"] / 10.0) + share)).cast("int")
            if not told:
                return F.struct(F.when(none, "FAIL").otherwise("PASS").alias("result"), score.alias("score"))
            fields = F.array_compact(F.array(*[F.when(h, F.struct(F.lit(r.field).alias("field"), value(n).alias("value"))) for h, (r, n, _) in zip(each, names)])) if names else F.array()
            finding = lambda severity, reason, field, rule, c: F.struct(F.lit(severity).alias("severity"), F.lit(reason).alias("reason"), F.lit(field).alias("field"), F.lit(rule).alias("rule_id"), F.lit(c).alias("confidence"))
            gone = [F.when(~h, finding("S3", "LOW_CONFIDENCE", r.field, r.id, MISSING)) for h, (r, _, _) in zip(each, names) if r.required]
            empty = F.when(none, finding("S1", "OCR_FAILURE", "Document Content", "SYSTEM", NO_CONTENT))
            return F.struct(F.when(none, "FAIL").otherwise("PASS").alias("result"), score.alias("score"), d["words"].alias("words"), detected.alias("detected"), F.lit(expected).alias("expected"),
                            fields.cast(_FIELDS).alias("fields"), F.array_sort(F.array_compact(F.array(*gone, empty)).cast(_FINDINGS)).alias("findings"))

        return let(found, judged)

    def read(t: Column) -> Column:
        return let(F.struct(t.alias("text"), F.lower(t).alias("low"), F.size(F.filter(F.split(t, f"{BLANK}+"), lambda w: w != "")).alias("words")), one)

    return let(F.coalesce(text, F.lit("")), read)


# --- fixtures -----------------------------------------------------------------------------


@dataclass(frozen=True)
class SpecField:
    """A field of a template's specification; ``critical`` if a rule of that severity is about it."""

    field: str
    label: str
    required: bool = True
    critical: bool = False

    def words(self) -> list[str]:
        """Words of the label and of the name, one of which a text must hold; words of up to two letters don't count."""
        name = re.sub("([A-Z])", r" \1", self.field).lower().strip()
        return list(dict.fromkeys(w for w in (*self.label.lower().split(" "), *name.split(" ")) if len(w) > 2))


def expected_outcomes(cases: DataFrame, specs: Mapping[str, Sequence[SpecField]], spec: str = "spec", text: str = "input_text") -> DataFrame:
    """``cases`` with outcome, reason_codes, fields and errors, and whether each case passed.

    ``cases(case_id, spec, input_text, expected_outcome, expected_reason_codes, required)``:
    a required field that the text doesn't mention is a MISSING_FIELD; it fails the case if
    the field is critical, else the case goes to review. A case passes if the outcome is the
    expected one and all expected reason codes are among its own; others may be there too.
    A spec that isn't known gives an error and no outcome. Null texts are empty.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    answer = "struct<outcome:string,reason_codes:array<string>,fields:array<string>>"

    def judged(fields: Sequence[SpecField]) -> Column:
        seen = F.array(*[reduce(lambda a, w: a | F.col("_low").contains(w), f.words(), F.lit(False)) for f in fields]) if fields else F.array().cast("array<boolean>")

        def outcome(s: Column) -> Column:
            gone = [(~F.get(s, i), f) for i, f in enumerate(fields) if f.required]
            n, grave = _sum([g for g, _ in gone]), _sum([g for g, f in gone if f.critical])
            names = [F.when(F.get(s, i), F.lit(f.field)) for i, f in enumerate(fields)]
            return F.struct(F.when(grave > 0, "fail").when(n > 0, "review_queue").otherwise("pass").alias("outcome"), F.array_repeat(F.lit("MISSING_FIELD"), n).alias("reason_codes"),
                            (F.array_compact(F.array(*names)) if names else F.array()).cast("array<string>").alias("fields")).cast(answer)

        return let(seen, outcome)

    out = F.lit(None).cast(answer)
    for name, fields in specs.items():
        out = F.when(F.col(spec) == name, judged(fields)).otherwise(out)
    wanted = F.coalesce("expected_reason_codes", F.array().cast("array<string>"))
    rows = cases.withColumn("_low", low).withColumn("_o", out)
    lacking = F.array_except(wanted, F.coalesce("_o.reason_codes", F.array().cast("array<string>")))
    other = ~F.col("_o.outcome").eqNullSafe(F.col("expected_outcome"))
    errors = F.array_compact(F.array(
        F.when(F.col("_o").isNull(), "No specification").when(other, F.concat(F.lit("Expected outcome '"), F.coalesce("expected_outcome", F.lit("null")), F.lit("' but got '"), F.col("_o.outcome"), F.lit("'"))),
        F.when(F.size(lacking) > 0, F.concat(F.lit("Missing expected reason codes: "), F.array_join(lacking, ", ")))))
    return rows.withColumn("_e", errors).select(*cases.columns, F.col("_o.outcome").alias("outcome"), F.col("_o.reason_codes").alias("reason_codes"), F.col("_o.fields").alias("fields"),
                                                F.col("_e").alias("errors"), (F.size("_e") == 0).alias("passed"))


def matrix_report(results: DataFrame, spec: str = "spec") -> DataFrame:
    """(spec, result, total, passed, failed, required_failed): PASS unless a required case failed."""
    bad = ~F.col("passed")
    g = results.groupBy(spec).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed_cases"), F.count_if(bad).alias("failed"), F.count_if(bad & F.col("required")).alias("required_failed"))
    return g.select(spec, F.when(F.col("required_failed") == 0, "PASS").otherwise("FAIL").alias("result"), "total", F.col("passed_cases").alias("passed"), "failed", "required_failed")
