"""Validation of specifications and of regions given as JSON: every fault with its path, code and message.

The JSON is a VARIANT: members are looked up by path, arrays are walked with their index, and
what must be unique is compared with its siblings; all of it inside one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let
from .nested import _type as type_of

# Required members, kinds of rules, severities, and usual regions.
REQUIRED = ("name", "version", "rules")
RULE_REQUIRED = ("id", "field", "type", "required", "description")
RULE_TYPES = ("presence", "format", "regex", "range", "enum")
SEVERITIES = ("S0", "S1", "S2", "S3")
REGIONS = ("header", "jobReference", "assetId", "date", "expiryDate", "tickboxBlock", "signatureBlock", "customerSignature", "engineerSignature", "workDescription", "partsUsed")
LONGEST_NAME, SEMVER, RULE_ID, BEYOND = 200, r"^\d+\.\d+\.\d+$", r"^[A-Z]+-\d{3}$", 1.001

_FAULT = "struct<path:string,level:string,code:string,message:string,value:string>"


def _text(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c


def _fault(test: Column, path: Column | str, code: str, message: Column | str, value: Column | None = None, level: str = "error") -> Column:
    """The fault where the test holds, else null."""
    return F.when(test, F.struct(_text(path).alias("path"), F.lit(level).alias("level"), F.lit(code).alias("code"), _text(message).alias("message"),
                                 (F.lit(None) if value is None else value).cast("string").alias("value")).cast(_FAULT))


def _join(*parts: Column | str) -> Column:
    return F.concat(*map(_text, parts))


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    """A member, null where it isn't there; as another kind also null where it isn't that."""
    return F.try_variant_get(v, f"$.{path}", kind)


def _kind(v: Column) -> Column:
    """The type of a value as it is named there: null and arrays are objects."""
    t = type_of(v)
    return F.when(t.isin("null", "array"), "object").otherwise(t)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(type_of(v) == kind, F.lit(False))


def _string(v: Column) -> Column:
    return F.when(_is(v, "string"), F.try_variant_get(v, "$", "string"))


def pattern_fault(p: Column) -> Column:
    """Whether a pattern can't be compiled: open or unopened brackets, nothing to repeat, or a last backslash. Names of classes and groups aren't looked at."""
    bare = F.regexp_replace(F.regexp_replace(p, r"(?s)\\.", "x"), r"\[\^?\]?[^\]]*\]", "x")
    depth = F.aggregate(F.regexp_extract_all(bare, F.lit("[()]"), F.lit(0)), F.lit(0), lambda a, c: F.when(a < 0, a).otherwise(a + F.when(c == "(", 1).otherwise(-1)))
    return (depth != 0) | bare.contains("[") | bare.endswith("\\") | bare.rlike(r"(?:^|[(|])(?:[*+]|\?(?![:=!<]))|\{\d*,?\d*\}[*+{]|[*+?][*+]|^\?")


def _date_fault(spec: Column, name: str) -> Column:
    v = _get(spec, name)
    blank = v.isNull() | _is(v, "null") | F.coalesce(_string(v) == "", F.lit(False)) | F.coalesce(F.try_variant_get(v, "$", "string").isin("false", "0") & type_of(v).isin("boolean", "number"), F.lit(False))
    good = F.coalesce(_string(v).try_cast("timestamp").isNotNull(), F.lit(False))
    return _fault(~blank & ~good, f"$.{name}", "invalid_date", f"{name} must be a valid ISO 8601 date-time", F.try_variant_get(v, "$", "string"))


def _rule_faults(rules: Column, i: Column, ids: Column) -> Column:
    """Faults of the rule at ``i``; ``ids`` are the ids of all rules, null where they are no strings."""
    rule, path = F.get(rules, i), _join("$.rules[", i.cast("string"), "]")
    has, said = (lambda n: _get(rule, n).isNotNull()), (lambda n: _string(_get(rule, n)))
    kind, pattern, identity = F.coalesce(said("type"), F.lit("")), said("pattern"), F.get(ids, i)
    at = lambda n: F.concat(path, F.lit(f".{n}"))
    gone = [_fault(~has(n), at(n), "required", f"Required field '{n}' is missing in rule") for n in RULE_REQUIRED]
    value = lambda n: F.try_variant_get(rule, f"$.{n}", "string")
    faults = [
        *gone, _fault(has("id") & identity.isNull(), at("id"), "type", "Rule ID must be a string"),
        _fault(~identity.rlike(RULE_ID), at("id"), "rule_id_form", "Rule ID should follow pattern X-NNN (e.g., R-001)", identity, "warning"),
        _fault(F.array_position(ids, identity) <= i, at("id"), "duplicate", _join("Duplicate rule ID: ", identity), identity),
        _fault(has("type") & ~kind.isin(*RULE_TYPES), at("type"), "rule_type", f"Invalid rule type. Must be one of: {', '.join(RULE_TYPES)}", value("type")),
        _fault((kind == "regex") & ~has("pattern"), at("pattern"), "required", "Pattern is required for regex type rules"),
        _fault((kind == "regex") & F.coalesce(pattern_fault(pattern), F.lit(False)), at("pattern"), "pattern", "Invalid regex pattern", pattern),
        _fault((kind == "range") & ~has("minValue") & ~has("maxValue"), path, "range", "Range type requires minValue and/or maxValue"),
        _fault((kind == "enum") & ~has("allowedValues"), at("allowedValues"), "required", "allowedValues is required for enum type rules"),
        _fault(has("severity") & ~F.coalesce(said("severity").isin(*SEVERITIES), F.lit(False)), at("severity"), "severity", f"Invalid severity. Must be one of: {', '.join(SEVERITIES)}", value("severity"))]
    other = F.array(_fault(F.lit(True), path, "type", "Each rule must be an object"))
    return F.when(_is(rule, "object"), F.array_compact(F.array(*faults))).otherwise(other)


def spec_faults(spec: Column) -> Column:
    """array of (path, level, code, message, value) of a specification as VARIANT; a null one is no JSON."""
    name, version, rules = (_get(spec, n) for n in ("name", "version", "rules"))
    text, listed = _string(name), _get(spec, "rules", "array<variant>")
    head = F.array_compact(F.array(
        *[_fault(_get(spec, n).isNull(), f"$.{n}", "required", f"Required field '{n}' is missing") for n in REQUIRED],
        _fault(name.isNotNull() & text.isNull(), "$.name", "type", "Name must be a string", _kind(name)), _fault(text == "", "$.name", "empty", "Name cannot be empty"),
        _fault(F.length(text) > LONGEST_NAME, "$.name", "too_long", f"Name cannot exceed {LONGEST_NAME} characters", F.length(text)),
        _fault(version.isNotNull() & _string(version).isNull(), "$.version", "type", "Version must be a string", _kind(version)),
        _fault(~_string(version).rlike(SEMVER), "$.version", "semver", "Version must follow semantic versioning (e.g., 1.0.0)", _string(version)),
        _date_fault(spec, "effectiveDate"), _date_fault(spec, "expiryDate"),
        _fault(rules.isNotNull() & ~_is(rules, "array"), "$.rules", "type", "Rules must be an array", _kind(rules)), _fault(F.size(listed) == 0, "$.rules", "empty", "Rules array cannot be empty")))
    each = let(listed, lambda rs: let(F.transform(rs, lambda r: _string(_get(r, "id"))), lambda ids: F.flatten(F.transform(F.sequence(F.lit(0), F.size(rs) - 1), lambda i: _rule_faults(rs, i, ids)))))
    body = F.concat(head, F.when(F.size(listed) > 0, each).otherwise(F.array().cast(f"array<{_FAULT}>")))
    none = F.array(_fault(F.lit(True), "$", "malformed", "Specification must be JSON"))
    other = F.array(_fault(F.lit(True), "$", "type", "Specification must be a JSON object", _kind(spec)))
    return F.when(spec.isNull(), none).when(_is(spec, "object"), body).otherwise(other)


def _region_faults(regions: Column, i: Column) -> Column:
    r, n = F.get(regions, i), i.cast("string")
    at = lambda *p: _join("$.regions[", n, "]", *p)
    number = lambda p: F.when(_is(_get(r, p), "number"), _get(r, p, "double"))
    name, page, bounds = _string(_get(r, "name")), number("page"), _get(r, "bounds")
    boxed = bounds.isNotNull() & ~_is(bounds, "null")
    x, y, w, h = (number(f"bounds.{p}") for p in ("x", "y", "width", "height"))

    def outside(p: str, v: Column, least: Column) -> Column:
        return _fault(boxed & ~F.coalesce(least & (v <= 1), F.lit(False)), at(f".bounds.{p}"), "bounds", _join("Region ", n, f": bounds.{p} must be 0-1 (normalized)"), _get(r, f"bounds.{p}", "string"))

    return F.array_compact(F.array(
        _fault(F.trim(F.coalesce(name, F.lit(""))) == "", at(".name"), "required", _join("Region ", n, ": name is required")),
        _fault(~F.coalesce(page >= 1, F.lit(False)), at(".page"), "page", _join("Region ", n, ": page must be >= 1 (1-indexed)"), _get(r, "page", "string")),
        _fault(~boxed, at(".bounds"), "required", _join("Region ", n, ": bounds are required")),
        outside("x", x, x >= 0), outside("y", y, y >= 0), outside("width", w, w > 0), outside("height", h, h > 0),
        _fault(boxed & (x + w > BEYOND), at(".bounds"), "beyond_page", _join("Region ", n, ": x + width exceeds page boundary"), None, "warning"),
        _fault(boxed & (y + h > BEYOND), at(".bounds"), "beyond_page", _join("Region ", n, ": y + height exceeds page boundary"), None, "warning"),
        _fault(boxed & ~F.coalesce(name.isin(*REGIONS), F.lit(False)), at(".name"), "unusual_region", _join("Region ", n, ": '", F.coalesce(name, F.lit("undefined")), "' is not a standard ROI type"), name, "warning")))


def region_faults(roi: Column) -> Column:
    """array of faults of regions as VARIANT: names, pages, boxes within the page; warnings of repeated names and of boxes that overlap."""
    listed = F.when(_is(_get(roi, "regions"), "array"), _get(roi, "regions", "array<variant>"))

    def body(rs: Column) -> Column:
        places = F.when(F.size(rs) > 0, F.sequence(F.lit(0), F.size(rs) - 1)).otherwise(F.array().cast("array<int>"))
        names = F.transform(rs, lambda r: _string(_get(r, "name")))
        flat = F.transform(rs, lambda r: F.struct(_string(_get(r, "name")).alias("name"), _get(r, "page", "double").alias("page"), *[_get(r, f"bounds.{p}", "double").alias(p) for p in ("x", "y", "width", "height")]))

        def pairs(bs: Column) -> Column:
            def apart(a: Column, b: Column) -> Column:
                return (a["x"] + a["width"] < b["x"]) | (b["x"] + b["width"] < a["x"]) | (a["y"] + a["height"] < b["y"]) | (b["y"] + b["height"] < a["y"])

            def against(i: Column) -> Column:
                a = F.get(bs, i)
                later = F.filter(F.transform(bs, lambda b, j: F.struct(b.alias("b"), j.alias("j"))), lambda o: (o["j"] > i) & F.coalesce((o["b"]["page"] == a["page"]) & ~apart(a, o["b"]), F.lit(False)))
                name = lambda c: F.coalesce(c, F.lit("undefined"))
                return F.transform(later, lambda o: _fault(F.lit(True), "$.regions", "overlap", _join("Regions '", name(a["name"]), "' and '", name(o["b"]["name"]), "' overlap"), None, "warning"))

            return F.flatten(F.transform(places, against))

        twice = let(names, lambda ns: F.array_distinct(F.filter(F.transform(ns, lambda n, i: F.when(F.array_position(ns, n) <= i, n)), lambda n: n.isNotNull())))
        repeated = let(twice, lambda t: F.when(F.size(t) > 0, F.array(_fault(F.lit(True), "$.regions", "duplicate", _join("Duplicate region names: ", F.array_join(t, ", ")), None, "warning"))).otherwise(F.array().cast(f"array<{_FAULT}>")))
        return F.concat(F.flatten(F.transform(places, lambda i: _region_faults(rs, i))), repeated, let(flat, pairs))

    none = F.array(_fault(F.lit(True), "$.regions", "type", "regions must be an array"))
    return F.when(listed.isNull(), none).otherwise(let(listed, body))


def faults(packs: DataFrame, key: str, spec: str | None = None, regions: str | None = None) -> DataFrame:
    """(key, part, path, level, code, message, value): a row per fault of each row's JSON texts, ``part`` being ``spec`` or ``regions``.

    A null text isn't checked. Rows that share a key are checked one by one.
    """
    def part(name: str, column: str, check) -> Column:
        found = F.transform(let(F.try_parse_json(F.col(column)), check), lambda f: F.struct(F.lit(name).alias("part"), f.alias("f")))
        return F.when(F.col(column).isNotNull(), found).otherwise(F.array())

    asked: Sequence[Column] = [part(n, c, f) for n, c, f in (("spec", spec, spec_faults), ("regions", regions, region_faults)) if c]
    every = reduce(lambda a, b: F.concat(a, b), asked)
    return packs.select(key, F.explode(every).alias("x")).select(key, "x.part", "x.f.*")
