"""Activation policy, boosts by metadata, and routing by images as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import templates as P
from .registry import query

_FIELDS = (*P.CRITICAL_FIELDS, *P.RECOMMENDED_FIELDS)


def _names(values, n: str, start: int = 0) -> str:
    """SQL of the values whose place plus the number isn't a multiple of 4."""
    return "list_filter([" + ", ".join(f"CASE WHEN ({n} + {i + start}) % 4 > 0 THEN '{v}' END" for i, v in enumerate(values)) + "], lambda x: x IS NOT NULL)"


def names(values, n, start: int = 0):
    return F.array_compact(F.array(*[F.when((n + (i + start)) % 4 > 0, v) for i, v in enumerate(values)]))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _less(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


@query("activation_policy", f"""WITH p AS (SELECT p_partkey AS version_id, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 3 ELSE 0 END AS tokens, CASE WHEN p_partkey % 2 = 0 THEN 'F-1' END AS form_code, {_names(_FIELDS, 'p_partkey')} AS fields,
 CASE WHEN p_partkey % 7 > 0 THEN {_names(P.CRITICAL_FIELDS, 'p_partkey', 1)} ELSE [] END AS rule_fields, {_names(P.CRITICAL_REGIONS, 'p_size')} AS regions, p_size % 6 > 0 AS has_fixtures, p_size % 4 AS failed FROM part),
 m AS (SELECT *, {_less(_list(P.CRITICAL_REGIONS), 'regions')} AS gone FROM p), k AS (SELECT *, list_filter(gone, lambda x: x <> 'expiryDate') AS stops FROM m),
 v AS (SELECT version_id, list_concat(list_concat(list_concat(CASE WHEN tokens = 0 AND form_code IS NULL THEN ['SELECTION_CONFIG_EMPTY:'] ELSE [] END, list_transform({_less(_list(P.CRITICAL_FIELDS), 'fields')}, lambda x: 'MISSING_CRITICAL_FIELD:' || x)),
 list_concat(CASE WHEN len(rule_fields) = 0 THEN ['NO_VALIDATION_RULES:'] ELSE [] END, CASE WHEN NOT has_fixtures THEN ['MISSING_FIXTURE_PACK:'] WHEN failed > 0 THEN ['FIXTURES_FAILING:' || failed] ELSE [] END)),
 list_concat(CASE WHEN len(stops) > 0 THEN ['MISSING_CRITICAL_ROIS:' || array_to_string(stops, ', ')] ELSE [] END, CASE WHEN tokens < 1 THEN ['INSUFFICIENT_SELECTION_TOKENS:' || tokens] ELSE [] END)) AS violations,
 list_concat(list_concat(list_transform({_less(_list(P.RECOMMENDED_FIELDS), 'fields')}, lambda x: 'MISSING_RECOMMENDED_FIELD:' || x),
 list_transform(list_filter({_list(P.CRITICAL_FIELDS)}, lambda x: list_contains(fields, x) AND NOT list_contains(rule_fields, x)), lambda x: 'CRITICAL_FIELD_NO_RULE:' || x)), CASE WHEN list_contains(gone, 'expiryDate') THEN ['ALLOWED_MISSING_ROIS:expiryDate'] ELSE [] END) AS warnings FROM k)
 SELECT version_id, len(violations) = 0 AS allowed, array_to_string(violations, ';') AS violations, array_to_string(warnings, ';') AS warnings FROM v""")
def _(v):
    k, s = F.col("p_partkey"), F.col("p_size")
    tokens = F.when(k % 5 > 0, F.slice(F.array(F.lit("job"), F.lit("sheet")), F.lit(1), (k % 3).cast("int"))).otherwise(F.array().cast("array<string>"))
    versions = v.table("part").select(
        k.alias("version_id"), tokens.alias("tokens_all"), F.lit(None).cast("array<string>").alias("tokens_any"), F.when(k % 2 == 0, "F-1").alias("form_code"), names(_FIELDS, k).alias("fields"),
        F.when(k % 7 > 0, names(P.CRITICAL_FIELDS, k, 1)).alias("rule_fields"), names(P.CRITICAL_REGIONS, s).alias("regions"), (s % 6 > 0).alias("has_fixtures"), (s % 4).alias("required_failed"))
    out = P.activation_policy(versions, allowed_missing=("expiryDate",))
    said = lambda c: F.array_join(F.transform(c, lambda i: F.concat_ws(":", i["code"], i["detail"])), ";")
    return out.select("version_id", "allowed", said("violations").alias("violations"), said("warnings").alias("warnings"))


@query("boosted_scores", "SELECT c_custkey, least(100.0::DOUBLE, least(100.0::DOUBLE, c_custkey % 101 * 1.0 + CASE WHEN c_mktsegment = 'BUILDING' THEN 10 ELSE 0 END) + CASE WHEN c_nationkey % 3 = 1 THEN 5 ELSE 0 END) AS score FROM customer")
def _(v):
    c = v.table("customer")
    meta = {"client": F.col("c_mktsegment"), "asset_type": F.concat(F.lit("asset_"), (F.col("c_nationkey") % 3).cast("string"))}
    return c.select("c_custkey", P.boosted((F.col("c_custkey") % 101).cast("double"), {"client": "BUILDING", "asset_type": "asset_1", "work_type": None}, meta).alias("score"))


@query("image_review_routing", f"""WITH d AS (SELECT o_orderkey AS doc_id, o_custkey % 100 AS quality, o_orderkey % 3 AS skewed, o_orderkey % 4 > 0 AS signed, o_custkey % 5 > 0 AS ticked, CASE WHEN o_custkey % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS weak FROM orders),
 r AS (SELECT doc_id, trim(CASE WHEN NOT signed THEN 'MISSING_SIGNATURE:customer;' ELSE '' END || CASE WHEN quality < 50 THEN 'LOW_QUALITY:' || quality || ';' ELSE '' END || CASE WHEN NOT ticked THEN 'UNCHECKED_REQUIRED:safety;' ELSE '' END
 || CASE WHEN skewed > 0 THEN 'SKEWED_DOCUMENT:' || skewed || ';' ELSE '' END || CASE WHEN weak > 0 THEN 'LOW_CONFIDENCE:' || weak || ';' ELSE '' END, ';') AS reasons, CASE WHEN NOT signed THEN 'high' WHEN quality < 50 OR NOT ticked THEN 'medium' ELSE 'low' END AS priority FROM d)
 SELECT doc_id, reasons <> '' AS route, reasons, priority FROM r""")
def _(v):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    mark = lambda label, present, confidence: F.struct(F.lit(label).alias("label"), present.alias("present"), confidence.alias("confidence"))
    docs = v.table("orders").select(
        o.alias("doc_id"), (c % 100).alias("quality"), (o % 3).alias("skewed_pages"),
        F.array(mark("customer", o % 4 > 0, F.when(c % 6 == 0, 0.5).otherwise(0.8)), mark("witness", F.lit(False), F.lit(0.9))).alias("signatures"),
        F.array(mark("safety", c % 5 > 0, F.when(o % 9 == 0, 0.6).otherwise(0.7))).alias("boxes"))
    out = P.image_review(docs, ("customer",), ("safety",))
    return out.select("doc_id", "route", F.array_join(F.transform("reasons", lambda r: F.concat_ws(":", r["code"], r["detail"])), ";").alias("reasons"), "priority")
