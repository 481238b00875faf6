"""Free-form JSON as queries: leaves with paths, personal data by path, and names reduced to initials."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import nested as N
from ..operators import review as V
from .registry import query

#: Orders as JSON of several levels, members in the order of their names.
_NESTED_SQL = """n AS (SELECT o_orderkey AS id, to_json({'customer': {'address': (o_custkey % 90 + 1) || ' Green Mill Road, AB1 2CD', 'customerName': 'Ann Marie ' || c_name, 'tags': []}, 'engineerName': CASE WHEN o_orderkey % 5 = 0 THEN 'Solo' ELSE 'Eng Alpha ' || (o_custkey % 40) END,
 'id': o_orderkey, 'lines': lines, 'open': o_orderstatus = 'O'}) AS json FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, list({'customerName': CASE WHEN l_linenumber = 2 THEN '' ELSE 'Lee ' || l_linestatus || ' Ray' END, 'flag': l_returnflag,
 'n': l_linenumber, 'notes': [CASE WHEN l_linenumber % 2 = 0 THEN 'call 201-555-' || (1000 + l_partkey % 9000) END, 'say "hi" to u' || l_suppkey || '@mail.test, due 2024-12345']} ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def nested(v):
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    n = F.col("l_linenumber")
    line = F.struct(n.alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"), F.col("l_returnflag").alias("d"), F.col("l_linestatus").alias("e"))
    lines = v.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    one = lambda x: F.struct(
        F.when(x["a"] == 2, "").otherwise(text("Lee ", x["e"], " Ray")).alias("customerName"), x["d"].alias("flag"), x["a"].alias("n"),
        F.array(F.when(x["a"] % 2 == 0, text("call 201-555-", 1000 + x["b"] % 9000)), text('say "hi" to u', x["c"], "@mail.test, due 2024-12345")).alias("notes"))
    customer = F.struct(text(F.col("o_custkey") % 90 + 1, " Green Mill Road, AB1 2CD").alias("address"), text("Ann Marie ", F.col("c_name")).alias("customerName"), F.array().cast("array<string>").alias("tags"))
    o = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    engineer = F.when(F.col("o_orderkey") % 5 == 0, "Solo").otherwise(text("Eng Alpha ", F.col("o_custkey") % 40))
    return o.select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(
        customer.alias("customer"), engineer.alias("engineerName"), F.col("o_orderkey").alias("id"), F.transform("ls", one).alias("lines"), (F.col("o_orderstatus") == "O").alias("open")), {"ignoreNullFields": "false"}).alias("json"))


_LEAVES = """SELECT {0} AS id, 'root' || substring(fullkey, 2) AS path, CASE WHEN json_tree.type = 'VARCHAR' THEN 'string' WHEN json_tree.type = 'NULL' THEN 'null' WHEN json_tree.type = 'BOOLEAN' THEN 'boolean' WHEN json_tree.type IN ('OBJECT', 'ARRAY') THEN lower(json_tree.type) ELSE 'number' END AS type,
 CASE WHEN json_tree.type NOT IN ('OBJECT', 'ARRAY') THEN atom->>'$' END AS value FROM {1}, json_tree({2}) WHERE json_tree.type NOT IN ('OBJECT', 'ARRAY') OR json_tree.value::VARCHAR IN ('[]', '{{}}')"""


@query("json_paths", f"WITH {_NESTED_SQL} SELECT 'order' AS source, * FROM ({_LEAVES.format('n.id', 'n', 'n.json')}) UNION ALL SELECT 'event', * FROM ({_LEAVES.format('event_id', 'events', 'props')})")
def _(v):
    events = v.table("events").select(F.lit("event").alias("source"), F.col("event_id").alias("id"), F.col("props").alias("json"))
    both = nested(v).select(F.lit("order").alias("source"), "id", "json").unionByName(events)
    return N.leaves(both, "json", ["source", "id"]).select("source", "id", "path", "type", "value")


# Names need a look ahead, which the oracle's patterns don't have.
_SCANNED = {n: p for n, p in V.PERSONAL.items() if n != "realName"}
_SCAN = " UNION ALL ".join(f"SELECT id, path, value, '{n}' AS pattern, unnest(regexp_extract_all(value, '{re.sub(r'[(][?]![^)]*[)]', '', p)}')) AS match FROM s" for n, p in _SCANNED.items())


@query("json_personal_data", f"""WITH {_NESTED_SQL}, l AS ({_LEAVES.format('n.id', 'n', 'n.json')}), s AS (SELECT * FROM l WHERE type = 'string'), f AS ({_SCAN})
 SELECT id, path, pattern, match FROM f WHERE NOT regexp_matches(match, '^(?i)(CUSTOMER_|VENDOR_|SUPPLIER_|PARTNER_|TECH-|PART-|JS-)') AND NOT ({' OR '.join(f"contains(match, '{a}')" for a in V.ALLOWED)})
 AND NOT (pattern = 'usPostalCode' AND regexp_matches(substring(value, greatest(1, instr(value, match) - 5), 15), '^\\d{{4}}-\\d{{2}}'))""")
def _(v):
    return N.personal_paths(nested(v), "json", ["id"], _SCANNED, V.ALLOWED)


def _initials(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN '' WHEN contains({x}, ' ') THEN left({x}, 1) || '. ' || left(list_last(string_split({x}, ' ')), 1) || '.' ELSE left({x}, 1) || '.' END"


@query("json_without_names", f"""WITH {re.sub("'(customerName|engineerName)': ((?:CASE.*?END|'Ann Marie ' [|][|] c_name))", lambda m: f"'{m[1]}': {_initials('(' + m[2] + ')')}", _NESTED_SQL)} SELECT id, json::VARCHAR AS json FROM n""")
def _(v):
    return N.names_as_initials(nested(v), "json", ["id"])
