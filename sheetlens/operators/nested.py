"""Free-form JSON: every leaf with its path, rewriting of leaves, and scans of texts by path.

Values are VARIANT and are opened level by level; how many levels there are is measured
first, so one lazy plan reaches every leaf whatever the depth, without a schema.
"""

from __future__ import annotations

import json as text_of
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import initials, let
from .review import personal_data

#: A string with its escapes, or a bracket; quantifiers are possessive, so long strings need no stack.
_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{}]'
_STEPS = "array<struct<name:string,pos:int>>"


def nesting(json: Column) -> Column:
    """How many containers stand inside one another at most; 0 for a scalar or null."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, token: Column) -> Column:
        now = a["now"] + F.when(token.isin("[", "{"), 1).when(token.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.coalesce(F.aggregate(F.regexp_extract_all(json, F.lit(_TOKENS), F.lit(0)), start, step)["most"], F.lit(0))


def _type(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (F.when(t == "STRING", "string").when(t == "VOID", "null").when(t == "BOOLEAN", "boolean").when(t.startswith("OBJECT"), "object")
            .when(t.startswith("ARRAY"), "array").otherwise("number"))


def depth(df: DataFrame, json: str) -> int:
    """How many containers stand inside one another at most in any row's JSON text."""
    return df.agg(F.max(nesting(F.col(json)))).first()[0] or 0


def leaves(df: DataFrame, json: str, keys: Sequence[str], levels: int | None = None) -> DataFrame:
    """(keys, row, path, steps, type, value, json): a row per leaf of each row's JSON text.

    ``path`` begins with ``root``; members add ``.name``, items ``[n]`` from 0. Leaves are
    strings, numbers, booleans, nulls and empty containers; ``value`` is a scalar's text, and
    ``json`` what stands there. ``row`` tells rows of equal keys apart. A text that is no JSON
    is one leaf of type ``malformed``; a null one has none. ``levels`` is the texts' ``depth``,
    which is measured where it isn't given.
    """
    text = F.col(json)
    levels = depth(df, json) if levels is None else levels
    rows = df.filter(text.isNotNull()).select(
        *keys, F.monotonically_increasing_id().alias("row"), F.lit("root").alias("path"), F.array().cast(_STEPS).alias("steps"), text.alias("_text"), F.try_parse_json(text).alias("_v"))
    for _ in range(levels):
        opened = rows.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()))
        inner = F.col("pos").isNotNull()
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        rows = opened.select(
            *keys, "row", F.when(inner, F.concat("path", step)).otherwise(F.col("path")).alias("path"),
            F.when(inner, F.array_append("steps", F.struct(F.col("key").alias("name"), F.col("pos").alias("pos")))).otherwise(F.col("steps")).alias("steps"),
            "_text", F.when(inner, F.col("value")).otherwise(F.col("_v")).alias("_v"))
    kind = F.when(F.col("_v").isNull(), "malformed").otherwise(_type(F.col("_v")))
    scalar = F.when(F.col("_v").isNull(), F.col("_text")).when(kind.isin("string", "number", "boolean"), F.try_variant_get("_v", "$", "string"))
    return rows.select(*keys, "row", "path", "steps", kind.alias("type"), scalar.alias("value"), F.coalesce(F.to_json("_v"), "_text").alias("json"))


def json_text(c: Column) -> Column:
    """A string as JSON writes it."""
    inside = F.to_json(F.array(c))
    return F.substring(inside, 2, F.length(inside) - 2)


def rewritten(found: DataFrame, change: Callable[[Column, Column], Column]) -> DataFrame:
    """``leaves`` with the strings that ``change(steps, value)`` gives in place of theirs."""
    new = F.when(F.col("type") == "string", change(F.col("steps"), F.col("value"))).otherwise(F.col("value"))
    return found.withColumn("value", new).withColumn("json", F.when(F.col("type") == "string", F.coalesce(json_text(F.col("value")), F.lit("null"))).otherwise(F.col("json")))


def rebuilt(found: DataFrame, keys: Sequence[str], name: str = "json", levels: int | None = None) -> DataFrame:
    """(keys, name): the JSON text of each row that has leaves, members in the order of their names.

    Containers close from the deepest level up. All levels of a row stay in one partition, so
    the leaves are shuffled once. ``levels`` is the texts' ``depth``; where it isn't given, the
    leaves are read once more to find the longest path.
    """
    if levels is None:
        levels = found.agg(F.max(F.size("steps"))).first()[0] or 0
    rows = found.select(*keys, "row", "steps", "json").repartition("row")
    for level in range(levels, 0, -1):
        deep = F.size("steps") == level
        parent = F.when(deep, F.slice("steps", 1, level - 1)).otherwise(F.col("steps"))
        last = F.when(deep, F.element_at("steps", -1))
        part = F.struct(last["pos"].alias("pos"), last["name"].alias("name"), "json")
        grouped = rows.select(*keys, "row", parent.alias("steps"), deep.alias("_deep"), part.alias("_p")).groupBy(*keys, "row", "steps", "_deep").agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
        first = F.get("_ps", 0)
        items = F.concat(F.lit("["), F.array_join(F.transform("_ps", lambda p: p["json"]), ","), F.lit("]"))
        members = F.concat(F.lit("{"), F.array_join(F.transform("_ps", lambda p: F.concat(json_text(p["name"]), F.lit(":"), p["json"])), ","), F.lit("}"))
        rows = grouped.select(*keys, "row", "steps", F.when(~F.col("_deep"), first["json"]).when(first["name"].isNull(), items).otherwise(members).alias("json"))
    return rows.select(*keys, F.col("json").alias(name))


# Members whose values are names of people.
NAMES = ("engineerName", "customerName")


def without_names(df: DataFrame, json: str, keys: Sequence[str], names: Sequence[str] = NAMES) -> DataFrame:
    """(keys, json): names reduced to initials wherever their member stands, at any depth; an empty name stays."""
    def change(steps: Column, value: Column) -> Column:
        named = F.coalesce(F.element_at(F.when(F.size(steps) > 0, steps), -1)["name"].isin(*names), F.lit(False))
        return F.when(named & (value != ""), initials(value)).otherwise(value)

    levels = depth(df, json)
    return rebuilt(rewritten(leaves(df, json, keys, levels), change), keys, json, levels)


def names_as_initials(df: DataFrame, json: str, keys: Sequence[str], names: Sequence[str] = NAMES) -> DataFrame:
    """What ``without_names`` gives, in the row: nothing is exploded or shuffled, and the depth of the texts doesn't matter.

    The JSON is written again with members in the order of their names, and cut where a
    named member's string begins. After ``{`` or ``,`` a quote begins a string, and one that
    stands before a colon is a member's name, so no string's inside is taken for a member.
    """
    known = "|".join(re.escape(text_of.dumps(n, ensure_ascii=False)) for n in names)

    def told(part: Column) -> Column:
        def new(token: Column) -> Column:
            said = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), token, F.lit('"'))), "$", "string")
            short = F.when(token.contains("\\"), json_text(initials(said))).otherwise(F.concat(F.lit('"'), initials(token), F.lit('"')))
            return F.concat(short, F.substring(part, F.length(token) + 3, F.length(part)))

        return let(F.regexp_extract(part, r'^"([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1), new)

    def joined(parts: Column) -> Column:
        return F.when(F.size(parts) < 2, F.get(parts, 0)).otherwise(F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(told(p))), ""))

    cut = rf'(?="[^"])(?<=":)(?<=[{{,](?:{known}):)'
    member, word = rf'([{{,](?:{known}):") *+', r'([^\s"\\])[^\s"\\]*+'

    def changed(w: Column) -> Column:
        """Names without escapes are one or several words; rows with other names are cut."""
        odd = w.rlike(rf'[{{,](?:{known}):"(?:[^"\\]*+\\| ++")')
        plain = F.regexp_replace(F.regexp_replace(w, rf'{member}{word} *+"', '$1$2."'), rf'{member}{word}(?: ++{word})++ *+"', '$1$2. $3."')
        return F.when(odd, let(F.split(w, cut), joined)).otherwise(plain)

    # Not a filter: pushed down to where the texts are made, it would have each made twice.
    def kept(t: Column) -> Column:
        return F.when(t.isNotNull(), F.array(F.coalesce(let(F.to_json(F.try_parse_json(t)), changed) if names else F.to_json(F.try_parse_json(t)), t)))

    return df.select(*keys, F.explode(let(F.col(json), kept)).alias(json))


def personal_paths(df: DataFrame, json: str, keys: Sequence[str], patterns: Mapping[str, str], allowed: Sequence[str] = ()) -> DataFrame:
    """(keys, path, pattern, match): what looks like personal data in the strings of a JSON text, and where; no JSON at all is a finding ``malformed``."""
    found = leaves(df, json, keys)
    hits = personal_data(found.filter("type = 'string'"), patterns, allowed, [*keys, "path"], "value")
    broken = found.filter("type = 'malformed'").select(*keys, "path", F.lit("malformed").alias("pattern"), F.substring("value", 1, 100).alias("match"))
    return hits.unionByName(broken)
