"""Filters, look-ups, pages, ranks, joins and set operations on any table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import r6


def where_given(df: DataFrame, **options) -> DataFrame:
    """Rows equal to every option given; None, 0 and the empty text mean no filter."""
    given = [F.col(k) == v for k, v in options.items() if v]
    return df.filter(reduce(and_, given)) if given else df


def page(df: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a total order, by a top-k of the tasks' own tops; never a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page and, beside it, the number of rows before paging; the total is one row and is broadcast."""
    return page(df, order, limit, offset).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


def find(df: DataFrame, **key) -> DataFrame:
    """The row of a key, or none."""
    return df.filter(reduce(and_, [F.col(k) == v for k, v in key.items()])).limit(1)


def latest_per_key(df: DataFrame, key: Sequence[str], at: str, tie: str) -> DataFrame:
    """Of each key the row of the greatest (at, tie): an aggregate with partial maxima, no sort of the groups."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_r"))
    return best.select(*key, "_r.*")


def top_and_runner_up(df: DataFrame, key: str, score: str, name: str) -> DataFrame:
    """The two best of each key by score, then name, and the gap between them; a missing second scores 0."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.col(name))
    two = df.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    at = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    return two.groupBy(key).agg(at(1, name).alias("top"), at(1, score).alias("top_score"), at(2, name).alias("runner_up"), F.coalesce(at(2, score), F.lit(0).cast(df.schema[score].dataType)).alias("runner_up_score")).withColumn("gap", F.col("top_score") - F.col("runner_up_score"))


def natural_order(c: Column) -> list[Column]:
    """R2 before R10: the text without digits, then its first number."""
    return [F.regexp_replace(c, r"\d+", ""), F.regexp_extract(c, r"(\d+)", 1).try_cast("long")]


def merge(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Insert or update by key: only what the delta gives overwrites."""
    rest = [c for c in base.columns if c != key]
    b, d = base.alias("b"), delta.alias("d")
    kept = [F.coalesce(F.col(f"d.{c}"), F.col(f"b.{c}")).alias(c) if c in delta.columns else F.col(f"b.{c}") for c in rest]
    return b.join(d, F.col(f"b.{key}") == F.col(f"d.{key}"), "full_outer").select(F.coalesce(f"d.{key}", f"b.{key}").alias(key), *kept)


def activate(df: DataFrame, ident: int, of_type: str, id_column: str = "id", type_column: str = "spec_type") -> DataFrame:
    """One active row of a type, in a single pass."""
    return df.withColumn("is_active", F.when(F.col(type_column) == of_type, F.col(id_column) == ident).otherwise(F.col("is_active")))


def with_new_ids(base: DataFrame, rows: DataFrame, order: Sequence[str], key: str = "id") -> DataFrame:
    """``rows`` numbered on from the greatest id in use, in a total order."""
    top = base.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return rows.crossJoin(F.broadcast(top)).withColumn(key, F.col("_top") + n).drop("_top")


def overlapping(regions: DataFrame) -> DataFrame:
    """Pairs of boxes on one page that overlap or touch; an equi-join on document and page."""
    a, b = regions.alias("a"), regions.alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.idx") < F.col("b.idx"))).filter(
        "NOT (a.x + a.w < b.x OR b.x + b.w < a.x OR a.y + a.h < b.y OR b.y + b.h < a.y)").select("a.doc_id", "a.page", F.col("a.idx").alias("first"), F.col("b.idx").alias("second"))


def bag_intersection(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many rows of each key match one to one: the smaller of the two counts."""
    n = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    return n(a, "expected").join(n(b, "actual"), list(key), "full_outer").select(
        *key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"), F.least(F.coalesce("expected", F.lit(0)), F.coalesce("actual", F.lit(0))).alias("matched"))


def run_deltas(metrics: DataFrame, lower_is_better: Sequence[str] = (), band: float = 0.01) -> DataFrame:
    """Change of each metric from run to run: delta, percent and direction."""
    w = Window.partitionBy("metric").orderBy("run")
    d = metrics.withColumn("previous", F.lag("value").over(w)).filter("previous IS NOT NULL").withColumn("delta", r6(F.col("value") - F.col("previous")))
    sign = F.when(F.col("metric").isin(*lower_is_better), -F.col("delta")).otherwise(F.col("delta")) if lower_is_better else F.col("delta")
    return d.withColumn("delta_percent", r6(F.when(F.col("previous") > 0, F.col("delta") / F.col("previous") * 100).otherwise(0.0))).withColumn(
        "trend", F.when(sign > band, "improving").when(sign < -band, "degrading").otherwise("stable"))


def consensus(votes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The value most votes agree on; of equals the one of the earliest vote, then the smallest. Confidence is the best of its votes plus 10 a further vote, at most 15, capped at 100."""
    g = votes.groupBy(*key, "value").agg(F.count("*").alias("n"), F.min("ordinal").alias("_o"), F.max("confidence").alias("_c"))
    best = g.groupBy(*key).agg(F.min_by(F.struct("value", "n", "_c"), F.struct((-F.col("n")).alias("_m"), "_o", F.col("value").alias("_v"))).alias("b"))
    return best.select(*key, "b.value", "b.n", F.least(F.lit(100.0), F.col("b._c") + F.least(10 * (F.col("b.n") - 1), F.lit(15))).alias("confidence"))


def stage_durations(runs: DataFrame) -> DataFrame:
    """Time between a run's states, in its order."""
    w = Window.partitionBy("run_id").orderBy("seq")
    return runs.withColumn("duration", F.col("at") - F.lag("at").over(w))


#: Allowed edges of the run state machine; the last two states are terminal.
EDGES: Mapping[str, Sequence[str]] = {
    "QUEUED": ("OCR", "FAILED"), "OCR": ("EXTRACT", "FAILED"), "EXTRACT": ("VALIDATE", "FAILED"), "VALIDATE": ("COMPLETE", "FAILED"), "COMPLETE": (), "FAILED": ("QUEUED",)}


def invalid_transitions(runs: DataFrame, edges: Mapping[str, Sequence[str]] = EDGES) -> DataFrame:
    """State changes that no edge allows; a run must begin queued."""
    w = Window.partitionBy("run_id").orderBy("seq")
    allowed = F.create_map(*[x for k, v in edges.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    p = runs.withColumn("previous", F.lag("state").over(w))
    return p.filter(F.when(F.col("previous").isNull(), F.col("state") != "QUEUED").otherwise(~F.coalesce(F.array_contains(F.element_at(allowed, F.col("previous")), F.col("state")), F.lit(False))))


def held(rows: DataFrame, holds: DataFrame, as_of: str) -> DataFrame:
    """Rows under a hold that isn't released by then."""
    live = holds.filter((F.col("placed_at") <= F.lit(as_of).cast("timestamp")) & (F.col("released_at").isNull() | (F.col("released_at") > F.lit(as_of).cast("timestamp"))))
    return rows.join(live.select("entity_id").distinct(), rows["id"] == F.col("entity_id"), "left_semi")


def eligible_for_retention(rows: DataFrame, holds: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows older than the policy's days and under no live hold."""
    old = rows.filter(F.col("created_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    return old.join(held(rows, holds, as_of).select("id"), "id", "left_anti")


def layered(specs: DataFrame, parents: DataFrame, most_depth: int = 32) -> DataFrame:
    """Specifications with what they inherit: of each property the value nearest to the leaf.

    ``parents(id, parent)``, ``specs(id, field, property, value)``. The chain is followed by a
    recursive query; a cycle runs into ``most_depth`` and raises.
    """
    spark = specs.sparkSession
    chain = spark.sql("""WITH RECURSIVE chain(leaf, id, depth) MAX RECURSION LEVEL """ + str(most_depth) + """ AS (
        SELECT id, id, 0 FROM {parents} UNION ALL
        SELECT c.leaf, p.parent, c.depth + 1 FROM chain c JOIN {parents} p ON c.id = p.id WHERE p.parent IS NOT NULL)
        SELECT leaf, id, depth FROM chain""", parents=parents)
    return chain.join(specs, "id").groupBy("leaf", "field", "property").agg(F.min_by("value", F.col("depth")).alias("value"))


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed or modified rows by key."""
    a, b = old.select(key, F.col(value).alias("_a"), F.lit(1).alias("_ia")), new.select(key, F.col(value).alias("_b"), F.lit(1).alias("_ib"))
    j = a.join(b, key, "full_outer")
    change = F.when(F.col("_ia").isNull(), "added").when(F.col("_ib").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return j.select(key, change.alias("change")).filter("change IS NOT NULL")
