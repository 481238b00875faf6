"""Joining rows to the classes of their keys where one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, spread: list[str], parts: int = 1024) -> DataFrame:
    """``rows`` left-joined to ``classes``, of which there is one for a key at most.

    ``size`` is how many rows a class has. Sizes add up to a total, so at most ``parts``
    classes have that share of it or more; these are broadcast, which bounds the broadcast
    whatever the data. All other keys are joined by a shuffle in which none has more than that
    share; the rows already served are dealt out there by a hash of ``spread``. Keys aren't null.
    ``classes`` is read three times: pass a saved one.
    """
    total = classes.agg(F.sum(size)).first()[0] or 0
    values = F.struct(*(F.col(c) for c in classes.columns if c not in keys))
    often = F.col(size) * parts >= F.lit(total)
    hot = classes.filter(often).select(*keys, values.alias("_hot"))
    cold = classes.filter(~often).select(*keys, F.lit(0).alias("_deal"), values.alias("_cold"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_deal", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.lit(8191)).cast("int") + 1))
    got = F.coalesce("_hot", "_cold")
    return dealt.join(cold, [*keys, "_deal"], "left").select(
        *rows.columns, *(got[c].alias(c) for c in classes.columns if c not in keys))
