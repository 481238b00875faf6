"""Exact duplicates by skew-safe combining, in DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z. Every row goes by a digest of
its text, and every stage compares the texts themselves beside it: a task first combines the
equal texts it reads, tasks that share a salt combine theirs, and the winners of the salts are
combined by digest alone. A text that a third of all rows have thus reaches the last stage as
one row for each salt. Texts that differ and yet share a digest are told apart by the texts.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import join_classes
from .text import saved


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; empty for null."""
    c = F.coalesce(text.cast("string"), F.lit(""))
    # Only of ASCII does lower() change no other letters; it is several times faster there.
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _texts(docs: DataFrame, key: str, text: str, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    """(_digest, _text, _size, _keep): every distinct normalised text, combined in three stages."""
    rows = docs.select(F.col(key).alias("_id"), normalised(F.col(text)).alias("_text")).select(
        "_id", "_text", digest(F.col("_text")).alias("_digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"))
    salted = rows.groupBy("_salt", "_digest", "_text").agg(F.count("*").alias("_n"), F.max("_id").alias("_top"))
    return salted.repartition("_digest").groupBy("_digest", "_text").agg(F.sum("_n").alias("_size"), F.max("_top").alias("_keep"))


def _classified(docs: DataFrame, key: str, text: str, digest: Callable[[Column], Column], salts: int, *more: Column) -> DataFrame:
    """(_id, _sha, _digest, _size, _keep, more): the rows of ``docs``; size and winner are null where a text has no copy."""
    texts = _texts(docs, key, text, digest, salts)
    classes = saved(texts.groupBy("_digest").agg(F.count("*").alias("_variants"), F.max("_size").alias("_size"), F.max("_keep").alias("_keep"))
                    .filter("_variants > 1 OR _size > 1"))
    norm = normalised(F.col(text))
    rows = docs.select(F.col(key).alias("_id"), norm.alias("_text"), *more)
    rows = rows.withColumns({"_sha": sha256(F.col("_text")), "_digest": digest(F.col("_text"))})
    shared = classes.filter("_variants > 1").select("_digest")
    if shared.isEmpty():
        return join_classes(rows.drop("_text"), classes.drop("_variants"), ["_digest"], "_size", ["_id", "_sha"])
    # Only the texts of a digest that several texts share stand beside it as a key.
    told = saved(texts.join(shared, "_digest").filter("_size > 1").select("_digest", F.concat(F.lit("="), "_text").alias("_tell"), "_size", "_keep"))
    alone = classes.filter("_variants = 1").select("_digest", F.lit("").alias("_tell"), "_size", "_keep")
    rows = rows.join(shared.withColumn("_shared", F.lit(True)), "_digest", "left").withColumn(
        "_tell", F.when(F.col("_shared"), F.concat(F.lit("="), "_text")).otherwise("")).drop("_text", "_shared")
    return join_classes(rows, saved(alone.unionByName(told)), ["_digest", "_tell"], "_size", ["_id", "_sha"]).drop("_tell")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = 64) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept and text_sha256 (of the normalised text).

    Of equal texts the row of the largest key stays. A null text is an empty one; a null key is
    smaller than all others, and stays only among nulls. Rows repeated whole are one document,
    which stays or goes: they share every value. An empty table gives no row. Columns of ``docs``
    other than key and text aren't read, whatever their names.
    """
    rows = _classified(docs, key, text, digest, salts)
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return rows.select(
        F.col("_id").alias(key), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat key and text one stays."""
    rows = _classified(docs, key, text, digest, salts, F.struct(*docs.columns).alias("_row"))
    alone = rows.filter("_size IS NULL")
    copies = rows.filter(F.col("_size").isNotNull() & F.col("_id").eqNullSafe(F.col("_keep"))).dropDuplicates(["_sha"])
    return alone.unionByName(copies).select("_row.*")
