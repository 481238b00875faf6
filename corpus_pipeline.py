"""A training-data pipeline over ``documents``: four stages, each one of the operators of ``sheetlens.llm``.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the
last return the columns of documents. Null ids, null and empty texts, repeated rows, empty
tables and extra columns are those of the operators: a text that is null or has no letter is
rejected as undetermined, copies of a row leave one of them, and rows without an id, which
near-duplicate classes can't name, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.llm import langid, minhash, packing, toxicity
from sheetlens.llm.text import holdout, read, saved


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with columns that an operator would replace under names not in use; ``_back`` undoes it."""
    return docs.withColumnsRenamed({c: _free(docs, f"_kept_{c}") for c in docs.columns if c.lower() in names})


def _back(judged: DataFrame, docs: DataFrame, *names: str) -> DataFrame:
    return judged.select(*(F.col(_free(docs, f"_kept_{c}")).alias(c) if c.lower() in names else F.col(c) for c in docs.columns))


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has; names are compared without case, as Spark does."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``und`` ones go."""
    model = langid.fit(docs, ~holdout())
    return _back(langid.identify(_aside(docs, "lang_pred", "score"), model).filter(F.col("lang_pred") != langid.UNDETERMINED), docs, "lang_pred", "score")


def toxic_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic at its threshold."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~holdout())
    return _back(toxicity.score(_aside(docs, "score", "predicted"), model).filter("predicted = 0"), docs, "score", "predicted")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of the smallest id.

    Rows are decided one by one, also where different texts share an id; of those with equal
    ids the smallest text stays. Only where ids do repeat are rows numbered first, in the
    order of (id, text), to tell them apart; that needs the documents sorted and written once.
    """
    row = _free(docs, "_row")
    named = docs.filter("doc_id IS NOT NULL")
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        gone = minhash.near_duplicates(named.select("doc_id", "text")).filter(~F.col("kept")).select(F.col("doc_id").alias(row))
        left = named.join(gone, F.col("doc_id") == F.col(row), "left_anti")
    else:
        rows = saved(named.sort("doc_id", "text").withColumn(row, F.monotonically_increasing_id()))
        gone = minhash.near_duplicates(rows.select(row, "text"), key=row).filter(~F.col("kept")).select(row)
        left = rows.join(gone, row, "left_anti").drop(row).dropDuplicates(["doc_id", "text"])
    return left.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as packed pieces."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("toxicity", toxic_text), ("near_dedup", near_dedup), ("packing", best_fit)]

#: The stages hold trained models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each cut from its predecessor's lineage."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
