"""The training-data queries that have SQL, against it; and held-out accuracy of those that learn."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracle import rows

from sheetlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, SF)
    rel = duck.execute(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in rel.description], rel.fetchall())


def test_held_out_language_and_toxicity(spark):
    sf = "/root/testdata/sf0.1"  # smaller tables hold too few toxic documents to learn from
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op10_language_id"](spark, sf).join(lang, "doc_id").filter("held_out AND lang IS NOT NULL")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    toxic = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = {r.toxic: r for r in QUERIES["op1_toxicity"](spark, sf).join(toxic, "doc_id").filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p"), F.avg("score").alias("s")).collect()}
    assert got[1].p > 0.85 and got[0].p < 0.04 and got[1].s > 0.85 and got[0].s < 0.1
