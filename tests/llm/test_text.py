import time

import pyarrow as pa
from pyspark.sql import functions as F

from sheetlens.llm import packing
from sheetlens.llm.text import in_parts, saved


def _shuffled(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return {f for f in files.split() if "/shuffle_" in f}


def test_saved_leaves_no_shuffle_files(spark):
    before = _shuffled(spark)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "count")
    kept = saved(df)
    for _ in range(50):
        if not _shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffled(spark) - before
    assert kept.count() == df.count() == len(saved(df).collect()) == len(df.collect()) == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_parts_hold_few_texts_and_all_rows():
    texts = ["a" * n for n in (3, 4, 0, 20, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["id", "text"])
    parts = list(in_parts(iter([batch, batch.slice(0, 0)]), 1, 8))
    assert [p["id"].to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5]]


def test_library_gets_few_chunks_in_a_call(monkeypatch):
    few, usual = packing.ChunkEncoder("word_bpe_49k.json", at_once=3), packing.ChunkEncoder("word_bpe_49k.json")
    sizes = []
    for kind in ("_ids", "_words"):
        monkeypatch.setattr(few, kind, lambda x, f=getattr(few, kind): (sizes.append(len(x)), f(x))[1])
    texts = ["one two three four five six seven 8 9 10 11 12 Ünder?", None, "x\x1cy", "seven, eight"]
    assert few.encode(texts) == usual.encode(texts)
    assert max(sizes) == 3 and sum(sizes) > 12
