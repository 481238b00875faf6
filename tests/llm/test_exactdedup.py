import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from sheetlens.llm import exactdedup
from sheetlens.llm.skew import join_classes

SCHEMA = "doc_id long, text string"
ROWS = [
    (1, "Same Text"), (9, "same text"), (5, "SAME TEXT"), (2, "same text "), (3, None), (4, ""), (6, "ÉCOLE a"), (7, "École A"), (8, "école a"),
    (None, "nameless"), (None, "Nameless"), (10, "named"), (None, "NAMED"), (11, "twice"), (11, "twice"), (12, "Twice"), (13, "x " * 200_000), (14, "X " * 200_000),
    *((100 + i, ("Hot", "hot", "HOT")[i % 3]) for i in range(600)), (20, "İ"), (21, "i̇"), (22, "K"), (23, "K"), (24, "k"),
]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[lowered(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(map(str, out))


def test_equals_brute_force_also_where_digests_collide(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5).withColumns({"kept": F.lit(1), "_id": F.lit("clash"), "_size": F.lit(2)})
    for digest in (exactdedup.sha256, lambda t: F.substring(exactdedup.sha256(t), 1, 0), lambda t: F.unhex(F.hex(F.length(t) % 3))):
        got = exactdedup.exact_duplicates(docs, digest=digest, salts=3)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted(str(tuple(r)) for r in got.collect()) == brute(ROWS)


def test_one_row_of_each_text_stays(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({"kept": F.col("doc_id") * 2, "_digest": F.lit("mine")})
    for digest in (exactdedup.sha256, lambda t: F.unhex(F.hex(F.length(t) % 2))):
        left = exactdedup.drop_duplicates(docs, digest=digest)
        assert left.columns == docs.columns
        rows = left.collect()
        assert len(rows) == len({lowered(t) for _, t in ROWS}) == len({lowered(r.text) for r in rows})
        assert {r.doc_id for r in rows} == {k for k in (eval(x)[1] for x in brute(ROWS))}
        assert all(r.kept == (r.doc_id * 2 if r.doc_id is not None else None) and r._digest == "mine" for r in rows)


def test_empty_table_and_native_plan(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert exactdedup.exact_duplicates(docs.filter("false")).count() == 0
    assert exactdedup.drop_duplicates(docs.filter("false")).count() == 0
    plan = exactdedup.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_are_combined_in_a_task_then_by_salt_then_by_digest(spark):
    docs = spark.range(900).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 != 0, "Hot").otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    texts = exactdedup._texts(docs, "doc_id", "text", exactdedup.sha256, 4)
    assert {(r._text, r._size, r._keep) for r in texts.filter("_size > 1").collect()} == {("hot", 600, 899)} and texts.count() == 301
    plan = texts._jdf.queryExecution().toString()
    assert "hashpartitioning(_salt" in plan and "hashpartitioning(_digest" in plan


def test_classes_join_rows_of_hot_and_rare_keys(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 700).alias("k"))
    classes = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).filter("k <> 5").checkpoint()
    got = {(r.id, r.k): (r.n, r.m) for r in join_classes(rows, classes, ["k"], "n", ["id"], parts=10).collect()}
    by = {r.k: (r.n, r.m) for r in classes.collect()}
    assert len(got) == 3000 and all(v == by.get(k, (None, None)) for (_, k), v in got.items())
