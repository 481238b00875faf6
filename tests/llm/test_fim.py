import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetlens.llm import fim

SCHEMA = "doc_id long, text string"
ROWS = [
    *((i, f"Text {i} of é 中 😀 <P <S M> >\n\tend" * (i % 4 + 1)) for i in range(300)), *((400 + i, "<>"[i % 2] * (i % 7)) for i in range(100)),
    (501, None), (502, ""), (503, "has <P> inside"), (504, "<S>"), (505, "x<M>"), (None, "no id"), (506, "é" * 100_000), (600, "again"), (600, "again"), (-3, "negative"), (507, "\r\n \x00x"),
]


def brute(i, text, units):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


def test_equals_brute_force_and_restores(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(4).withColumns({"n": F.lit("clash"), "_units": F.lit(1), "output": F.lit(0)})
    for unit, cut in ((fim.CODE_POINTS, list), (fim.LINES, lambda t: re.findall("[^\n]*\n|[^\n]+", t))):
        made = fim.transform(docs, unit=unit)
        got = sorted(str((r.doc_id, r.n, r.form, r.prefix, r.middle, r.output)) for r in made.collect())
        assert got == sorted(str((i, *brute(i, t, cut(t or "")))) for i, t in ROWS)
        back = made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).select("doc_id", "back")
        assert sorted(map(str, ((r.doc_id, r.back) for r in back.collect()))) == sorted(map(str, ((i, t or "") for i, t in ROWS)))
        assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    digests = {r.doc_id: r for r in fim.digest(fim.transform(docs)).collect()}
    for i, t in ROWS:
        n, form, p, m, out = brute(i, t, list(t or ""))
        r = digests[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, None if p is None else len(p), None if m is None else len(m))
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="<>PSM ab\né😀", max_size=30), min_size=1, max_size=40))
def test_any_text_is_restored(spark, texts):
    made = fim.transform(spark.createDataFrame(list(enumerate(texts)), SCHEMA), rate=100, spm=50, unit=fim.WORDS)
    got = made.select("doc_id", fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert {r.doc_id: r.back for r in got} == dict(enumerate(texts))


def test_rates_empty_table_and_native_plan(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some text here").alias("text"))
    share = {r.form: r["count"] / 3000 for r in fim.transform(docs).groupBy("form").count().collect()}
    assert abs(share["plain"] - 0.1) < 0.02 and abs(share["spm"] - 0.18) < 0.03
    assert {r.form for r in fim.transform(docs, rate=0).collect()} == {"plain"} and {r.form for r in fim.transform(docs, rate=100, spm=100).collect()} == {"spm"}
    assert fim.digest(fim.transform(docs.filter("false"))).count() == 0
    plan = fim.digest(fim.transform(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
