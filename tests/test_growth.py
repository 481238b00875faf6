"""What makes a query's time grow: expressions evaluated more often than once, and work left to one task."""

from pyspark.sql import functions as F

from sheetlens.functions import scalars as S
from sheetlens.operators import sheets as T


def _plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_candidates_look_at_region_and_text_once(spark):
    docs = spark.createDataFrame([(1, "Job Reference: AB-12 asset: x9-77 31/12/2024 due 5.1.25 7 March 2023 WO AB-12", "job ref: ab-12"), (2, None, None)], "doc_id long, text string, region string")
    df = T.critical_candidates(docs)
    assert _plan(df).count(r"job\s+reference") == 2  # the region's and the text's
    assert sorted(tuple(r) for r in df.collect()) == [
        (1, "assetId", "X9-77", 0.7), (1, "date", "2023-03-07", 0.7), (1, "date", "2024-12-31", 0.7), (1, "date", "2025-01-05", 0.7), (1, "expiryDate", "2025-01-05", 0.7), (1, "jobReference", "AB-12", 0.9)]


def test_dates_cast_only_what_was_found(spark):
    said = ["2024-2-3", "3/2/24", "31.12.2023", " 15 January 2024 ", "5 mar 24", "13/13/2024", "2024-1-32", "soon", "", None]
    rows = spark.createDataFrame([(x,) for x in said], "t string").select(S.parse_date(F.col("t")).alias("p"), S.search_date(F.col("t")).alias("s")).collect()
    assert [r.p for r in rows] == ["2024-02-03", "2024-02-03", "2023-12-31", "2024-01-15", "2024-03-05", None, None, None, None, None]
    assert [r.s for r in rows] == ["2024-02-03", "2024-02-03", "31.12.2023", " 15 January 2024 ", "5 mar 24", "13/13/2024", "2032-01-24", "soon", "", None]
    assert spark.createDataFrame([("a-7",), ("",)], "t string").select(S.digits(F.col("t"), r"(\d+)", 1).alias("n")).collect() == [(7,), (None,)]


def test_trimming_is_that_of_the_pattern(spark):
    from sheetlens.operators.review import SPACE

    x = spark.createDataFrame([(" \t a b ﻿\n",), ("",), (" \r\n",), (None,), ("​z​",)], "t string")
    r = x.select(S.trimmed(F.col("t")).alias("a"), F.regexp_replace("t", f"^[{SPACE}]+|[{SPACE}]+$", "").alias("b"), S.trimmed(F.col("t"), True).alias("c"), F.regexp_replace("t", r"^\s+|\s+$", "").alias("d")).collect()
    assert [q.a for q in r] == [q.b for q in r] and [q.c for q in r] == [q.d for q in r]


def test_labels_are_ruled_out_without_losing_any(spark):
    from sheetlens.operators import ensemble as E

    names = ["job no", "jub no", "jb no", "job n", "jobno", "job nr", "work ordr", "wrk ordr", "w0", "wo", "refernce", "rfrnce", "abcdef", "job numbers", "jobb  number", "make", "mke", "xake", "mxxe", "technician nots", "tchnician ntes", "engineer", "enginer", "egnineer", "n"]
    labels = spark.createDataFrame([(x,) for x in names], "l string")
    for wanted in sorted({x.lower() for f in E.FIELDS for x in f.labels}):
        ratio = f"(1 - levenshtein(l, '{wanted}') / greatest(length(l), {len(wanted)})) * 100"
        assert {r.l: r.r for r in labels.selectExpr("l", f"CASE WHEN {ratio} >= 70D THEN {ratio} END AS r").collect()} == {x: E.alike(x, wanted) for x in names}


def test_each_different_label_is_compared_once(spark):
    from sheetlens.operators import ensemble as E

    fields = (E.LabelField("a", labels=("Job No", "Order")), E.LabelField("b", labels=("Make",)), E.LabelField("c"))
    rows = [(1, ["x", "jub no", "job no"]), (2, []), (3, ["make", "ordr", "mke"]), (4, ["order"] * 3)]
    df = spark.createDataFrame(rows, "id long, labels array<string>").coalesce(1)
    out = {r.id: [(x.place, x.ratio) for x in r.m] for r in df.select("id", E._labelled(F.col("labels"), fields).alias("m")).collect()}
    none = (None, None)
    assert out == {1: [(1, E.alike("jub no", "job no")), none, none], 2: [none] * 3, 3: [(1, 80.0), (0, 100.0), none], 4: [(0, 100.0), none, none]}


def test_voting_patterns_start_at_their_literal(spark):
    from sheetlens.operators import ensemble as E

    docs = spark.createDataFrame([(1, "x" * 30 + "\nASSET No: ab-1\nmake: ACME\nİ Date: 1.2.2024"), (2, "İasset id: cd-2\nK work order: 77")], "doc_id long, text string")
    df = E.extract_wide(docs, correct=False)
    assert "locate(asset" in _plan(df)
    r = {x.doc_id: x for x in df.collect()}
    assert (r[1].asset_no.value, r[1].make_model.value, r[1].date.value, r[2].asset_no.value, r[2].job_no.value) == ("AB-1", "ACME", "2024-02-01", "CD-2", "77")


def test_heads_are_those_of_every_match():
    assert T.heads("foo|bar") == [] and T.heads(r"(?:ab|cd)*ef") == [] and T.heads("fo{0,2}x") == [] and T.heads(r"(?:foo|bar)[:|]\s*(a|b)") == ["foo", "bar"] and T.heads(r"foo\|x") == ["foo"]


def test_specifications_are_dealt_out(spark, tmp_path):
    from sheetlens.plans import signals
    from sheetlens.sources.tables import Views

    spark.range(40).selectExpr("id AS p_partkey", "CAST(id % 9 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert signals.spec_texts(Views(spark, str(tmp_path))).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_depth_is_measured_once(spark, monkeypatch):
    from sheetlens.operators import nested as N

    calls = []
    df = spark.createDataFrame([(1, '{"a":[{"customerName":"Ann Lee"},{}],"b":[]}'), (2, "[["), (3, '"x"'), (4, None)], "id long, json string")
    first = type(df).first
    monkeypatch.setattr(type(df), "first", lambda self: calls.append(1) or first(self))
    assert sorted(tuple(r) for r in N.without_names(df, "json", ["id"]).collect()) == [(1, '{"a":[{"customerName":"A. L."},{}],"b":[]}'), (2, "[["), (3, '"x"')]
    assert len(calls) == 1


def test_personal_patterns_find_the_same_without_trying_again(spark):
    import random

    from sheetlens.functions.scalars import js_regex
    from sheetlens.operators import review as V

    rng = random.Random(7)
    parts = ["a", "b.c", "@", "@d.org", "x@y.co", " ", " ", "\n", "\t", "-", "_", "12", "12345", "12345-6789", "AB1", "a1", "2CD", "2cd", "E", "Acme", "Ab", "Pumps", "Ltd", "Co", "Company", "CUSTOMER_A", "Inc", "é", "ſ", "K", "%", ".", "7 Green ", "Mill\t", "Mc Rd", "st", "Lane"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 16))) for _ in range(9000)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    matches = lambda pattern: F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), 0)
    for name in ("usPostalCode", "ukPostalCode", "streetAddress", "realCompany"):
        pattern = V.PERSONAL[name]
        both = df.select(matches(js_regex(pattern)).alias("a"), matches(V._FASTER[pattern]).alias("b")).collect()
        assert [r.a for r in both] == [r.b for r in both] and sum(len(r.a) for r in both) > 10
    found = V.personal_data(df, {"email": V.PERSONAL["email"]}).select("doc_id", "match")
    want = df.select("doc_id", F.explode(matches(js_regex(V.PERSONAL["email"]))).alias("match")).filter(~F.col("match").rlike("(?i)^(CUSTOMER_|VENDOR_|SUPPLIER_|PARTNER_|TECH-|PART-|JS-)"))
    assert want.count() > 20 and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    import time

    long = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("a"), 300_000), F.lit("@ b@c.de")).alias("text"))
    began = time.time()
    assert [r.match for r in V.personal_data(long, {"email": V.PERSONAL["email"]}).collect()] == ["b@c.de"] and time.time() - began < 20


def test_words_are_found_without_cutting_the_text(spark):
    import random

    rng = random.Random(5)
    parts = ["job", "Job", "jobs", "re_job", "a", "a1", "é", "İ", "Kob", "ß", "😀", "_", "-", " ", "  ", "\n", "\t", "\x0b", " ", ".", "7", "Due", "due", "ſ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(3000)] + [None, "job", "jobjob job", "jobjob"]
    words = ["job", "Due", "a1", "_", "7", "é", "a b", "", "re_job", "kob"]
    by_class = F.filter(F.split(F.regexp_replace(F.lower("t"), r"[^a-z0-9_\s]", " "), r"\s+"), lambda w: w != "")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(S.tokens(F.col("t")).alias("a"), by_class.alias("b"), *(S.names_word(F.lower("t"), w).alias(f"w{i}") for i, w in enumerate(words))).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    for i, w in enumerate(words):
        assert [bool(r[f"w{i}"]) for r in rows] == [w.lower() in (r.b or []) for r in rows]
    assert sum(r.w0 or False for r in rows) > 100


def test_signals_are_asked_once_and_told_for_the_best(spark):
    from sheetlens.operators import documents as D
    from sheetlens.operators import signals as G

    a = G.Profile(D.Template("a", ("job",), ("sheet", "card"), ("seal",), r"\bJOB\b"), (G.Region("top", 1, ("jobNumber",)), G.Region("rest", 2)), (("date", "date", None), ("jobNumber", "string", None)), client="ACME")
    b = G.Profile(D.Template("b", ("job",), (), ("seal",), r"job \d+"), (G.Region("top", 1, ("jobNumber", "assetId")),), (("jobNumber", "required", None), ("x", "regex", "no")), form=None, sections=("Parts",))
    docs = spark.createDataFrame([(1, "Job 7 sheet: job no 7, seal", ["job no", "x" * 60], 3, None, ["PARTS"], "ACME"), (2, None, None, None, "printed", None, None), (3, "jobs", [], 2, "printed", [], "ACME")],
                                 "doc_id long, text string, pages array<string>, page_count int, form_type string, sections array<string>, client string")
    meta = {"client": F.col("client")}
    long, short = (G.select_by_signals(docs, (a, b), sections="sections", metadata=meta, explained=x) for x in (True, False))
    known = lambda r: (*r[:-1], [tuple(s)[:4] for s in r.signals])
    assert sorted(map(known, long.collect()), key=str) == sorted(map(known, short.collect()), key=str)
    one = next(r for r in long.collect() if r.doc_id == 1)
    by = {s.type: s for s in one.signals}
    assert (one.slug, one.top_score, by["token"].matched, by["token"].missing) == ("b", 100.0, ["job", r"REGEX:job \d+", "optional:seal"], []) and by["roi"].matched == ["roi:top (fields: jobNumber)"]
    from sheetlens.plans import signals

    asked = G._Tests("_text", "_low", "_pages")
    for p in signals.PROFILES:
        G.token_signal(asked, p.template)
    plain = _plan(G.select_by_signals(docs, signals.PROFILES))
    assert "regexp_replace" not in plain and "split(" not in plain and plain.count("examination(?<") == 1
    assert len(asked.answers) == len({w for p in signals.PROFILES for w in p.template.tokens()} | {"job"})  # a form's code that is one word


def test_sheets_are_made_without_running_their_join(spark, monkeypatch):
    from sheetlens.sources import tables

    dealt = []
    spread = tables.spread
    monkeypatch.setattr(tables, "spread", lambda df, key: dealt.append(_plan(df)) or spread(df, key))
    sheets = tables.Views(spark, "/root/testdata/sf0.001").sheets
    assert dealt and not any("Join" in p for p in dealt)
    assert sheets.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_patterns_find_the_same_without_their_optional_lead(spark):
    import random
    import re

    assert T.without_lead(r"(?:Work\s*)?(?:work)s (x)") == r"(?:Work\s*)?(?:work)s (x)" and T.without_lead(r"(?:\d*)?job (x)") == r"(?:\d*)?job (x)"
    patterns = {p: T.without_lead(p) for f in T.FIELDS for p in f.patterns if re.compile(p).groups and T.without_lead(p) != p}
    assert len(patterns) == 5
    rng = random.Random(3)
    parts = ["Asset ", "asset", "Mileage", "hours", "/", ": ", "12", "3.5", "Site ", "site", "Address", "Were ", "all ", "work", "works ", "fully ", "completed", "? ", "Yes", "no", "Is a ", "is the ", "return ", "visit ", "required", "safe to use", "\n", "İ", "K", "works completed: Yes", "return visit required: no", "asset safe to use? y"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for long, short in patterns.items():
        both = df.select(F.regexp_extract("t", "(?i)" + long, 1).alias("a"), F.regexp_extract("t", "(?i)" + short, 1).alias("b"), T.first_group(F.col("t"), [long], F.lower("t")).alias("c")).collect()
        assert [r.a for r in both] == [r.b for r in both] == [r.c or "" for r in both] and any(r.a for r in both)


def test_the_queue_makes_only_the_checks_it_needs(spark):
    docs = spark.createDataFrame([(1, "Job No: 7\nAsset No: A-1\nFault Reason: Broken\nMileage: 5"), (2, None)], "doc_id long, text string")
    df = T.review_queue(T.validate_wide(T.extract_wide(docs)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "^[A-Z0-9_-]+$" not in plan and "map(" not in plan
    assert sorted(tuple(r) for r in df.filter("doc_id = 1").collect()) == [(1, "fault_reason", 0.5, "Review and correct if necessary")]


def test_names_become_initials_without_a_shuffle(spark):
    import json
    import random

    from sheetlens.operators import nested as N

    rng = random.Random(11)
    words = ["Ann", "Lee", " ", "  ", "\t", '"', "\\", ",", '{"customerName":"', "é", "😀", "\n", ":", "İda", "\u2028", "/"]

    def said():
        return "".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind < 5:
            return [said(), rng.randrange(-5, 10**6), rng.random(), None, True][kind]
        return [value(depth - 1) for _ in range(rng.randrange(0, 4))] if kind == 5 else {k: value(depth - 1) for k in {rng.choice(["customerName", "engineerName", "a", 'x,"customerName', "b\\", said()]) for _ in range(rng.randrange(0, 5))}}

    texts = [json.dumps(value(4), ensure_ascii=rng.random() < 0.5) for _ in range(1500)] + [
        None, "", "[[", '"x"', '{"a":1,"a":2}', '{"customerName":""}', ' {"z" : 1.50, "customerName" : "Ann  Marie Lee"}', '{"customerName":7,"engineerName":null}', '["customerName","x"]']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, json string").repartition(4)
    both = [{r.id: r.json for r in how(df, "json", ["id"]).collect()} for how in (N.without_names, N.names_as_initials)]
    assert both[0] == both[1] and len(both[0]) == len(texts) - 1 and both[1][len(texts) - 3] == '{"customerName":"A. L.","z":1.5}'
    fast = N.names_as_initials(df.select("id", "json"), "json", ["id"])
    assert "Exchange" not in fast._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobinPartitioning", "") and "variant_explode" not in _plan(fast)
    assert sorted(map(tuple, N.names_as_initials(df.filter("id = 1507"), "json", ["id"], ["z"]).collect())) == sorted(map(tuple, N.without_names(df.filter("id = 1507"), "json", ["id"], ["z"]).collect()))


def test_outcomes_are_those_of_processing_without_reading_fields(spark):
    from sheetlens.operators import processing as P
    from sheetlens.plans import processing as Q
    from sheetlens.sources.tables import Views

    docs = Q.paged(Views(spark, "/root/testdata/sf0.001"))
    short = P.outcomes(docs, Q.TEMPLATES, Q.SETS)
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    assert "signature[" not in plan and "[detected]" not in plan
    want = P.processed(docs, Q.TEMPLATES, Q.SETS).select(*short.columns)
    assert sorted(map(str, short.collect())) == sorted(map(str, want.collect()))
    assert {tuple(r) for r in P.outcomes(docs, (), {}).select("status", "template", "score").collect()} == {("failed", None, None)}
