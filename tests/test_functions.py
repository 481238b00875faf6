import json

import pytest
from pyspark.sql import functions as F

from sheetlens.functions import scalars as S
from sheetlens.operators import comparison as C
from sheetlens.operators import documents as D
from sheetlens.operators import relational as R
from sheetlens.sources import files, tables
from sheetlens.streaming import folds


def one(spark, column, **values):
    types = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], types).select(column.alias("x")).first().x


@pytest.mark.parametrize("x,digits,want", [(0.285, 2, 0.28), (1.005, 2, 1.0), (-2.5, 0, -2.0), (2.5, 0, 3.0), (12.25, 1, 12.3)])
def test_round_half_up(spark, x, digits, want):
    assert one(spark, S.round_half_up(F.col("a"), digits), a=x) == want


def test_redaction_order(spark):
    text = "Mail a.b@c.org or ring 555-123-4567, IP 10.0.0.1, born 01/02/1990, Dr. Jane Doe é1234567"
    assert one(spark, S.redact(F.col("a")), a=text) == "Mail [EMAIL_REDACTED] or ring [PHONE_REDACTED], IP [IP_REDACTED], born [DOB_REDACTED], [NAME_REDACTED] é[PHONE_REDACTED]"


def test_text_scalars(spark):
    assert one(spark, S.correct_ocr(F.col("a")), a="Narne and Cornpleted, rn vv") == "Name and Completed, m w"
    assert one(spark, S.tokens(F.col("a")), a="Größe, A-b_1!") == ["gr", "e", "a", "b_1"]
    assert one(spark, S.rolling_hash(F.col("a")), a="jobNumber") == 987292006
    assert one(spark, S.rolling_hash(F.col("a")), a="phone") == 106642798
    assert one(spark, S.fuzzy_ratio(F.col("a"), F.lit("")), a="") == 0
    assert [one(spark, S.initials(F.col("a")), a=n) for n in ("Ada King Lovelace", "Ada", "")] == ["A. L.", "A.", ""]
    assert one(spark, S.safe_file_name(F.col("a")), a="x\\y/z report?.pdf") == "z_report_.pdf"
    assert [one(spark, S.normalise_date(F.col("a")), a=d) for d in ("3/4/2024", "2024-1-5", "soon")] == ["2024-04-03", "2024-01-05", "soon"]
    assert one(spark, S.file_type(F.unhex(F.col("a"))), a="89504E470D0A1A0A00") == "png"
    assert one(spark, S.file_type(F.unhex(F.col("a"))), a="524946460000000057454250") == "webp"
    assert [one(spark, S.confidence_band(F.col("a")), a=x) for x in (80.0, 79.9, 49.0)] == ["HIGH", "MEDIUM", "LOW"]


def test_periods(spark):
    got = [tuple(map(str, spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(S.period_bounds("2024-01-31", p))]).first())) for p in ("daily", "weekly", "monthly")]
    assert got == [("2024-01-31", "2024-01-31"), ("2024-01-28", "2024-02-03"), ("2024-01-01", "2024-01-31")]


def test_field_extraction(spark):
    text = "Job No: 12345\nCustomer Nane: ACME\nSerial\nSN-77\nEngineer = Bob\n"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    assert D.extract_with_patterns(docs, {"job": [r"Nope: (\d+)", r"Job No: (\d+)"]}).collect() == [(1, "job", "12345", 75)]
    fuzzy = D.extract_fuzzy(docs, ["Customer Name", "Job No"]).orderBy("label").collect()
    assert [(r.label, r.value) for r in fuzzy] == [("Customer Name", "ACME"), ("Job No", "12345")]
    assert [tuple(r)[1:] for r in D.extract_by_context(docs, "serial").collect()] == [("SN-77", 60)]
    assert [tuple(r)[1:] for r in D.extract_by_context(docs, "job no").collect()] == [("12345", 70)]
    assert [r.x for r in docs.orderBy("doc_id").select(D.extract_by_keyword(F.col("text"), ["Technician", "Engineer"]).alias("x")).collect()] == ["Bob", None, None]


def test_template_gate(spark):
    t = [D.Template("a", ("alpha", "beta"), (), ("gamma",)), D.Template("b", ("alpha",), ("delta",))]
    docs = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "alpha"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: (r.slug, r.top_score, r.band, r.selected) for r in D.select_template(docs, t).collect()}
    assert got == {1: ("a", 100.0, "HIGH", True), 2: ("a", 0.0, "LOW", False), 3: ("a", 0.0, "LOW", False)}


def test_merge_and_ids(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, n string, m string")
    delta = spark.createDataFrame([(2, "B"), (3, "C")], "id long, n string")
    assert sorted(map(tuple, R.merge(base, delta, "id").collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "C", None)]
    new = R.with_new_ids(base.select("id"), spark.createDataFrame([("q",), ("p",)], "n string"), ["n"])
    assert {r.n: r.id for r in new.collect()} == {"p": 3, "q": 4}


def test_layers_and_cycles(spark):
    parents = spark.createDataFrame([("base", None), ("client", "base"), ("type", "client")], "id string, parent string")
    specs = spark.createDataFrame([("base", "f", "label", "L0"), ("client", "f", "label", "L1"), ("base", "f", "type", "text")], "id string, field string, property string, value string")
    got = {(r.leaf, r.property): r.value for r in R.layered(specs, parents).collect()}
    assert got["type", "label"] == "L1" and got["type", "type"] == "text" and got["base", "label"] == "L0"
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string")
    with pytest.raises(Exception, match="(?i)recursi"):
        R.layered(specs, loop).collect()


def test_validators(spark):
    C.register_validator("even", lambda v, p: v.cast("int") % 2 == 0)
    rules = spark.createDataFrame([("R1", "n", "custom", None, None, None, "even", True, "major"), ("R2", "n", "range", None, 5.0, None, None, True, "minor")], "rule_id string, field string, type string, pattern string, min double, max double, validator string, enabled boolean, severity string")
    fields = spark.createDataFrame([(1, "n", "4"), (2, "n", "x7"[1:]), (3, "n", "abc"[:0])], "doc_id int, field string, value string").filter("doc_id < 3")
    got = {(r.doc_id, r.rule_id): r.status for r in C.validate_rules(rules, fields).collect()}
    assert got == {(1, "R1"): "passed", (1, "R2"): "failed", (2, "R1"): "failed", (2, "R2"): "passed"}


def test_sources_and_sinks(spark, tmp_path):
    golden = {"version": "1", "documents": [{"id": "d1", "name": "n", "expectedResult": "pass", "validatedFields": [{"ruleId": "R1", "field": "f", "status": "passed", "value": "v", "confidence": 0.9, "severity": "S0"}]}, {"id": "d2", "expectedResult": "fail", "validatedFields": []}]}
    (tmp_path / "g.json").write_text(json.dumps(golden, indent=1))
    assert [(r.doc_id, r.rule_id, r.is_critical) for r in files.golden_fields(spark, str(tmp_path / "g.json"), "pass").collect()] == [("d1", "R1", True)]
    (tmp_path / "b.json").write_text('{"accuracy": 0.8}')
    base = {r.metric: r.baseline for r in files.baseline_or_defaults(spark, str(tmp_path / "b.json"), {"accuracy": 0.95, "rate": 0.1}).collect()}
    assert base == {"accuracy": 0.8, "rate": 0.1}
    assert {r.baseline for r in files.baseline_or_defaults(spark, str(tmp_path / "none.json"), {"rate": 0.1}).collect()} == {0.1}
    field = [{"field": "f", "label": "F", "type": "text", "required": True}]
    pack = {"packVersion": "1", "templates": [{"metadata": {"templateId": t}, "version": v, "specJson": {"fields": f}} for t, v, f in (("new", "1.0.0", field), ("old", "1.0.0", field), ("bad", "x", field), ("empty", "1.0.0", []))]}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps(pack))
    (tmp_path / "p" / "b.json").write_text("{ broken")
    good, bad = files.import_pack(spark, str(tmp_path / "p"), spark.createDataFrame([("old",)], "slug string"))
    assert [r.slug for r in good.collect()] == ["new"] and {r.error for r in bad.collect()} == {"already known", "version", "no fields", "unreadable file"}
    (tmp_path / "t.txt").write_text("one\f\fthree")
    assert [(r.page_no, r.text) for r in files.read_texts(spark, str(tmp_path / "t.txt")).collect()] == [(1, "one"), (3, "three")]
    files.write_csv(spark.createDataFrame([('a "q"', 1)], "t string, n int").coalesce(1), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("part*")).read_text() == '"t","n"\n"a ""q""","1"\n'
    assert tables.load(spark, str(tmp_path), "waivers").count() == 0
    h = spark.createDataFrame([('{"b": 1, "a": {"d": 2, "c": 3}}',), ('{"a": {"c": 3, "d": 2}, "b": 1, "contentHash": "x"}',)], "j string").select(files.canonical_json_hash(F.col("j"), ("contentHash",)).alias("h")).distinct()
    assert h.count() == 1
    subs = spark.createDataFrame([(1, "u", True, ["done"]), (2, "u", False, ["done"]), (3, "u", True, ["other"])], "id int, url string, active boolean, events array<string>")
    assert [len(r.signature) for r in files.deliveries(subs, "done", "{}", "k").collect()] == [64]
    assert files.exposition(spark.createDataFrame([("n", 'a"b', 1.0)], "name string, label string, value double")).first().line == 'audit_n{label="a\\"b"} 1.0'


def test_folds(spark):
    reqs = spark.createDataFrame([("k", t) for t in (0, 1, 2, 10, 25, 26)], "key string, at_ms long")
    assert [r.allowed for r in folds.rate_limited(reqs, 10, 2).orderBy("at_ms").collect()] == [True, True, False, True, True, True]
    calls = spark.createDataFrame([("k", t, ok) for t, ok in ((0, False), (1, False), (2, True), (12, True), (13, True))], "key string, at_ms long, ok boolean")
    assert [r.state for r in folds.breaker_states(calls, 2, 10).orderBy("at_ms").collect()] == ["CLOSED", "CLOSED", "OPEN", "HALF_OPEN", "CLOSED"]
    acc = spark.createDataFrame([("c", t, k) for t, k in ((0, 1), (1, 2), (2, 1), (3, 3), (4, 2), (50, 2))], "cache string, at_ms long, key long")
    assert tuple(folds.cache_replay(acc, 40, 2).first()) == ("c", 1, 5, 2)
    runs = spark.createDataFrame([(1, "h", "DONE", 1, False), (2, "h", "DONE", 2, False), (3, "h", "FAILED", 0, False), (4, "h", "DONE", 3, True)], "run_id int, input_hash string, state string, at int, forced boolean")
    assert {r.run_id for r in folds.started_once(runs).collect()} == {1, 3, 4}


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "VALID"), (1, "2024-01-01 23:00:00", "INVALID"), (2, "2024-01-05 00:00:00", "VALID")], "engineer_id int, at string, outcome string").withColumn("audited_at", F.col("at").cast("timestamp")).drop("at")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    folds.run_available(folds.outcome_windows(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert [tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 2, 1)]
    keyed = stream.select(F.col("engineer_id").alias("key"), F.unix_millis("audited_at").alias("at_ms"))
    q = folds.rate_limited_stream(keyed, 86_400_000, 1).writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM limits").collect())) == [(1, 1, 1), (2, 1, 0)]


def test_signature_marks_equal_brute_force(spark):
    import re

    texts = [
        None, "", "Customer Signature: ____\nSigned: J. Smith\nAUTHORIZED BY\u00a0Ann Lee", "digital signature: abc\ne-sign esign E-SIGN", "signature\n\n  Bob Jones", "signed: -._-\nsigned: abc\nsigned: abcd",
        "Technician\tsignature\u2003: \u3000x.y.\u3000\n[STAMP] (official) Seal: ACME approved REJECTED certified received", "stamp: stamp stamp [stamp]" + " seal" * 9, "signature " * 50]
    labelled = [r"signature[:\s]*([^\n]{0,30})", r"signed[:\s]*([^\n]{0,30})", r"authorized\s*by[:\s]*([^\n]{0,30})"]
    kinds = [labelled + [r"customer\s*signature", r"technician\s*signature"], [r"digital\s*signature", "e-?sign"]]
    stamps = [["approved", "rejected"], ["certified"], ["received"], [r"stamp[:\s]*([^\n]{0,20})", r"\[stamp\]"], [r"seal[:\s]*([^\n]{0,20})", r"\(official\)"]]

    def want(t):
        n = lambda ps: sum(len(re.findall(p, t or "", re.I)) for p in ps)
        after = [m.strip() for p in labelled for m in re.findall(p, t or "", re.I)]
        return (n(kinds[0]), n(kinds[1]), sum(len(a) > 3 and not re.match(r"[_\-.]+\Z", a) for a in after), *map(n, stamps))

    from sheetlens.operators import review

    got = review.signature_marks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: want(t) for i, t in enumerate(texts)}
    assert sum(r.present for r in got) >= 4 and all(sum(r[k] for r in got) for k in range(1, 9))


def test_names_equal_the_pattern_by_hand(spark):
    import re

    from sheetlens.operators import review as V

    texts = ["see Mary Jones and Technician Signature", "Repair Report\nJob Number Bert Lee", "Sheet Mary Standard Anna", "CUSTOMER_A Missing Anna Bell", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.match) for r in V.personal_data(docs, {"realName": V.PERSONAL["realName"]}, V.ALLOWED).collect())
    want = [(i, m) for i, t in enumerate(texts) for m in re.findall(V.PERSONAL["realName"], t or "", re.ASCII) if not any(a in m for a in V.ALLOWED)]
    assert got == sorted(want) and (0, "Mary Jones") in got


def test_word_boundaries_are_those_of_ascii(spark):
    import re

    from sheetlens.functions import scalars as S

    patterns = [p for _, p, _ in S.REDACTIONS] + [r"\bab\b", r"\b\d{2,}\b|x", r"\b[a-c]+\b", r"a?\b", r"\b[-a]b\b"]
    texts = ["ab xab ab_ éab ab-ab 12 123x x12", "a@b.cd.e@f.gh é.foo@bar.com", "+44 20 7946 0958, (020) 7946-0958, 123-45-6789x", "Dr. Who Mr Smith", "-ab ab a-b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in patterns:
        got = [r[0] for r in df.select(F.regexp_replace("t", S.js_regex(p), "#")).collect()]
        assert got == [re.sub(p.replace("(?i)", ""), "#", t, flags=re.ASCII | (re.IGNORECASE if p.startswith("(?i)") else 0)) for t in texts], p
        hints = dict(S.REDACTION_HINTS)
    rules = [(n, p, tag) for n, p, tag in S.REDACTIONS]
    plain = [("x" + n, p, tag) for n, p, tag in rules]
    both = df.select(S.redact(F.col("t")), S.redact(F.col("t"), plain)).collect()
    assert hints and all(a == b for a, b in both)


def test_job_sheet_with_blocks_of_lines(spark):
    from sheetlens.operators import sheets as T

    text = """Job No: 123
Customer Name: Acme
Date: 5/3/24
Issue: pump leaks
since Monday
Location: yard
Asset safe to use: yes
Engineer Comments: ok
Parts Used: seal
ring 3
Fault Reason: electrical
Works fully completed: No
Return visit required: No
VOR Status: Yes
Technician Signature: X
Parts Required: gasket"""
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    wide = T.extract_wide(docs)
    rows = {r.doc_id: r for r in wide.collect()}
    one = rows[1]
    assert (one.job_no.value, one.customer_name.value, one.date.value) == ("123", "Acme", "2024-03-05")
    assert one.issue_description.value == "pump leaks\nsince Monday" and one.parts_used.value == "seal\nring 3"
    assert one.asset_no.value == "safe" and one.make_model.error == "required" and one.technician_signature.value is None
    assert one.fault_reason.value == "Electrical" and abs(one.fault_reason.confidence - 1.0) < 0.011 and one.safe_to_use.value == "true"
    assert all(rows[k].job_no.level == "UNREADABLE" and rows[k].job_no.error == "required" for k in (2, 3))
    gold = {r.doc_id: r for r in T.gold_standard(T.validate_wide(wide)).collect()}
    assert not gold[1].is_valid and gold[1].rules_passed == 1 and gold[2].rules_passed == 5
    found = {(r.field, r.reason) for r in T.build_findings(T.validate_wide(wide)).filter("doc_id = 1").collect()}
    assert {("engineer_comments", "INVALID_FORMAT"), ("make_model", "MISSING_FIELD"), ("vor_safety_consistency", "BUSINESS_RULE_VIOLATION")} <= found
    status = {r.doc_id: r.status for r in T.document_status(T.long_form(wide)).collect()}
    assert status == {1: "FAIL", 2: "FAIL", 3: "FAIL"}


def test_folds_over_sorted_partitions(spark):
    from sheetlens.streaming import folds

    rows = [("a", i, 1000 * (i // 2)) for i in range(40)] + [("b", 100, 5), ("c", 200, 0), ("c", 201, 0)]
    df = spark.createDataFrame(rows, "key string, id long, at_ms long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.id: (r.allowed, r.remaining) for r in folds.rate_limited(df, 3000, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    assert [got[i][0] for i in range(12)] == [True] * 4 + [False] * 2 + [True] * 4 + [False] * 2
    assert got[100] == got[200] == (True, 3) and got[201] == (True, 2)


def test_evaluation_helpers(spark):
    from sheetlens.operators import evaluation as E
    from sheetlens.operators.sheets import name_patterns

    rules = spark.createDataFrame([("r1", True, ["a", "b"]), ("r2", False, ["b"]), ("r3", True, None)], "id string, enabled boolean, tags array<string>")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(E.rules_with(rules)) == ["r1", "r2", "r3"] and ids(E.rules_with(rules, ["b"])) == ["r1", "r2"] and ids(E.rules_with(rules, ["b", "x"], True)) == ["r1"]
    templates = spark.createDataFrame([(1, "x"), (2, "y")], "template_id long, name string")
    metrics = spark.createDataFrame([(1, 5, 0.2, 0.5, 0.6)], "template_id long, total_audits long, ambiguity_rate double, valid_rate double, avg_confidence double")
    got = {r.template_id: tuple(r)[2:] for r in E.with_template_metrics(templates, metrics).collect()}
    assert got == {1: (5, 0.2, 0.5, 0.6), 2: (0, 0.0, 1.0, 1.0)}
    docs = spark.createDataFrame([(7, [("R1", "S0"), ("R2", "S2")])], "doc_id long, fields array<struct<rule_id:string,severity:string>>")
    assert [(r.rule_id, r.is_critical) for r in E.golden_documents(docs).collect()] == [("R1", True), ("R2", False)]
    d = spark.createDataFrame([(1, [str(i) for i in range(30)], 99)], "doc_id long, tokens array<string>, document_length int")
    t = E.selection_traces(d, spark.createDataFrame([(1, "slug")], "doc_id long, slug string")).first()
    assert t.token_count == 30 and t.token_sample == [str(i) for i in range(20)] and t.slug == "slug"
    names = spark.createDataFrame([("serialNumber",), ("otherField",)], "n string").select(name_patterns(F.col("n")).alias("p")).collect()
    assert names[0].p == ["serialNumber", "serial Number", "serialNumber", "serial", "serial no", "s/n", "sn"] and names[1].p == ["otherField", "other Field", "otherField"]


def test_gates_end_with_one_where_rows_break_them(spark, tmp_path, capsys):
    from sheetlens import cli

    sf = "/root/testdata/sf0.001"
    assert cli.main(["gate", "parity", sf, str(tmp_path / "v"), "--format", "json"]) == 1
    assert {r.violation for r in spark.read.json(str(tmp_path / "v")).collect()} >= {"worse fields"}
    from sheetlens.plans.catalogue import QUERIES

    want = int(QUERIES["drift_alerts"](spark, sf).filter("severity = 'critical'").count() > 0)
    assert cli.main(["gate", "drift", sf]) == want
    assert cli.main(["run", "registry_counts", sf]) == 0 and cli.main(["list"]) == 0
    assert cli.broken(spark.range(3), "id > 5").isEmpty() and all(n in QUERIES for n, _ in cli.GATES.values())
    capsys.readouterr()


def test_exports_hide_personal_data_by_default(spark, tmp_path):
    df = spark.createDataFrame([("R1", 'say "hi" to a@b.org', None), ("R2", "call 020-555-1234", "x")], "rule_id string, message string, value string")
    files.export_csv(df, str(tmp_path / "a"), {"rule_id": "Rule ID", "message": "Message", "value": "Value"}, ["message"])
    raw = "".join(p.read_text() for p in sorted((tmp_path / "a").glob("part-*")))
    assert '"Rule ID","Message","Value"' in raw and '"R1","say ""hi"" to [REDACTED]",""' in raw and '"call [REDACTED]"' in raw
    files.export_csv(df, str(tmp_path / "b"), {"message": "Message"}, ["message"], redact=False)
    assert "a@b.org" in "".join(p.read_text() for p in (tmp_path / "b").glob("part-*"))
    audits = spark.createDataFrame([(1, "ok")], "id long, result string")
    f = spark.createDataFrame([(1, 2, "to a@b.org"), (1, 1, "z")], "id long, n int, message string")
    got = files.bundle(audits, f, f, "id", ["message"]).first()
    assert [(x.n, x.message) for x in got.fields] == [(1, "z"), (2, "to [REDACTED]")] == [(x.n, x.message) for x in got.findings]


def test_reports_are_kept_by_run(spark, tmp_path):
    for run, n in (("2024-01-01", 1), ("2024-01-02", 2)):
        files.save_report(spark.createDataFrame([(n, 0.5)], "documents long, rate double"), str(tmp_path), run)
    kind = "documents LONG, rate DOUBLE"
    assert files.latest_report(spark, str(tmp_path), kind).first().documents == 2
    assert files.latest_report(spark, str(tmp_path), kind, before="2024-01-02").first().documents == 1
    said = files.markdown(spark.createDataFrame([(2, 0.5)], "documents_same long, rate double"), "Parity")
    assert said.startswith("# Parity") and "| documents same | 2 |" in said


def test_patterns_that_start_at_their_literal_find_the_same(spark):
    import random

    from sheetlens.operators import sheets as T

    assert T.heads(r"(?:Were\s*)?(?:all\s*)?works?\s*x") == ["work"] and T.heads("(?:Make|Manufacturer)[:]") == ["make", "manufacturer"] and T.heads(r"S/N[:\s]*(x)") == ["s/n"] and T.heads(r"\d+") == []
    rng = random.Random(3)
    words = ["Asset", "No:", "AS-1", "asset", "Hours", "12.5", "Mileage", "Job", "77", "Make", "/", "Model", "x", "İ", "all works", "completed:", "Yes", "Return visit required?", "no", "S/N", "q9", "\n", "Date:", "1/2/24", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, t string").withColumn("low", F.expr("CASE WHEN length(lower(t)) = length(t) THEN lower(t) END"))
    pairs = [F.struct(T.first_group(F.col("t"), f.patterns).alias("a"), T.first_group(F.col("t"), f.patterns, F.col("low")).alias("b")).alias(f.id) for f in T.FIELDS]
    for r in df.select(*pairs).collect():
        assert all(x.a == x.b for x in r)
