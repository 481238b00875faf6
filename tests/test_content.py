"""JSON by path, marks, signals, analysis and specifications against plain Python, with nulls and repeated ids."""

import json
import random
import re

from pyspark.sql import functions as F

from sheetlens.operators import analyzer as A
from sheetlens.operators import comparison as C
from sheetlens.operators import documents as D
from sheetlens.operators import marks as M
from sheetlens.operators import nested as N
from sheetlens.operators import review as V
from sheetlens.operators import sheets as T
from sheetlens.operators import signals as G
from sheetlens.operators import specs as P
from sheetlens.operators.templates import booster


def plain_leaves(x, path="root"):
    if isinstance(x, dict) and x:
        return [y for k in sorted(x) for y in plain_leaves(x[k], f"{path}.{k}")]
    if isinstance(x, list) and x:
        return [y for i, v in enumerate(x) for y in plain_leaves(v, f"{path}[{i}]")]
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(x), "number")
    return [(path, kind, {"string": x, "boolean": str(x).lower(), "number": str(x)}.get(kind))]


def made(rng, depth=0):
    kind = rng.randrange(8 if depth < 5 else 5)
    if kind < 5:
        return (None, True, rng.randrange(1000), "".join(rng.choices('ab"\\{[]}: é😀\n', k=rng.randrange(6))), "Ann Bo Lee")[kind]
    return [made(rng, depth + 1) for _ in range(rng.randrange(4))] if kind == 5 else {rng.choice(("a", "b c", "engineerName", "customerName", 'q"')): made(rng, depth + 1) for _ in range(rng.randrange(4))}


def without_names(x, name=None):
    if isinstance(x, dict):
        return {k: without_names(v, k) for k, v in x.items()}
    if isinstance(x, list):
        return [without_names(v) for v in x]
    if isinstance(x, str) and name in N.NAMES and x:
        parts = x.split()
        return "" if not parts else f"{parts[0][0]}. {parts[-1][0]}." if len(parts) > 1 else f"{parts[0][0]}."
    return x


def test_json_of_any_depth(spark):
    rng = random.Random(4)
    values = [made(rng) for _ in range(120)] + [[[[[[[["deep"]]]]]]], "text", {}, [], {"long": "x{[" * 30_000}]
    rows = [(i % 90, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)] + [(1000, None), (1001, "{broken"), (1002, "")]
    df = spark.createDataFrame(rows, "id long, j string").repartition(3)
    got = sorted(str((r.id, r.path, r.type, r.value)) for r in N.leaves(df, "j", ["id"]).collect())
    want = [(i % 90, *leaf) for i, v in enumerate(values) for leaf in plain_leaves(v)] + [(1001, "root", "malformed", "{broken"), (1002, "root", "malformed", "")]
    assert got == sorted(map(str, want))
    back = N.without_names(df.filter("id < 1000"), "j", ["id"]).collect()
    dump = lambda v: json.dumps(v, sort_keys=True)
    assert sorted((r.id, dump(json.loads(r.j))) for r in back) == sorted((i % 90, dump(without_names(v))) for i, v in enumerate(values))
    assert N.leaves(df.filter("false"), "j", ["id"]).count() == 0


def test_postal_codes_of_dates_are_none(spark):
    df = spark.createDataFrame([(1, "2024-12345 and 54321"), (1, "on 2024-0112345"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.match) for r in V.personal_data(df, {"usPostalCode": V.PERSONAL["usPostalCode"]}).collect())
    assert got == [(1, "54321")]


def test_emails_inside_runs_equal_a_plain_search(spark):
    texts = ["a@b.comx@y.org", "a@b.com_x@y.org", "..@..", "x" * 3000 + "@", "no", "u%1@a-b.co.uk,v@w.de", "@@a@b.cc@d.ee"]
    got = V.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), {"email": V.PERSONAL["email"]}).collect()
    assert sorted((r.doc_id, r.match) for r in got) == sorted((i, m) for i, t in enumerate(texts) for m in re.findall(V.PERSONAL["email"], t))


_JS = "\t\n\x0b\f\r \xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


def plain_marks(text, kind):
    every, x, w, h, conf = M.KINDS[kind]
    units, out = (lambda s: len(s.encode("utf-16-le")) // 2), []
    for place, m in enumerate(every):
        pattern = re.sub(r"\\x\{([0-9A-F]+)\}", lambda c: re.escape(chr(int(c[1], 16))), m.pattern)
        for i, hit in enumerate(re.finditer(pattern, text)):
            at = units(text[: hit.start()])
            y = min(95, int(at / units(text) * 100 + 0.5))
            after = hit[1].strip(_JS) if m.group else ""
            present = m.type == "checked" if kind == "checkbox" else len(after) > 3 and not re.match(r"[_\-.]+\Z", after) if kind == "signature" else None
            label = (after or None) if kind == "checkbox" else hit[0].split(":")[0].strip(_JS) if kind == "signature" and re.match("[^:]+:", hit[0]) else None
            out.append((y, place, i, at, text[: hit.start()].count("\n") + 1, m.type, present, conf["medium"] + (0.1 if kind == "signature" and present else 0), label, hit[0]))
    return [(kind, n + 1, *r[3:5], r[0], *r[5:]) for n, r in enumerate(sorted(out, key=lambda r: r[:3]))]


def test_marks_equal_a_plain_search(spark):
    rng = random.Random(2)
    bits = ["[x] a label\n", "[ ]", "☑", "( )\u2003two ", "(✓)", "[Y] ", "[n]", "Signature: ____", "signed:\u00a0Ann Lee", "e-sign", "Customer  Signature", "APPROVED", "stamp: x😀", "[STAMP]", "seal", "(official)", "😀", "word ", "\n", "\r\n", "authorized by Bo B."]
    texts = [None, "", "😀[x]", "x" * 5000 + "[ ]", "[x] " * 700] + ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(60)]
    rows = [(i % 50, t) for i, t in enumerate(texts)]
    got = sorted(str((r.doc_id, r.kind, r.n, r["at"], r.line, r.y, r.type, r.present, round(r.confidence, 9), r.label, r.match)) for r in M.marks(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = sorted(str((i, *m[:7], round(m[7], 9), *m[8:])) for i, t in rows for k in M.KINDS for m in plain_marks(t or "", k))
    assert got == want and any("'checkbox', 300" in x for x in want) is False
    assert {r.confidence for r in M.marks(spark.createDataFrame([(1, "[x] a")], "doc_id long, text string"), sensitivity="high").collect()} == {0.7}


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        got = spark.range(1).select(M.running_sums(F.array(*[F.lit(k).cast("bigint") for k in range(n)]) if n else F.array().cast("array<bigint>"), block=64).alias("s")).first().s
        assert got == [k * (k - 1) // 2 for k in range(n)]


def test_signals_explain_themselves(spark):
    form = G.Profile(D.Template("form", ("job",), ("sheet", "card"), ("seal",), r"\bjob\b"), (G.Region("top", 1, ("jobNumber",)), G.Region("rest", 2)), (("date", "date", None), ("partsUsed", "string", None), ("x", "regex", r"no:\s*\d+"), ("y", "other", None)))
    other = G.Profile(D.Template("other", ("nothing",)), form=None)
    rows = [
        (1, "job sheet no: 7 on 1/2/2024, materials: seal", ["job no 7", "x" * 51], 2, "printed"), (2, "job", None, None, None), (3, None, None, 99, "handwritten"), (1, "job sheet", ["a", "b"], 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pages array<string>, page_count int, form_type string")
    got = G.select_by_signals(df, [other, form]).collect()
    one = next(r for r in got if r.doc_id == 1 and r.top_score > 80)
    by = {s.type: s for s in one.signals}
    assert by["token"].score == 100 and by["token"].matched == ["job", "sheet", r"REGEX:\bjob\b", "optional:seal"] and by["layout"].score == 80 and by["roi"].score == 100 and by["plausibility"].score == 75
    assert by["roi"].matched == ["roi:top (fields: jobNumber)", "roi:rest (fields: content present)"] and by["plausibility"].missing == ["field:y"]
    assert one.top_score == int((100 * 0.4 + 80 * 0.2 + 100 * 0.25 + 75 * 0.15) + 0.5) and one.selected and one.block_reason is None
    two = next(r for r in got if r.doc_id == 2)
    assert [s.type for s in two.signals] == ["token", "roi", "plausibility"] and not two.selected and two.block_reason.startswith("LOW_CONFIDENCE_BLOCK: Top candidate")
    three = next(r for r in got if r.doc_id == 3)
    assert three.slug == "other" and three.block_reason == f'LOW_CONFIDENCE_BLOCK: Top candidate "other" scored {three.top_score:.0f}. Low signals: [token:0, layout:30]'
    assert len([r for r in got if r.doc_id == 1]) == 2 and G.select_by_signals(df.filter("false"), [form]).count() == 0
    boosted = G.select_by_signals(df, [other, form], metadata={"client": F.lit("ACME")}).collect()
    assert [r.top_score for r in boosted] == [r.top_score for r in got]


def test_selection_with_boosts_and_the_catch_all(spark):
    docs = spark.createDataFrame([(1, "job", "ACME"), (2, "job", None), (3, None, "ACME")], "doc_id long, text string, client string")
    ts = (D.Template("a", ("job",), (), ("x",) * 5), D.Template("b", ("job",), (), ("x",) * 5))
    got = {r.doc_id: r for r in D.select_template(docs, ts, carry=("client",), boost=booster({"b": {"client": "ACME"}}, {"client": F.col("client")})).collect()}
    assert (got[1].slug, got[1].top_score, got[1].gap, got[1].selected) == ("b", 60, 10, True) and (got[2].slug, got[2].selected, got[2].block_reason) == ("a", False, "MEDIUM confidence with ambiguous gap (0 < 10)")
    assert got[3].block_reason == "LOW confidence (10 < 50)"
    lone = D.select_template(docs, (D.Template("standard-maintenance-v1", ("none",)),)).collect()
    assert all(r.selected and r.block_reason is None for r in lone)


def test_analysis_and_fixture_reasons(spark):
    text = "Customer Signature: J. Smith\nTime In= 09:00   \nTechnician present\nJob Number\r\n\r\nJOB-1 and more words here to be long enough for it all, date too"
    got = {r.doc_id: r for r in A.analyse(spark.createDataFrame([(1, text), (2, None), (3, "customer"), (4, text.upper())], "doc_id long, text string")).collect()}
    said = {f.field: f.value for f in got[1].fields}
    assert said["Customer Signature"] == "J. Smith" and said["Time In"] == "09:00" and said["Technician Name"] == "[detected]" and said["Job Number"] == "JOB-1 and more words here to be long enough for it"
    assert [(f.severity, f.reason) for f in got[2].findings][0] == ("S1", "OCR_FAILURE") and got[2].result == "FAIL" and got[2].score == 0 and got[3].detected == 2
    assert got[1].result == got[4].result == "PASS" and [f.field for f in got[1].findings] == sorted(f.field for f in got[1].findings) and len(got[4].fields) == len(got[1].fields)
    spec = {"s": (A.SpecField("jobReference", "Job No", True, True), A.SpecField("partsUsed", "Parts"), A.SpecField("notes", "Notes", False))}
    cases = [(1, "s", "job parts", "pass", None, True), (1, "s", "parts", "fail", ["MISSING_FIELD"], True), (2, "s", "job", "review_queue", ["MISSING_FIELD", "CONFLICT"], True), (3, "s", None, "fail", [], False), (4, "other", "x", "pass", None, False), (5, "s", "job", "pass", None, False)]
    out = A.expected_outcomes(spark.createDataFrame(cases, "case_id long, spec string, input_text string, expected_outcome string, expected_reason_codes array<string>, required boolean"), spec)
    rows = out.collect()
    assert [(r.case_id, r.outcome, r.passed) for r in rows] == [(1, "pass", True), (1, "fail", True), (2, "review_queue", False), (3, "fail", True), (4, None, False), (5, "review_queue", False)]
    assert rows[2].errors == ["Missing expected reason codes: CONFLICT"] and rows[3].reason_codes == ["MISSING_FIELD"] * 2 and rows[5].errors == ["Expected outcome 'pass' but got 'review_queue'"]
    total = {r.spec: r for r in A.matrix_report(out).collect()}
    assert (total["s"].result, total["s"].total, total["s"].failed, total["s"].required_failed, total["other"].result) == ("FAIL", 5, 2, 1, "PASS")


def test_specs_with_each_fault(spark):
    rule = {"id": "R-001", "field": "f", "type": "presence", "required": True, "description": "d"}
    good = {"name": "n", "version": "1.2.3", "rules": [rule]}
    cases = {
        "good": (good, []), "array": ([], ["$ type"]), "null": (None, ["$ type"]), "number": (7, ["$ type"]), "empty": ({}, ["$.name required", "$.rules required", "$.version required"]),
        "names": ({**good, "name": "", "version": 1}, ["$.name empty", "$.version type"]), "long": ({**good, "name": "x" * 201, "version": "1.2"}, ["$.name too_long", "$.version semver"]),
        "dates": ({**good, "effectiveDate": "soon", "expiryDate": ""}, ["$.effectiveDate invalid_date"]), "rules": ({**good, "rules": {}}, ["$.rules type"]), "none": ({**good, "rules": []}, ["$.rules empty"]),
        "twice": ({**good, "rules": [rule, 5, rule, {**rule, "id": "x"}]}, ["$.rules[1] type", "$.rules[2].id duplicate", "$.rules[3].id rule_id_form"]),
        "parts": ({**good, "rules": [{"id": 4, "type": "odd", "severity": "S9"}]}, [f"$.rules[0].{n} required" for n in ("description", "field", "required")] + ["$.rules[0].id type", "$.rules[0].severity severity", "$.rules[0].type rule_type"]),
        "kinds": ({**good, "rules": [{**rule, "id": f"R-{i:03}", **more} for i, more in enumerate(({"type": "regex"}, {"type": "regex", "pattern": "(a"}, {"type": "regex", "pattern": r"^[(\]]\(x{2}$"}, {"type": "range"}, {"type": "range", "maxValue": 1}, {"type": "enum"}))]},
                  ["$.rules[0].pattern required", "$.rules[1].pattern pattern", "$.rules[3] range", "$.rules[5].allowedValues required"])}
    rows = [(k, json.dumps(v)) for k, (v, _) in cases.items()] + [("broken", "{"), ("missing", None), ("good", json.dumps(good))]
    got = P.faults(spark.createDataFrame(rows, "k string, s string"), "k", spec="s").collect()
    for k, (_, want) in cases.items():
        assert sorted(f"{r.path} {r.code}" for r in got if r.k == k) == sorted(want), k
    assert [(r.path, r.code) for r in got if r.k == "broken"] == [("$", "malformed")] and {r.level for r in got if r.code == "rule_id_form"} == {"warning"}
    patterns = {r"a+b*?c": False, "a)": True, "[a": True, "*a": True, "a**": True, "(?:a|b)?": False, "(|+)": True, "end\\": True, r"\(": False, "": False, "(?=x)y": False, "x{2,}{3}": True}
    faults = spark.createDataFrame([(p,) for p in patterns], "p string").select("p", P.pattern_fault(F.col("p")).alias("x")).collect()
    assert {r.p: r.x for r in faults} == patterns


def test_regions_with_each_fault(spark):
    box = lambda x=0.1, y=0.1, w=0.2, h=0.2: {"x": x, "y": y, "width": w, "height": h}
    region = lambda name="header", page=1, bounds=None: {"name": name, "page": page, "bounds": bounds or box()}
    cases = {
        "good": ({"regions": [region(), region("date", 2)]}, []), "none": ({}, ["type"]), "empty": ({"regions": []}, []), "name": ({"regions": [region(" ")]}, ["required", "unusual_region"]), "page": ({"regions": [region(page=0), region("date", "1")]}, ["page", "page"]),
        "outside": ({"regions": [region(bounds=box(-1, 2, 0, "x"))]}, ["bounds"] * 4 + ["beyond_page"] * 0), "beyond": ({"regions": [region(bounds=box(0.9, 0.9))]}, ["beyond_page"] * 2), "overlap": ({"regions": [region(), region("date")]}, ["overlap"]),
        "twice": ({"regions": [region(), region(page=2), region(page=3)]}, ["duplicate"]), "unboxed": ({"regions": [{"name": "date", "page": 1}]}, ["required"])}
    got = P.faults(spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in cases.items()], "k string, r string"), "k", regions="r").collect()
    for k, (_, want) in cases.items():
        assert sorted(r.code for r in got if r.k == k) == sorted(want), (k, [r.asDict() for r in got if r.k == k])


def test_audits_and_parity_keep_repeated_rows_apart(spark):
    sheet = "SERVICE REPORT\nJob No: 12\nDate: 1/2/2024\nEngineer Name: Eng 1\n"
    docs = spark.createDataFrame([(1, sheet), (1, sheet + "x"), (2, None), (3, "")], "doc_id long, text string")
    got = T.audit(docs, waived=F.col("doc_id") == 2).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3] and {r.doc_id: r.status for r in got}[2] == "WAIVED" and {r.kind for r in got if r.doc_id == 1} == {"SERVICE_REPORT"}
    schema = "doc_id string, rule_id string, field string, status string, value string, confidence double, severity string, reason_code string"
    row = lambda d, r, s="passed", c=0.5, why=None: (d, r, f"f{r}", s, "v", c, "S0", why)
    golden = spark.createDataFrame([row("a", "1"), row("a", "2"), row("b", "1"), row("c", "1")], schema)
    actual = spark.createDataFrame([row("a", "1", c=0.6), row("a", "3"), row("c", "1", "failed"), row("d", "1")], schema)
    fields = C.compare_fields(golden, actual)
    assert sorted((r.doc_id, r.rule_id, r.verdict) for r in fields.collect()) == [("a", "1", "improved"), ("a", "2", "missing"), ("a", "3", "new"), ("b", "1", "missing"), ("c", "1", "worse")]
    assert {r.doc_id: r.status for r in C.compare_documents(fields).collect()} == {"a": "worse", "b": "missing", "c": "worse"}
    wanted = spark.createDataFrame([("a", "1", "f1", "CONFLICT"), ("a", "1", "f1", "CONFLICT"), ("a", "2", None, "CONFLICT"), ("b", "9", "f9", "OUT_OF_POLICY")], "doc_id string, rule_id string, field string, reason_code string")
    found = spark.createDataFrame([row("a", "1", "failed", why="CONFLICT"), ("a", "2", None, "failed", "v", 0.5, "S0", "CONFLICT"), row("b", "9", "failed", why="RANGE_ERROR"), row("z", "1", "failed")], schema)
    assert sorted(str((r.doc_id, r.rule_id, r.kind)) for r in C.compare_failures(wanted, found).collect()) == sorted(map(str, [("a", "1", "matched"), ("a", "1", "matched"), ("a", "2", "missed"), ("a", "2", "unexpected"), ("b", "9", "matched"), ("z", "1", "unexpected")]))


def test_small_scalars_without_queries(spark):
    assert [r.x for r in spark.createDataFrame([(v,) for v in ("Yes", " y ", "0", "maybe", None)], "v string").select(V.yes_no(F.col("v")).alias("x")).collect()] == ["Yes", "Yes", "No", "maybe", None]


def test_small_files_are_dealt_out(spark):
    from sheetlens.sources.tables import spread

    one = spark.range(1000).coalesce(1)
    dealt = spread(one, "id")
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and sorted(r.id for r in dealt.collect()) == list(range(1000))
    many = spark.range(0, 1000, 1, 64)
    assert spread(many, "id") is many


def test_summary_of_reconciled_fields(spark):
    rows = [("a", "improved", 0.9), ("b", "unchanged", 0.2), ("c", "failed", 0.3), ("d", "kept", 0.4)]
    got = C.reconciliation_summary(spark.createDataFrame(rows, "field string, outcome string, confidence double"), F.lit(0.35)).first()
    assert (got.fields, got.improved, got.unchanged, got.failed, got.average_confidence, got.low_confidence) == (4, 1, 1, 2, 0.45, 2)
    empty = C.reconciliation_summary(spark.createDataFrame([], "field string, outcome string, confidence double"), F.lit(0.5)).first()
    assert empty.fields == 0 and empty.average_confidence == 0
