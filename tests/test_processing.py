"""Voting strategies and stored processing against plain Python, with nulls, repeated rows, replays and crashes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sheetlens.operators import ensemble as E
from sheetlens.operators import processing as P
from sheetlens.operators.analyzer import Rule
from sheetlens.operators.documents import Template
from sheetlens.streaming.stored import AuditStore, process_stream


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        nxt = [i + 1]
        for j, y in enumerate(b):
            nxt.append(min(row[j + 1] + 1, nxt[j] + 1, row[j] + (x != y)))
        row = nxt
    return row[-1]


def plain_usual(value, how):
    if how == "date":
        for p, order in ((r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})", (3, 2, 1)), (r"(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})", (1, 2, 3))):
            m = re.search(p, value)
            if m:
                return "-".join(m[k].rjust(w, "0") for k, w in zip(order, (4, 2, 2)))
        return value
    if how == "boolean":
        return "Yes" if value.upper() in E.YES else "No" if value.upper() in E.NO else value
    if how == "name":
        return " ".join(w.upper() if w.upper() in E.ACRONYMS else w[:1].upper() + w[1:].lower() for w in re.split(r"\s+", value))
    return value.upper() if how == "uppercase" else value


def plain_field(text, f):
    found = []
    shown = any(s in text for s in f.shown)
    for p in f.patterns:
        m = re.search(p, text, re.I | re.A)
        value = (m[1].strip() if m and m.re.groups and m[1] else "") or ("Present" if m and shown else "")
        if value:
            found.append((value, 85 if len(p) > 50 else 75, "regex"))
            break
    else:
        if shown:
            found.append(("Present", 70, "regex"))
    lines = text.split("\n")

    def fuzzy():
        for line in lines:
            if ":" in line:
                label, value = (x.strip() for x in line.split(":")[:2])
                for wanted in f.labels:
                    score = (1 - distance(label.lower(), wanted.lower()) / max(len(label), len(wanted))) * 100 if label else 0
                    if score >= 70 and value:
                        return value, min(score, 80), "fuzzy"

    def context():
        for i, line in enumerate(lines):
            for wanted in f.labels:
                if wanted.lower() in line.lower():
                    if ":" in line:
                        value = line.split(":")[1].strip()
                        if value:
                            return value, 70, "context"
                    elif i + 1 < len(lines) and lines[i + 1].strip() and ":" not in lines[i + 1]:
                        return lines[i + 1].strip(), 60, "context"

    found += [x for x in (fuzzy(), context()) if x]
    found = [(plain_usual(v, f.normaliser), c, s) for v, c, s in found]
    if not found:
        return None, 0, "none", 0
    values = [v for v, _, _ in found]
    best = max(values, key=values.count)
    n, sure = values.count(best), max(c for v, c, _ in found if v == best)
    return best, min(100, sure + min(10 * (n - 1), 15)), f"ensemble({n} agree)" if n > 1 else next(s for v, _, s in found if v == best), n


def test_votes_equal_a_plain_reading(spark):
    rng = random.Random(7)
    labels = [x for f in E.FIELDS for x in f.labels] + ["Jub No", "Custommer", "Enginer", "Aset Numbr", "", "Nothing", "Print name"]
    values = ["AS-12", "12345", "acme uk ltd", "1/2/2024", "2024-3-4", "13.12.2023 late", "Yes", "n", "maybe", "", "ann lee", "x:y:z", "  padded\t", "3rd Jan 2024", "fixed\nthe seal\nand more", "😀 ok"]
    texts = []
    for _ in range(400):
        lines = [rng.choice(labels) + rng.choice((": ", ":", "\n", " ", " : ")) + rng.choice(values) for _ in range(rng.randrange(9))]
        texts.append("\n".join(lines))
    texts += [None, "", "\n:\n", "Technician Signature", "Date: " + "1" * 20_000]
    rows = [(i % 300, i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, n long, text string, _x string").repartition(5)
    got = {(r.n, r.field): (r.value, round(r.confidence, 6), r.strategy, r.agreeing) for r in E.long_form(E.extract_wide(df, key="n", correct=False), key="n").collect()}
    want = {(i, f.name): (lambda v: (v[0], round(v[1], 6), v[2], v[3]))(plain_field(t or "", f)) for i, t in enumerate(texts) for f in E.FIELDS}
    assert {k: (got[k], want[k]) for k in want if got.get(k) != want[k]} == {}
    assert len(E.extract_wide(df).filter("doc_id = 5").collect()) == 2  # repeated ids stay rows of their own
    docs = {r.n: r for r in E.document_results(E.extract_wide(df, key="n"), key="n").collect()}
    assert docs[len(texts) - 5].status == "FAIL" and docs[len(texts) - 5].found == 0 and docs[len(texts) - 5].confidence == 0
    assert E.extract_wide(df.filter("false")).count() == 0


def test_a_field_may_have_only_patterns_or_only_labels(spark):
    fields = (E.LabelField("a", (r"A=(\w+)",), (), False), E.LabelField("b", (), ("Bee",), False))
    r = E.extract_wide(spark.createDataFrame([(1, "A=x\nBees: y")], "doc_id long, text string"), fields).first()
    assert (r.a.value, r.a.confidence, r.a.strategy) == ("x", 75, "regex") and (r.b.value, r.b.strategy, r.b.agreeing) == ("y", "ensemble(2 agree)", 2)
    out = E.document_results(E.extract_wide(spark.createDataFrame([(1, "")], "doc_id long, text string"), fields), fields).first()
    assert out.status == "REVIEW_QUEUE" and out.quality == 70.0  # nothing is required


TEMPLATES = (Template("repair", ("job", "serial"), (), ("parts",)), Template("lift", ("lifting",), (), ("chain",)))
RULES = {"repair": (Rule("R-1", "Job No"), Rule("R-2", "Parts used"))}
GOOD = "Job No: 17\nSerial: S1\nparts fitted\n" + "all is well with this unit " * 4
PAGES = "array<struct<page:int,text:string>>"


def frame(spark, rows):
    return spark.createDataFrame(rows, f"doc_id long, pages {PAGES}, received_at long")


def test_modes_of_processing(spark):
    rows = [(1, [(1, GOOD), (2, None)], 0), (2, [(1, "Serial No: AB-123\nsigned: Ann")], 0), (3, [], 0), (4, None, 0), (5, [(1, None)], 0), (1, [(1, GOOD), (2, None)], 1), (6, [(1, "")], 0), (None, [(1, GOOD)], 0)]
    got = {(r.doc_id, r.received_at): r for r in P.processed(frame(spark, rows), TEMPLATES, RULES, carry=("received_at",)).collect()}
    assert len(got) == 8
    a = got[1, 0]
    assert (a.status, a.mode, a.result, a.template) == ("completed", "FULL", "pass", "repair") and a.run_id == got[1, 1].run_id != got[None, 0].run_id
    assert [(f.field, f.value, f.page) for f in a.fields] == [("Job No", "17", 1), ("Parts used", "[detected]", 1)] and a.findings == []
    b = got[2, 0]
    assert (b.status, b.mode, b.result, b.template, b.review_reason) == ("review_queue", "HYBRID", "review_queue", None, "TEMPLATE_NOT_MATCHED")
    assert {f.field for f in b.findings} >= {"assetIdentifier", "signature"} and all(f.severity == "S3" and f.reason == "VALID" and f.snippet for f in b.findings)
    for k in (3, 4, 5):
        assert (got[k, 0].status, got[k, 0].result, got[k, 0].error) == ("failed", None, "No readable page")
    assert got[4, 0].page_count == 0 and got[5, 0].page_count == 1 and got[6, 0].status == "review_queue"
    none = P.processed(frame(spark, rows[:2]), (), {}).collect()
    assert {(r.status, r.error) for r in none} == {("failed", "No templates")}
    assert P.processed(frame(spark, []), TEMPLATES, RULES).count() == 0


def test_pages_are_gathered_in_order(spark):
    pages = spark.createDataFrame([(1, 2, "b", 5), (1, 1, "a", 7), (2, 1, None, 1)], "doc_id long, page long, text string, received_at long")
    got = {r.doc_id: r for r in P.gathered(pages, carry=("received_at",)).collect()}
    assert [(p.page, p.text) for p in got[1].pages] == [(1, "a"), (2, "b")] and got[1].received_at == 7 and got[2].pages[0].text is None
    assert spark.range(1).select(P.whole_text(F.lit(None).cast(PAGES)).alias("t")).first().t is None


def stored(store):
    return ({r.doc_id: (r.status, r.template, r.error) for r in store.sheets.read().collect()}, sorted((r.doc_id, r.result) for r in store.results.read().collect()), store.findings.read().count())


def test_stored_over_restarts_and_crashes(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path / "store"), buckets=2)
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    schema = f"doc_id long, pages {PAGES}, received_at long"
    for rows in ([(1, [(1, GOOD)], 1), (2, [(1, "nothing known")], 1), (3, None, 1)], [(3, [(1, GOOD)], 2), (1, [(1, GOOD)], 2), (4, [(1, GOOD)], 2)]):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(source)
        process_stream(spark.readStream.schema(schema).parquet(source), store, TEMPLATES, RULES, checkpoint).awaitTermination()
    sheets, results, findings = stored(store)
    assert sheets == {1: ("completed", "repair", None), 2: ("review_queue", None, None), 3: ("completed", "repair", None), 4: ("completed", "repair", None)}
    assert results == [(1, "pass"), (2, "review_queue"), (3, "pass"), (4, "pass")]
    # A batch that dies between tables, then comes again.
    rows = P.processed(frame(spark, [(4, None, 9), (5, [(1, "Serial No: AB-123")], 9)]), TEMPLATES, RULES, carry=("received_at",))

    def die(table):
        if table == "audit_results":
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.write(rows, 7, between=die)
    assert 5 not in stored(store)[0] and stored(store)[0][4][0] == "completed"
    for _ in range(2):
        store.write(rows, 7)
    sheets, results, more = stored(store)
    assert sheets[4] == ("failed", None, "No readable page") and sheets[5] == ("review_queue", None, None) and len(results) == 5 and more > findings
    assert more == store.findings.read().select("finding_id").distinct().count()


def test_fields_by_keyword(spark):
    from sheetlens.operators import keywords as K

    fields = (K.KeywordField("n", "Job (no)", "number", ("W.O.",)), K.KeywordField("d", "Date", "date"), K.KeywordField("c", "Cost", "currency", ("Sum",), ("Total",)), K.KeywordField("b", "Signed", "boolean", page_hint=2), K.KeywordField("s", "Who"))
    rows = [
        (1, [(1, "job (NO): 1,234\nDate\n: 2024-01-15\nSum = x\nTotal $1,250.50\nsigned: no"), (2, "Signed: signed")]), (2, [(1, "on March 3, 2024 w.o.17a"), (2, "cost $5 signed by Bo")]), (3, [(1, None), (2, "Who:   \n")]),
        (4, None), (5, []), (6, [(1, "date 2/31/2024\nwho Ann")]), (6, [(1, "WHO:Ann\\E")])]
    got = sorted((r.doc_id, r.field, r.value, r.normalised, round(r.confidence, 2), r.level, r.page, r.method) for r in K.keyword_fields(spark.createDataFrame(rows, f"doc_id long, pages {PAGES}"), fields).collect())
    assert got == sorted([
        (1, "n", "1234.0", True, 0.85, "high", 1, "keyword"), (1, "d", "2024-01-15", True, 0.95, "high", 1, "keyword"), (1, "c", "= x", False, 0.7, "medium", 1, "keyword"), (1, "b", "true", True, 1.0, "high", 2, "keyword"),
        (2, "d", "2024-03-03", True, 0.6, "medium", 1, "pattern"), (2, "n", "17.0", True, 0.7, "medium", 1, "keyword"), (2, "c", "5.0", True, 0.6, "medium", 2, "pattern"), (2, "b", "by Bo", False, 0.7, "medium", 2, "keyword"),
        (3, "s", "", False, 0.0, "none", 2, "keyword"), (6, "d", "2/31/2024", False, 0.95, "high", 1, "keyword"), (6, "s", "Ann", False, 0.7, "medium", 1, "keyword"), (6, "s", "Ann\\E", False, 0.7, "medium", 1, "keyword")])
    assert {r.field for r in K.keyword_fields(spark.createDataFrame(rows[:1], f"doc_id long, pages {PAGES}"), fields, least=0.9).collect()} == {"d", "b"}


def test_cache_of_bounded_bytes(spark):
    from sheetlens.streaming import folds

    rows = [("c", 0, 1, 6), ("c", 1, 2, 6), ("c", 2, 3, 1), ("c", 3, 2, 9), ("c", 4, 4, None), ("c", 5, 5, 100), ("c", 6, 6, 1), ("c", 99, 6, 2), ("d", 0, 1, 0)]
    df = spark.createDataFrame(rows, "cache string, at_ms long, key long, size long")
    got = {r.cache: tuple(r)[1:] for r in folds.cache_replay(df, 50, 10, 10).collect()}
    # 3 evicts 1 (12 bytes held), 2 is a hit, 6 evicts 2, 3, 4 and 5; at 99 its entry is too old.
    assert got["c"] == (1, 7, 4 + 1, 1, 2, 1 / 8) and got["d"] == (0, 1, 0, 1, 0, 0.0)


def test_dead_letters_by_code_age_and_attempts(spark):
    from sheetlens.streaming import folds

    rows = [(1, "boom", "ETIMEDOUT", "OCR", 7, "2024-01-10", 1, 1), (2, "Timeout", None, "OCR", 8, "2024-01-10", 3, 3), (3, "bad", None, "SAVE", 7, "2024-01-10", 1, 3), (4, "HTTP 503", None, "SAVE", 7, "2024-01-01", 2, 3), (5, None, None, None, None, None, None, None)]
    f = spark.createDataFrame(rows, "id long, message string, code string, stage string, job_sheet_id long, at string, attempts int, max_attempts int").withColumn("created_at", F.to_timestamp("at"))
    letters = folds.dead_letters(f)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(folds.letters_of(letters, recoverable=True)) == [1, 4] and ids(folds.letters_of(letters, "OCR")) == [1, 2] and ids(folds.letters_of(letters, job=7, recoverable=False)) == [3]
    assert ids(folds.not_too_old(letters, "2024-01-11")) == [1, 2, 3, 5] and ids(folds.dead_letters(f, 2)) == [1, 2]


def test_priorities_of_packs(spark):
    from sheetlens.operators.audits import prioritised_packs

    rows = [("a", "S0", "X")] * 6 + [("b", "S1", "X")] * 3 + [("b", "S3", "Y")] * 4 + [("c", "S1", "X"), ("c", None, "X"), ("d", None, None)]
    got = {r.t: r for r in prioritised_packs(spark.createDataFrame(rows, "t string, severity string, issue_type string"), "t").collect()}
    assert {k: (r.total_issues, r.critical, r.priority, r.estimated_impact) for k, r in got.items()} == {"a": (6, 6, "critical", 3.0), "b": (7, 3, "high", 3.5), "c": (1, 1, "medium", 0.5)}
    assert got["b"].severities == {"S1": 3, "S3": 4} and got["b"].reasons == {"X": 3, "Y": 4}
