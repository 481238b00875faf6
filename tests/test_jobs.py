"""Jobs over a user's own files, and their exit codes."""

import json

import pytest

from sheetlens import cli


def field(rule, status="passed", severity="S0", confidence=0.9, reason=None):
    return {"ruleId": rule, "field": f"f{rule}", "status": status, "value": "v", "confidence": confidence, "severity": severity, "reasonCode": reason}


def document(ident, expected, fields, failures=None, findings=None):
    return {"id": ident, "name": ident, "expectedResult": expected, "validatedFields": fields, "expectedFailures": failures, "findings": findings}


def written(path, value):
    path.write_text(json.dumps(value))
    return str(path)


@pytest.fixture
def golden(tmp_path):
    failure = {"ruleId": "R1", "field": "fR1", "reasonCode": "MISSING_FIELD", "severity": "S0"}
    return [document("good", "pass", [field("R1"), field("R2")], findings=[{"id": "F1", "ruleId": "R1", "field": "fR1", "severity": "S2", "reasonCode": "CONFLICT"}]), document("bad", "fail", [field("R1", "failed", reason="MISSING_FIELD")], [failure])]


def rows(spark, path):
    return [r.asDict() for r in spark.read.json(str(path)).collect()]


def test_parity_of_own_json(spark, tmp_path, golden):
    g = written(tmp_path / "g.json", {"version": "1", "documents": golden})
    assert cli.main(["parity", g, g, "--out", str(tmp_path / "same")]) == 0
    assert sorted((r["suite"], r["doc_id"], r["rule_id"], r["result"]) for r in rows(spark, tmp_path / "same")) == [("negative", "bad", "R1", "matched"), ("positive", "good", "R1", "same"), ("positive", "good", "R2", "same")]
    worse = written(tmp_path / "w.json", {"documents": [document("good", "pass", [field("R1", "failed"), field("R3")]), golden[1]]})
    assert cli.main(["parity", g, worse, "--mode", "positive", "--out", str(tmp_path / "worse")]) == 1
    assert {(r["rule_id"], r["result"]) for r in rows(spark, tmp_path / "worse")} == {("R1", "worse"), ("R2", "missing"), ("R3", "new")}
    assert cli.main(["parity", g, worse, "--mode", "negative"]) == 0
    missed = written(tmp_path / "m.json", {"documents": [document("bad", "fail", [field("R1", "failed", reason="OUT_OF_RANGE"), field("R2", "failed")])]})
    assert cli.main(["parity", g, missed, "--mode", "negative", "--out", str(tmp_path / "missed")]) == 1
    assert sorted(r["result"] for r in rows(spark, tmp_path / "missed")) == ["missed", "unexpected"]


def test_golden_parts_are_read(spark, tmp_path, golden):
    from sheetlens.sources import files

    g = written(tmp_path / "g.json", {"documents": golden})
    assert [(r.doc_id, r.rule_id, r.reason_code, r.severity) for r in files.golden_failures(spark, g).collect()] == [("bad", "R1", "MISSING_FIELD", "S0")]
    assert [(r.doc_id, r.finding_id, r.field) for r in files.golden_findings(spark, g).collect()] == [("good", "F1", "fR1")]


def report(rate, by, docs, version="1.0.0"):
    return {"passRate": rate, "passedFields": 1, "datasetVersion": version, "thresholdVersion": "2", "bySeverity": by, "docResults": [{"id": i, "name": i, "status": "pass", "passRate": r} for i, r in docs]}


def test_baseline_of_own_json(spark, tmp_path):
    stored = {"version": "1", "sourceReport": {"datasetVersion": "1.0.0", "thresholdVersion": "2"}, "metrics": report(90.0, {"S0": {"passed": 9, "total": 10}, "S1": {"passed": 1, "total": 2}}, []), "docResults": [{"id": i, "status": "pass", "passRate": r} for i, r in (("a", 90.0), ("b", 80.0), ("c", 50.0))]}
    b = written(tmp_path / "b.json", stored)
    limits = written(tmp_path / "t.json", {"thresholds": {"overall": {"minPassRate": 0.8, "maxWorseCount": 1}, "bySeverity": {"S0": {"minPassRate": 0.9}}}})
    fine = written(tmp_path / "r.json", report(91.0, {"S0": {"passed": 9, "total": 10}}, [("a", 95.0), ("b", 80.05), ("d", 1.0)], "1.1.0"))
    assert cli.main(["baseline", b, fine, limits, "--out", str(tmp_path / "fine")]) == 0
    got = rows(spark, tmp_path / "fine")
    assert {(r["name"], r["status"]) for r in got if r["part"] == "document"} == {("a", "improved"), ("b", "same"), ("c", "regressed"), ("d", "new")}
    assert {(r["name"], r["status"]) for r in got if r["part"] == "severity"} == {("S0", "unchanged"), ("S1", "removed")}
    assert [r["name"] for r in got if r["part"] == "version"] == ["datasetVersion"] and not [r for r in got if r["part"] == "violation"]
    assert cli.main(["baseline", b, fine, limits, "--strict"]) == 1
    poor = written(tmp_path / "p.json", report(70.0, {"S0": {"passed": 8, "total": 10}, "Major": {"passed": 1, "total": 1}, "X": {"passed": 1, "total": 1}}, [("a", 1.0)]))
    assert cli.main(["baseline", b, poor, limits, "--out", str(tmp_path / "poor")]) == 1
    bad = {(r["name"], r.get("current"), r.get("delta")) for r in rows(spark, tmp_path / "poor") if r["part"] == "violation"}
    assert bad == {("overall", "70.0", None), ("regressions", "3.0", None), ("severity", "80.0", "S0"), ("legacy_severity", None, "Major")}


def test_drift_of_own_json(spark, tmp_path):
    fine = written(tmp_path / "f.json", {"ambiguity_rate": 0.01, "scan_quality": 0.9, "note": "x"})
    assert cli.main(["drift", fine, "--out", str(tmp_path / "fine")]) == 0
    assert [(r["metric"], r["severity"], r["value"]) for r in rows(spark, tmp_path / "fine") if r["metric"] == "summary"] == [("summary", "warning", "1")]
    stored = written(tmp_path / "s.json", {"scan_quality": 0.9})
    assert cli.main(["drift", fine, "--stored", stored, "--out", str(tmp_path / "stored")]) == 0 and rows(spark, tmp_path / "stored")[-1]["severity"] == "none"
    assert cli.main(["drift", written(tmp_path / "c.json", {"override_rate": 0.5})]) == 1


def test_personal_data_determinism_and_transitions(spark, tmp_path):
    (tmp_path / "clean").mkdir()
    written(tmp_path / "clean" / "a.json", {"id": "JS-1", "note": "Job Sheet"})
    assert cli.main(["personal-data", str(tmp_path / "clean")]) == 0
    written(tmp_path / "clean" / "b.json", {"rows": [{"who": "Mary Jones"}, "mail a@b.org"]})
    assert cli.main(["personal-data", str(tmp_path / "clean"), "--out", str(tmp_path / "found")]) == 1
    assert sorted((r["file"], r["path"], r["pattern"], r["match"]) for r in rows(spark, tmp_path / "found")) == [("b.json", "root.rows[0].who", "realName", "Mary Jones"), ("b.json", "root.rows[1]", "email", "a@b.org")]
    (tmp_path / "clean" / "c.json").write_text("{broken")
    assert cli.main(["personal-data", str(tmp_path / "clean" / "c.json")]) == 1
    assert cli.main(["determinism", str(tmp_path)]) == 0  # nothing stored
    from sheetlens.sources.tables import DDL

    sums = [(1, "doc", 1, "h", "o1", None), (2, "doc", 2, "h", "o2", None), (3, "doc", 3, "g", "o1", None)]
    spark.createDataFrame(sums, DDL["determinism_checksums"]).write.parquet(str(tmp_path / "determinism_checksums"))
    assert cli.main(["determinism", str(tmp_path)]) == 1
    events = spark.createDataFrame([(1, 0, "OCR_STARTED"), (1, 1, "OCR_DONE")], "run_id long, seq long, state string")
    events.write.parquet(str(tmp_path / "runs"))
    assert cli.main(["transitions", str(tmp_path / "runs")]) == 0
    events.selectExpr("run_id", "seq", "'PERSISTED' AS state").write.parquet(str(tmp_path / "runs2"))
    assert cli.main(["transitions", str(tmp_path / "runs2")]) == 1
