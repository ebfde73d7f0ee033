"""Report roll-ups and the remaining detectors."""

from pyspark.sql import functions as F

from veritrail.operators import experiments, reporting, rot


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rollups(spark):
    o = spark.createDataFrame([("c1", "v1", "failed"), ("c1", "v2", "skipped"), ("c2", "v1", "completed"), ("c2", "v2", "failed"), ("c3", "v1", "skipped")], "case_id string, variant_id string, status string")
    assert {r.case_id: r.status for r in reporting.outcome_summary(o, ["case_id"]).collect()} == {"c1": "failed", "c2": "partial", "c3": "skipped"}
    assert {r.case_id: r.case_status for r in experiments.case_status(o).collect()} == {"c1": "partial", "c2": "partial", "c3": "skipped"}
    v = spark.createDataFrame([("v1",), ("v9",)], "variant_id string")
    assert rows(reporting.variant_summary(v, o).select("variant_id", "outcomes", "failed")) == [("v1", 3, 1), ("v9", 0, 0)]
    s = spark.createDataFrame([("a",), ("b",), ("c",)], "strategy_id string")
    i = spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "strategy_id string")
    assert rows(reporting.strategy_input_issues(s, i)) == [("b", "duplicate-strategy-input"), ("c", "missing-strategy-input"), ("z", "input-strategy-not-selected")]
    st = spark.createDataFrame([("completed", "not-applicable", "passed"), ("invalid-input", None, "failed")], "execution string, evaluation string, assurance string")
    one = reporting.stage_context_summary(st).first()
    assert (one.strategies, one.invalid_input_executions, one.not_applicable_evaluations, one.passed_assurances) == (2, 1, 1, 1)


def test_ladders(spark):
    df = spark.createDataFrame([(0, 0, False, 0), (2, 1, False, 0), (2, 0, False, 0)], "c int, s int, f boolean, w int")
    assert [r[0] for r in df.select(reporting.gallery_status(F.col("c"), F.col("s"), F.col("f"), F.col("w"))).collect()] == ["skipped", "warning", "pass"]
    a = spark.createDataFrame([(1, True, 1), (0, False, 2), (0, False, 1)], "i int, m boolean, n int")
    assert [r[0] for r in a.select(reporting.assurance_status(F.col("i"), F.col("m"), F.col("n"))).collect()] == ["failed", "passed", "not-applicable"]
    assert tuple(spark.range(1).select(reporting.truncated(F.lit("abc"), 2)).first()[0]) == ("ab", True, 3)
    versions = spark.createDataFrame([("10.1",), ("9.2",), ("9.10",)], "v string")
    assert [r.v for r in versions.orderBy(reporting.natural_order(F.col("v"))).collect()] == ["9.2", "9.10", "10.1"]


def test_profiles(spark):
    schema = "project_id string, display_name string, languages array<string>, complexity_score int, source_file_count int, source_lines int, language_count int, internal_imports int, max_file_lines int, expected_files double, expected_symbols double"
    p = spark.createDataFrame([("a", "A", ["ts"], 100, 20, 2000, 4, 50, 300, 10.0, 20.0), ("b", "", [], 101, 0, 0, 0, 0, 0, 0.0, 0.0)], schema)
    assert rows(reporting.profile_violations(p, ["a", "c"])) == [("b", "name is empty"), ("b", "no language"), ("b", "score does not match the formula"), ("b", "score is out of range"), ("c", "profile is missing")]


def test_document_detectors(spark):
    docs = spark.createDataFrame([("a.md", "The audit is available.\nAndroid checks are planned.\nThe audit supports this and is planned, audit", 90)], "path string, content string, size_bytes int")
    got = {(r.kind, r.severity, r.line) for r in rot.feature_claims(docs, [("audit", "audit", False), ("android", "android checks", True)]).collect()}
    assert {("current-but-missing", "high", 1), ("planned-but-implemented", "medium", 2), ("ambiguous", "info", 3)} == got
    pm = spark.createDataFrame([("a", "run yarn install"), ("b", "yarn install or npm ci"), ("c", "pnpm add x " + "y" * 200 + " npm install")], "path string, content string")
    assert sorted(r.file for r in rot.package_manager_mismatch(pm).collect()) == ["a", "c"]
    wf = "node-version: '20'\nnode-version:\n  - 18\n  - \"22\"\nother:\n  - 7\n"
    y = spark.createDataFrame([("ci", wf, 9)], "path string, content string, size_bytes int")
    assert sorted(r.version for r in rot.node_versions(y).collect()) == ["18", "20", "22"]
