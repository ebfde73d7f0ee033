"""Edge rows of the engine's operators on small hand-written tables."""

import json

import pytest
from pyspark.sql import functions as F

from veritrail.functions import semantics as S
from veritrail.functions import text as X
from veritrail.operators import audit, expectations, experiments, inventory, rot, scoring, security, snapshots, tasks
from veritrail.sources import artifacts, scanners

RUNS = "case_id string, project string, agent string, complexity string, strategy string, ord long, run_id string, status string, duration_ms long, total_tokens long, correctness double, passed boolean"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_scalars(spark):
    assert one(spark, S.round_half_up(F.lit(-2.5))) == -2.0 and one(spark, S.round_half_up(F.lit(0.00005), 4)) == 0.0001
    assert one(spark, S.utf16_len(F.lit("a😀"))) == 3 and one(spark, S.est_tokens(F.lit(""))) == 0 and one(spark, S.est_tokens(F.lit("abcde"))) == 2
    assert one(spark, S.norm_text(F.lit("  A--béC "))) == "a b c"
    assert one(spark, S.unicode_trim(F.lit("  x "))) == "x"
    assert one(spark, S.ratio_metric(F.lit(1), F.lit(0)))[0] == "not-applicable"
    assert one(spark, S.ratio_metric(F.lit(0), F.lit(4))).rate == 0.0


def test_text_functions(spark):
    assert one(spark, X.identifier_words(F.lit("userAuthToken_v2.HTTPServer"))) == ["user", "auth", "token", "v2", "http", "server"]
    assert [one(spark, X.extension(F.lit(p))) for p in ("a/b.TS", ".env", "a/Makefile", "x.tar.gz")] == [".ts", "", "", ".gz"]
    assert [one(spark, X.candidate_preview(F.lit(v).cast("string"))) for v in (None, "", "abcdef", "abcdefg")] == ["[unavailable]", "[empty]", "***", "abc***efg"]
    secret = "sk-" + "A" * 20
    assert one(spark, X.redact(F.lit(f"a {secret} b {secret}"))) == "a [REDACTED:23chars] b [REDACTED:23chars]"
    assert one(spark, X.redact(F.lit("x" * 300), 10)) == "xxxxxxxxxx... [truncated, 300 chars total]"
    assert [one(spark, X.supported_major_one(F.lit(v))) for v in ("1.0.0", "1.99.3", "2.0.0", "1.0", "01.0.0", "1.0.0\n")] == [True, True, False, False, False, False]
    assert one(spark, X.version_at_least(F.lit("0.10.0"), F.lit("0.9.9"))) is True
    assert one(spark, X.canonical_map(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))) == '{"a":2,"b":1}'
    assert one(spark, X.escape_html(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, X.clean_list(F.lit("- `a`, b\n2. c\n\n- a"))) == ["a", "b", "c"]
    assert one(spark, X.merge_config(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2)))) == {"a": 2}
    assert one(spark, X.context_window(F.lit("abcdefgh"), F.lit("de"), 2)) == "bcdefg"


def test_keep_first_and_dense(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "id string, ord int, v string")
    assert rows(S.keep_first(df, ["id"], ["ord"])) == [("a", 1, "y"), ("b", 3, None)]
    assert rows(S.keep_first(df, ["id"], ["ord"], last=True)) == [("a", 2, "x"), ("b", 3, None)]
    assert rows(S.dense_counts(df, "id", ["a", "z"])) == [("a", 2), ("z", 0)]


def test_pairing(spark):
    run = lambda strategy, ord_, tokens, ms, status="completed", case="c": (case, "p", "g", "short", strategy, ord_, f"{case}{strategy}{ord_}", status, ms, tokens, 0.5, True)
    df = spark.createDataFrame([run("baseline", 1, 200, 1000), run("baseline", 2, 1, 1), run("guided", 3, 120, 700), run("guided", 1, None, 5, case="d"), run("baseline", 1, 0, 0, "failed", "e"), run("guided", 2, 5, 5, case="e"), run("other", 1, 1, 1, case="f")], RUNS)
    got = {r.case_id: r for r in experiments.pair_strategies(df).collect()}
    assert set(got) == {"c", "d", "e"}
    assert (got["c"].token_delta, got["c"].token_savings_percent, got["c"].duration_delta_ms, got["c"].duration_reduction_percent, got["c"].reliability) == (80, 40.0, 300, 30.0, "strong")
    assert got["d"].reliability == "partial" and not got["d"].same_pass and len(got["d"].warnings) == 2
    assert got["e"].token_delta == -5 and got["e"].token_savings_percent is None and got["e"].reliability == "failed"
    summary = experiments.pair_summary(experiments.pair_strategies(df)).first()
    assert (summary.total_comparisons, summary.completed_comparisons, summary.token_answer, summary.preserves_correctness) == (3, 1, "yes", True)
    none = experiments.pair_summary(experiments.pair_strategies(df.limit(0))).first()
    assert (none.token_answer, none.correctness_answer, none.saves_tokens, none.average_token_savings_percent) == ("unavailable", "unavailable", None, None)
    assert rows(experiments.pair_strategies(df.repartition(5, "run_id")).select("case_id", "token_delta")) == rows(experiments.pair_strategies(df).select("case_id", "token_delta"))


def test_outcome_classes(spark):
    df = spark.createDataFrame(
        [("skipped", "Agent not found", None), ("completed", "our quota is fine", "parsed"), ("failed", "timed out after 3", None), ("failed", "boom", None), ("skipped", None, None), ("completed", "x", "partial"), ("completed", "x", "parsed")],
        "s string, t string, p string",
    )
    got = [r[0] for r in df.select(experiments.classify_outcome(F.col("s"), F.col("t"), F.col("p"))).collect()]
    assert got == ["agent-unavailable", "agent-limit-reached", "timeout", "failed", "skipped", "invalid-output", "completed"]


def test_matrix(spark):
    cases = spark.createDataFrame([(0, "a b", "p"), (1, "c", "q")], "ord int, case_id string, project string")
    m = experiments.experiment_matrix(cases, ["x"], ["baseline", "guided"], ["short"], max_runs=3)
    assert [r.run_id for r in m.orderBy("ord", "strategy").collect()] == ["a-b.p.x.baseline.short", "a-b.p.x.guided.short", "c.q.x.baseline.short"]
    with pytest.raises(ValueError, match="zz"):
        experiments.experiment_matrix(cases, ["x"], ["baseline"], ["short"], case_ids=["c", "zz"])


def test_token_savings(spark):
    schema = "case_id int, raw_tokens long, guided_tokens long, skipped boolean, commands_run long, ms_raw long, ms_guided long"
    df = spark.createDataFrame([(1, 100, 50, False, 2, 1, 1), (2, 0, 5, False, 1, 1, 1), (3, 10, 1, True, 7, 5, 5)], schema)
    s = experiments.token_savings_summary(df).first()
    assert (s.completed_count, s.average_percent_saved, s.total_tokens_saved, s.total_commands, s.total_duration_ms) == (2, 25.0, 45, 10, 14)
    assert experiments.token_savings_summary(df.where("skipped")).first().average_raw_tokens == 0.0


def test_scoring(spark):
    schema = "case_id int, status string, parse_status string, answer_text string, relevant_files array<string>, relevant_symbols array<string>, facts_found array<string>, expected_files array<string>, expected_symbols array<string>, expected_facts array<struct<id:string,text:string,weight:double,required:boolean>>, minimum_correct_facts int"
    fact = ("f1", "uses a map", 2.0, True)
    df = spark.createDataFrame(
        [
            (1, "completed", "parsed", "It uses a MAP.", ["lib/src/a.ts"], [], [], ["src/a.ts"], [], [fact, ("f2", "never seen words", 2.0, False)], 1),
            (2, "timeout", "failed", "", ["---"], [], [], ["src/b.ts"], ["Sym"], [fact], 1),
            (3, None, "parsed", "", [], [], [], [], [], [], 0),
        ],
        schema,
    )
    got = {r.case_id: r for r in scoring.score_correctness(df).collect()}
    assert (got[1].file_match_score, got[1].fact_match_score, got[1].correctness_score, got[1].passed) == (1.0, 0.5, 0.75, True)
    assert got[2].expected_files_found == 1  # an item that normalises to nothing lies in every expected one
    assert got[2].failure_reasons == ["timeout", "invalid output", "missing required fact: f1", "too few facts found: 0/1", "missing expected symbol", "score below threshold"]
    assert got[3].correctness_score == 1.0 and got[3].passed


def test_expectations(spark):
    e = spark.createDataFrame([(1, "a", "required", "cap", "file", "k1"), (2, "b", "forbidden", "cap", "file", "k1"), (3, "c", "forbidden", "cap", "file", "K1"), (4, "d", "required", "cap", "file", "no")], "ord int, expectation_id string, inclusion string, source_artifact string, category string, target_key string")
    o = spark.createDataFrame([(2, "cap", "i2", "file", "k1", "p2"), (1, "cap", "i1", "file", "k1", "p1"), (3, "cap", "i1", "file", "k9", "p3")], "ord int, source_artifact string, source_instance string, category string, target_key string, source_field_path string")
    m = expectations.match_expectations(e, o)
    got = {r.expectation_id: (r.outcome, r.matched_instances) for r in m.collect()}
    assert got == {"a": ("matched", ["i1", "i2"]), "b": ("violated", ["i1", "i2"]), "c": ("matched", []), "d": ("missing", [])}
    metrics = {r.metric: (r.availability, r.rate) for r in expectations.inclusion_metrics(m).collect()}
    assert metrics["required_recall"] == ("available", 0.5) and metrics["allowed_coverage"] == ("not-applicable", None)
    assert expectations.irrelevant_inclusion(o, e, ["cap"], ["file"]).first().rate == 0.5
    assert expectations.irrelevant_inclusion(o.limit(0), e, ["cap"], ["file"]).first().availability == "not-applicable"
    assert [r.target_key for r in expectations.irrelevant_targets(o, e, ["cap"], ["file"]).collect()] == ["k9"]


def test_states_and_determinism(spark):
    side = "instance string, field string, value string"
    expected = spark.createDataFrame([("i", "a", "1"), ("i", "b", None), ("i", "c", "2")], side)
    actual = spark.createDataFrame([("i", "a", "2"), ("i", "b", None)], side)
    got = {r.field: (r.matched, r.availability) for r in expectations.compare_states(expected, actual).collect()}
    assert got == {"a": (False, "available"), "b": (True, "available"), "c": (None, "unavailable")}
    runs = spark.createDataFrame([("x", 1, "p"), ("x", 2, "p"), ("x", 3, "q"), ("y", 1, "p")], "case_id string, run int, canonical string")
    d = {r.case_id: (r.availability, r.deterministic, r.mismatched_runs) for r in expectations.determinism(runs).collect()}
    assert d == {"x": ("available", False, [3]), "y": ("not-applicable", None, [])}


def test_evidence_and_consistency(spark):
    a = spark.createDataFrame([("i1", ["a.ts", "a.ts", None], [("s1", 3)])], "source_instance string, files array<string>, symbols array<struct<id:string,line:int>>")
    got = rows(expectations.flatten_evidence(a, {"files": ("file", ""), "symbols": ("symbol", "id")}, "context-capsule").select("category", "target", "source_field_path"))
    assert got == [("file", "a.ts", "files[0]"), ("file", "a.ts", "files[1]"), ("symbol", "s1", "symbols[0]")]
    m = spark.createDataFrame([("mapped",), ("missing",), ("not-applicable",), ("not-applicable",)], "mapping_status string")
    r = expectations.responsibility_completeness(m).first()
    assert (r.availability, r.rate, r.not_applicable) == ("available", 0.5, 2)
    assert expectations.responsibility_completeness(m.where("mapping_status = 'not-applicable'")).first().availability == "not-applicable"
    side = "struct<x:int,y:array<int>,z:string>"
    p = spark.createDataFrame([(1, (1, [1], None), (1, [2], None))], f"pair_id int, capsule {side}, audit {side}")
    assert [c.field for c in expectations.field_consistency(p, ["x", "y", "z"]).collect()] == ["y"]
    t = spark.createDataFrame([("context-capsule", "source-range", ("p", 1, 9)), ("full-workflow-library", "file", ("q", 1, 2)), ("x", "odd", ("r", 1, 2))], "a string, c string, m struct<filePath:string,startLine:int,endLine:int>")
    keyed = t.select("a", "c", F.struct(F.col("m.*"), F.col("m.filePath").alias("path"), *[F.lit("v").alias(n) for n in ("symbolId", "responsibilityId", "name", "commandText", "id", "evidenceId")]).alias("m"))
    assert [k[0] for k in keyed.select(expectations.target_key(F.col("a"), F.col("c"), F.col("m"))).collect()] == ["context-capsule|source-range|filePath:p|startLine:1|endLine:9", "full-workflow-library|file|path:q", None]
    size = spark.createDataFrame([("a", 5), ("a", 1), ("b", 0)], "k string, n_chars int")
    assert rows(expectations.context_size(size, ["k"])) == [("a", 2, 6, 3), ("b", 1, 0, 0)]


def test_chains_and_orders(spark):
    b = spark.createDataFrame([("app", "release", "rel"), ("lib", "release", "none"), ("dyn", "release", "d"), ("app", "debug", "rel")], "module string, build_type string, signing_config string")
    c = spark.createDataFrame([("rel", "../keys/k.jks", True, False), ("d", "k.jks", True, True)], "name string, store_file string, literal_credential boolean, dynamic boolean")
    f = spark.createDataFrame([("app/keys/k.jks",)], "path string")
    assert {r.module: r.state for r in security.signing_chain(b, c, f).collect()} == {"app": "committed", "lib": "missing", "dyn": "unresolved"}
    k = spark.createDataFrame([("b", "r", None, "p", None, None, "f2"), ("b", "r", None, "p", None, None, "f1"), ("a", "z", "m", "p", 3, 1, "f"), ("a", "z", None, "p", 9, 1, "f")], "category string, rule_id string, module_path string, path string, line int, col int, fingerprint string")
    assert [(r.category, r.module_path, r.fingerprint) for r in k.orderBy(*security.candidate_order()).collect()] == [("a", None, "f"), ("a", "m", "f"), ("b", None, "f1"), ("b", None, "f2")]
    modules = spark.createDataFrame([("library", "views", "low"), ("application", "compose", "high")], "kind string, ui_toolkit string, confidence string")
    assert tuple(security.project_kind(modules).first()) == ("application", "mixed", "high")
    outcomes = spark.createDataFrame([("r1", "failed", ["w1", "w2"]), ("r2", "skipped", [])], "run_id string, status string, warnings array<string>")
    assert rows(audit.tagged_findings(outcomes)) == [("r1", "failure", "outcome failed"), ("r1", "warning", "w1"), ("r1", "warning", "w2"), ("r2", "skipped", "outcome was skipped")]
    a, b2 = spark.createDataFrame([(1, "x"), (2, "y")], "ord int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "ord int, v string")
    assert [r.v for r in audit.union_distinct([a, b2], "v").orderBy("first_seen").collect()] == ["x", "y", "z"]


def test_snapshots(spark):
    schema = "path string, sha256 string"
    before = spark.createDataFrame([("same", "1"), ("gone", "1"), ("null", None), ("changed", "1")], schema)
    after = spark.createDataFrame([("same", "1"), ("new", "1"), ("null", None), ("changed", None)], schema)
    assert [(r[0], r[3]) for r in rows(snapshots.diff(before, after, ["path"], "sha256"))] == [("changed", "changed"), ("gone", "removed"), ("new", "added")]
    assert "new" not in [r.path for r in snapshots.diff(before, after, ["path"], "sha256", left_only=True).collect()]
    assert snapshots.new_entries(before, after.union(after.where("path = 'new'")), ["path"]).count() == 2
    files = spark.createDataFrame([("out",), ("out/a",), ("outer/b",)], "path string")
    assert rows(snapshots.writes_outside(files, "out/")) == [("outer/b",)]


def test_tasks(spark):
    t = spark.createDataFrame([(1, "a", "alpha", "T one", "high", True, 3, 1, ["x"]), (2, "b", "alpha", "t  ONE", "high", False, 5, 10, ["y"]), (3, "c", "zeta", "u", "low", False, 8, 11, [])], "ord int, task_id string, project_id string, title string, priority string, completed boolean, story_points int, updated_day int, tags array<string>")
    p = spark.createDataFrame([("alpha",), ("empty",)], "project_id string")
    snap = {r.project_id: r for r in tasks.analytics_snapshot(p, t, 20).collect()}
    assert (snap["alpha"].completion_rate, snap["alpha"].stale_tasks, snap["alpha"].average_points) == (50.0, 1, 4.0) and snap["empty"].total_tasks == 0
    assert tasks.grand_totals(tasks.analytics_snapshot(p, t, 20)).first().total_tasks == 2
    assert rows(tasks.task_summary(p, t)) == [("alpha", 2, 1, 1), ("empty", 0, 0, 0), ("zeta", 1, 0, 1)]
    imported, skipped = tasks.import_tasks(t.where("ord = 3").select("project_id", "title"), t, p.union(spark.createDataFrame([("zeta",)], p.schema)))
    assert [r.ord for r in imported.collect()] == [1] and sorted(r.ord for r in skipped.collect()) == [2, 3]
    with pytest.raises(ValueError, match="zeta"):
        tasks.import_tasks(t, t, p)
    assert one(spark, tasks.normalize_tags(F.array(F.lit(" B "), F.lit("a"), F.lit("b"), F.lit(" ")))) == ["a", "b"]
    bad = spark.createDataFrame([("1", " ", "low", 3), ("2", "t", "odd", 0), ("3", "t", "low", 13)], "task_id string, title string, priority string, story_points int")
    assert {r.task_id: len(r.reasons) for r in tasks.rejected_rows(bad).collect()} == {"1": 1, "2": 2}


def test_inventory(spark):
    paths = {"src/a.ts": ("source", "source"), "tests/a.md": ("tests", "test"), "src/x_test.py": ("tests", "test"), "package.json": ("package", "package"), ".github/workflows/ci.yml": ("ci", "config"), ".prettierrc": ("config", "config"), "dist/a.js": ("source", "build-output"), "x-audit.json": ("report", "report-output"), "lib/FooTest.kt": ("tests", "test"), "node_modules/a.js": ("source", "vendor"), "README": ("unknown", "unknown")}
    df = inventory.classify(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {r.path: (r.category, r.role) for r in df.collect()} == paths
    assert ("extension", "(none)", 2) in rows(inventory.counts(df, ["extension"]))
    got = inventory.collect_globs(df, ["src/*.ts", "**/*.md"])
    assert sorted(r.path for r in got.collect()) == ["src/a.ts", "tests/a.md"]
    tree = inventory.file_tree(df.select("path"))
    assert tree.where("kind = 'directory'").count() == 7
    rep = spark.createDataFrame([("k", 1), ("k", 2), ("k", 2), ("m", 1)] + [("n", i) for i in range(6)], "key string, v int")
    assert rows(inventory.repeated_groups(rep, ["key"], "v", 2, 4)) == [("k", 2, [1, 2])]


def test_inventory_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.ts").write_text("one\ntwo\n")
    (tmp_path / "src" / "b.bin").write_bytes(b"a\x00b\n")
    (tmp_path / "node_modules" / "c.js").write_text("x")
    got = inventory.scan(spark, str(tmp_path))
    assert {r.path: r.n for r in got.select("path", inventory.line_count(F.col("content")).alias("n")).collect()} == {"src/a.ts": 3, "src/b.bin": None}
    assert [one(spark, inventory.line_count(F.lit(v).cast("binary"))) for v in ("", "a", None)] == [0, 1, None]


def test_audit(spark):
    df = spark.createDataFrame([(1, "a", "d1", "low", "fix x"), (2, "a", "d2", "blocker", "fix y"), (3, "b", "d2", "high", "fix x"), (4, "c", "d1", "info", "fix z")], "ord int, id string, detector_id string, severity string, recommended_action string")
    assert [(r.recommended_action, r.highest_severity, r.issues) for r in audit.recommendations(audit.deduplicate(df)).collect()] == [("fix x", "high", 2), ("fix z", "info", 1)]
    assert audit.deduplicate_last(df).where("id = 'a'").first().ord == 2
    assert audit.exit_decision(df, "blocker").first().exit_code == 1 and audit.exit_decision(df, "none").first().exit_code == 0
    assert audit.exit_decision(df.limit(0), "low").first().verdict == "no issues"
    assert audit.exit_decision(df.where("ord = 4"), "low", detector_errors=1).first().verdict == "detector errors"
    assert dict(rows(audit.severity_counts(df))) == {"info": 1, "low": 1, "medium": 0, "high": 1, "blocker": 1}
    assert tuple(one(spark, audit.bounded(F.array(*[F.lit(i) for i in range(5)]), 2))) == ([0, 1], 5, 2, 3)


def test_security(spark):
    files = spark.createDataFrame([("package/.env",), ("src\\a.test.ts",), ("docs/x.md",), ("keys/a.PEM",), ("dist/keep.map",)], "path string")
    got = dict(rows(security.forbidden_files(files, [".env", "*.pem", "docs/", "src/*.ts", "*.map"], ["dist/keep*"])))
    assert got == {".env": ".env", "src/a.test.ts": "src/*.ts", "docs/x.md": "docs/", "keys/a.PEM": "*.pem"}
    ids = spark.createDataFrame([("apiKey",), ("userPassword",), ("passwords",), ("db_password",), ("",)], "identifier string")
    d = {"password": "credential", "dbpassword": "database-credential"}
    assert [r.sensitivity for r in security.classify_identifiers(ids, d).collect()] == [None, "credential", None, "database-credential", None]
    c = spark.createDataFrame([("m1", "failed", "major", None), ("o1", "skipped", "major", None), ("s-attack-runner-error", "failed", "major", None), ("x", "failed", "major", "release-blocker"), ("y", "passed", "major", None)], "id string, status string, severity string, verdict_impact string")
    f = spark.createDataFrame([("f", "informational")], "id string, severity string")
    reasons = dict(rows(security.reason_summary(c, f, ["m1"]).where("n > 0")))
    assert reasons == {"scanner-finding": 1, "optional-skipped-tool": 1, "adversarial-scenario-failure": 1, "release-blocker": 1, "informational-evidence": 1}
    assert security.verdict(c, f, ["m1"]).first().verdict == "not-ready-security-blocker-remains"
    assert security.verdict(c.where("status = 'skipped'"), f, ["m1"]).first().verdict == "ready-except-optional-manual-checks"
    assert security.verdict(c.limit(0), f.limit(0), []).first().verdict == "ready-for-release-preparation"


def test_rot(spark):
    doc = "# Use\nnpm run build\nnpm run --silent gone\n" + "text\n" * 20 + "## Planned\ntext\n" + "text\n" * 20 + "### v2\nnpm run later\n# Now\n" + "text\n" * 16 + "npm run missing and npm run missing\n"
    docs = spark.createDataFrame([("d.md", doc, len(doc))], "path string, content string, size_bytes int")
    refs = {r.command: r.planned for r in rot.command_references(docs).collect()}
    assert refs == {"build": False, "gone": False, "later": True, "missing": False}
    scripts = spark.createDataFrame([("build", "rm -rf dist"), ("b2", "rm -rf dist"), ("ok", "node ./scripts/a.js")], "name string, command string")
    assert sorted(r.id.rsplit(":")[-1] for r in rot.stale_commands(docs, scripts).collect()) == ["gone", "missing"]
    assert rot.duplicate_commands(scripts).count() == 1 and rot.posix_scripts(scripts).count() == 2
    files = spark.createDataFrame([("src/a.ts", "import x from './b.js'", 9), ("src/b.ts", "", 0), ("src/c.ts", "", 0), ("src/index.ts", "", 0)], "path string, content string, size_bytes int")
    assert sorted(r.file for r in rot.unreferenced_files(files, files, []).collect()) == ["src/a.ts", "src/c.ts"]
    named = spark.createDataFrame([("src/x/util.ts",), ("src/y/util.ts",), ("src/x/index.ts",), ("src/y/index.ts",)], "path string")
    assert [r.message for r in rot.duplicate_basenames(named).collect()] == ["src/x, src/y"]
    paths = spark.createDataFrame([("d.md", "see `src/x/util.ts` and `src/no/way.ts` and `src/x/`", 9)], "path string, content string, size_bytes int")
    assert [r.message for r in rot.stale_paths(paths, named).collect()] == ["no such path: src/no/way.ts"]
    tests = spark.createDataFrame([("t.ts", "it.only('x')\nit.skip('y')\nit('z')", 9)], "path string, content string, size_bytes int")
    assert sorted(r.severity for r in rot.focused_tests(tests).collect()) == ["high", "medium"]
    claims = spark.createDataFrame([("a.md", "the scan passed"), ("b.md", "if available the scan passed")], "path string, content string")
    assert [r.file for r in rot.claims_without_hedge(claims, "scan passed", "if available", "x", "y", "low").collect()] == ["a.md"]


def test_scanners(spark):
    raw = lambda *texts: spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "source string, raw string")
    assert rows(scanners.malformed(raw("", "{bad", "[1]", "{}", None))) == [("s0", "empty"), ("s1", "malformed"), ("s2", "not-an-object"), ("s4", "empty")]
    audit_json = '{"vulnerabilities": {"p": {"name": "p", "severity": "high", "via": ["q", {"title": "T", "url": "u", "severity": "critical"}]}}}'
    assert [(r.package, r.severity, r.title) for r in scanners.npm_audit(raw(audit_json)).collect()] == [("p", "blocker", "T")]
    assert [(r.severity, r.title) for r in scanners.npm_audit(raw('{"vulnerabilities": {"p": {"via": ["q"]}}}')).collect()] == [("major", None)]
    assert {r.level: r.n for r in scanners.npm_audit_counts(raw('{"metadata": {"vulnerabilities": {"high": 2, "total": 2}}}')).collect()} == {"critical": 0, "high": 2, "moderate": 0, "low": 0, "info": 0, "total": 2}
    node: dict = {}
    for i in range(25):
        node = {"dependencies": {f"d{i}": {"missing": True} | node}}
    deep = json.dumps(node)
    assert scanners.npm_ls(raw('{"dependencies": {"a": {"dependencies": {"b": {"missing": true}}}, "c": {"invalid": true, "name": "cc"}, "d": {"invalid": "x"}}}')).orderBy("path").select("path", "package", "problem").collect() == [("a>b", "unknown", "missing"), ("c", "cc", "invalid")]
    assert scanners.npm_ls(raw(deep)).count() == 20
    assert [(r.depth, r.deeper) for r in scanners.npm_tree(raw(deep)).orderBy("depth").collect()] == [(d, d == 20) for d in range(21)]
    assert [(r.depth, r.deeper) for r in scanners.npm_tree(raw('{"dependencies": [1, {"a": 2}]}')).collect()] == [(0, False)] and scanners.npm_tree(raw("no")).count() == 0
    sem = '{"results": [' + ",".join('{"check_id": "r", "path": "p", "start": {"line": 1}, "extra": {"severity": "ERROR"}}' for _ in range(4)) + "]}"
    assert [(r.severity, r.truncated) for r in scanners.semgrep(raw(sem), 3).collect()] == [("major", True)] * 3
    osv = '{"results": [{"source": {"path": "l"}, "packages": [{"package": {"name": "p"}, "vulnerabilities": [{"id": "1", "severity": [{"score": "7.5"}]}, {"id": "2"}]}]}]}'
    assert [(r.vulnerability, r.severity, r.kind) for r in scanners.osv(raw(osv)).collect()] == [("1", "major", "finding"), ("2", None, "candidate")]
    sarif = '{"runs": [{"results": [{"ruleId": "r", "level": "warning", "message": {"text": "m"}}]}]}'
    assert [(r.rule, r.severity, r.path) for r in scanners.lint_sarif(raw(sarif)).collect()] == [("r", "minor", None)]
    xml = '<issues><issue id="A" severity="Error" message="m"><location file="f" line="3"/></issue></issues>'
    assert [(r.rule, r.severity, r.path, r.line) for r in scanners.lint_xml(raw(xml)).collect()] == [("A", "major", "f", 3)]
    pack = '[{"name": "n", "files": [{"path": "a", "size": 1}]}]'
    assert [r.path for r in scanners.npm_pack(raw(pack)).collect()] == ["a"]
    assert scanners.npm_outdated(raw('{"p": {"current": "1", "latest": "2"}}')).first().latest == "2"


def test_artifacts(spark):
    texts = ['{"schemaVersion": "1.4.0", "x": 1}', '{"schemaVersion": "2.0.0"}', "[1]", "{bad", "", '{"a": 1}', '{"schemaVersion": "1.x"}', '{"schemaVersion": "1.0.0", "artifactKind": "other"}']
    raw = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source string, raw string")
    assert {r.source: r.code for r in artifacts.failures(raw, "capsule").collect()} == {"1": "unsupported-version", "2": "not-an-object", "3": "invalid-json", "4": "empty", "5": "missing-field", "6": "malformed-version", "7": "wrong-kind"}
    assert artifacts.read_artifacts(raw, "capsule", "x INT").first().artifact.x == 1
    cases = '[{"id": "a", "query": "q", "benchmarkProject": "p", "answerKey": {"minimumCorrectFacts": 2, "expectedFacts": [{"id": "f", "text": "t", "weight": 0}]}}, {"id": "a", "query": ""}]'
    rows_ = artifacts.evaluation_cases(spark.createDataFrame([("s", cases)], "source string, raw string"))
    found = sorted(r.rule for r in artifacts.case_violations(rows_, spark.createDataFrame([("p",)], "project string")).collect())
    assert found == ["minimum cannot be met", "missing query", "repeated case id", "unknown project", "weight is not positive"]


def test_facts_feed_the_detectors(spark):
    from veritrail.operators import facts

    ts = "import def, { a, b as c } from './m.js'\nimport * as ns from 'x'\nimport type { T } from './t'\nexport class A {}\nconst own = 1"
    py = "import os.path, sys as system\nfrom m import (d, e as f)\ndef g():\n  pass\nclass _H: pass"
    made = facts.source_facts(spark.createDataFrame([("a.ts", ts, 9, "typescript", "source"), ("b.py", py, 9, "python", "source"), ("c.rb", "", 0, "ruby", "source")], "path string, content string, size_bytes int, language string, role string"))
    got = {r.path: r for r in made.collect()}
    assert [sorted(i.importedNames) for i in got["a.ts"].imports] == [["a", "c", "def"], ["ns"], ["T"]]
    assert [sorted(i.importedNames) for i in got["b.py"].imports] == [["path", "system"], ["d", "f"]]
    assert [(d.name, d.kind, d.exported) for d in got["a.ts"].declarations] == [("A", "class", True), ("own", "constant", False)]
    assert [(d.name, d.kind, d.exported) for d in got["b.py"].declarations] == [("g", "function", True), ("_H", "class", False)]
    assert (got["b.py"].analyzer_id, got["c.rb"].analyzer_id, got["c.rb"].parse_status) == ("python", "file-level", "unsupported")
    assert [r.id.rsplit(":")[-1] for r in rot.unimported_declarations(made).orderBy("id").collect()] == ["A", "g"]


def test_unreferenced_scripts(spark):
    files = spark.createDataFrame([("scripts/a.ts",), ("scripts/b.ts",), ("scripts/shared.ts",), ("scripts/index.ts",)], "path string")
    commands = spark.createDataFrame([("tsx ./scripts/a.ts --x",), ("",)], "command string")
    importing = spark.createDataFrame([("scripts/a.ts", "import x from './shared.js'", 9)], "path string, content string, size_bytes int")
    assert [r.file for r in rot.unreferenced_scripts(files, commands).orderBy("file").collect()] == ["scripts/b.ts", "scripts/shared.ts"]
    assert [r.file for r in rot.unreferenced_scripts(files, commands, importing).collect()] == ["scripts/b.ts"]
    assert rot.unreferenced_scripts(files.limit(0), commands).count() == 0
