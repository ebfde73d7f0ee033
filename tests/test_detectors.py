"""Registry and runs of detectors, matches with places, and the claims and calls they find."""

import re

import pytest
from pyspark.sql import functions as F

from veritrail.functions import text as X
from veritrail.operators import rot
from veritrail.plans import detectors as D


def issues(spark, *rows):
    return spark.createDataFrame([(i, "x", s, "low", None, None, "m") for i, s in rows], D.ISSUE)


def test_registry_and_selection():
    one = D.Detector("a", "code-rot", ("docs", "cli"), None)
    two = D.Detector("b", "security", ("docs",), None)
    with pytest.raises(ValueError, match='Duplicate audit detector id: "a"'):
        D.registry([one, two, one])
    every = D.registry([two, one])
    assert [d.id for d in D.select(every, ["code-rot", "security"], ["docs"])] == ["b", "a"]
    assert [d.id for d in D.select(every, ["security"], ["cli"])] == [] and len(D.DETECTORS) == 10


def test_a_failing_detector_is_a_row(spark):
    def planned(context):
        raise RuntimeError("ENOENT: no such file\nmore")

    in_task = lambda c: issues(spark, ("t", "low")).withColumn("message", F.raise_error(F.lit("unexpected token in JSON")).cast("string"))
    every = [
        D.Detector("first", "code-rot", ("docs",), lambda c: issues(spark, ("1", "high"), ("2", "low"))),
        D.Detector("planned", "code-rot", ("docs",), planned),
        D.Detector("task", "code-rot", ("docs",), in_task),
        D.Detector("columns", "code-rot", ("docs",), lambda c: issues(spark).drop("line")),
        D.Detector("skipped", "code-rot", ("docs",), planned, lambda c: "not selected"),
        D.Detector("last", "code-rot", ("docs",), lambda c: issues(spark, ("2", "blocker"), ("3", c["severity"]))),
    ]
    got = D.run(spark, every, {"severity": "medium"}, fail_on="high")
    assert sorted((r.id, r.detector_ord, r.severity) for r in got.issues.collect()) == [("1", 0, "high"), ("2", 0, "low"), ("3", 5, "medium")]
    errors = {r.detector_id: (r.detector_ord, r.category) for r in got.errors.collect()}
    assert errors == {"planned": (1, "filesystem"), "task": (2, "parse"), "columns": (3, errors["columns"][1])}
    assert got.errors.where("detector_id = 'planned'").first().message == "ENOENT: no such file"
    assert [tuple(r) for r in got.skipped.collect()] == [(4, "skipped", "not selected")]
    assert got.exit.first().verdict == "fail-on threshold breached" and got.exit.first().exit_code == 1
    assert {r.severity: r.n for r in got.counts.collect()}["medium"] == 1
    calm = D.run(spark, every[1:2], {})
    assert calm.exit.first().verdict == "detector errors" and calm.issues.count() == 0
    assert D.run(spark, [], {}).exit.first().verdict == "no issues"


def test_all_detectors_on_one_project(spark):
    file = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    context = {
        "docs": file(("README.md", "Runs on Windows.\nnpm run gone\nyarn install\nSemgrep passed.\nsee `src/no/way.ts`")),
        "sources": file(("src/a/util.ts", "import x from './b.js'"), ("src/b/util.ts", ""), ("src/audits/x.ts", "spawn(a, { shell: true })")),
        "tests": file(("t.test.ts", "it.only('x')")),
        "scripts": spark.createDataFrame([("clean", "tsc && rm -rf dist")], "name string, command string"),
        "version": "0.4.0",
    }
    context["files"] = context["sources"]
    got = D.run(spark, D.DETECTORS, context, fail_on="medium")
    assert {r.detector_id for r in got.issues.collect()} >= {"stale-command-reference", "duplicate-implementation-candidate", "dead-code-candidate", "test-rot", "architecture-drift", "dependency-environment-rot", "cross-platform-rot", "security-validation-assumption-rot"}
    assert {r.detector_id: r.reason for r in got.skipped.collect()} == {"docs-code-mismatch": "no features given", "package-release-rot": "no package given"}
    assert got.errors.count() == 0 and got.exit.first().exit_code == 1
    assert {r.file: r.severity for r in got.issues.where("detector_id = 'cross-platform-rot' AND file IS NOT NULL").collect()} == {"src/audits/x.ts": "high"}
    assert [r.severity for r in got.issues.where("id LIKE 'cross-platform-rot:posix%'").collect()] == ["high"]


@pytest.mark.parametrize("pattern", ["ab+", r"\w+", "é|b", r"(?m)^x", "(a)(b)?"])
def test_matches_against_re(spark, pattern):
    texts = ["", "ab abb b", "éab xé", "x\nx ab", "abab\n\nab", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("m", X.matches(F.col("t"), pattern)).withColumn("l", F.transform("m", lambda m: X.line_of(F.col("t"), m)))
    for r in rows.collect():
        want = [(m.start(), m[0]) for m in re.finditer(pattern, texts[r.i], re.ASCII)] if texts[r.i] is not None and pattern != r"\w+" else None
        if want is not None:
            assert [tuple(m) for m in r.m] == want and r.l == [texts[r.i][:a].count("\n") + 1 for a, _ in want]
        elif texts[r.i] is None:
            assert r.m is None
    around = spark.createDataFrame([("0123456789",)], "t string").withColumn("m", F.get(X.matches(F.col("t"), "45"), F.lit(0)))
    assert around.select(X.around(F.col("t"), F.col("m"), 2, 3), X.around(F.col("t"), F.col("m"), 20, 30)).first()[:] == ("2345678", "0123456789")


def test_security_claims(spark):
    texts = {
        "hedged.md": "CodeQL, when available, passed.\n" + "-" * 100 + "\nSemgrep has passed.",
        "only.md": "The optional Semgrep scan passed.",
        "same.md": "A skipped check counts as passed. A skipped check is the same as passed.",
        "secret.md": "We cannot prove complete secret absence." + " " * 80 + "This gives exhaustive secret detection.",
        "net.md": "It guarantees no network." + "-" * 70 + " Not full network isolation." + "-" * 70 + " Full network isolation.",
        "claims.md": "A manual pentest is implemented. Android support is current. The attack scenario is planned.",
        "old.md": "one\nsecurity\nsince v0.2.1\nend\n\n\n\nprevious security\nv0.2.1",
        "CHANGELOG.md": "security v0.2.1",
        "large.md": "Semgrep passed. " + "x" * 200_000,
    }
    docs = spark.createDataFrame(list(texts.items()), "path string, content string")
    got = lambda **kw: sorted((r.file, r.id.split(":", 1)[1].rsplit(":" + r.file, 1)[0], r.line) for r in rot.security_claims(docs, **kw).collect())
    always = [("claims.md", "unsupported-current-claim:manual-pentest", 1), ("hedged.md", "tool-passed-without-hedge", 3), ("net.md", "complete-network-isolation-claim", 1), ("same.md", "skipped-equals-passed", 1), ("secret.md", "exhaustive-secret-claim", 1)]
    android = ("claims.md", "unsupported-current-claim:android-validation", 1)
    assert got() == sorted([*always, android])
    assert got(version="0.4.0", scenarios_exist=True, android_exists=True) == sorted([*always, ("claims.md", "attack-scenarios-planned-but-implemented", 1), ("old.md", "stale-v021-security-mention", 3)])
    assert got(version="0.2.1") == got()
    assert ("hedged.md", "tool-passed-without-hedge", 3) not in got(first_only=True) and ("secret.md", "exhaustive-secret-claim", 1) not in got(first_only=True)


def test_cross_platform(spark):
    scripts = spark.createDataFrame([("a", "tsc && rm -rf x && rm -rf y"), ("b", "node grep.js"), ("c", "mv"), ("d", "  cat f"), ("e", "x=$(ls) && export A=1"), ("f", "find . -name x")], "name string, command string")
    assert sorted((r.id.rsplit(":")[-1], r.severity, r.message) for r in rot.posix_scripts(scripts).collect()) == [("a", "medium", "rm -rf x"), ("d", "medium", "cat f"), ("f", "medium", "find . -name x")]
    docs = spark.createDataFrame([("d", "on Windows too")], "path string, content string")
    assert {r.severity for r in rot.posix_scripts(scripts, docs).collect()} == {"high"} and {r.severity for r in rot.posix_scripts(scripts, docs.limit(0)).collect()} == {"medium"}
    sources = spark.createDataFrame([("src/audits/a.ts", r"""x.split("\n"); y.split('\\')"""), ("src/audits/textLines.ts", r'x.split("\n")'), ("src/other.ts", r'x.split("\n")'), ("src/audits/b.ts", "shell: true" + " " * 200 + "exec(a, { shell: true })"), ("src/audits/c.ts", "shell: true" + " " * 200 + "exec(a)")], "path string, content string")
    assert sorted((r.file, r.message) for r in rot.cross_platform_sources(sources).collect()) == [("src/audits/a.ts", "raw-backslash-split"), ("src/audits/a.ts", "raw-split-newline"), ("src/audits/b.ts", "shell-true-usage")]


def test_size_limit_is_by_content(spark):
    docs = spark.createDataFrame([("a", "npm run gone\n" + "x" * 300_000), ("b", "npm run gone")], "path string, content string")
    scripts = spark.createDataFrame([("ok", "x")], "name string, command string")
    assert [r.file for r in rot.stale_commands(docs, scripts).collect()] == ["b"] and [r.file for r in rot.stale_commands(docs.withColumn("size_bytes", F.lit(1)), scripts).collect()] == ["b"]
