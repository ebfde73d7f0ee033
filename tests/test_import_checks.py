"""Test-file checks, path folding, secret values and baselines on small tables."""

from pyspark.sql import functions as F

from veritrail.functions import text as X
from veritrail.operators import expectations, facts, import_checks, rot, security

FILES = "path string, language string, role string, size_bytes int, content string"


def test_normal_path(spark):
    cases = {"a/./b//c": "a/b/c", "a/../b": "b", "../x": "../x", "a/../../x": "../x", "..": "..", "": "", "a/..": "", "a/b/../../c/": "c"}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", X.normal_path(F.col("p")).alias("v")).collect()
    assert {r.p: r.v for r in got} == cases
    assert spark.range(1).select(X.normal_path(F.lit(None).cast("string")).alias("v")).first().v is None


def test_missing_imports(spark):
    tests = [
        ("tests/a.test.ts", "typescript", "import x from '../src/here.js'\nimport y from '../src/gone'\nimport z from '../src'\nimport v from 'vitest'\nimport up from '..'"),
        ("tests/pkg/test_b.py", "python", "from . import near, far\nfrom ..lib.mod import f\nfrom .gone import g\nimport os\nfrom ....top import h"),
        ("src/test/java/C.java", "java", "import org.junit.Test;\nimport com.x.Known;\nimport static com.x.Known.member;\nimport com.x.Lost;\nimport com.x.*;"),
        ("src/test/kotlin/D.kt", "kotlin", "import com.x.Known\nimport com.x.Nowhere"),
        ("a.test.ts", "typescript", None),
    ]
    table = spark.createDataFrame([(p, lang, "test", 9, c) for p, lang, c in tests] + [("src/s.ts", "typescript", "source", 9, "import q from './nothing'")], FILES)
    there = spark.createDataFrame([("src/here.ts",), ("tests/pkg/near.py",), ("tests/lib/mod/__init__.py",), ("top.py",), ("lib/com/x/Known.java",)], "path string")
    got = import_checks.missing_imports(facts.source_facts(table), there).collect()
    assert sorted(r.message.rsplit(" ")[-1] for r in got) == ["../src/gone", ".gone", "com.x.Lost", "com.x.Nowhere"]
    assert {(r.kind, r.severity, r.confidence) for r in got} == {("missing-source-import", "medium", "high"), ("missing-python-source-import", "low", "low"), ("missing-jvm-source-import", "low", "low")}
    assert import_checks.missing_imports(facts.source_facts(table.limit(0)), there).count() == 0
    alone = import_checks.missing_imports(facts.source_facts(table), there.limit(0)).collect()
    script, python, java, kotlin = ["../src", "../src/gone", "../src/here.js"], ["....top", ".", "..lib.mod", ".gone"], ["com.x.Known", "com.x.Known.member", "com.x.Lost"], ["com.x.Known", "com.x.Nowhere"]
    assert sorted(r.message.rsplit(" ")[-1] for r in alone) == sorted(script + python + java + kotlin)


def test_versions_paths_and_focus(spark):
    tests = spark.createDataFrame([("t.ts", "it('v1.0.0 works')\nit(\"v2.0.0\")\ntest(`legacy v0.1.0`)\n// v3.0.0\nit.skip ('a')\nit.only('b')")], "path string, content string")
    assert [(r.line, r.severity) for r in import_checks.stale_versions(tests, "2.0.0").collect()] == [(1, "low")]
    assert sorted(r.severity for r in rot.focused_tests(tests).collect()) == ["high", "medium"]
    scripts = spark.createDataFrame([("a", "vitest run tests/x"), ("b", "vitest run 'tests/x/y.ts' && vitest run \"gone\""), ("c", "npm test"), ("d", None)], "name string, command string")
    files = spark.createDataFrame([("tests/x/y.ts",)], "path string")
    assert [r.message for r in import_checks.missing_test_paths(scripts, files).collect()] == ["no such test path: gone"]


def test_secret_values(spark):
    kinds = {"": "suppressed", " \t\n": "suppressed", "TODO ": "suppressed", "0000": "suppressed", "x": "suppressed", "ab": "literal", "${A}": "reference", "see $VAR": "reference", "%A%": "reference", "@xml/a": "reference", "a@xml/a": "literal", "s3cr3t": "literal", None: None}
    got = spark.createDataFrame([(k,) for k in kinds], "v string").select("v", security.value_kind(F.col("v")).alias("k")).collect()
    assert {r.v: r.k for r in got} == kinds


def test_full_file_baseline(spark):
    files = spark.createDataFrame([("c", "b.ts", "x😀"), ("c", "a.ts", ""), ("d", "z", None)], "case_id string, path string, content string")
    text = {"c": "=== FILE: a.ts ===\n\n\n=== FILE: b.ts ===\nx😀\n", "d": "=== FILE: z ===\n\n"}
    got = {r.case_id: r for r in expectations.full_file_baseline(files).collect()}
    for case, whole in text.items():
        n = len(whole.encode("utf-16-le")) // 2
        assert (got[case].total_chars, got[case].total_estimated_tokens) == (n, -(-n // 4))
    parts = expectations.full_file_parts(files).where("case_id = 'c'").orderBy("path").collect()
    assert "\n".join(r.part for r in parts) == text["c"]


def test_facts_of_one_file_are_dealt_out_and_made_once(spark):
    """A small table lies in one task; no filter that Spark infers for the explode may do the work before the rows are dealt out."""
    from pyspark.sql import functions as F

    from veritrail.operators import facts

    files = spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("path"), F.lit("typescript").alias("language"), F.lit("source").alias("role"), F.concat(F.lit("import a from './m"), F.col("id").cast("string"), F.lit("'\n")).alias("content"))
    found = facts.source_facts(files).select("path", F.explode("imports").alias("i"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_extract_all" in line]
    assert sorted(r[0] for r in found.select("i.source").collect()) == sorted(f"./m{i}" for i in range(40))
