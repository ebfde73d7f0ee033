"""Queries of test-file checks, secret values and full-file baselines; inputs are texts made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import expectations, facts, import_checks, security
from veritrail.sources.tables import table


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as TypeScript, Python and Java files."""
    k, s = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    path = F.when(k % 3 == 0, F.concat(F.lit("src/f"), s, F.lit(".ts"))).when(k % 3 == 1, F.concat(F.lit("tests/f"), s, F.lit(".py"))).otherwise(F.concat(F.lit("src/main/java/com/b/F"), s, F.lit(".java")))
    return table(spark, sf_dir, "supplier").select(path.alias("path"))


def missing_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as test files of three languages, each with one local import and one of a library."""
    k, p = F.col("p_partkey"), F.col("p_partkey").cast("string")
    n = (k % 150).cast("string")
    language = F.when(k % 3 == 0, "typescript").when(k % 3 == 1, "python").otherwise("java")
    path = F.when(k % 3 == 0, F.concat(F.lit("tests/u/t"), p, F.lit(".test.ts"))).when(k % 3 == 1, F.concat(F.lit("tests/py/test_"), p, F.lit(".py"))).otherwise(F.concat(F.lit("src/test/java/T"), p, F.lit(".java")))
    content = F.when(k % 3 == 0, F.concat(F.lit("import a from './../../src/f"), n, F.lit(".js'\nimport v from 'vitest'\n"))).when(k % 3 == 1, F.concat(F.lit("from ..f"), n, F.lit(" import x\nimport os\n"))).otherwise(F.concat(F.lit("import java.util.List;\nimport com.a.F"), n, F.lit(";\n")))
    tests = table(spark, sf_dir, "part").select(path.alias("path"), language.alias("language"), F.lit("test").alias("role"), F.length(content).alias("size_bytes"), content.alias("content"))
    return import_checks.missing_imports(facts.source_facts(tests), _inventory(spark, sf_dir)).select("id", "file", "kind", "severity", "confidence")


def stale_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as test files: a title with a version, every fifth a past one on purpose."""
    k = F.col("c_custkey")
    content = F.concat(F.lit("// v9.9.9\nit('"), F.when(k % 5 == 0, "legacy ").otherwise("runs "), F.lit("v1."), (k % 4).cast("string"), F.lit(".0', go)\n"))
    tests = table(spark, sf_dir, "customer").select(F.concat(F.lit("t"), k.cast("string")).alias("path"), content.alias("content"))
    return import_checks.stale_versions(tests, "1.2.0").select("id", "file", "line", "severity")


def missing_test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scripts that run a folder, a file that may be there, or another tool."""
    k = F.col("c_custkey")
    named = F.when(k % 4 == 0, "src").otherwise(F.concat(F.lit("'src/f"), (k % 120).cast("string"), F.lit(".ts'")))
    command = F.concat(F.when(k % 7 == 0, "jest run ").otherwise("vitest run "), named, F.lit(" && echo done"))
    scripts = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), k.cast("string")).alias("name"), command.alias("command"))
    return import_checks.missing_test_paths(scripts, _inventory(spark, sf_dir)).select("id", "severity")


def secret_value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    value = F.get(F.array(*[F.lit(v) for v in ("  ", " ChangeMe", "*****", "${KEY}", "a $TOKEN", "%HOME%", "@string/key")], F.concat(F.lit("k"), k.cast("string")), F.lit(None).cast("string")), (k % 9).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", security.value_kind(value).alias("kind"))


def full_file_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of their source."""
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return expectations.full_file_baseline(files)


QUERIES = {f.__name__: f for f in (missing_imports, stale_versions, missing_test_paths, secret_value_kinds, full_file_baseline)}

ORACLE_SQL = {
    "missing_imports": """WITH t AS (SELECT p_partkey % 3 AS g, p_partkey % 150 AS n, CASE p_partkey % 3 WHEN 0 THEN 'tests/u/t' || p_partkey || '.test.ts' WHEN 1 THEN 'tests/py/test_' || p_partkey || '.py' ELSE 'src/test/java/T' || p_partkey || '.java' END AS file FROM part),
m AS (SELECT *, CASE g WHEN 0 THEN 'missing-source-import' WHEN 1 THEN 'missing-python-source-import' ELSE 'missing-jvm-source-import' END AS kind,
  CASE g WHEN 0 THEN './../../src/f' || n || '.js' WHEN 1 THEN '..f' || n ELSE 'com.a.F' || n END AS source FROM t WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = n AND s_suppkey % 3 = g))
SELECT 'test-rot:import:' || file || ':' || kind || ':' || source AS id, file, kind, CASE g WHEN 0 THEN 'medium' ELSE 'low' END AS severity, CASE g WHEN 0 THEN 'high' ELSE 'low' END AS confidence FROM m""",
    "stale_versions": "SELECT 'test-rot:stale-version-mention:t' || c_custkey || ':2:1.' || (c_custkey % 4) || '.0' AS id, 't' || c_custkey AS file, 2 AS line, 'low' AS severity FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 4 <> 2",
    "missing_test_paths": "SELECT 'test-rot:script-references-missing-test-path:s' || c_custkey || ':src/f' || (c_custkey % 120) || '.ts' AS id, 'medium' AS severity FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey % 120 AND s_suppkey % 3 = 0)",
    "secret_value_kinds": "SELECT c_custkey, CASE WHEN c_custkey % 9 < 3 THEN 'suppressed' WHEN c_custkey % 9 < 7 THEN 'reference' WHEN c_custkey % 9 = 7 THEN 'literal' END AS kind FROM customer",
    "full_file_baseline": """WITH t AS (SELECT source AS case_id, count(*) AS total_files, CAST(sum(length('=== FILE: d/' || doc_id || ' ===') + 2 + length(coalesce(text, ''))) + count(*) - 1 AS BIGINT) AS total_chars FROM documents GROUP BY source)
SELECT *, CAST(ceil(total_chars / 4) AS BIGINT) AS total_estimated_tokens FROM t""",
}
