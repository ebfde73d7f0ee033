"""Queries of the detector, scanner, Android and answer families; inputs are texts and structs made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import android, answers, audit, facts, rot, security
from veritrail.sources import scanners
from veritrail.sources.tables import table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as source files that import the file of the next-but-two part."""
    k = F.col("p_partkey")
    folder = F.get(F.array(*[F.lit(x) for x in ("src/a", "src/b", "scripts/c", "benchmarks/d")]), (k % 4).cast("int"))
    content = F.concat(F.lit("import x from './f"), ((k + 3) % 60).cast("string"), F.lit(".js'\nexport function g"), (k % 440).cast("string"), F.lit("() {}\nfunction own() {}\n"))
    path = F.concat(folder, F.lit("/f"), (k % 75).cast("string"), F.lit("."), F.when(k % 2 == 0, "ts").otherwise("mts"))
    return table(spark, sf_dir, "part").select(path.alias("path"), content.alias("content"), F.length(content).alias("size_bytes"), F.lit("typescript").alias("language"), F.lit("source").alias("role"))


def unreferenced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return rot.unreferenced_files(files.dropDuplicates(["path"]), files, ["src/a/f64.ts"]).select("id", "file", "severity")


def duplicate_basenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rot.duplicate_basenames(_files(spark, sf_dir)).select("id", "message")


def duplicate_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rot.duplicate_exports(facts.source_facts(_files(spark, sf_dir))).select("id", "message")


def stale_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per customer: two references, the second below a heading that may be planned."""
    k = F.col("c_custkey")
    content = F.concat(F.lit("# Use\nnpm run s"), (k % 9).cast("string"), F.lit("\n"), F.repeat(F.lit("text\n"), 20), F.when(k % 2 == 0, "## Planned\n").otherwise("## Now\n"), F.lit("npm run --silent s"), (k % 7 + 5).cast("string"), F.lit("\n"))
    docs = table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), k.cast("string"), F.lit(".md")).alias("path"), content.alias("content"), F.length(content).alias("size_bytes"))
    scripts = table(spark, sf_dir, "region").select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("name"))
    return rot.stale_commands(docs, scripts).select("id", "file", "line")


def npm_audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit document per nation with a transitive entry and, for most, one advisory."""
    n = F.col("n_nationkey")
    severity = F.get(F.array(*[F.lit(x) for x in ("critical", "high", "moderate", "low", "info")]), (n % 5).cast("int"))
    raw = F.concat(F.lit('{"vulnerabilities": {"p'), n.cast("string"), F.lit('": {"name": "p", "severity": "'), severity, F.lit('", "via": ["q"'), F.when(n % 4 > 0, F.concat(F.lit(', {"title": "T'), n.cast("string"), F.lit('", "url": "u", "severity": "low"}'))).otherwise(""), F.lit("]}}}"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), F.when(n % 6 == 5, "{bad").otherwise(raw).alias("raw"))
    return scanners.npm_audit(rows)


def malformed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("source"), F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("x"), "props")).when(F.col("event_id") % 10 == 1, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(F.col("event_id") % 10 == 2, "").otherwise(F.col("props")).alias("raw"))
    return scanners.malformed(e)


def exported_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as components: export state, permission and filters by key."""
    k = F.col("s_suppkey")
    cell = F.struct(
        F.when(k % 5 == 0, "provider").otherwise("activity").alias("kind"),
        F.col("s_name").alias("name"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("exported"),
        F.when((k % 3 == 2) & (k % 13 == 0), "@bool/x").alias("exportedRaw"),
        F.when(k % 7 == 0, "p").alias("permission"),
        F.when(k % 10 == 0, "r").alias("readPermission"),
        F.lit(None).cast("string").alias("writePermission"),
        (k % 2).cast("int").alias("intentFilterCount"),
        (k % 11 == 0).alias("isLauncher"),
    )
    m = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("manifest_path"), F.when(k % 23 == 0, "q").alias("application_permission"), F.array(cell).alias("components"))
    return android.exported_findings(m)


def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    c = e.select(F.when(F.col("value") > 80, "high").otherwise("low").alias("confidence"), F.when(F.col("event_id") % 4 == 0, "unresolved").otherwise("resolved").alias("resolution_state"), F.col("event_type").alias("category"))
    return security.candidate_summary(c)


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    out = F.when(k % 3 == 0, F.concat(F.lit('{"input_tokens": '), k.cast("string"), F.lit(', "output_tokens": 7} {"input_tokens": 5}'))).when(k % 3 == 1, F.concat(F.lit("Total tokens: "), k.cast("string"))).otherwise("nothing")
    return answers.token_usage(table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), out.alias("output"))).drop("output")


def detector_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "nation").select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("detector_id"))
    issues = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("d"), (F.col("user_id") % 20).cast("string")).alias("detector_id"))
    return audit.detector_report(registry, issues)


QUERIES = {f.__name__: f for f in (unreferenced_files, duplicate_basenames, duplicate_exports, stale_commands, npm_audit_findings, malformed_outputs, exported_components, candidate_summary, token_usage, detector_report)}

_FILES = """
p AS (SELECT ['src/a', 'src/b', 'scripts/c', 'benchmarks/d'][p_partkey % 4 + 1] AS d, 'f' || (p_partkey % 75) AS b, CASE WHEN p_partkey % 2 = 0 THEN 'ts' ELSE 'mts' END AS e, 'f' || ((p_partkey + 3) % 60) AS i, 'g' || (p_partkey % 440) AS g,
  length('import x from ''./f' || ((p_partkey + 3) % 60) || '.js''' || 'export function g' || (p_partkey % 440) || '() {}function own() {}') + 3 AS n FROM part)"""

ORACLE_SQL = {
    "unreferenced_files": f"WITH {_FILES} SELECT DISTINCT 'dead-code-candidate:unreferenced-source-file:' || d || '/' || b || '.' || e AS id, d || '/' || b || '.' || e AS file, 'low' AS severity FROM p WHERE d <> 'benchmarks/d' AND b NOT IN (SELECT i FROM p) AND d || '/' || b || '.' || e <> 'src/a/f64.ts'",
    "duplicate_basenames": f"WITH {_FILES} SELECT 'duplicate-implementation-candidate:basename-repeat:' || b AS id, string_agg(DISTINCT d, ', ' ORDER BY d) AS message FROM p WHERE d <> 'benchmarks/d' GROUP BY b HAVING count(DISTINCT d) BETWEEN 2 AND 3",
    "duplicate_exports": f"WITH {_FILES} SELECT 'duplicate-implementation-candidate:export-repeat:typescript-javascript:function:' || g AS id, 'declared in ' || count(DISTINCT d || b || e) || ' files' AS message FROM p GROUP BY g HAVING count(DISTINCT d || b || e) BETWEEN 2 AND 4",
    "stale_commands": """WITH r AS (SELECT 'd' || c_custkey || '.md' AS file, 's' || (c_custkey % 9) AS c, 2 AS line, false AS planned FROM customer
UNION ALL SELECT 'd' || c_custkey || '.md', 's' || (c_custkey % 7 + 5), 24, c_custkey % 2 = 0 FROM customer)
SELECT 'stale-command-reference:missing-script:' || file || ':' || c AS id, file, CAST(min(line) AS INTEGER) AS line FROM r WHERE NOT planned AND c NOT IN (SELECT 's' || r_regionkey FROM region) GROUP BY file, c""",
    "npm_audit_findings": """WITH n AS (SELECT * FROM nation WHERE n_nationkey % 6 <> 5)
SELECT n_name AS source, 'p' || n_nationkey AS package, ['blocker', 'blocker', 'major', 'minor', 'informational'][n_nationkey % 5 + 1] AS severity, CASE WHEN n_nationkey % 4 > 0 THEN 'T' || n_nationkey END AS title, CASE WHEN n_nationkey % 4 > 0 THEN 'u' END AS url FROM n""",
    "malformed_outputs": "SELECT event_id::VARCHAR AS source, CASE event_id % 10 WHEN 0 THEN 'malformed' WHEN 1 THEN 'not-an-object' ELSE 'empty' END AS code FROM events WHERE event_id % 10 < 3",
    "exported_components": """WITH k AS (SELECT *, s_suppkey AS k FROM supplier),
r AS (SELECT s_nationkey::VARCHAR AS manifest_path, CASE WHEN k % 5 = 0 THEN 'provider' ELSE 'activity' END AS kind, s_name AS name,
  CASE k % 3 WHEN 2 THEN CASE WHEN k % 13 = 0 THEN 'component-malformed-exported' WHEN k % 2 = 1 THEN 'component-unspecified-exported-with-filter' END
  WHEN 0 THEN CASE WHEN k % 5 = 0 THEN CASE WHEN k % 7 = 0 THEN 'provider-exported-protected' WHEN k % 10 = 0 THEN 'provider-exported-partial-protection' ELSE 'provider-exported-unprotected' END
    WHEN k % 7 = 0 OR k % 23 = 0 THEN 'component-exported-protected' WHEN k % 11 = 0 THEN 'component-launcher-activity-exported' ELSE 'component-exported-unprotected' END END AS rule FROM k)
SELECT manifest_path, kind, name, 'android-' || rule AS rule, CASE WHEN rule = 'provider-exported-unprotected' THEN 'major' WHEN rule IN ('provider-exported-protected', 'component-exported-protected', 'component-launcher-activity-exported') THEN 'informational' ELSE 'minor' END AS severity FROM r WHERE rule IS NOT NULL""",
    "candidate_summary": """SELECT 'confidence' AS dimension, CASE WHEN value > 80 THEN 'high' ELSE 'low' END AS value, count(*) AS n FROM events GROUP BY 2
UNION ALL SELECT 'resolution_state', CASE WHEN event_id % 4 = 0 THEN 'unresolved' ELSE 'resolved' END, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'category', event_type, count(*) FROM events GROUP BY 2""",
    "token_usage": """SELECT event_id AS run_id, CASE WHEN event_id % 3 = 0 THEN greatest(event_id, 5) END AS input_tokens, CASE WHEN event_id % 3 = 0 THEN 7::BIGINT END AS output_tokens, NULL::BIGINT AS reasoning_tokens,
  CASE event_id % 3 WHEN 0 THEN greatest(event_id, 5) + 7 WHEN 1 THEN event_id END AS total_tokens, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS reliability FROM events""",
    "detector_report": "SELECT 'd' || n_nationkey AS detector_id, count(e.user_id) AS issues FROM nation LEFT JOIN (SELECT user_id FROM events WHERE event_type = 'error') e ON e.user_id % 20 = n_nationkey GROUP BY 1",
}
