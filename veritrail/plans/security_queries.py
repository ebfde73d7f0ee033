"""Queries of scanner severities, Android audits and verdicts, and roll-ups; inputs are texts and structs made of the test tables.

The SQL twins take their severities from the published rules, not from the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import android, audit, expectations, facts, reporting, rot, tasks
from veritrail.sources import scanners
from veritrail.sources.tables import table


def _pick(k: Column, *values: str | None) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values)).cast("int"))


def _json(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("source"))


def npm_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k").cast("string")
    raw = F.when(F.col("k") % 5 == 0, "[]").otherwise(_json('{"metadata": {"vulnerabilities": {"high": ', k, ', "low": 2, "total": ', k, "}}}"))
    return scanners.npm_audit_counts(_parts(spark, sf_dir).select("source", raw.alias("raw")))


def semgrep_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    raw = _json('{"results": [{"check_id": "r', k.cast("string"), '", "path": "p", "start": {"line": 3}, "extra": {"severity": "', _pick(k, "ERROR", "WARNING", "INFO", "warning", "EXPERIMENT"), '"}}]}')
    return scanners.semgrep(_parts(spark, sf_dir).select("source", raw.alias("raw"))).select("source", "rule", "severity", "truncated")


def osv_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named levels, scores as numbers and as vectors, and neither; without a path or a severity a candidate."""
    k = F.col("k")
    named = _pick(k, "CRITICAL", "high", "Moderate", "MEDIUM", "LOW", "odd", None)
    own = F.coalesce(_json('"database_specific": {"severity": "', named, '"}, '), F.lit(""))
    score = _pick(F.floor(k / 7), '[{"score": "9.8"}]', '[{"score": "CVSS:3.1/AV:N"}, {"score": "4.0"}]', '[{"score": "0.1"}]', "[]")
    raw = _json('{"results": [{"source": {', F.when(k % 2 == 0, '"path": "l"').otherwise(""), '}, "packages": [{"package": {"name": "p"}, "vulnerabilities": [{"id": "V", ', own, '"severity": ', score, "}]}]}]}")
    return scanners.osv(_parts(spark, sf_dir).select("source", raw.alias("raw"))).select("source", "severity", "kind")


def dependency_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    v3 = _pick(k, ', "cvssv3": {"baseScore": 7.0}', ', "cvssv3": {"baseScore": 3.9}', ', "cvssv3": {"baseScore": 0.0}', "")
    v2 = _pick(F.floor(k / 4), ', "cvssv2": {"score": 4.0}', "", "")
    raw = _json('{"dependencies": [{"fileName": "f", "filePath": "p", "vulnerabilities": [{"name": "V", "severity": "', _pick(F.floor(k / 12), "CRITICAL", "high", "Medium", "LOW", "MODERATE"), '"', v3, v2, "}]}]}")
    return scanners.dependency_check(_parts(spark, sf_dir).select("source", raw.alias("raw"))).select("source", "severity")


def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    level = _pick(k, "error", "Warning", "note", "fatal", "Information", "ignore")
    sarif = _json('{"runs": [{"results": [{"ruleId": "r", "level": "', level, '", "message": {"text": "m"}}]}]}')
    xml = _json('<issues><issue id="r" severity="', level, '" message="m"><location file="f" line="3"/></issue></issues>')
    made = _parts(spark, sf_dir)
    one = scanners.lint_sarif(made.select("source", sarif.alias("raw"))).select("source", F.lit("sarif").alias("form"), "severity")
    return one.unionByName(scanners.lint_xml(made.select("source", xml.alias("raw"))).select("source", F.lit("xml").alias("form"), "severity"))


PERMISSIONS = ["android.permission.INTERNET", "android.permission.CAMERA", "android.permission.ACCESS_BACKGROUND_LOCATION", "android.permission.ACCESS_FINE_LOCATION", "com.acme.CUSTOM", "android.permission.POST_NOTIFICATIONS", "android.permission.SYSTEM_ALERT_WINDOW"]


def permission_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    names = F.transform(F.array(k, F.floor(k / 7), k), lambda i: F.struct(F.get(F.array(*[F.lit(p) for p in PERMISSIONS]), (i % 7).cast("int")).alias("name")))
    return android.permission_findings(table(spark, sf_dir, "customer").select(k.cast("string").alias("manifest_path"), names.alias("permissions")))


def _filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as filters: actions, categories and data by key."""
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    actions = F.when(k % 6 == 0, none).when(k % 6 == 1, F.array(F.lit("my.ACTION"))).when(k % 6 == 2, F.array(F.lit(android.MAIN))).when(k % 6 == 3, F.array(F.lit(android.VIEW), F.lit(android.VIEW))).otherwise(F.array(F.lit(android.VIEW)))
    categories = F.when(k % 4 == 0, none).when(k % 4 == 1, F.array(F.lit("android.intent.category.LAUNCHER"))).when(k % 4 == 2, F.array(F.lit(android.BROWSABLE))).otherwise(F.array(F.lit(android.BROWSABLE), F.lit("x.CAT")))
    data = F.struct(_pick(k, "https", "my", None, "@s").alias("scheme"), _pick(F.floor(k / 4), "h", None).alias("host"), F.lit(None).cast("string").alias("path"), _pick(F.floor(k / 8), "/a", "${x}", None).alias("pathPrefix"), _pick(F.floor(k / 24), ".*", "/b", None).alias("pathPattern"))
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("manifest_path"),
        F.lit("activity").alias("kind"),
        F.col("c_name").alias("component"),
        F.when(k % 5 < 2, True).when(k % 5 == 2, False).alias("exported"),
        F.when(k % 5 == 3, "@bool/x").alias("exported_raw"),
        F.when(k % 3 == 0, "p").alias("permission"),
        actions.alias("actions"),
        categories.alias("categories"),
        F.when(k % 7 == 0, F.array().cast("array<struct<scheme:string,host:string,path:string,pathPrefix:string,pathPattern:string>>")).otherwise(F.array(data)).alias("data"),
    )


def intent_filter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return android.intent_filter_findings(_filters(spark, sf_dir)).select("component", "rule", "severity")


def deep_link_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return android.deep_link_findings(_filters(spark, sf_dir)).select("component", "rule", "severity")


def _android_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as runs, their orders as checks and, where urgent, as findings."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    runs = table(spark, sf_dir, "customer").select(
        k.alias("run_id"),
        F.when(k % 11 == 0, "non-android").when(k % 13 == 0, "partial").otherwise("application").alias("project_kind"),
        F.when(k % 17 == 0, 1).otherwise(0).alias("unexpected_changes"),
        (k % 19 == 0).alias("multiple_application_modules"),
        (k % 2).cast("int").alias("manual_play_items"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    checks = orders.select(F.col("o_custkey").alias("run_id"), o.alias("id"), _pick(o, "android-gradle", "android-permissions", "android-webview").alias("category"), F.when(o % 2 == 0, "required").otherwise("optional").alias("requirement_level"), F.when(o % 37 == 0, "failed").when(o % 41 == 0, "error").when(o % 43 == 0, "unsupported").when(o % 5 == 0, "skipped").otherwise("passed").alias("status"))
    findings = orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("run_id"), o.alias("id"), F.when(o % 97 == 0, "blocker").when(o % 53 == 0, "major").when(o % 4 == 0, "minor").otherwise("skipped").alias("severity"))
    return checks, findings, runs


def android_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return android.verdict(*_android_runs(spark, sf_dir))


def android_verdict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return android.verdict_reasons(*_android_runs(spark, sf_dir)).groupBy("code", "impact").agg(F.count(F.lit(1)).alias("n"))


def unimported_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files; each declares a function and imports one or two by name, and facts are taken from their text."""
    k = F.col("p_partkey")
    content = F.concat(F.lit("import { f"), ((k * 3) % 500).cast("string"), F.lit(", other as f"), ((k * 7) % 900).cast("string"), F.lit(" } from './x.js'\nexport function f"), k.cast("string"), F.lit("() {}\nconst own = 1\n"))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("src/p"), k.cast("string"), F.lit(".ts")).alias("path"), content.alias("content"), F.length(content).alias("size_bytes"), F.lit("typescript").alias("language"), F.lit("source").alias("role"))
    return rot.unimported_declarations(facts.source_facts(files)).select("id", "file", "line")


def high_priority_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return tasks.high_priority_open(c.select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("title"), F.when(F.col("c_mktsegment") == "BUILDING", "high").otherwise("low").alias("priority"), (F.col("c_acctbal") < 0).alias("completed")))


def variant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of a report: every nation with the statuses of its customers, 0 where it has none."""
    variants = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("variant_id"))
    k = F.col("c_custkey")
    outcomes = table(spark, sf_dir, "customer").where("c_nationkey < 22").select(F.col("c_nationkey").alias("variant_id"), _pick(k, *reporting.OUTCOMES).alias("status"))
    return reporting.variant_summary(variants, outcomes)


def strategy_input_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("strategy_id"))
    inputs = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select((F.col("s_nationkey") + 3).alias("strategy_id"))
    return reporting.strategy_input_issues(selected, inputs)


def responsibility_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return expectations.responsibility_completeness(table(spark, sf_dir, "events").select(_pick(k, "mapped", "partial", "mapped", "missing", "not-applicable").alias("mapping_status")))


def compare_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance"), F.lit("status").alias("field"), "o_orderstatus", "o_orderpriority")
    expected = o.select("instance", "field", F.col("o_orderstatus").alias("value"))
    actual = o.where("o_orderpriority <> '5-LOW'").select("instance", "field", F.when(F.col("o_orderpriority") == "2-HIGH", "F").when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderstatus")).alias("value"))
    return expectations.compare_states(expected, actual)


def field_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    side = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    pairs = table(spark, sf_dir, "customer").select(k.alias("pair_id"), side(k % 3, F.when(k % 5 > 0, "v")).alias("capsule"), side(k % 2, F.when(k % 7 > 0, "v")).alias("audit"))
    return expectations.field_consistency(pairs, ["x", "y"]).select("pair_id", "field")


def security_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    found = table(spark, sf_dir, "events").select(k.alias("ord"), k.cast("string").alias("id"), F.lit("npm").alias("check_id"), _pick(k, "blocker", "major", "minor", "informational", "skipped").alias("severity"), F.lit("t").alias("title"))
    return audit.findings_to_issues(found).groupBy("severity", "release_blocking", "detector_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (npm_audit_counts, semgrep_findings, osv_findings, dependency_findings, lint_findings, permission_findings, intent_filter_findings, deep_link_findings, android_verdict, android_verdict_reasons, unimported_declarations, high_priority_open, variant_summary, strategy_input_issues, responsibility_completeness, compare_states, field_consistency, security_issues)
}


_FILTERS = """
k AS (SELECT c_custkey AS k, c_name AS component, c_custkey % 5 < 2 AS open, c_custkey % 5 = 4 AS unset, c_custkey % 3 <> 0 AS bare, c_custkey % 7 = 0 AS no_data, ['https', 'my', NULL, '@s'][c_custkey % 4 + 1] AS scheme,
  (c_custkey // 4) % 2 = 0 AS host, (c_custkey // 8) % 3 = 1 AS held, (c_custkey // 24) % 3 = 0 AS broad, c_custkey % 6 AS a, c_custkey % 4 AS c FROM customer)"""
_VERDICT = """
f AS (SELECT o_custkey AS run_id, CASE WHEN o_orderkey % 97 = 0 THEN 'blocker' WHEN o_orderkey % 53 = 0 THEN 'major' WHEN o_orderkey % 4 = 0 THEN 'minor' END AS s FROM orders WHERE o_orderkey % 3 = 0),
c AS (SELECT o_custkey AS run_id, o_orderkey % 3 AS kind, o_orderkey % 2 = 0 AS must, CASE WHEN o_orderkey % 37 = 0 THEN 'failed' WHEN o_orderkey % 41 = 0 THEN 'error' WHEN o_orderkey % 43 = 0 THEN 'unsupported' WHEN o_orderkey % 5 = 0 THEN 'skipped' END AS s FROM orders),
r AS (SELECT run_id, 0 AS stage, 'android-blocker-finding' AS code FROM f WHERE s = 'blocker' UNION ALL SELECT run_id, 1, 'android-major-finding' FROM f WHERE s = 'major'
  UNION ALL SELECT c_custkey, 2, 'android-unexpected-target-modification' FROM customer WHERE c_custkey % 17 = 0 UNION ALL SELECT run_id, 3, 'android-required-check-failed' FROM c WHERE must AND kind = 0 AND s = 'failed'
  UNION ALL SELECT c_custkey, 4, 'android-profile-mismatch' FROM customer WHERE c_custkey % 11 = 0 UNION ALL SELECT c_custkey, 5, 'android-partial-detection' FROM customer WHERE c_custkey % 13 = 0 AND c_custkey % 11 <> 0
  UNION ALL SELECT run_id, 5, 'android-required-check-inconclusive' FROM c WHERE must AND kind < 2 AND s = 'error' UNION ALL SELECT run_id, 5, 'android-required-check-unsupported' FROM c WHERE must AND kind < 2 AND s = 'unsupported'
  UNION ALL SELECT c_custkey, 5, 'android-multiple-application-modules' FROM customer WHERE c_custkey % 19 = 0 UNION ALL SELECT run_id, 6, 'android-review-finding' FROM f WHERE s = 'minor'
  UNION ALL SELECT run_id, 6, 'android-optional-check-not-run' FROM c WHERE NOT must AND s = 'skipped' UNION ALL SELECT run_id, 6, 'android-optional-check-failed' FROM c WHERE NOT must AND s = 'failed'
  UNION ALL SELECT c_custkey, 6, 'android-play-readiness-manual-items' FROM customer WHERE c_custkey % 2 = 1),
g AS (SELECT * FROM r QUALIFY stage = min(stage) OVER (PARTITION BY run_id))"""

ORACLE_SQL = {
    "npm_audit_counts": "SELECT p_partkey::VARCHAR AS source, l AS level, CASE l WHEN 'high' THEN p_partkey WHEN 'total' THEN p_partkey WHEN 'low' THEN 2 ELSE 0 END::BIGINT AS n FROM part, (SELECT unnest(['critical', 'high', 'moderate', 'low', 'info', 'total']) AS l) WHERE p_partkey % 5 <> 0",
    "semgrep_findings": "SELECT p_partkey::VARCHAR AS source, 'r' || p_partkey AS rule, ['major', 'minor', 'informational', 'minor', 'informational'][p_partkey % 5 + 1] AS severity, false AS truncated FROM part",
    "osv_findings": """WITH s AS (SELECT p_partkey AS k, coalesce(['major', 'major', 'minor', 'minor', 'informational', NULL, NULL][p_partkey % 7 + 1], ['major', 'minor', 'informational', NULL][(p_partkey // 7) % 4 + 1]) AS severity FROM part)
SELECT k::VARCHAR AS source, severity, CASE WHEN k % 2 = 0 AND severity IS NOT NULL THEN 'finding' ELSE 'candidate' END AS kind FROM s""",
    "dependency_findings": """SELECT p_partkey::VARCHAR AS source, CASE WHEN p_partkey % 4 < 3 THEN ['major', 'informational', NULL][p_partkey % 4 + 1] WHEN (p_partkey // 4) % 3 = 0 THEN 'minor' ELSE ['major', 'major', 'minor', 'informational', NULL][(p_partkey // 12) % 5 + 1] END AS severity FROM part""",
    "lint_findings": "SELECT p_partkey::VARCHAR AS source, form, ['major', 'minor', NULL, 'major', 'informational', NULL][p_partkey % 6 + 1] AS severity FROM part, (VALUES ('sarif'), ('xml')) AS v(form)",
    "permission_findings": f"""WITH n AS (SELECT DISTINCT c_custkey, unnest([c_custkey % 7, (c_custkey // 7) % 7]) AS i FROM customer), g AS (SELECT *, bool_or(i = 3) OVER (PARTITION BY c_custkey) AS fore FROM n)
SELECT c_custkey::VARCHAR AS manifest_path, {PERMISSIONS}[i + 1] AS permission, CASE WHEN i = 2 AND fore THEN 'android-permission-background-and-foreground-location' WHEN i = 4 THEN 'android-permission-unknown-custom' ELSE 'android-permission-sensitive' END AS rule,
  [NULL, 'camera', 'background-location', 'location', NULL, 'notifications'][i + 1] AS grp, CASE WHEN i = 4 THEN 'informational' ELSE 'minor' END AS severity FROM g WHERE i NOT IN (0, 6)""",
    "intent_filter_findings": f"""WITH {_FILTERS}, e AS (SELECT *, a = 0 AND no_data AS empty, a = 2 AND c < 2 AS launcher FROM k)
SELECT component, 'android-intent-filter-empty-or-malformed' AS rule, 'informational' AS severity FROM e WHERE empty UNION ALL SELECT component, 'android-intent-filter-duplicate-entries', 'informational' FROM e WHERE a = 3
UNION ALL SELECT component, 'android-intent-filter-custom-action-reachable', 'minor' FROM e WHERE a = 1 AND (open OR unset) UNION ALL SELECT component, 'android-intent-filter-non-standard-category', 'informational' FROM e WHERE NOT empty AND NOT launcher AND c = 3""",
    "deep_link_findings": f"""WITH {_FILTERS}, e AS (SELECT *, a > 2 AS v, c > 1 AS b, NOT no_data AND (held OR coalesce(scheme = '@s', false)) AS placeholder, NOT no_data AND broad AS wide, NOT no_data AND host AS hosted, NOT no_data AND scheme IS NOT NULL AS has_scheme FROM k),
r AS (SELECT *, CASE WHEN b AND NOT v THEN 'browsable-without-view' WHEN NOT v OR (NOT b AND no_data) THEN NULL WHEN placeholder THEN 'placeholder-value' WHEN wide THEN 'broad-path-pattern' WHEN has_scheme AND scheme = 'https' AND NOT hosted THEN 'web-link-without-host' WHEN has_scheme AND scheme <> 'https' AND NOT hosted THEN 'custom-scheme-without-host' ELSE 'bounded' END AS t FROM e)
SELECT component, 'android-deep-link-' || t AS rule, CASE WHEN t = 'broad-path-pattern' THEN CASE WHEN open AND bare THEN 'major' ELSE 'minor' END WHEN t LIKE '%without-host' THEN 'minor' ELSE 'informational' END AS severity FROM r WHERE t IS NOT NULL""",
    "android_verdict": f"""WITH {_VERDICT} SELECT c_custkey AS run_id, CASE WHEN min(stage) < 4 THEN 'not-ready-security-blocker-remains' WHEN min(stage) < 6 THEN 'inconclusive-audit-environment-incomplete' WHEN min(stage) = 6 THEN 'ready-except-optional-manual-checks' ELSE 'ready-for-release-preparation' END AS verdict, count(stage) AS reasons FROM customer LEFT JOIN g ON run_id = c_custkey GROUP BY 1""",
    "android_verdict_reasons": f"WITH {_VERDICT} SELECT code, CASE WHEN stage < 4 THEN 'blocking' WHEN stage < 6 THEN 'inconclusive' ELSE 'advisory' END AS impact, count(*) AS n FROM g GROUP BY 1, 2",
    "unimported_declarations": """SELECT 'dead-code-candidate:unreferenced-declaration:src/p' || p_partkey || '.ts:f' || p_partkey AS id, 'src/p' || p_partkey || '.ts' AS file, 2 AS line FROM part AS p
WHERE NOT EXISTS (SELECT 1 FROM part AS q WHERE q.p_partkey <> p.p_partkey AND ((q.p_partkey * 3) % 500 = p.p_partkey OR (q.p_partkey * 7) % 900 = p.p_partkey))""",
    "high_priority_open": "SELECT c_nationkey AS project_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS position, count(*) OVER (PARTITION BY c_nationkey) AS n_open, c_name AS title FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT c_acctbal < 0",
    "variant_summary": "SELECT n_nationkey AS variant_id, count(c_custkey) AS outcomes, " + ", ".join(f"count(c_custkey) FILTER (c_custkey % {len(reporting.OUTCOMES)} = {i}) AS \"{s}\"" for i, s in enumerate(reporting.OUTCOMES)) + " FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_nationkey < 22 GROUP BY 1",
    "strategy_input_issues": """WITH i AS (SELECT s_nationkey + 3 AS id, count(*) AS n FROM supplier WHERE s_suppkey % 5 = 0 GROUP BY 1)
SELECT coalesce(n_nationkey, id) AS strategy_id, CASE WHEN n_nationkey IS NULL THEN 'input-strategy-not-selected' WHEN n IS NULL THEN 'missing-strategy-input' ELSE 'duplicate-strategy-input' END AS code FROM nation FULL JOIN i ON n_nationkey = id WHERE n_nationkey IS NULL OR n IS NULL OR n > 1""",
    "responsibility_completeness": """WITH c AS (SELECT count(*) FILTER (event_id % 5 IN (0, 2)) AS mapped, count(*) FILTER (event_id % 5 = 1) AS "partial", count(*) FILTER (event_id % 5 = 3) AS missing, count(*) FILTER (event_id % 5 = 4) AS not_applicable FROM events)
SELECT *, CASE WHEN mapped + "partial" + missing > 0 THEN 'available' ELSE 'not-applicable' END AS availability, mapped AS numerator, mapped + "partial" + missing AS denominator, mapped / (mapped + "partial" + missing) AS rate FROM c""",
    "compare_states": """WITH o AS (SELECT *, CASE WHEN o_orderpriority = '2-HIGH' THEN 'F' WHEN o_orderpriority NOT IN ('1-URGENT', '5-LOW') THEN o_orderstatus END AS actual, o_orderpriority <> '5-LOW' AS seen FROM orders)
SELECT o_orderkey AS instance, 'status' AS field, o_orderstatus AS expected, actual, CASE WHEN seen THEN o_orderstatus IS NOT DISTINCT FROM actual END AS matched, CASE WHEN seen THEN 'available' ELSE 'unavailable' END AS availability FROM o""",
    "field_consistency": "SELECT c_custkey AS pair_id, 'x' AS field FROM customer WHERE c_custkey % 3 <> c_custkey % 2 UNION ALL SELECT c_custkey, 'y' FROM customer WHERE (c_custkey % 5 > 0) <> (c_custkey % 7 > 0)",
    "security_issues": "SELECT s AS severity, s = 'blocker' AS release_blocking, 'security-npm' AS detector_id, count(*) AS n FROM (SELECT ['blocker', 'high', 'medium', 'info', 'info'][event_id % 5 + 1] AS s FROM events) GROUP BY 1",
}
