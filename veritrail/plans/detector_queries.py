"""Queries of matches with places, security claims, calls of sources and whole audits; texts are made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import text
from veritrail.operators import facts, rot, security, truth
from veritrail.plans import detectors
from veritrail.sources.tables import table

#: Sentences with a claim of the kind of the same place, and ones that take it back.
_BARE = ["Semgrep has passed.", "A skipped check counts as passed.", "It offers complete secret search.", "There is full network isolation.", "A manual pentest is implemented."]
_HEDGED = ["Semgrep, if available, has passed.", "A skipped check is left out.", "It is not a complete secret search.", "There is never full network isolation.", "A manual pentest is planned."]
_CUES = ["tool-passed-without-hedge", "skipped-equals-passed", "exhaustive-secret-claim", "complete-network-isolation-claim", "unsupported-current-claim:manual-pentest"]
_GAP = "-" * 90


def word_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of a document with its place, line and surroundings, summed up."""
    found = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.explode(text.matches(F.col("text"), r"[0-9]+")).alias("m"))
    placed = found.select("doc_id", F.col("m.match").alias("word"), F.col("m.at").alias("at"), text.line_of(F.col("text"), F.col("m")).alias("line"), text.around(F.col("text"), F.col("m"), 5, 7).alias("near"))
    return placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("at").alias("places"), F.sum("line").alias("lines"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word", "near"))), lambda x: F.concat(x["word"], F.lit("|"), x["near"])), "\n")).alias("digest"))


def security_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a hedged and a bare claim of one kind, either of which may be missing: the first bare one, with its line."""
    k = F.col("o_orderkey")
    pick = lambda sentences: F.get(F.array(*map(F.lit, sentences)), (k % 5).cast("int"))
    content = F.concat(F.repeat(F.lit("\n"), (k % 4).cast("int")), F.when(k % 3 > 0, pick(_HEDGED)).otherwise("-"), F.lit(f"\n{_GAP}\n"), F.when(k % 7 > 2, pick(_BARE)).otherwise("-"), F.lit(f"\n{_GAP}\n"), F.when(k % 2 == 0, pick(_BARE)).otherwise("-"))
    docs = table(spark, sf_dir, "orders").select(k.cast("string").alias("path"), content.alias("content"))
    return rot.security_claims(docs).select("file", "line", "severity", F.regexp_extract("id", r"^[^:]*:(.*):[0-9]+$", 1).alias("cue"))


def cross_platform_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with raw splits and with a shell near a call, or far from all of them, several of each in a file."""
    k = F.col("p_partkey")
    far = F.lit("shell: true" + " " * 200)
    content = F.concat(F.when(k % 2 == 0, r'a.split("\n"); ').otherwise("a.split(b); "), F.when(k % 3 == 0, r"c.split( '\\' ); ").otherwise(""), F.when(k % 4 > 0, far).otherwise(""), F.when(k % 5 < 2, "spawn(x, { shell: true });").otherwise("spawn(x);"))
    files = table(spark, sf_dir, "part").select(F.concat(F.when(k % 11 == 0, "src/x/").otherwise("src/audits/"), F.when(k % 13 == 0, F.concat(k.cast("string"), F.lit("/textLines.ts"))).otherwise(F.concat(k.cast("string"), F.lit(".ts")))).alias("path"), content.alias("content"))
    return rot.cross_platform_sources(files).select("file", F.col("message").alias("cue"), "severity")


def audit_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole audit over customers as scripts, with a detector that fails: issues, errors and skipped detectors."""
    k = F.col("c_custkey")
    scripts = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), k.cast("string")).alias("name"), F.get(F.array(F.lit("tsc && rm -rf dist"), F.lit("node grep.js"), F.lit("cat a && mv b c"), F.lit("mvn x")), (k % 4).cast("int")).alias("command"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.concat(F.lit("Windows\nnpm run s"), F.col("o_custkey").cast("string"), F.lit("x"), (F.col("o_custkey") % 2).cast("string")).alias("content"))
    broken = detectors.Detector("broken", "code-rot", ("docs",), lambda c: c["docs"].select("no_such_column"))
    chosen = detectors.select((broken, *detectors.DETECTORS), ["code-rot"], ["package"])
    failing = (*chosen[:1], broken, *chosen[1:])
    got = detectors.run(spark, failing, {"scripts": scripts, "docs": docs, "sources": docs.limit(0)}, fail_on="high")
    issues = got.issues.groupBy(F.lit("issue").alias("what"), "detector_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    errors = got.errors.select(F.lit("error").alias("what"), "detector_id", F.lit(None).cast("string").alias("severity"), F.lit(1).cast("long").alias("n"))
    skipped = got.skipped.select(F.lit("skipped").alias("what"), "detector_id", F.lit(None).cast("string").alias("severity"), F.lit(1).cast("long").alias("n"))
    return issues.unionByName(errors).unionByName(skipped)


def import_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each part, with imports over several lines, and others in comments and strings, which are none."""
    k = F.col("p_partkey")
    when = lambda test, s: F.when(test, F.lit(s)).otherwise("")
    content = F.concat(
        when(k % 2 == 1, "// import { no } from './c'\n"),
        F.concat(F.lit("import d"), k.cast("string"), F.lit(", {\n  n1, // x\n  type n2 as m2,\n} from \"./m"), (k % 7).cast("string"), F.lit("\";\n")),
        when(k % 3 == 0, "/* import z from './z'\n*/ "),
        F.lit("const s = 'import q from \\'./q\\''; "),
        when(k % 5 == 0, "export * from './e'; "),
        when(k % 4 == 0, "obj.require('./no'); require( './r' ); "),
    )
    files = table(spark, sf_dir, "part").select(k.cast("string").alias("path"), F.lit("typescript").alias("language"), F.lit("source").alias("role"), content.alias("content"))
    found = facts.source_facts(files).select("path", F.explode("imports").alias("i"))
    return found.select("path", "i.source", F.array_join("i.importedNames", ",").alias("names"), "i.line")


def candidate_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    rows = e.select(F.col("user_id").cast("string").alias("check_id"), F.when(F.col("value") > 80, "high").otherwise("low").alias("confidence"), pick("resolved", "missing", "unresolved").alias("resolution_state"), F.col("event_type").alias("category"))
    return security.candidate_roll_up(rows)


def package_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages and lockfiles of suppliers, some fields of a wrong type: what they say and whether they agree."""
    k = F.col("s_suppkey")
    s = lambda x: x.cast("string")
    package = F.concat(F.lit('{"name": '), F.when(k % 7 == 0, "7").otherwise(F.concat(F.lit('"p'), s(k), F.lit('"'))), F.lit(', "version": "1.'), s(k % 3), F.lit('.0", "scripts": {"test:a": "x", "security:b": '), F.when(k % 5 == 0, "1").otherwise('"y"'), F.lit('}, "engines": {"node": ">=20"}}'))
    lock = F.concat(F.lit('{"lockfileVersion": '), F.when(k % 2 == 0, '"3"').otherwise("3"), F.when(k % 4 < 2, F.concat(F.lit(', "name": "p'), s(k), F.lit('", "version": "1.0.0"'))).otherwise(F.concat(F.lit(', "packages": {"": {"name": "p'), s(k), F.lit('", "version": "1.1.0"}}'))), F.lit("}"))
    rows = table(spark, sf_dir, "supplier").select(s(k).alias("root"), package.alias("package"), F.when(k % 11 == 0, "broken").otherwise(lock).alias("lock"))
    packages = truth.packages(rows.select("root", F.col("package").alias("raw")))
    locks = truth.lockfiles(rows.select("root", F.col("lock").alias("raw")), packages)
    return packages.join(locks.select("root", "present", F.col("version").alias("locked"), "lockfile_version", "consistent"), "root").select("root", "name", "version", F.size("scripts").alias("scripts"), F.element_at("engines", F.lit("node")).alias("node"), "present", "locked", "lockfile_version", "consistent")


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What whole texts of documents mention, and the titles put before some of them."""
    k = F.col("doc_id")
    content = F.concat(F.when(k % 3 == 0, F.concat(F.lit("# Title "), k.cast("string"), F.lit("\n"))).otherwise(""), F.when(k % 4 == 0, "An audit is planned.\n").otherwise(""), F.col("text"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(k.cast("string"), F.when(k % 5 == 0, "/README.md").otherwise(".md")).alias("path"), content.alias("content"))
    return truth.documents(docs).select("path", F.col("title").isNotNull().alias("titled"), "is_readme", "mentions_audit", "mentions_planned_commands", "mentions_release_publish")


def collated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of each document, accents and capitals among them, in the order of dictionaries."""
    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w != "")
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.locale_sorted(words).alias("w"))
    return rows.where(F.size("w") > 0).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


QUERIES = {f.__name__: f for f in (collated_words, candidate_roll_up, package_facts, document_facts, import_facts, word_places, security_claims, cross_platform_calls, audit_run)}

ORACLE_SQL = {
    "collated_words": """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array("text", '[^\\p{L}]+')) AS w FROM documents WHERE "text" IS NOT NULL)
SELECT doc_id, count(*) AS n, md5(string_agg(w, ' ' ORDER BY w COLLATE en_us)) AS digest FROM w WHERE w <> '' GROUP BY doc_id""",
    "candidate_roll_up": """WITH c AS (SELECT user_id, CASE WHEN value > 80 THEN 'high' ELSE 'low' END AS confidence, ['resolved', 'missing', 'unresolved'][event_id % 3 + 1] AS state, event_type FROM events)
SELECT 'total' AS dimension, NULL AS value, count(*) AS n FROM c UNION ALL SELECT 'checks_with_candidates', NULL, count(DISTINCT user_id) FROM c UNION ALL SELECT 'category', event_type, count(*) FROM c GROUP BY 2
UNION ALL SELECT 'confidence', v, (SELECT count(*) FROM c WHERE confidence = v) FROM (SELECT unnest(['unknown', 'low', 'medium', 'high']) AS v)
UNION ALL SELECT 'resolution_state', v, (SELECT count(*) FROM c WHERE state = v) FROM (SELECT unnest(['resolved', 'unresolved', 'missing', 'malformed', 'unsupported', 'not-applicable']) AS v)""",
    "package_facts": """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 > 0 THEN 'p' || s_suppkey END AS name, '1.' || s_suppkey % 3 || '.0' AS version, s_suppkey % 11 > 0 AS present, CASE WHEN s_suppkey % 11 > 0 THEN CASE WHEN s_suppkey % 4 < 2 THEN '1.0.0' ELSE '1.1.0' END END AS locked FROM supplier)
SELECT CAST(k AS VARCHAR) AS root, name, version, CASE WHEN k % 5 = 0 THEN 0 ELSE 2 END AS scripts, '>=20' AS node, present, locked, CASE WHEN present AND k % 2 = 1 THEN 3.0::DOUBLE END AS lockfile_version, CASE WHEN name IS NOT NULL AND present THEN version = locked END AS consistent FROM s""",
    "document_facts": """WITH d AS (SELECT doc_id AS k, CASE WHEN doc_id % 3 = 0 THEN '# Title ' || doc_id || chr(10) ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN 'An audit is planned.' || chr(10) ELSE '' END || "text" AS t FROM documents WHERE "text" IS NOT NULL),
r AS (SELECT k, CASE WHEN strlen(t) <= 200000 THEN t ELSE '' END AS t FROM d)
SELECT k || CASE WHEN k % 5 = 0 THEN '/README.md' ELSE '.md' END AS path, regexp_matches(t, '(?m)^#\\s+.+$') AS titled, k % 5 = 0 AS is_readme, regexp_matches(t, '(?i)\\baudit\\b') AS mentions_audit, regexp_matches(t, '(?i)\\bplanned\\b') AS mentions_planned_commands, regexp_matches(t, '(?i)\\b(release|publish)\\b') AS mentions_release_publish FROM r""",
    "import_facts": """WITH p AS (SELECT p_partkey AS k, CAST(1 + p_partkey % 2 AS INTEGER) AS b, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS c FROM part)
SELECT CAST(k AS VARCHAR) AS path, './m' || k % 7 AS source, 'd' || k || ',n1,m2' AS names, b AS line FROM p UNION ALL SELECT CAST(k AS VARCHAR), './e', '', b + 4 + c FROM p WHERE k % 5 = 0 UNION ALL SELECT CAST(k AS VARCHAR), './r', '', b + 4 + c FROM p WHERE k % 4 = 0""",
    "word_places": """WITH d AS (SELECT doc_id, "text" AS t, regexp_extract_all("text", '[0-9]+') AS w, regexp_split_to_array("text", '[0-9]+') AS p FROM documents WHERE "text" IS NOT NULL),
e AS (SELECT doc_id, t, w, p, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (SELECT doc_id, t, w[i] AS word, length(array_to_string(p[1:i], '')) + length(array_to_string(w[1:i - 1], '')) AS pos FROM e),
x AS (SELECT doc_id, word, pos, length(left(t, pos)) - length(replace(left(t, pos), chr(10), '')) + 1 AS line, substring(t, greatest(pos - 5, 0) + 1, pos + length(word) + 7 - greatest(pos - 5, 0)) AS near FROM m)
SELECT doc_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places, CAST(sum(line) AS BIGINT) AS lines, md5(string_agg(word || '|' || near, chr(10) ORDER BY pos)) AS digest FROM x GROUP BY doc_id""",
    "security_claims": f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 > 2 AS early, o_orderkey % 2 = 0 AS late FROM orders)
SELECT CAST(k AS VARCHAR) AS file, CAST(k % 4 + CASE WHEN early THEN 3 ELSE 5 END AS INTEGER) AS line, 'high' AS severity, {_CUES}[k % 5 + 1] AS cue FROM o WHERE early OR late""",
    "cross_platform_calls": """WITH p AS (SELECT p_partkey AS k, 'src/audits/' || p_partkey || '.ts' AS file FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0)
SELECT file, 'raw-split-newline' AS cue, 'medium' AS severity FROM p WHERE k % 2 = 0 UNION ALL SELECT file, 'raw-backslash-split', 'medium' FROM p WHERE k % 3 = 0 UNION ALL SELECT file, 'shell-true-usage', 'high' FROM p WHERE k % 5 < 2""",
    "audit_run": """SELECT 'issue' AS what, 'cross-platform-rot' AS detector_id, 'high' AS severity, count(*) AS n FROM customer WHERE c_custkey % 4 IN (0, 2) UNION ALL
SELECT 'issue', 'stale-command-reference', 'high', count(*) FROM orders UNION ALL SELECT 'error', 'broken', NULL, 1 UNION ALL SELECT 'skipped', 'package-release-rot', NULL, 1""",
}
