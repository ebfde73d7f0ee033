"""Queries of the inventory, audit, security and scoring families over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import text as X
from veritrail.functions.semantics import dense_counts, keep_first, norm_text, round_half_up
from veritrail.operators import audit as A
from veritrail.operators import inventory as I
from veritrail.operators import scoring, security, tasks
from veritrail.sources.tables import table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]
WORDS = {"utm": "tracking", "page": "navigation", "fr": "language", "de": "language", "blog": "site"}


def dense_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_counts(table(spark, sf_dir, "orders"), "o_orderpriority", PRIORITIES)


def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.counts(table(spark, sf_dir, "documents"), ["lang", "source"])


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(norm_text(F.col("text")), 256).alias("normalised_sha256"))
    g = I.repeated_groups(docs, ["normalised_sha256"], "doc_id", 2, 4)
    return g.select("normalised_sha256", "n", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "doc_id", "source")
    return keep_first(docs, ["text"], ["doc_id"]).select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"))


def unreferenced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    status = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    impact = F.when(F.col("o_orderkey") % 17 == 0, "tool-framework-blocker").when(F.col("o_orderkey") % 19 == 0, "other")
    return o.select(F.concat(F.lit("check-"), (F.col("o_orderkey") % 50).cast("string")).alias("id"), status.alias("status"), F.when(F.col("o_orderpriority") == "5-LOW", "informational").otherwise("major").alias("severity"), impact.alias("verdict_impact"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    severity = F.when(F.col("event_type") == "error", "major").when(F.col("event_type") == "purchase", "informational").otherwise("minor")
    return e.select(F.col("event_id").cast("string").alias("id"), severity.alias("severity"))


MANDATORY = [f"check-{i}" for i in range(10)]


def first_match_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.verdict(_checks(spark, sf_dir), _findings(spark, sf_dir), MANDATORY)


def verdict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.reason_summary(_checks(spark, sf_dir), _findings(spark, sf_dir), MANDATORY)


def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order, its lineitems as facts weighted by quantity and found if returned."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    g = items.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.sum("l_quantity").alias("weight"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.lit(0.0)).alias("found"))
    score = F.when(F.col("weight") == 0, F.lit(1.0)).otherwise(round_half_up(F.col("found") / F.col("weight"), 4))
    return g.select("case_id", score.alias("fact_match_score"), (round_half_up(F.lit(0.5) + scoring.FACT_WEIGHT * score, 4) >= scoring.PASS_SCORE).alias("passed"))


def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns scored against a key made of words of the text itself."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    words = F.split("text", " ")
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.get(words, F.lit(0)))
    fact = lambda i, w, r: F.struct(F.concat(F.lit(f"fact {i} "), word(i)).alias("id"), word(i).alias("text"), F.lit(w).alias("weight"), F.lit(r).alias("required"))
    none = F.array().cast("array<string>")
    answers = c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"),
        F.when(F.col("turn") % 5 == 4, "timeout").otherwise("completed").alias("status"),
        F.lit("parsed").alias("parse_status"),
        F.reverse("text").alias("answer_text"),
        F.array(F.concat(F.lit("./src/"), F.get(words, F.lit(0)))).alias("relevant_files"),
        none.alias("relevant_symbols"),
        none.alias("facts_found"),
        F.array(F.concat(F.lit("SRC\\"), F.get(words, F.lit(0))), F.lit("src/zzz.ts")).alias("expected_files"),
        none.alias("expected_symbols"),
        F.array(fact(1, 3.0, True), fact(8, 1.0, False)).alias("expected_facts"),
        F.lit(1).alias("minimum_correct_facts"),
    )
    s = scoring.score_correctness(answers)
    return s.select("case_id", "file_match_score", "symbol_match_score", "fact_match_score", "correctness_score", F.array_join("failure_reasons", "; ").alias("reasons"), "passed")


def complexity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    g = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max("s_suppkey").alias("m"), F.count_if(F.col("s_acctbal") < 0).alias("neg"))
    m = {"source_file_count": F.col("n"), "source_lines": F.col("n") * 100, "language_count": F.col("neg"), "internal_imports": F.col("m"), "max_file_lines": F.col("m") * 3, "expected_files": F.col("n") / 2, "expected_symbols": F.col("neg") * 2}
    return g.select("s_nationkey", I.complexity_score(m).alias("score"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    severity = F.when(F.col("event_id") % 101 == 0, "blocker").when(F.col("event_type") == "error", "high").when(F.col("event_type") == "click", "info").otherwise("low")
    return e.select(F.col("event_id").alias("ord"), F.concat(F.lit("i"), (F.col("event_id") % 700).cast("string")).alias("id"), F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string")).alias("detector_id"), severity.alias("severity"), F.concat(F.lit("fix "), (F.col("user_id") % 60).cast("string")).alias("recommended_action"))


def recommendation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.recommendations(A.deduplicate(_issues(spark, sf_dir)), 40)
    return r.withColumn("detectors", F.array_join("detectors", ","))


def exit_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.exit_decision(_issues(spark, sf_dir), "high")


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    m = c.groupBy(F.col("c_nationkey").alias("project_id")).agg(round_half_up(F.count_if(F.col("c_acctbal") > 0) * 100.0 / F.count(F.lit(1)), 2).alias("completion_rate"), F.count_if(F.col("c_acctbal") < -500).alias("stale_tasks"))
    return tasks.leaderboard(m)


def filter_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    t = d.select(F.col("doc_id").alias("task_id"), F.col("source").alias("project_id"), (F.col("n_chars") > 1000).alias("completed"), F.col("lang").alias("priority"), F.col("source").alias("title"), F.col("text").alias("notes"), F.array("lang", "source").alias("tags"))
    return tasks.filter_tasks(t, completed=True, priority="en", tag=" EN ", query="The ").select("task_id", "project_id")


def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("project_id"))
    t = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project_id"), (F.col("c_acctbal") > 0).alias("completed"))
    return tasks.task_summary(nations, t)


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", 'token = "([0-9a-f]{40})"', 1).alias("secret"))
    hit = d.where("secret <> ''")
    return hit.select("doc_id", X.redact(F.concat(F.lit("key "), F.col("secret"), F.lit(" end"))).alias("redacted"), X.candidate_preview(F.col("secret")).alias("preview"), X.fingerprint(F.col("secret")).alias("fingerprint"))


def identifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://([^/?#]*)", 1).alias("identifier"))
    c = security.classify_identifiers(p, WORDS)
    return c.select("page_id", F.array_join(X.identifier_words(F.col("identifier")), " ").alias("words"), "sensitivity")


def prompt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *X.prompt_metrics(F.col("text")))


def forbidden_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://[^/]*/([^?#]*)", 1).alias("path"))
    return security.forbidden_files(p, ["fr/", "*.html", "es/1*", "en/7"], ["fr/1*"]).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as file names in folders and with extensions taken by key."""
    k = F.col("p_partkey")
    folder = F.get(F.array(*[F.lit(x) for x in ("src", "tests", "docs", "scripts", "src/generated", "reports", "vendor/x", "lib")]), (k % 8).cast("int"))
    ext = F.get(F.array(*[F.lit(x) for x in (".ts", ".py", ".md", ".kt", ".json", ".map", "")]), (k % 7).cast("int"))
    files = table(spark, sf_dir, "part").select(F.concat(folder, F.lit("/"), F.when(k % 11 == 0, F.lit("test_")).otherwise(F.lit("")), F.lit("f"), k.cast("string"), ext).alias("path"))
    return I.classify(files).groupBy("category", "language", "role").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (dense_severity_counts, inventory_counts, duplicate_groups, dedupe_keep_first, unreferenced_orders, first_match_verdict, verdict_reasons, weighted_score, answer_scores, complexity_score, recommendation_rollup, exit_decision, leaderboard, filter_tasks, task_summary, redaction, identifier_words, prompt_metrics, forbidden_files, file_roles)}

_CHECKS = """
c AS (SELECT 'check-' || (o_orderkey % 50) AS id, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS status,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'informational' ELSE 'major' END AS severity, CASE WHEN o_orderkey % 17 = 0 THEN 'tool-framework-blocker' WHEN o_orderkey % 19 = 0 THEN 'other' END AS impact, o_orderkey % 50 < 10 AS must FROM orders),
f AS (SELECT CASE event_type WHEN 'error' THEN 'major' WHEN 'purchase' THEN 'informational' ELSE 'minor' END AS severity FROM events)"""
_ISSUES = """
i0 AS (SELECT event_id AS ord, 'i' || (event_id % 700) AS id, 'd' || (user_id % 4) AS detector_id, CASE WHEN event_id % 101 = 0 THEN 'blocker' WHEN event_type = 'error' THEN 'high' WHEN event_type = 'click' THEN 'info' ELSE 'low' END AS severity, 'fix ' || (user_id % 60) AS recommended_action FROM events),
i AS (SELECT *, CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'high' THEN 3 ELSE 4 END AS r FROM i0)"""

ORACLE_SQL = {
    "dense_severity_counts": f"SELECT p AS o_orderpriority, count(o_orderkey) AS n FROM (SELECT unnest({PRIORITIES}) AS p) LEFT JOIN orders ON o_orderpriority = p GROUP BY 1",
    "inventory_counts": "SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2",
    "duplicate_groups": "SELECT sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS normalised_sha256, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members FROM documents GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4",
    "dedupe_keep_first": "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, sha256(text) AS text_sha256 FROM documents GROUP BY text",
    "unreferenced_orders": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "first_match_verdict": f"""WITH {_CHECKS}, a AS (SELECT count(*) FILTER (must AND status = 'failed') AS failed_mandatory, count(*) FILTER (must AND status = 'skipped') AS skipped_mandatory, count(*) FILTER (NOT must AND status = 'skipped') AS skipped_optional FROM c),
b AS (SELECT count(*) FILTER (severity = 'blocker') AS blockers, count(*) FILTER (severity = 'major') AS majors FROM f)
SELECT *, CASE WHEN blockers > 0 OR failed_mandatory > 0 THEN 'not-ready-security-blocker-remains' WHEN skipped_mandatory >= 4 THEN 'inconclusive-audit-environment-incomplete' WHEN majors > 0 THEN 'not-ready-security-blocker-remains'
  WHEN skipped_optional > 0 THEN 'ready-except-optional-manual-checks' ELSE 'ready-for-release-preparation' END AS verdict FROM a, b""",
    "verdict_reasons": f"""WITH {_CHECKS}, r AS (SELECT CASE WHEN status = 'skipped' THEN CASE WHEN impact IS NOT NULL THEN 'adversarial-scenario-skipped' WHEN must THEN 'required-evidence-missing' ELSE 'optional-skipped-tool' END
  WHEN status = 'failed' THEN CASE WHEN impact = 'tool-framework-blocker' THEN impact WHEN impact IS NOT NULL THEN 'adversarial-scenario-failure' WHEN severity = 'informational' THEN 'x' ELSE 'scanner-finding' END END AS reason FROM c
  UNION ALL SELECT 'informational-evidence' FROM f WHERE severity = 'informational')
SELECT v AS reason, count(r.reason) AS n FROM (SELECT unnest({security.REASONS}) AS v) LEFT JOIN r ON r.reason = v GROUP BY 1""",
    "weighted_score": """WITH g AS (SELECT l_orderkey AS case_id, sum(l_quantity) AS w, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS f FROM lineitem GROUP BY 1), s AS (SELECT case_id, floor(f / w * 10000 + 0.5) / 10000 AS fact_match_score FROM g)
SELECT case_id, fact_match_score, floor((0.5 + 0.5 * fact_match_score) * 10000 + 0.5) / 10000 >= 0.7 AS passed FROM s""",
    "complexity_score": """WITH g AS (SELECT s_nationkey, count(*) AS n, max(s_suppkey) AS m, count(*) FILTER (s_acctbal < 0) AS neg FROM supplier GROUP BY 1)
SELECT s_nationkey, CAST(floor((0.2::DOUBLE * least(n / 20, 1) + 0.2::DOUBLE * least(n * 100 / 2000, 1) + 0.15::DOUBLE * least(neg / 4, 1) + 0.15::DOUBLE * least(m / 50, 1) + 0.1::DOUBLE * least(m * 3 / 300, 1) + 0.1::DOUBLE * least(n / 2 / 10, 1) + 0.1::DOUBLE * least(neg * 2 / 20, 1)) * 100 + 0.5) AS BIGINT) AS score FROM g""",
    "recommendation_rollup": f"""WITH {_ISSUES}, k AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1)
SELECT recommended_action, count(*) AS issues, string_agg(DISTINCT detector_id, ',' ORDER BY detector_id) AS detectors, arg_max(severity, r) AS highest_severity, min(ord) AS first_ord FROM k GROUP BY 1 ORDER BY max(r) DESC, first_ord LIMIT 40""",
    "exit_decision": f"WITH {_ISSUES} SELECT count(*) AS issues, count(*) FILTER (r >= 3) AS breaching, arg_max(severity, r) AS highest_severity, CAST(count(*) FILTER (r >= 3) > 0 AS INTEGER) AS exit_code, CASE WHEN count(*) FILTER (r >= 3) > 0 THEN 'fail-on threshold breached' WHEN count(*) = 0 THEN 'no issues' ELSE 'issues found below fail-on threshold' END AS verdict FROM i",
    "leaderboard": """WITH m AS (SELECT c_nationkey AS project_id, floor(count(*) FILTER (c_acctbal > 0) * 100.0::DOUBLE / count(*) * 100 + 0.5) / 100 AS completion_rate, count(*) FILTER (c_acctbal < -500) AS stale_tasks FROM customer GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY completion_rate DESC, stale_tasks, project_id) AS INTEGER) AS "rank" FROM m""",
    "filter_tasks": "SELECT doc_id AS task_id, source AS project_id FROM documents WHERE n_chars > 1000 AND lang = 'en' AND contains(lower(source || ' ' || text || ' ' || lang || ' ' || source), 'the')",
    "task_summary": """SELECT coalesce(p.id, t.id) AS project_id, coalesce(total, 0) AS total, CAST(coalesce(completed, 0) AS BIGINT) AS completed, coalesce(total, 0) - CAST(coalesce(completed, 0) AS BIGINT) AS open
FROM (SELECT n_nationkey AS id FROM nation WHERE n_nationkey < 20) p FULL JOIN (SELECT c_nationkey AS id, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS completed FROM customer GROUP BY 1) t ON p.id = t.id""",
    "redaction": """WITH d AS (SELECT doc_id, regexp_extract(text, 'token = "([0-9a-f]{40})"', 1) AS s FROM documents)
SELECT doc_id, 'key [REDACTED:40chars] end' AS redacted, left(s, 3) || '***' || right(s, 3) AS preview, 'sha256:' || sha256(s) AS fingerprint FROM d WHERE s <> ''""",
    "identifier_words": """WITH p AS (SELECT page_id, list_filter(string_split_regex(trim(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '[-_.]+', ' ', 'g')), '\\s+'), lambda w: w <> '') AS w FROM pages),
f AS (SELECT page_id, w, list_filter(w, lambda x: x IN ('utm', 'page', 'fr', 'de', 'blog'))[1] AS k FROM p)
SELECT page_id, array_to_string(w, ' ') AS words, CASE k WHEN 'utm' THEN 'tracking' WHEN 'page' THEN 'navigation' WHEN 'fr' THEN 'language' WHEN 'de' THEN 'language' WHEN 'blog' THEN 'site' END AS sensitivity FROM f""",
    "prompt_metrics": "SELECT conv_id, turn, length(text) AS chars, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words, len(string_split_regex(text, '\\r?\\n')) AS lines, "
    + ", ".join(f"len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS {n}" for n, p in X.PROMPT_COUNTS.items())
    + " FROM conversations",
    "forbidden_files": """WITH p AS (SELECT lower(regexp_extract(url, '://[^/]*/([^?#]*)', 1)) AS f FROM pages)
SELECT CASE WHEN starts_with(f, 'fr/') OR f = 'fr' THEN 'fr/' WHEN ends_with(f, '.html') THEN '*.html' WHEN contains(f, 'es/1') THEN 'es/1*' WHEN f = 'en/7' OR starts_with(f, 'en/7/') THEN 'en/7' END AS pattern, count(*) AS n
FROM p WHERE NOT contains(f, 'fr/1') GROUP BY 1 HAVING pattern IS NOT NULL""",
    "file_roles": """WITH p AS (SELECT ['src', 'tests', 'docs', 'scripts', 'src/generated', 'reports', 'vendor/x', 'lib'][p_partkey % 8 + 1] AS d, ['.ts', '.py', '.md', '.kt', '.json', '.map', ''][p_partkey % 7 + 1] AS e, p_partkey % 11 = 0 AS t FROM part),
c AS (SELECT *, CASE WHEN d = 'tests' OR (e = '.py' AND t) THEN 'tests' WHEN d = 'scripts' THEN 'scripts' WHEN e = '.md' OR d = 'docs' THEN 'docs' WHEN e = '.map' THEN 'generated' WHEN e IN ('.ts', '.py', '.kt') THEN 'source' ELSE 'unknown' END AS category,
  CASE e WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.kt' THEN 'kotlin' WHEN '.json' THEN 'json' ELSE 'unknown' END AS language FROM p)
SELECT category, language, CASE WHEN d = 'reports' THEN 'report-output' WHEN d = 'vendor/x' THEN 'vendor' WHEN e = '.map' OR d = 'src/generated' THEN 'generated' WHEN category = 'tests' THEN 'test' WHEN category = 'docs' THEN 'docs'
  WHEN category IN ('source', 'scripts') THEN 'source' ELSE 'unknown' END AS role, count(*) AS n FROM c GROUP BY 1, 2, 3""",
    "answer_scores": """WITH c AS (SELECT conv_id || '-' || turn AS case_id, turn, text, string_split(text, ' ') AS w0, list_transform(range(9), lambda i: coalesce(w0[i + 1], w0[1])) AS w FROM conversations),
n AS (SELECT *, trim(regexp_replace(lower(reverse(text)), '[^a-z0-9]+', ' ', 'g')) AS a, list_transform(w, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS t FROM c),
m AS (SELECT *, contains(a, t[2]) OR contains(a, trim('fact 1 ' || t[2])) AS f1, contains(a, t[9]) OR contains(a, trim('fact 8 ' || t[9])) AS f2,
  1 + CASE WHEN contains(trim('src ' || t[1]), 'src zzz ts') OR contains('src zzz ts', trim('src ' || t[1])) THEN 1 ELSE 0 END AS files FROM n),
s AS (SELECT *, 0.5 * files AS fs, CASE WHEN f1 THEN 0.75 ELSE 0 END + CASE WHEN f2 THEN 0.25 ELSE 0 END AS xs FROM m),
k AS (SELECT *, floor((0.25::DOUBLE * fs + 0.25 + 0.5::DOUBLE * xs) * 10000 + 0.5) / 10000 AS score FROM s)
SELECT case_id, fs::DOUBLE AS file_match_score, 1.0::DOUBLE AS symbol_match_score, xs::DOUBLE AS fact_match_score, score AS correctness_score,
  array_to_string(list_filter([CASE WHEN turn % 5 = 4 THEN 'timeout' END, CASE WHEN NOT f1 THEN 'missing required fact: fact 1 ' || w[2] END, CASE WHEN NOT f1 AND NOT f2 THEN 'too few facts found: 0/1' END,
    CASE WHEN files < 2 THEN 'missing expected file' END, CASE WHEN score < 0.7 THEN 'score below threshold' END], lambda x: x IS NOT NULL), '; ') AS reasons,
  turn % 5 <> 4 AND f1 AND files = 2 AND score >= 0.7 AS passed FROM k""",
}
