"""Queries of the experiment family over the test tables.

Events stand for runs: a user's day is a case, ``view`` the baseline and
``purchase`` the guided strategy. Lineitems stand for answer facts, documents
for contexts and evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.semantics import est_tokens, round_half_up
from veritrail.operators import expectations as X
from veritrail.operators import experiments as E
from veritrail.operators import snapshots as S
from veritrail.sources.tables import table


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string")).alias("case_id"),
        F.lit("events").alias("project"),
        F.concat(F.lit("agent"), F.pmod("user_id", F.lit(3)).cast("string")).alias("agent"),
        F.lit("short").alias("complexity"),
        F.when(F.col("event_type") == "view", E.BASELINE).when(F.col("event_type") == "purchase", E.GUIDED).otherwise(F.col("event_type")).alias("strategy"),
        F.struct(micros.alias("t"), F.col("event_id").alias("i")).alias("ord"),
        F.col("event_id").alias("run_id"),
        F.when(F.pmod("event_id", F.lit(7)) == 0, "failed").when(F.pmod("event_id", F.lit(11)) == 0, "agent-limit-reached").otherwise("completed").alias("status"),
        F.floor(F.col("value") * 100).cast("long").alias("duration_ms"),
        F.when(F.pmod("event_id", F.lit(5)) != 0, F.floor("value").cast("long")).alias("total_tokens"),
        (F.pmod("event_id", F.lit(10)) / 10).alias("correctness"),
        (F.pmod("event_id", F.lit(10)) >= 7).alias("passed"),
    )


_RUNS = """
runs AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS case_id, 'events' AS project, 'agent' || (user_id % 3) AS agent, 'short' AS complexity,
  CASE event_type WHEN 'view' THEN 'baseline' WHEN 'purchase' THEN 'guided' ELSE event_type END AS strategy, ts, event_id AS run_id,
  CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 11 = 0 THEN 'agent-limit-reached' ELSE 'completed' END AS status,
  CAST(floor(value * 100) AS BIGINT) AS duration_ms, CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value) AS BIGINT) END AS total_tokens,
  (event_id % 10) / 10 AS correctness, event_id % 10 >= 7 AS passed FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY case_id, agent, strategy ORDER BY ts, run_id) AS k FROM runs WHERE strategy IN ('baseline', 'guided')),
p AS (SELECT coalesce(b.case_id, g.case_id) AS case_id, coalesce(b.project, g.project) AS project, coalesce(b.agent, g.agent) AS agent, coalesce(b.complexity, g.complexity) AS complexity,
  b.run_id AS baseline_run_id, b.status AS baseline_status, b.duration_ms AS baseline_duration_ms, b.total_tokens AS baseline_total_tokens, b.correctness AS baseline_correctness, b.passed AS baseline_passed,
  g.run_id AS guided_run_id, g.status AS guided_status, g.duration_ms AS guided_duration_ms, g.total_tokens AS guided_total_tokens, g.correctness AS guided_correctness, g.passed AS guided_passed,
  coalesce(b.passed = g.passed, false) AS same_pass,
  floor((g.correctness - b.correctness) * 10000 + 0.5) / 10000 AS correctness_delta,
  b.duration_ms - g.duration_ms AS duration_delta_ms,
  floor((b.duration_ms - g.duration_ms)::DOUBLE / nullif(b.duration_ms, 0) * 100 * 10000 + 0.5) / 10000 AS duration_reduction_percent,
  b.total_tokens - g.total_tokens AS token_delta,
  floor((b.total_tokens - g.total_tokens)::DOUBLE / nullif(b.total_tokens, 0) * 100 * 10000 + 0.5) / 10000 AS token_savings_percent,
  b.total_tokens IS NOT NULL AND g.total_tokens IS NOT NULL AS tokens_comparable,
  CASE WHEN b.run_id IS NULL OR g.run_id IS NULL THEN 'partial' WHEN 'agent-limit-reached' IN (b.status, g.status) THEN 'limit-reached'
    WHEN b.status = 'completed' AND g.status = 'completed' THEN CASE WHEN b.total_tokens IS NOT NULL AND g.total_tokens IS NOT NULL THEN 'strong' ELSE 'correctness-only' END
    ELSE 'failed' END AS reliability
  FROM (SELECT * FROM f WHERE k = 1 AND strategy = 'baseline') b FULL JOIN (SELECT * FROM f WHERE k = 1 AND strategy = 'guided') g ON b.case_id = g.case_id AND b.agent = g.agent)"""


def strategy_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pair_strategies(_runs(spark, sf_dir)).drop("warnings")


def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.pair_summary(E.pair_strategies(_runs(spark, sf_dir)))
    return s.withColumns({c: round_half_up(F.col(c), 6) for c in s.columns if c.startswith("average_")})


def reliability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pair_strategies(_runs(spark, sf_dir)).groupBy("reliability").agg(F.count(F.lit(1)).alias("n"))


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.outcome_counts(_runs(spark, sf_dir))


def run_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.run_summary(_runs(spark, sf_dir))
    return s.withColumns({c: F.array_join(c, ",") for c in ("agents", "strategys", "complexitys")})


def case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.case_status(_runs(spark, sf_dir))


def matrix_plot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    places = runs.select("run_id", "ord", F.col("duration_ms").alias("prompt_tokens"), F.pmod("run_id", F.lit(100)).alias("project_score"))
    points, skipped = E.plot_points(E.pair_strategies(runs), places, "token_savings_percent")
    return points.groupBy("agent").agg(F.count(F.lit(1)).alias("points"), F.sum("x_prompt_tokens").alias("prompt_tokens"), F.sum("x_project_score").alias("project_score")).join(skipped.groupBy("agent").agg(F.count(F.lit(1)).alias("skipped")), "agent", "left")


def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metrics_long(_runs(spark, sf_dir).where("strategy = 'guided'"))


def experiment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("case_id"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("project"))
    return E.experiment_matrix(cases, ["fake", "real"], [E.BASELINE, E.GUIDED], ["short", "long"], projects=["region 1", "region 3"], max_runs=50)


def token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.token_savings_summary(_savings(spark, sf_dir))


def _savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select(
        F.col("doc_id").alias("case_id"),
        est_tokens(F.col("text")).alias("raw_tokens"),
        est_tokens(F.substring("text", 1, 400)).alias("guided_tokens"),
        (F.col("doc_id") % 13 == 0).alias("skipped"),
        (F.col("doc_id") % 4).alias("commands_run"),
        (F.col("doc_id") % 97).alias("ms_raw"),
        (F.col("doc_id") % 31).alias("ms_guided"),
    )


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = lambda name, label: table(spark, sf_dir, name).select(label.alias("origin"), F.length("text").alias("n_chars"))
    d = sized("conversations", F.concat(F.lit("role "), F.col("role"))).unionByName(sized("documents", F.concat(F.lit("source "), F.col("source"))))
    return X.context_size(d, ["origin"])


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    inclusion = F.when(F.col("toxic") == 1, "forbidden").when(F.col("quality") == 1, "required").otherwise("allowed")
    return labels.select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("expectation_id"),
        inclusion.alias("inclusion"),
        F.lit("context-capsule").alias("source_artifact"),
        F.when(F.col("doc_id") % 5 == 0, "provenance").otherwise("file").alias("category"),
        F.col("doc_id").cast("string").alias("target_key"),
    )


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.select(
        F.col("doc_id").alias("ord"),
        F.lit("context-capsule").alias("source_artifact"),
        F.col("source").alias("source_instance"),
        F.when(F.col("doc_id") % 5 == 0, "provenance").otherwise("file").alias("category"),
        F.col("doc_id").cast("string").alias("target_key"),
        F.concat(F.lit("documents["), F.col("doc_id").cast("string"), F.lit("]")).alias("source_field_path"),
    )


_EXPECT = """
x AS (SELECT doc_id AS ord, 'e' || doc_id AS expectation_id, CASE WHEN toxic = 1 THEN 'forbidden' WHEN quality = 1 THEN 'required' ELSE 'allowed' END AS inclusion,
  CASE WHEN doc_id % 5 = 0 THEN 'provenance' ELSE 'file' END AS category, doc_id::VARCHAR AS target_key FROM labels),
o AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN 'provenance' ELSE 'file' END AS category, doc_id::VARCHAR AS target_key FROM documents),
m AS (SELECT x.*, o.doc_id, o.source, CASE WHEN inclusion = 'forbidden' THEN CASE WHEN o.doc_id IS NULL THEN 'matched' ELSE 'violated' END
  ELSE CASE WHEN o.doc_id IS NULL THEN 'missing' ELSE 'matched' END END AS outcome FROM x LEFT JOIN o USING (category, target_key))"""


def expectation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.match_expectations(_expected(spark, sf_dir), _observed(spark, sf_dir))
    return m.select("expectation_id", "inclusion", "category", "target_key", "outcome", F.array_join("matched_instances", ",").alias("instances"), F.array_join("matched_field_paths", ",").alias("field_paths"))


def expectation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.inclusion_metrics(X.match_expectations(_expected(spark, sf_dir), _observed(spark, sf_dir)))


def irrelevant_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.irrelevant_inclusion(_observed(spark, sf_dir), _expected(spark, sf_dir), ["context-capsule"], ["file"])


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    side = lambda cond: o.where(cond).groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("m")).select("o_custkey", F.col("m.o_orderstatus").alias("state"))
    return S.diff(side("o_orderdate < '1998-01-01'"), side("o_orderdate >= '1998-01-01'"), ["o_custkey"], "state")


def new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return S.new_entries(n.where("n_regionkey < 2").select("n_regionkey", "n_name"), n.select("n_regionkey", "n_name"), ["n_regionkey", "n_name"])


def determinism_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    runs = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("int").alias("run"), F.substring("o_orderpriority", 1, 1).alias("canonical"))
    d = X.determinism(runs)
    return d.withColumn("mismatched_runs", F.array_join(F.transform("mismatched_runs", lambda r: r.cast("string")), ","))


QUERIES = {
    "strategy_pairing": strategy_pairing,
    "pair_summary": pair_summary,
    "reliability_counts": reliability_counts,
    "outcome_counts": outcome_counts,
    "run_status_summary": run_status_summary,
    "case_status": case_status,
    "matrix_plot_points": matrix_plot_points,
    "metrics_long": metrics_long,
    "experiment_matrix": experiment_matrix,
    "token_savings": token_savings,
    "token_estimate": token_estimate,
    "expectation_match": expectation_match,
    "expectation_metrics": expectation_metrics,
    "irrelevant_inclusion": irrelevant_inclusion,
    "snapshot_diff": snapshot_diff,
    "new_entries": new_entries,
    "determinism_digest": determinism_digest,
}

_AVERAGE = "floor(avg({0}) * 1000000 + 0.5) / 1000000"
_VOTE = "CASE WHEN count({0}) = 0 THEN 'unavailable' WHEN count(*) FILTER ({0} > 0) > count({0}) / 2 THEN 'yes' WHEN count(*) FILTER ({0} < 0) > count({0}) / 2 THEN 'no' ELSE 'mixed' END"
_AVAIL = "CASE WHEN d = 0 THEN 'not-applicable' ELSE 'available' END AS availability, CASE WHEN d > 0 THEN n END AS numerator, CASE WHEN d > 0 THEN d END AS denominator, n::DOUBLE / nullif(d, 0) AS rate"

ORACLE_SQL = {
    "strategy_pairing": f"WITH {_RUNS} SELECT * FROM p",
    "pair_summary": f"""WITH {_RUNS}, q AS (SELECT *, coalesce(baseline_status = 'completed' AND guided_status = 'completed', false) AS done, CASE WHEN tokens_comparable THEN token_savings_percent END AS tok FROM p)
SELECT count(*) AS total_comparisons, count(*) FILTER (done) AS completed_comparisons, count(*) FILTER (done AND same_pass) AS preserved_comparisons,
  {_AVERAGE.format("token_savings_percent")} AS average_token_savings_percent, {_AVERAGE.format("duration_reduction_percent")} AS average_duration_reduction_percent, {_AVERAGE.format("correctness_delta")} AS average_correctness_delta,
  avg(token_savings_percent) > 0 AS saves_tokens, CASE WHEN count(*) FILTER (done) > 0 THEN bool_and(same_pass) FILTER (done) END AS preserves_correctness, avg(duration_reduction_percent) > 0 AS reduces_time,
  {_VOTE.format("tok")} AS token_answer,
  CASE WHEN count(*) FILTER (done) = 0 THEN 'inconclusive' WHEN bool_and(same_pass) FILTER (done) THEN 'yes' WHEN NOT bool_or(same_pass) FILTER (done) THEN 'no' ELSE 'mixed' END AS correctness_answer,
  {_VOTE.format("duration_reduction_percent")} AS duration_answer FROM q""",
    "reliability_counts": f"WITH {_RUNS} SELECT reliability, count(*) AS n FROM p GROUP BY 1",
    "outcome_counts": f"WITH {_RUNS} SELECT agent, status, count(*) AS n FROM runs GROUP BY 1, 2",
    "run_status_summary": f"WITH {_RUNS} SELECT count(*) AS total_runs, "
    + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.replace('-', '_')}_runs" for s in E.STATUSES)
    + ", "
    + ", ".join(f"string_agg(DISTINCT {c}, ',' ORDER BY {c}) AS {c}s" for c in ("agent", "strategy", "complexity"))
    + " FROM runs",
    "case_status": f"""WITH {_RUNS} SELECT case_id, CASE WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'partial' END AS case_status,
  count(*) AS outcomes, count(*) FILTER (status = 'completed') AS completed FROM runs GROUP BY 1""",
    "matrix_plot_points": f"""WITH {_RUNS}, a AS (SELECT p.*, r.duration_ms AS x1, r.run_id % 100 AS x2, token_savings_percent IS NOT NULL AS ok FROM p JOIN runs r ON r.run_id = coalesce(guided_run_id, baseline_run_id))
SELECT agent, count(*) FILTER (ok) AS points, CAST(sum(x1) FILTER (ok) AS BIGINT) AS prompt_tokens, CAST(sum(x2) FILTER (ok) AS BIGINT) AS project_score, count(*) FILTER (NOT ok) AS skipped FROM a GROUP BY 1""",
    "metrics_long": f"""WITH {_RUNS}, g AS (SELECT * FROM runs WHERE strategy = 'guided') SELECT run_id, 'correctness' AS metric, correctness::DOUBLE AS value FROM g UNION ALL SELECT run_id, 'duration_ms', duration_ms FROM g
UNION ALL SELECT run_id, 'total_tokens', total_tokens FROM g WHERE total_tokens IS NOT NULL""",
    "experiment_matrix": """WITH c AS (SELECT n_nationkey AS ord, n_name AS case_id, 'region ' || n_regionkey AS project FROM nation WHERE n_regionkey IN (1, 3)),
a(ai, agent) AS (VALUES (0, 'fake'), (1, 'real')), s(si, strategy) AS (VALUES (0, 'baseline'), (1, 'guided')), x(xi, complexity) AS (VALUES (0, 'short'), (1, 'long'))
SELECT ord, case_id, project, agent, strategy, complexity,
  concat_ws('.', regexp_replace(case_id, '[^A-Za-z0-9._-]+', '-', 'g'), regexp_replace(project, '[^A-Za-z0-9._-]+', '-', 'g'), agent, strategy, complexity) AS run_id
FROM c, a, s, x ORDER BY ord, ai, si, xi LIMIT 50""",
    "token_savings": """WITH c AS (SELECT ceil(length(text) / 4)::BIGINT AS r, ceil(length(substr(text, 1, 400)) / 4)::BIGINT AS g, doc_id % 13 = 0 AS sk, doc_id % 4 AS cr, doc_id % 97 AS mr, doc_id % 31 AS mg FROM documents)
SELECT count(*) AS case_count, count(*) FILTER (NOT sk) AS completed_count, count(*) FILTER (sk) AS skipped_count, avg(r) FILTER (NOT sk) AS average_raw_tokens, avg(g) FILTER (NOT sk) AS average_guided_tokens,
  avg(r - g) FILTER (NOT sk) AS average_tokens_saved, avg(CASE WHEN r = 0 THEN 0 ELSE (r - g) / r * 100 END) FILTER (NOT sk) AS average_percent_saved,
  CAST(sum(r) FILTER (NOT sk) AS BIGINT) AS total_raw_tokens, CAST(sum(g) FILTER (NOT sk) AS BIGINT) AS total_guided_tokens, CAST(sum(r - g) FILTER (NOT sk) AS BIGINT) AS total_tokens_saved,
  CAST(sum(cr) AS BIGINT) AS total_commands, CAST(sum(mr + mg) AS BIGINT) AS total_duration_ms FROM c""",
    "token_estimate": "SELECT origin, count(*) AS sources, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, CAST(coalesce(sum(ceil(length(text) / 4)), 0) AS BIGINT) AS estimated_tokens FROM (SELECT 'role ' || role AS origin, text FROM conversations UNION ALL SELECT 'source ' || source, text FROM documents) GROUP BY 1",
    "expectation_match": f"WITH {_EXPECT} SELECT expectation_id, inclusion, category, target_key, outcome, coalesce(source, '') AS instances, CASE WHEN doc_id IS NULL THEN '' ELSE 'documents[' || doc_id || ']' END AS field_paths FROM m",
    "expectation_metrics": f"""WITH {_EXPECT}, c AS (SELECT 'required_recall' AS metric, count(*) FILTER (inclusion = 'required' AND outcome = 'matched') AS n, count(*) FILTER (inclusion = 'required') AS d FROM m
UNION ALL SELECT 'allowed_coverage', count(*) FILTER (inclusion = 'allowed' AND outcome = 'matched'), count(*) FILTER (inclusion = 'allowed') FROM m
UNION ALL SELECT 'forbidden_inclusion', count(*) FILTER (inclusion = 'forbidden' AND outcome = 'violated'), count(*) FILTER (inclusion = 'forbidden') FROM m
UNION ALL SELECT 'provenance_recall', count(*) FILTER (inclusion = 'required' AND category = 'provenance' AND outcome = 'matched'), count(*) FILTER (inclusion = 'required' AND category = 'provenance') FROM m)
SELECT metric, {_AVAIL} FROM c""",
    "irrelevant_inclusion": f"""WITH {_EXPECT}, c AS (SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM x WHERE x.target_key = o.target_key AND x.category = o.category AND inclusion <> 'forbidden')) AS n, count(*) AS d FROM o WHERE category = 'file') SELECT {_AVAIL} FROM c""",
    "snapshot_diff": """WITH b AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders WHERE o_orderdate < '1998-01-01' GROUP BY 1),
a AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders WHERE o_orderdate >= '1998-01-01' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, b.s AS before, a.s AS after, CASE WHEN a.o_custkey IS NULL THEN 'removed' WHEN b.o_custkey IS NULL THEN 'added' ELSE 'changed' END AS change
FROM b FULL JOIN a ON a.o_custkey = b.o_custkey WHERE a.s IS DISTINCT FROM b.s""",
    "new_entries": "SELECT n_regionkey, n_name FROM nation WHERE n_regionkey >= 2",
    "determinism_digest": """WITH r AS (SELECT o_custkey AS case_id, o_orderkey AS run, sha256(substr(o_orderpriority, 1, 1)) AS h FROM orders),
f AS (SELECT case_id, arg_min(h, run) AS b, count(*) AS n FROM r GROUP BY 1)
SELECT f.case_id, CAST(n AS INTEGER) AS runs, b AS baseline_sha256, coalesce(string_agg(run::VARCHAR, ',' ORDER BY run) FILTER (h <> b), '') AS mismatched_runs,
  CASE WHEN n = 1 THEN 'not-applicable' ELSE 'available' END AS availability, CASE WHEN n > 1 THEN bool_and(h = b) END AS deterministic
FROM f JOIN r ON r.case_id = f.case_id GROUP BY f.case_id, n, b""",
}
