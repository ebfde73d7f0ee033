"""Report roll-ups: variants and cases, strategy inputs, status counts, summaries in words, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.semantics import utf16_len
from veritrail.operators.experiments import report_status
from veritrail.operators.inventory import complexity_score

OUTCOMES = ["completed", "partial", "failed", "skipped"]
EXECUTIONS = ["completed", "invalid-input", "failed"]
EVALUATIONS = ["completed", "not-applicable", "failed"]
ASSURANCES = ["passed", "failed", "not-applicable"]


def outcome_summary(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Counts per outcome status and the rolled-up status, per variant or per case."""
    counted = outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("outcomes"), *[F.count_if(F.col("status") == s).alias(s) for s in OUTCOMES])
    return counted.withColumn("status", report_status(F.col("outcomes"), F.col("completed"), F.col("skipped")))


def variant_summary(variants: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every declared variant with its counts, 0 where it has no outcome."""
    counted = outcomes.groupBy("variant_id").agg(F.count(F.lit(1)).alias("outcomes"), *[F.count_if(F.col("status") == s).alias(s) for s in OUTCOMES])
    return variants.join(counted, "variant_id", "left").na.fill(0, ["outcomes", *OUTCOMES])


def stage_context_summary(strategies: DataFrame) -> DataFrame:
    """One row of counts. strategies: execution, evaluation, assurance status per strategy."""
    cells = [F.count_if(F.col(c) == s).alias(f"{s.replace('-', '_')}_{c}s") for c, ss in (("execution", EXECUTIONS), ("evaluation", EVALUATIONS), ("assurance", ASSURANCES)) for s in ss]
    return strategies.agg(F.count(F.lit(1)).alias("strategies"), *cells)


def strategy_input_issues(selected: DataFrame, inputs: DataFrame) -> DataFrame:
    """strategy_id, code: selected strategies with no or several inputs, and inputs that were not selected."""
    marks = selected.select("strategy_id").distinct().select("strategy_id", F.lit(1).alias("s"), F.lit(0).alias("i"))
    rows = marks.unionByName(inputs.select("strategy_id", F.lit(0).alias("s"), F.lit(1).alias("i"))).groupBy("strategy_id").agg(F.sum("s").alias("s"), F.sum("i").alias("i"))
    code = F.when(F.col("s") == 0, "input-strategy-not-selected").when(F.col("i") == 0, "missing-strategy-input").when(F.col("i") > 1, "duplicate-strategy-input")
    return rows.select("strategy_id", code.alias("code")).where("code IS NOT NULL")


def gallery_status(completed: Column, skipped: Column, screenshot_failed: Column, warnings: Column) -> Column:
    return F.when(completed == 0, "skipped").when(screenshot_failed | (warnings > 0) | (skipped > 0), "warning").otherwise("pass")


def assurance_status(issues: Column, checks_immutability: Column, repeats: Column) -> Column:
    return F.when(issues > 0, "failed").when(checks_immutability | (repeats > 1), "passed").otherwise("not-applicable")


def executive_summary(runs: DataFrame, answers: DataFrame) -> DataFrame:
    """One row of text from ``run_summary`` and ``pair_summary``, which have one row each and meet by a constant key."""
    one = runs.withColumn("_k", F.lit(1)).join(answers.withColumn("_k", F.lit(1)), "_k")
    text = F.concat(
        F.format_string("Completed %d of %d runs across %d comparisons. ", "completed_runs", "total_runs", "total_comparisons"),
        F.format_string("Token savings: %s. Correctness preserved: %s. Execution time reduced: %s.", "token_answer", "correctness_answer", "duration_answer"),
    )
    return one.select("token_answer", "correctness_answer", "duration_answer", text.alias("summary"))


def truncated(text: Column, most: int) -> Column:
    """STRUCT(text, truncated, length) with at most ``most`` characters."""
    return F.struct(F.left(text, F.lit(most)).alias("text"), (F.length(text) > most).alias("truncated"), utf16_len(text).alias("length"))


def natural_order(version: Column) -> Column:
    """A sort key: numbers of a version by value, other parts by text."""
    return F.transform(F.split(version, r"\."), lambda p: F.struct(F.coalesce(p.try_cast("long"), F.lit(-1).cast("long")).alias("n"), p.alias("t")))


def profile_violations(profiles: DataFrame, required: list[str]) -> DataFrame:
    """project_id, rule: missing profiles, empty fields, a score that is out of range or not the formula's. profiles: project_id, display_name, languages, complexity_score and the metrics of the formula."""
    recomputed = complexity_score({n: F.col(n) for n in ("source_file_count", "source_lines", "language_count", "internal_imports", "max_file_lines", "expected_files", "expected_symbols")})
    rules = F.filter(
        F.array(
            F.when(F.coalesce("display_name", F.lit("")) == "", "name is empty"),
            F.when(F.coalesce(F.size("languages"), F.lit(0)) == 0, "no language"),
            F.when(~F.coalesce(F.col("complexity_score").between(0, 100), F.lit(False)), "score is out of range"),
            F.when(F.col("complexity_score") != recomputed, "score does not match the formula"),
        ),
        lambda r: r.isNotNull(),
    )
    found = profiles.select("project_id", F.explode(rules).alias("rule"))
    known = profiles.agg(F.collect_set(F.when(F.col("project_id").isin(required), F.col("project_id"))).alias("ids"))
    missing = known.select(F.explode(F.array_except(F.array(*[F.lit(r) for r in required]), "ids")).alias("project_id"), F.lit("profile is missing").alias("rule"))
    return found.unionByName(missing)
