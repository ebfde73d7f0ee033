"""Controlled experiments: the run matrix, outcome classes, pairing of strategies, summaries and plot points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.semantics import ratio, round_half_up

BASELINE, GUIDED = "baseline", "guided"
PAIR_KEY = ["case_id", "project", "agent", "complexity"]
STATUSES = ["completed", "failed", "skipped", "agent-unavailable", "agent-limit-reached", "timeout", "invalid-output"]

# Texts that show a usage limit.
LIMIT_PATTERNS = [r"usage\s+limit", r"rate\s+limit", "quota", r"session\s+limit", r"limit\s+reached", r"too\s+many\s+requests", "exhausted", r"insufficient\s+quota", r"daily\s+limit", r"monthly\s+limit"]


def safe_segment(x: Column) -> Column:
    """Characters that a file name cannot hold become ``-``."""
    return F.regexp_replace(x, "[^A-Za-z0-9._-]+", "-")


def run_id(*parts: Column) -> Column:
    return F.concat_ws(".", *[safe_segment(p) for p in parts])


def experiment_matrix(cases: DataFrame, agents: list[str], strategies: list[str], complexities: list[str], case_ids: list[str] | None = None, projects: list[str] | None = None, max_runs: int | None = None) -> DataFrame:
    """Every selected case with every agent, strategy and complexity, in that order; ``max_runs`` keeps the first.

    cases: ord, case_id, project. Empty selections select all; a selected case
    that is missing is an error. The settings are short lists that come with
    the call, so each case is expanded in place rather than cross-joined.
    """
    chosen = cases
    if case_ids:
        chosen = chosen.where(F.col("case_id").isin(case_ids))
    if projects:
        chosen = chosen.where(F.col("project").isin(projects))
    if case_ids:
        found = {r[0] for r in chosen.select("case_id").distinct().collect()}
        missing = [c for c in case_ids if c not in found]
        if missing:
            raise ValueError(f"cases not found: {', '.join(missing)}")
    cells = chosen.select("ord", "case_id", "project")
    for name, values in (("agent", agents), ("strategy", strategies), ("complexity", complexities)):
        cells = cells.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"_{name}", name))
    cells = cells.withColumn("run_id", run_id(F.col("case_id"), F.col("project"), F.col("agent"), F.col("strategy"), F.col("complexity")))
    order = ["ord", "_agent", "_strategy", "_complexity"]
    if max_runs is not None:
        cells = cells.orderBy(*order).limit(max_runs)
    return cells.drop("_agent", "_strategy", "_complexity")


def classify_outcome(status: Column, text: Column, parse_status: Column) -> Column:
    """First match wins; ``text`` is the answer with warnings and errors, so a completed run that mentions a quota is limit-reached."""
    matches = lambda pattern: F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))
    return (
        F.when((status == "skipped") & matches("not available|unavailable|not found"), "agent-unavailable")
        .when(matches("|".join(LIMIT_PATTERNS)), "agent-limit-reached")
        .when(matches("timed out after|timeout|timed out"), "timeout")
        .when(status == "failed", "failed")
        .when(status == "skipped", "skipped")
        .when((status == "completed") & parse_status.isin("failed", "partial"), "invalid-output")
        .otherwise("completed")
    )


def reliability_label(raw: Column, guided: Column, tokens_known: Column) -> Column:
    """Label of a pair from both statuses; a missing side has a null status."""
    either = lambda *values: raw.isin(*values) | guided.isin(*values)
    both = (raw == "completed") & (guided == "completed")
    return (
        F.when(raw.isNull() | guided.isNull(), "partial")
        .when(either("agent-limit-reached"), "limit-reached")
        .when(either("agent-unavailable"), "unavailable")
        .when(both & tokens_known, "strong")
        .when(both, "correctness-only")
        .when(either("failed", "invalid-output"), "failed")
        .otherwise("partial")
    )


def pair_strategies(runs: DataFrame, key: list[str] | None = None, values: tuple[str, ...] = ("run_id", "status", "duration_ms", "total_tokens", "correctness", "passed")) -> DataFrame:
    """The first baseline and the first guided run of each group, side by side, with deltas and percentages.

    runs: ``key``, strategy, ord and ``values``. A group without either strategy
    gives no row; one side may be missing. One aggregation does it: the first
    run by ``ord`` of each strategy is a conditional min_by, combined before the
    shuffle, so neither a sort nor a full outer join is needed.
    """
    key = key or PAIR_KEY
    row = F.struct(*values)
    first = lambda strategy: F.min_by(F.when(F.col("strategy") == strategy, row), F.when(F.col("strategy") == strategy, F.col("ord")))
    pairs = runs.where(F.col("strategy").isin(BASELINE, GUIDED)).groupBy(*key).agg(first(BASELINE).alias("b"), first(GUIDED).alias("g"))
    known = F.col("b.total_tokens").isNotNull() & F.col("g.total_tokens").isNotNull()
    delta = F.col("b.total_tokens") - F.col("g.total_tokens")
    saved = F.col("b.duration_ms") - F.col("g.duration_ms")
    return pairs.select(
        *key,
        *[F.col(f"{side}.{v}").alias(f"{name}_{v}") for side, name in (("b", BASELINE), ("g", GUIDED)) for v in values],
        F.coalesce(F.col("b").isNotNull() & F.col("g").isNotNull() & F.col("b.passed").eqNullSafe(F.col("g.passed")), F.lit(False)).alias("same_pass"),
        round_half_up(F.col("g.correctness") - F.col("b.correctness"), 4).alias("correctness_delta"),
        saved.alias("duration_delta_ms"),
        round_half_up(ratio(saved, F.col("b.duration_ms")) * 100, 4).alias("duration_reduction_percent"),
        delta.alias("token_delta"),
        round_half_up(ratio(delta, F.col("b.total_tokens")) * 100, 4).alias("token_savings_percent"),
        known.alias("tokens_comparable"),
        reliability_label(F.col("b.status"), F.col("g.status"), known).alias("reliability"),
        F.filter(
            F.array(
                F.when(F.col("b").isNull() | F.col("g").isNull(), "one strategy has no run"),
                F.when(~known, "tokens are not known for both runs"),
            ),
            lambda w: w.isNotNull(),
        ).alias("warnings"),
    )


def status_counts(prefix: str = "") -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(f"{prefix}{s.replace('-', '_')}_runs") for s in STATUSES]


def run_summary(runs: DataFrame) -> DataFrame:
    """Counts per status and the distinct agents, strategies and complexities, sorted."""
    names = [F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("agent", "strategy", "complexity")]
    return runs.agg(F.count(F.lit(1)).alias("total_runs"), *status_counts(), *names)


def majority_answer(x: Column) -> list[Column]:
    """Aggregates for ``majority_label``: usable, positive and negative values; zeros count as usable."""
    ok = x.isNotNull() & ~F.isnan(x)
    return [F.count_if(ok), F.count_if(ok & (x > 0)), F.count_if(ok & (x < 0))]


def majority_label(n: Column, up: Column, down: Column) -> Column:
    return F.when(n == 0, "unavailable").when(up > n / 2, "yes").when(down > n / 2, "no").otherwise("mixed")


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Averages (null if there is none), their signs as answers, and majority answers over pairs; one row."""
    done = (F.col(f"{BASELINE}_status") == "completed") & (F.col(f"{GUIDED}_status") == "completed")
    parts = {"tok": majority_answer(F.when(F.col("tokens_comparable"), F.col("token_savings_percent"))), "dur": majority_answer(F.col("duration_reduction_percent"))}
    votes = [c.alias(f"_{name}{i}") for name, cs in parts.items() for i, c in enumerate(cs)]
    one = pairs.agg(
        F.count(F.lit(1)).alias("total_comparisons"),
        F.avg("token_savings_percent").alias("average_token_savings_percent"),
        F.avg("duration_reduction_percent").alias("average_duration_reduction_percent"),
        F.avg("correctness_delta").alias("average_correctness_delta"),
        F.count_if(done).alias("completed_comparisons"),
        F.count_if(done & F.col("same_pass")).alias("preserved_comparisons"),
        *votes,
    )
    n, same = F.col("completed_comparisons"), F.col("preserved_comparisons")
    label = lambda name: majority_label(*[F.col(f"_{name}{i}") for i in range(3)])
    return one.select(
        "total_comparisons",
        "completed_comparisons",
        "preserved_comparisons",
        "average_token_savings_percent",
        "average_duration_reduction_percent",
        "average_correctness_delta",
        (F.col("average_token_savings_percent") > 0).alias("saves_tokens"),
        F.when(n > 0, n == same).alias("preserves_correctness"),
        (F.col("average_duration_reduction_percent") > 0).alias("reduces_time"),
        label("tok").alias("token_answer"),
        F.when((n == 0) & (F.col("total_comparisons") == 0), "unavailable").when(n == 0, "inconclusive").when(n == same, "yes").when(same == 0, "no").otherwise("mixed").alias("correctness_answer"),
        label("dur").alias("duration_answer"),
    )


def outcome_counts(runs: DataFrame) -> DataFrame:
    """Runs by agent and status, only those that occur."""
    return runs.groupBy("agent", "status").agg(F.count(F.lit(1)).alias("n"))


def token_savings(cases: DataFrame) -> DataFrame:
    """Adds tokens_saved and percent_saved (0 for an empty baseline) to case_id, raw_tokens, guided_tokens."""
    saved = F.col("raw_tokens") - F.col("guided_tokens")
    return cases.withColumn("tokens_saved", saved).withColumn("percent_saved", F.when(F.col("raw_tokens") == 0, F.lit(0.0)).otherwise(ratio(saved, F.col("raw_tokens")) * 100))


def token_savings_summary(cases: DataFrame) -> DataFrame:
    """Averages and token sums over cases that were not skipped, 0 if there is none; commands and durations over all."""
    done = ~F.coalesce(F.col("skipped"), F.lit(False))
    mean = lambda c: F.coalesce(F.avg(F.when(done, F.col(c))), F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0))
    return token_savings(cases).agg(
        F.count(F.lit(1)).alias("case_count"),
        F.count_if(done).alias("completed_count"),
        F.count_if(~done).alias("skipped_count"),
        mean("raw_tokens").alias("average_raw_tokens"),
        mean("guided_tokens").alias("average_guided_tokens"),
        mean("tokens_saved").alias("average_tokens_saved"),
        mean("percent_saved").alias("average_percent_saved"),
        total("raw_tokens").alias("total_raw_tokens"),
        total("guided_tokens").alias("total_guided_tokens"),
        total("tokens_saved").alias("total_tokens_saved"),
        F.coalesce(F.sum("commands_run"), F.lit(0)).alias("total_commands"),
        F.coalesce(F.sum(F.col("ms_raw") + F.col("ms_guided")), F.lit(0)).alias("total_duration_ms"),
    )


def plot_points(pairs: DataFrame, runs: DataFrame, metric: str) -> tuple[DataFrame, DataFrame]:
    """(points, skipped): pairs whose ``metric`` is finite with the coordinates of a run, the guided one first; the others with a reason.

    runs: run_id, prompt_tokens, project_score; of repeated run ids the last by ord counts.
    """
    place = runs.groupBy("run_id").agg(F.max_by(F.struct("prompt_tokens", "project_score"), "ord").alias("at"))
    side = lambda name: place.select(F.col("run_id").alias(f"{name}_run_id"), F.col("at").alias(f"{name}_at"))
    met = pairs.join(side(GUIDED), f"{GUIDED}_run_id", "left").join(side(BASELINE), f"{BASELINE}_run_id", "left")
    at = F.coalesce(f"{GUIDED}_at", f"{BASELINE}_at")
    x = F.col(metric)
    reason = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "metric is not available").when(at.isNull(), "run is not known")
    marked = met.select(*PAIR_KEY, x.cast("double").alias("y"), at["prompt_tokens"].alias("x_prompt_tokens"), at["project_score"].alias("x_project_score"), reason.alias("reason"))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL").select(*PAIR_KEY, "reason")


def metrics_long(outcomes: DataFrame) -> DataFrame:
    """One row per outcome and metric; tokens only where known. outcomes: run_id, correctness, duration_ms, total_tokens."""
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in (("correctness", "correctness"), ("duration_ms", "duration_ms"), ("total_tokens", "total_tokens"))])
    return outcomes.select("run_id", F.inline(cells)).where((F.col("metric") != "total_tokens") | F.col("value").isNotNull())


def case_status(outcomes: DataFrame) -> DataFrame:
    """Per case: completed if all outcomes are, failed if all failed, skipped if all were, else partial."""
    all_are = lambda s: F.bool_and(F.col("status") == s)
    label = F.when(all_are("completed"), "completed").when(all_are("failed"), "failed").when(all_are("skipped"), "skipped").otherwise("partial")
    return outcomes.groupBy("case_id").agg(label.alias("case_status"), F.count(F.lit(1)).alias("outcomes"), F.count_if(F.col("status") == "completed").alias("completed"))


def report_status(total: Column, completed: Column, skipped: Column) -> Column:
    """The report's own roll-up: partial only if at least one outcome completed."""
    return F.when(total == 0, "skipped").when(completed == total, "completed").when(completed > 0, "partial").when(skipped == total, "skipped").otherwise("failed")


def hierarchy(runs: DataFrame) -> DataFrame:
    """One row per case with its outcomes in order. A case has as many outcomes as the matrix has cells for it."""
    cell = F.struct("ord", "run_id", "agent", "strategy", "status")
    return runs.groupBy("case_id").agg(F.array_sort(F.collect_list(cell)).alias("outcomes"))


def prompt_variants(spark: SparkSession, tasks: DataFrame, complexities: list[str], strategies: list[str]) -> DataFrame:
    """Every task with every complexity and strategy; the two lists come with the call."""
    pairs = F.array(*[F.struct(F.lit(c).alias("complexity"), F.lit(s).alias("strategy")) for c in complexities for s in strategies])
    return tasks.select("*", F.inline(pairs))
