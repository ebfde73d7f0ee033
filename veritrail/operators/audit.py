"""Audit issues: order, duplicates, thresholds, roll-ups and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.semantics import dense_counts, keep_first

# Severities from weak to strong, in both vocabularies.
AUDIT_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "blocker": 4}
SECURITY_RANK = {"skipped": 0, "informational": 1, "minor": 2, "major": 3, "blocker": 4}
THRESHOLD_RANK = {"low": 1, "medium": 2, "high": 3, "blocker": 4}
# Other vocabularies' names for them.
NPM_SEVERITY = {"critical": "blocker", "high": "blocker", "moderate": "major", "low": "minor"}
SECURITY_TO_AUDIT = {"blocker": "blocker", "major": "high", "minor": "medium", "informational": "info", "skipped": "info"}
MOST_RECOMMENDATIONS = 200


def lookup(table: dict, key: Column, default=None) -> Column:  # noqa: ANN001
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def severity_rank(severity: Column, ranks: dict[str, int] | None = None) -> Column:
    return lookup(ranks or AUDIT_RANK, severity)


def breaches(severity: Column, fail_on: str, ranks: dict[str, int] | None = None) -> Column:
    """Whether a severity reaches the threshold; ``info`` never does and ``none`` is never reached."""
    if fail_on == "none":
        return F.lit(False)
    return F.coalesce(severity_rank(severity, ranks) >= THRESHOLD_RANK[fail_on], F.lit(False))


def deduplicate(issues: DataFrame) -> DataFrame:
    """The first issue of each id by ord."""
    return keep_first(issues, ["id"], ["ord"])


def deduplicate_last(candidates: DataFrame) -> DataFrame:
    """The last candidate of each id by ord."""
    return keep_first(candidates, ["id"], ["ord"], last=True)


def severity_counts(issues: DataFrame) -> DataFrame:
    return dense_counts(issues, "severity", list(AUDIT_RANK))


def exit_decision(issues: DataFrame, fail_on: str, detector_errors: int = 0) -> DataFrame:
    """One row: exit code (1 if an issue reaches the threshold), highest severity, and the label; a breach goes before detector errors."""
    n, hit = F.count(F.lit(1)), F.count_if(breaches(F.col("severity"), fail_on))
    one = issues.agg(n.alias("issues"), hit.alias("breaching"), F.max_by("severity", severity_rank(F.col("severity"))).alias("highest_severity"))
    label = F.when(F.col("breaching") > 0, "fail-on threshold breached").when(F.lit(detector_errors > 0), "detector errors").when(F.col("issues") == 0, "no issues").otherwise("issues found below fail-on threshold")
    return one.select("*", (F.col("breaching") > 0).cast("int").alias("exit_code"), label.alias("verdict"))


def recommendations(issues: DataFrame, most: int = MOST_RECOMMENDATIONS) -> DataFrame:
    """One row per recommended action: issues, detectors, highest severity; strongest first, then by first issue, ``most`` of them."""
    rows = issues.groupBy("recommended_action").agg(
        F.count(F.lit(1)).alias("issues"),
        F.array_sort(F.collect_set("detector_id")).alias("detectors"),
        F.max_by("severity", severity_rank(F.col("severity"))).alias("highest_severity"),
        F.min("ord").alias("first_ord"),
    )
    return rows.orderBy(severity_rank(F.col("highest_severity")).desc(), "first_ord").limit(most)


def detector_report(registry: DataFrame, issues: DataFrame) -> DataFrame:
    """Every registered detector with its number of issues, 0 included."""
    n = issues.groupBy("detector_id").agg(F.count(F.lit(1)).alias("issues"))
    return registry.join(n, "detector_id", "left").na.fill(0, ["issues"])


def select_detectors(registry: DataFrame, types: list[str], areas: list[str]) -> DataFrame:
    """Detectors of a type in the set with an area in common, in registry order."""
    return registry.where(F.col("audit_type").isin(types) & F.arrays_overlap("areas", F.array(*[F.lit(a) for a in areas]))).orderBy("ord")


def error_category(message: Column) -> Column:
    return F.when(message.rlike("(?i)ENOENT|no such file|ENOTDIR|EACCES|EPERM"), "filesystem").when(message.rlike("(?i)JSON|unexpected token|parse"), "parse").otherwise("unknown")


def findings_to_issues(findings: DataFrame) -> DataFrame:
    """Security findings in the audit vocabulary."""
    severity = lookup(SECURITY_TO_AUDIT, F.col("severity"), "info")
    return findings.select(
        "ord",
        F.concat_ws(":", F.lit("security"), "check_id", "id").alias("id"),
        F.concat(F.lit("security-"), F.col("check_id")).alias("detector_id"),
        severity.alias("severity"),
        (severity == "blocker").alias("release_blocking"),
        F.col("title").alias("recommended_action"),
    )


def bounded(items: Column, most: int) -> Column:
    """STRUCT(items, total, displayed, omitted) of an array."""
    n = F.size(items)
    return F.struct(F.slice(items, 1, most).alias("items"), n.alias("total"), F.least(n, F.lit(most)).alias("displayed"), F.greatest(n - most, F.lit(0)).alias("omitted"))


def union_distinct(frames: list[DataFrame], value: str) -> DataFrame:
    """First-seen distinct values over several tables in order: value and its first place."""
    rows = None
    for i, df in enumerate(frames):
        part = df.select(F.struct(F.lit(i).alias("part"), "ord").alias("first_seen"), value)
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(value).agg(F.min("first_seen").alias("first_seen"))


def tagged_findings(outcomes: DataFrame) -> DataFrame:
    """Warnings, failures and skipped outcomes as findings with a severity. outcomes: run_id, status, warnings."""
    warned = outcomes.select("run_id", F.lit("warning").alias("severity"), F.explode("warnings").alias("message"))
    failed = outcomes.where("status = 'failed'").select("run_id", F.lit("failure").alias("severity"), F.lit("outcome failed").alias("message"))
    skipped = outcomes.where("status = 'skipped'").select("run_id", F.lit("skipped").alias("severity"), F.lit("outcome was skipped").alias("message"))
    return warned.unionByName(failed).unionByName(skipped)
