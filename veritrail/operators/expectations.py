"""Stage-context expectations: matching, recall and inclusion ratios, state comparison, determinism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.semantics import ratio_metric, utf16_len

# Categories by what identifies their target.
PATH_CATEGORIES = ["file", "test-file", "fixture", "factory", "mock", "setup-file", "test-configuration"]
SYMBOL_CATEGORIES = ["symbol", "contract", "validator", "constant", "error", "schema-or-serializer"]
ID_CATEGORIES = ["workflow", "stage", "command", "rule", "report-contract"]
INSTRUCTION_ARTIFACTS = ["workflow-instruction-packet", "full-workflow-library"]


def target_key(artifact: Column, category: Column, match: Column) -> Column:
    """One string per target; ``match`` is a struct with path, symbolId, filePath, startLine, endLine, responsibilityId, name, commandText, id, evidenceId."""
    field = lambda name: F.concat_ws("|", artifact, category, F.concat(F.lit(f"{name}:"), match[name].cast("string")))
    fixed = lambda *names: F.concat_ws("|", F.lit("context-capsule"), category, *[F.concat(F.lit(f"{n}:"), match[n].cast("string")) for n in names])
    return (
        F.when(category.isin(PATH_CATEGORIES), field("path"))
        .when(category.isin(SYMBOL_CATEGORIES), field("symbolId"))
        .when(category == "source-range", fixed("filePath", "startLine", "endLine"))
        .when(category == "production-responsibility", field("responsibilityId"))
        .when(category == "package-script", fixed("name"))
        .when(category == "test-command", fixed("commandText"))
        .when(category.isin(ID_CATEGORIES), field("id"))
        .when(category == "provenance", field("evidenceId"))
    )


def match_expectations(expectations: DataFrame, observed: DataFrame) -> DataFrame:
    """Outcome per expectation: matched or missing; a forbidden one is violated when seen and matched when not.

    Adds the distinct source instances and field paths of the matches in
    observed order. Observations are first reduced to one row per target and
    instance, so a target seen very often costs one row per instance.
    """
    keys = ["source_artifact", "category", "target_key"]
    seen = observed.groupBy(*keys, "source_instance", "source_field_path").agg(F.min("ord").alias("o"))
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("o", c))), lambda x: x[c]))
    targets = seen.groupBy(*keys).agg(ordered("source_instance").alias("matched_instances"), ordered("source_field_path").alias("matched_field_paths"))
    met = expectations.join(targets, keys, "left")
    hit = F.col("matched_instances").isNotNull()
    outcome = F.when(F.col("inclusion") == "forbidden", F.when(hit, "violated").otherwise("matched")).otherwise(F.when(hit, "matched").otherwise("missing"))
    none = F.array().cast("array<string>")
    return met.select("ord", "expectation_id", "inclusion", *keys, outcome.alias("outcome"), F.coalesce("matched_instances", none).alias("matched_instances"), F.coalesce("matched_field_paths", none).alias("matched_field_paths"))


def inclusion_metrics(matches: DataFrame) -> DataFrame:
    """One row per metric: required recall, allowed coverage, forbidden inclusion, provenance recall; with counts, rate and availability."""
    rows = [
        ("required_recall", F.col("inclusion") == "required", "matched"),
        ("allowed_coverage", F.col("inclusion") == "allowed", "matched"),
        ("forbidden_inclusion", F.col("inclusion") == "forbidden", "violated"),
        ("provenance_recall", (F.col("inclusion") == "required") & (F.col("category") == "provenance"), "matched"),
    ]
    counts = matches.agg(*[F.struct(F.count_if(who & (F.col("outcome") == hit)).alias("n"), F.count_if(who).alias("d")).alias(name) for name, who, hit in rows])
    cells = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"{name}.n").alias("n"), F.col(f"{name}.d").alias("d")) for name, _, _ in rows])
    return counts.select(F.inline(cells)).select("metric", ratio_metric(F.col("n"), F.col("d")).alias("m")).select("metric", "m.*")


def irrelevant_inclusion(observed: DataFrame, expectations: DataFrame, artifacts: list[str], categories: list[str]) -> DataFrame:
    """The share of distinct observed targets that no required or allowed expectation names; one row. Without such evidence it is not applicable."""
    keys = ["source_artifact", "category", "target_key"]
    seen = observed.where(F.col("source_artifact").isin(artifacts) & F.col("category").isin(categories)).groupBy(*keys).agg(F.min("ord").alias("ord"))
    wanted = expectations.where(F.col("inclusion").isin("required", "allowed")).select(*keys).distinct().withColumn("wanted", F.lit(True))
    counts = seen.join(wanted, keys, "left").agg(F.count_if(F.col("wanted").isNull()).alias("n"), F.count(F.lit(1)).alias("d"))
    return counts.select(ratio_metric(F.col("n"), F.col("d")).alias("m")).select("m.*")


def irrelevant_targets(observed: DataFrame, expectations: DataFrame, artifacts: list[str], categories: list[str]) -> DataFrame:
    """The targets behind ``irrelevant_inclusion`` with their first place."""
    keys = ["source_artifact", "category", "target_key"]
    seen = observed.where(F.col("source_artifact").isin(artifacts) & F.col("category").isin(categories)).groupBy(*keys).agg(F.min("ord").alias("ord"))
    return seen.join(expectations.where(F.col("inclusion").isin("required", "allowed")), keys, "left_anti")


def responsibility_completeness(mappings: DataFrame) -> DataFrame:
    """Counts per mapping status and the share mapped among those that apply. mappings: mapping_status."""
    status = F.col("mapping_status")
    one = mappings.agg(*[F.count_if(status == s).alias(s.replace("-", "_")) for s in ("mapped", "partial", "missing", "not-applicable")])
    apply_ = F.col("mapped") + F.col("partial") + F.col("missing")
    return one.select("*", ratio_metric(F.col("mapped"), apply_).alias("m")).select("mapped", "partial", "missing", "not_applicable", "m.*")


def context_size(sources: DataFrame, by: list[str]) -> DataFrame:
    """Characters and estimated tokens per group: each source is rounded up by itself. sources: n_chars."""
    return sources.groupBy(*by).agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.ceil(F.col("n_chars") / 4)), F.lit(0)).cast("long").alias("estimated_tokens"))


def full_file_parts(files: DataFrame) -> DataFrame:
    """Adds ``part``, a file below its header line. The baseline text of a case is its parts in path order, with a line break between; it is not built, as a case may hold any number of files. files: case_id, path, content."""
    return files.withColumn("part", F.concat(F.lit("=== FILE: "), F.col("path"), F.lit(" ===\n"), F.coalesce("content", F.lit("")), F.lit("\n")))


def full_file_baseline(files: DataFrame) -> DataFrame:
    """Per case the files, characters and estimated tokens of its baseline text."""
    totals = full_file_parts(files).groupBy("case_id").agg(F.count(F.lit(1)).alias("total_files"), F.sum(utf16_len(F.col("part")).cast("long")).alias("n"))
    chars = F.col("n") + F.col("total_files") - 1
    return totals.select("case_id", "total_files", chars.alias("total_chars"), F.ceil(chars / 4).cast("long").alias("total_estimated_tokens"))


def compare_states(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per expected field: matched, or null where the artifact exposes no such field. Both: instance, field, value (canonical JSON)."""
    seen = actual.select("instance", "field", F.col("value").alias("actual"), F.lit(True).alias("exposed"))
    met = expected.select("instance", "field", F.col("value").alias("expected")).join(seen, ["instance", "field"], "left")
    return met.select("instance", "field", "expected", "actual", F.when(F.col("exposed"), F.col("expected").eqNullSafe(F.col("actual"))).alias("matched"), F.when(F.col("exposed"), "available").otherwise("unavailable").alias("availability"))


def field_consistency(pairs: DataFrame, fields: list[str], left: str = "capsule", right: str = "audit") -> DataFrame:
    """One row per pair and field that differs between two structs; nulls are equal to each other."""
    checks = F.array(*[F.struct(F.lit(f).alias("field"), F.to_json(F.struct(F.col(f"{left}.{f}").alias("v"))).alias("a"), F.to_json(F.struct(F.col(f"{right}.{f}").alias("v"))).alias("b")) for f in fields])
    return pairs.select("pair_id", F.inline(checks)).where(~F.col("a").eqNullSafe(F.col("b")))


def flatten_evidence(artifacts: DataFrame, paths: dict[str, tuple[str, str]], artifact: str) -> DataFrame:
    """Array fields of an artifact to evidence rows. paths: field path to (category, field of the element that identifies it, '' for the element itself)."""
    parts = None
    for path, (category, name) in paths.items():
        value = F.col("x") if not name else F.col(f"x.{name}")
        rows = artifacts.select("source_instance", F.posexplode(path).alias("i", "x"))
        rows = rows.select("source_instance", F.lit(artifact).alias("source_artifact"), F.lit(category).alias("category"), value.cast("string").alias("target"), F.format_string(f"{path}[%d]", "i").alias("source_field_path"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.where(F.col("target").isNotNull()).distinct()


def determinism(runs: DataFrame) -> DataFrame:
    """Per case: digest of the first run, runs that differ from it, and whether all agree; not applicable for one run. runs: case_id, run INT, canonical STRING."""
    cell = F.struct("run", F.sha2(F.col("canonical"), 256).alias("sha256"))
    one = runs.groupBy("case_id").agg(F.array_sort(F.collect_list(cell)).alias("r"))
    first = F.element_at("r", 1)["sha256"]
    differing = F.transform(F.filter("r", lambda x: x["sha256"] != first), lambda x: x["run"])
    return one.select("case_id", F.size("r").alias("runs"), first.alias("baseline_sha256"), differing.alias("mismatched_runs"), F.when(F.size("r") == 1, "not-applicable").otherwise("available").alias("availability"), F.when(F.size("r") > 1, F.size(differing) == 0).alias("deterministic"))
