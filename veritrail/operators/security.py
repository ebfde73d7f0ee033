"""Security validation: forbidden files, check categories, verdicts and candidate summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.text import identifier_words, locale_order
from veritrail.operators.audit import lookup

# Why a check counts toward a verdict.
REASONS = ["release-blocker", "target-project-blocker", "tool-framework-blocker", "environment-inconclusive", "optional-skipped-tool", "adversarial-scenario-skipped", "scanner-finding", "adversarial-scenario-failure", "required-evidence-missing", "informational-evidence"]
IMPACTS = ["release-blocker", "target-project-blocker", "tool-framework-blocker", "environment-inconclusive"]
MOST_SKIPPED = 4
# Words of identifiers that never name a secret by themselves.
PUBLIC_WORDS = ["apikey", "projectid", "appid", "packagename", "storagebucket", "databaseurl", "senderid", "clientid", "mobilesdkappid", "applicationid", "namespace"]

# Secret values that are examples, and how a text refers to a value kept elsewhere.
PLACEHOLDERS = ["changeme", "change_me", "change-me", "password", "secret", "example", "sample", "dummy", "fake", "test", "your-token-here", "your_token_here", "replace-me", "replace_me", "redacted", "masked", "todo", "xxx", "placeholder", "n/a", "none"]
REFERENCE = r"\$\{[^}]*\}|\$[A-Za-z_][A-Za-z0-9_]*|%[A-Za-z_][A-Za-z0-9_]*%|^@(string|xml|raw|array|integer|bool)/"


def matches_pattern(path: Column, pattern: Column) -> Column:
    """Folder prefix (``dir/``), suffix (``*.ext``), simple glob, or a name that is the path or a folder of it; case does not matter."""
    f, p = F.lower(path), F.lower(pattern)
    parts = F.filter(F.split(p, r"\*"), lambda x: x != "")
    return (
        F.when(p.endswith("/"), f.startswith(p) | (f == F.left(p, F.length(p) - 1)))
        .when(p.startswith("*."), f.endswith(F.substr(p, F.lit(2))))
        .when(p.contains("*") & (F.size(parts) == 1), f.contains(F.get(parts, F.lit(0))))
        .when(p.contains("*"), f.startswith(F.get(parts, F.lit(0))) & f.endswith(F.get(parts, F.size(parts) - 1)))
        .otherwise((f == p) | f.startswith(F.concat(p, F.lit("/"))))
    )


def forbidden_files(files: DataFrame, patterns: list[str], exceptions: list[str]) -> DataFrame:
    """file and the first pattern it matches, unless an exception matches it. The two lists come with the call."""
    raw = F.regexp_replace("path", r"\\", "/")
    named = files.withColumn("_file", F.when(raw.startswith("package/"), F.substr(raw, F.lit(9))).otherwise(raw))
    array = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    spared = F.exists(array(exceptions), lambda p: matches_pattern(F.col("_file"), p))
    first = F.get(F.filter(array(patterns), lambda p: matches_pattern(F.col("_file"), p)), F.lit(0))
    return named.where(~spared).select(F.col("_file").alias("file"), first.alias("pattern")).where("pattern IS NOT NULL")


def is_critical(file: Column) -> Column:
    f = F.lower(file)
    return f.contains(".env") | f.endswith(".pem") | f.endswith(".key") | f.endswith(".p12") | f.startswith("lab-output/")


def value_kind(value: Column) -> Column:
    """What a captured secret value is: ``suppressed`` if empty or an obvious placeholder, ``reference`` if it only names a value, else ``literal``; null for null."""
    trimmed = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    placeholder = (trimmed == "") | F.lower(trimmed).isin(PLACEHOLDERS) | trimmed.rlike(r"^([^\r\n])\1*\z")
    return F.when(value.isNull(), F.lit(None)).when(placeholder, "suppressed").when(trimmed.rlike(REFERENCE), "reference").otherwise("literal")


def select_scenarios(scenarios: DataFrame, checks: list[str], profile: str) -> DataFrame:
    """Scenarios of a chosen check that name the profile or none."""
    return scenarios.where(F.col("check_id").isin(checks) & ((F.size("profiles") == 0) | F.array_contains("profiles", profile)))


def check_reason(checks: DataFrame, mandatory: list[str]) -> DataFrame:
    """Adds ``reason``, null for a check that neither failed nor was skipped. checks: id, status, severity, verdict_impact."""
    scenario = F.col("id").endswith("-no-scenarios-registered") | F.col("id").endswith("-attack-runner-error") | F.col("verdict_impact").isNotNull()
    skipped = F.when(scenario, "adversarial-scenario-skipped").when(F.col("id").isin(mandatory), "required-evidence-missing").otherwise("optional-skipped-tool")
    failed = F.when(F.col("verdict_impact").isin(IMPACTS), F.col("verdict_impact")).when(scenario, "adversarial-scenario-failure").when(F.col("severity") == "informational", "informational-evidence").otherwise("scanner-finding")
    return checks.withColumn("reason", F.when(F.col("status") == "skipped", skipped).when(F.col("status") == "failed", failed))


def reason_summary(checks: DataFrame, findings: DataFrame, mandatory: list[str]) -> DataFrame:
    """Every reason with its count, 0 included; informational evidence counts findings, not checks."""
    cells = check_reason(checks, mandatory).agg(*[F.count_if(F.col("reason") == r).alias(r) for r in REASONS[:-1]])
    info = findings.agg(F.count_if(F.col("severity") == "informational").alias(REASONS[-1]))
    rows = cells.select(F.inline(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(f"`{r}`").alias("n")) for r in REASONS[:-1]])))
    return rows.unionByName(info.select(F.lit(REASONS[-1]).alias("reason"), F.col(f"`{REASONS[-1]}`").alias("n")))


def verdict(checks: DataFrame, findings: DataFrame, mandatory: list[str]) -> DataFrame:
    """One row: counts and the first verdict that applies."""
    must, status, severity = F.col("id").isin(mandatory), F.col("status"), F.col("severity")
    marks = {
        "failed_mandatory": must & (status == "failed"),
        "skipped_mandatory": must & (status == "skipped"),
        "skipped_optional": ~must & (status == "skipped"),
        "blockers": severity == "blocker",
        "majors": severity == "major",
    }
    from_checks = list(marks)[:3]
    rows = checks.select(*[(c if n in from_checks else F.lit(False)).alias(n) for n, c in marks.items()])
    rows = rows.unionByName(findings.select(*[(F.lit(False) if n in from_checks else c).alias(n) for n, c in marks.items()]))
    one = rows.agg(*[F.count_if(n).alias(n) for n in marks])
    ladder = (
        F.when((F.col("blockers") > 0) | (F.col("failed_mandatory") > 0), "not-ready-security-blocker-remains")
        .when(F.col("skipped_mandatory") >= MOST_SKIPPED, "inconclusive-audit-environment-incomplete")
        .when(F.col("majors") > 0, "not-ready-security-blocker-remains")
        .when(F.col("skipped_optional") > 0, "ready-except-optional-manual-checks")
        .otherwise("ready-for-release-preparation")
    )
    return one.select("*", ladder.alias("verdict"))


def classify_identifiers(identifiers: DataFrame, dictionary: dict[str, str], column: str = "identifier") -> DataFrame:
    """Adds ``sensitivity``: by the whole identifier, else by its first word in the dictionary; never by a part of a word."""
    words = identifier_words(F.col(column))
    whole = F.array_join(words, "")
    first = F.get(F.filter(words, lambda w: lookup(dictionary, w).isNotNull()), F.lit(0))
    found = F.when((F.size(words) == 0) | whole.isin(PUBLIC_WORDS), F.lit(None)).otherwise(F.coalesce(lookup(dictionary, whole), lookup(dictionary, first)))
    return identifiers.withColumn("sensitivity", found)


def candidate_order() -> list[Column]:
    """The total order of candidates, texts as in dictionaries; unknown module and line come first."""
    text = lambda name: locale_order(F.col(name)).asc_nulls_first()
    return [text("category"), text("rule_id"), text("module_path"), text("path"), F.asc_nulls_first("line"), F.asc_nulls_first("col"), text("fingerprint")]


def candidate_summary(candidates: DataFrame) -> DataFrame:
    """Counts by confidence, resolution state and category in one pass: dimension, value, n."""
    cells = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("confidence", "resolution_state", "category")])
    return candidates.select(F.inline(cells)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


# Levels that a summary of candidates always has.
CONFIDENCES, RESOLUTION_STATES = ["unknown", "low", "medium", "high"], ["resolved", "unresolved", "missing", "malformed", "unsupported", "not-applicable"]


def candidate_roll_up(candidates: DataFrame, confidences: list[str] | None = None, states: list[str] | None = None) -> DataFrame:
    """dimension, value, n: the total, checks with candidates, every confidence and resolution state (0 too), and categories that occur, by grouping sets in one aggregation.

    candidates: check_id, confidence, resolution_state, category.
    """
    spark = candidates.sparkSession
    grouped = spark.sql(
        """SELECT CASE grouping_id(confidence, resolution_state, category) WHEN 3 THEN 'confidence' WHEN 5 THEN 'resolution_state' WHEN 6 THEN 'category' ELSE 'total' END AS dimension,
             coalesce(confidence, resolution_state, category) AS value, count(*) AS n, count(DISTINCT check_id) AS checks
           FROM {candidates} GROUP BY GROUPING SETS ((confidence), (resolution_state), (category), ())""",
        candidates=candidates,
    )
    whole = F.array(F.struct("dimension", "value", "n"), F.struct(F.lit("checks_with_candidates").alias("dimension"), F.lit(None).cast("string").alias("value"), F.col("checks").alias("n")))
    cells = grouped.select(F.inline(F.when(F.col("dimension") == "total", whole).otherwise(F.slice(whole, 1, 1))))
    levels = [("confidence", v) for v in confidences or CONFIDENCES] + [("resolution_state", v) for v in states or RESOLUTION_STATES]
    dense = spark.createDataFrame(levels, "dimension string, value string").withColumn("n", F.lit(0).cast("long"))
    return cells.unionByName(dense).groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def project_kind(modules: DataFrame) -> DataFrame:
    """One row: the project's kind, UI toolkit and confidence from its modules. modules: kind, ui_toolkit, confidence."""
    has = lambda c, v: F.bool_or(F.col(c) == v)
    kind = F.when(has("kind", "application"), "application").when(has("kind", "library"), "library").otherwise("unknown")
    both = has("ui_toolkit", "compose") & has("ui_toolkit", "views")
    toolkit = F.when(both | has("ui_toolkit", "mixed"), "mixed").when(has("ui_toolkit", "compose"), "compose").when(has("ui_toolkit", "views"), "views").otherwise("unknown")
    return modules.agg(kind.alias("kind"), toolkit.alias("ui_toolkit"), F.max_by("confidence", lookup({"low": 0, "medium": 1, "high": 2}, F.col("confidence"))).alias("confidence"))


def signing_chain(build_types: DataFrame, configs: DataFrame, files: DataFrame) -> DataFrame:
    """Release build type to its signing config by name to a committed keystore by base name, if the config holds a literal credential."""
    c = configs.select(F.col("name").alias("signing_config"), "store_file", "literal_credential", "dynamic")
    k = files.select(F.substring_index("path", "/", -1).alias("_base"), F.col("path").alias("keystore")).groupBy("_base").agg(F.min("keystore").alias("keystore"))
    met = build_types.where("build_type = 'release'").join(c, "signing_config", "left").join(k, F.substring_index("store_file", "/", -1) == F.col("_base"), "left")
    state = F.when(F.col("dynamic"), "unresolved").when(F.col("literal_credential").isNull(), "missing").when(F.col("literal_credential") & F.col("keystore").isNotNull(), "committed").otherwise("clear")
    return met.select("module", "signing_config", "keystore", state.alias("state"))
