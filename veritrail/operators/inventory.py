"""File inventories: scanning, classification, counts, duplicates and complexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import text as X
from veritrail.functions.semantics import round_half_up

# Folders that are never looked into.
EXCLUDED_DIRS = ["node_modules", ".git", "dist", "build", "coverage", ".next", ".turbo", ".cache", "lab-output", "reports", "vendor", "out", "target", ".gradle"]
SKIP_BYTES = 20_000_000
COUNT_LINES_BYTES = 500_000

# Path segments that settle a role.
VENDOR, BUILD, GENERATED, REPORTS = ["node_modules", "vendor"], ["dist", "build", "out", ".next", ".turbo", "target", ".gradle"], ["generated", ".cache"], ["reports", "lab-output"]
# File names that settle a category.
PACKAGE_FILES = ["package.json", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml"]
CONFIG_FILES = [".editorconfig", ".gitignore", ".npmignore", "vitest.workspace.ts", "setup.py", "pyproject.toml", "requirements.txt", "setup.cfg", "tox.ini", "pytest.ini", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "pom.xml", "gradle.properties", "gradlew", "gradlew.bat"]
SOURCE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".py", ".go", ".rs", ".java", ".kt", ".kts"]
LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".json": "json", ".md": "markdown", ".yml": "yaml", ".yaml": "yaml"}
CATEGORIES = ["source", "tests", "docs", "config", "package", "ci", "scripts", "report", "generated", "unknown"]
# Weights and caps of the complexity score.
COMPLEXITY = {
    "source_file_count": (0.2, 20),
    "source_lines": (0.2, 2000),
    "language_count": (0.15, 4),
    "internal_imports": (0.15, 50),
    "max_file_lines": (0.1, 300),
    "expected_files": (0.1, 10),
    "expected_symbols": (0.1, 20),
}


def scan(spark: SparkSession, root: str, excluded: list[str] | None = None) -> DataFrame:
    """path (below the root), size_bytes, content (null above the line-count limit) of every file below ``root``.

    Folder and size limits are filters on the listing, so excluded files are
    never read. Spark's listing itself leaves out files of no bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":", 1)[-1]
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^/*" + base.lstrip("/").replace(".", r"\.") + "/", "")
    named = files.where(F.col("length") < SKIP_BYTES).withColumn("_rel", path)
    kept = named.where(~is_excluded(F.col("_rel"), excluded))
    body = F.when(F.col("length") <= COUNT_LINES_BYTES, F.col("content"))
    return kept.select(F.col("_rel").alias("path"), F.col("length").alias("size_bytes"), body.alias("content"))


def is_excluded(path: Column, excluded: list[str] | None = None) -> Column:
    """Whether some folder or file name of the path is excluded."""
    return F.arrays_overlap(F.split(path, r"[\\/]"), F.array(*[F.lit(d) for d in excluded or EXCLUDED_DIRS]))


def line_count(content: Column) -> Column:
    """Lines of a text file; null if its first 512 bytes hold a zero byte, 0 if it is empty."""
    head = F.hex(F.substring(content, 1, 512))
    binary = head.rlike("^(?:..)*00")
    lines = F.length(F.regexp_replace(F.decode(content, "UTF-8"), "[^\n]", "")) + 1
    return F.when(content.isNull() | binary, F.lit(None)).when(F.octet_length(content) == 0, F.lit(0)).otherwise(lines)


def glob_regex(glob: Column) -> Column:
    """``**`` to anything, ``*`` to anything but a slash; everything else is literal."""
    escaped = F.regexp_replace(glob, r"([.+?^${}()|\[\]\\])", r"\\$1")
    starred = F.replace(F.replace(escaped, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*"))
    return F.concat(F.lit("^"), F.replace(starred, F.lit("\u0001"), F.lit(".*")), F.lit(r"\z"))


def collect_globs(files: DataFrame, globs: list[str]) -> DataFrame:
    """Distinct files that match any of the globs, which come with the call and so become one predicate."""
    match = F.exists(F.array(*[F.lit(g) for g in globs]), lambda g: F.regexp_like("path", glob_regex(g)))
    return files.where(match).dropDuplicates(["path"])


def file_tree(files: DataFrame) -> DataFrame:
    """Files and every folder above them: path, kind."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    folders = files.where(F.contains("path", F.lit("/"))).select(F.explode_outer(above).alias("path"))
    return files.select("path", F.lit("file").alias("kind")).unionByName(folders.distinct().withColumn("kind", F.lit("directory")))


def is_test(path: Column) -> Column:
    name, ext = X.basename(path), X.extension(path)
    below = path.startswith("test/") | path.contains("/test/")
    py = (ext == ".py") & (below | name.rlike(r"^test_.*\.py\z") | name.rlike(r"_test\.py\z"))
    jvm = ext.isin(".java", ".kt") & (below | path.contains("src/test/java/") | path.contains("src/test/kotlin/") | name.rlike(r"Tests?\.(java|kt)\z") | name.rlike(r"Spec\.kt\z"))
    return path.startswith("tests/") | path.contains("/tests/") | name.rlike(r"\.(test|spec)\.[jt]sx?\z") | py | jvm


def is_config(path: Column) -> Column:
    name, ext = X.basename(path), X.extension(path)
    return (
        name.rlike(r"^tsconfig(\..+)?\.json\z")
        | name.rlike(r"^vitest\.config\.[jt]s\z")
        | name.rlike(r"^\.eslintrc(\..+)?\z")
        | name.rlike(r"^eslint\.config\.[jt]s\z")
        | name.isin(CONFIG_FILES)
        | (~path.contains("/") & name.startswith("."))
        | ((ext == ".json") & F.lower(name).contains("config"))
    )


def is_stray_report(path: Column) -> Column:
    return X.basename(path).rlike(r"-(security-validation|audit)\.(txt|json)\z")


def category(path: Column) -> Column:
    name, ext = X.basename(path), X.extension(path)
    return (
        F.when(name.isin(PACKAGE_FILES), "package")
        .when(path.startswith(".github/workflows/") & ext.isin(".yml", ".yaml"), "ci")
        .when(is_test(path), "tests")
        .when(path.startswith("scripts/"), "scripts")
        .when(ext.isin(".md", ".mdx") | path.startswith("docs/"), "docs")
        .when(is_config(path), "config")
        .when(is_stray_report(path), "report")
        .when(ext == ".map", "generated")
        .when(ext.isin(SOURCE_EXTENSIONS), "source")
        .otherwise("unknown")
    )


def language(path: Column) -> Column:
    pairs = [F.lit(x) for item in LANGUAGES.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), X.extension(path)), F.lit("unknown"))


def role(path: Column) -> Column:
    kind, ext = category(path), X.extension(path)
    within = lambda names: F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))
    return (
        F.when((kind == "report") | is_stray_report(path) | within(REPORTS), "report-output")
        .when(within(VENDOR), "vendor")
        .when((ext == ".tsbuildinfo") | within(BUILD), "build-output")
        .when((ext == ".map") | within(GENERATED), "generated")
        .when(kind == "tests", "test")
        .when(kind.isin("docs", "package"), kind)
        .when(kind.isin("config", "ci"), "config")
        .when(kind.isin("source", "scripts"), "source")
        .otherwise("unknown")
    )


def experiment_role(path: Column) -> Column:
    """The experiment side's own rules, which differ from ``role``."""
    name = F.lower(X.basename(path))
    return (
        F.when(path.rlike(r"(^|/)(tests?|__tests__)(/|\z)") | name.rlike(r"\.test\.[tj]s\z") | name.startswith("test_"), "test")
        .when(path.rlike(r"(^|/)(src|python|py)(/|\z)"), "source")
        .when(name.endswith(".md"), "docs")
        .when(name.isin("package.json", "package-lock.json", "tsconfig.json", "vitest.config.ts", "vitest.config.js", "requirements.txt", "pyproject.toml"), "config")
        .when(path.contains("contracts/"), "contract")
        .otherwise("other")
    )


def experiment_language(path: Column) -> Column:
    """Of the five languages that experiments know, else null."""
    known = {".ts": "typescript", ".js": "javascript", ".py": "python", ".json": "json", ".md": "markdown"}
    return F.try_element_at(F.create_map(*[F.lit(x) for item in known.items() for x in item]), X.extension(path))


def script_group(name: Column) -> Column:
    n = F.lower(name)
    return (
        F.when(n.startswith("security") | (n == "test:security") | n.startswith("test:fuzz"), "security")
        .when(n.startswith("experiment"), "experiment")
        .when((n == "audit") | n.startswith("audit:"), "audit")
        .when((n == "test") | n.startswith("test:"), "test")
        .when(n.isin("build", "typecheck", "clean") | n.contains("build"), "build")
        .when(n.contains("doc"), "docs")
        .when(n.rlike("release|publish|pack|version"), "release")
        .otherwise("other")
    )


def classify(files: DataFrame) -> DataFrame:
    p = F.col("path")
    return files.withColumns({"extension": X.extension(p), "category": category(p), "language": language(p), "role": role(p)})


def counts(files: DataFrame, by: list[str]) -> DataFrame:
    """Counts by each of ``by`` apart, in one pass: dimension, value, n; an empty value is ``(none)``."""
    cells = F.array(*[F.struct(F.lit(c).alias("dimension"), F.when(F.col(c) == "", "(none)").otherwise(F.col(c)).alias("value")) for c in by])
    return files.select(F.inline(cells)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def complexity_score(m: dict[str, Column]) -> Column:
    """0 to 100: the weighted sum of each metric over its cap, at most 1 each."""
    total = sum((F.lit(w) * F.least(m[name].cast("double") / F.lit(float(cap)), F.lit(1.0)) for name, (w, cap) in COMPLEXITY.items()), F.lit(0.0))
    return round_half_up(total * 100, 0).cast("long")


def project_complexity(files: DataFrame, by: list[str]) -> DataFrame:
    """Counts, sums and extremes of the files per project. files: role, language, lines, code_lines, imports, exports."""
    source, code = F.col("role") == "source", F.col("role").isin("source", "test")
    return files.groupBy(*by).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.count_if(source).alias("source_file_count"),
        F.count_if(F.col("role") == "test").alias("test_file_count"),
        F.coalesce(F.sum(F.when(code, F.col("code_lines"))), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum(F.when(source, F.col("code_lines"))), F.lit(0)).alias("source_lines"),
        F.count_distinct(F.when(code, F.col("language"))).alias("language_count"),
        F.coalesce(F.sum(F.when(source, F.col("imports"))), F.lit(0)).alias("internal_imports"),
        F.coalesce(F.max(F.when(code, F.col("lines"))), F.lit(0)).alias("max_file_lines"),
        F.coalesce(round_half_up(F.avg(F.when(code, F.coalesce("lines", F.lit(0)))), 2), F.lit(0.0)).alias("average_file_lines"),
    )


def repeated_groups(rows: DataFrame, key: list[str], member: str, least: int, most: int | None = None) -> DataFrame:
    """Keys with ``least`` to ``most`` distinct members, and these in order.

    Distinct pairs are counted first, so a key with very many members costs one
    row each and is never collected unless its count is within bounds; without
    an upper bound only the count is returned.
    """
    pairs = rows.where(F.col(member).isNotNull()).select(*key, member).distinct()
    sized = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    if most is None:
        return sized.where(F.col("n") >= least)
    wanted = sized.where(F.col("n").between(least, most))
    return pairs.join(wanted, key).groupBy(*key, "n").agg(F.array_sort(F.collect_list(member)).alias("members"))
