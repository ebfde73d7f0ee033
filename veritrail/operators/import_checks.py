"""Test-file checks over source facts and inventories: imports, versions and script paths that point to nothing.

Each import becomes the few paths that could satisfy it, and these meet the
inventory in one equi-join; an import none of whose paths is there is an issue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import text as X
from veritrail.operators.rot import issue, lines

# Endings that a relative import may leave out.
RESOLVE_EXTENSIONS = ["", ".ts", ".tsx", ".js", ".mjs", ".cjs"]
# Packages that are never local.
JVM_LIBRARIES = ["java.", "javax.", "jakarta.", "kotlin.", "kotlinx.", "org.junit.", "org.assertj.", "org.mockito.", "org.hamcrest.", "io.kotest."]
TITLE_VERSION = r"""\b(?:describe|it|test)\s*\(\s*["'`][^"'`]*\bv(\d+\.\d+\.\d+)\b"""
HISTORICAL = r"(?i)\b(regression|historical|legacy)\b"


def known_paths(files: DataFrame) -> DataFrame:
    """path: every file and every folder above one."""
    parts = F.split("path", "/")
    return files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()


def _script_candidates(folder: Column, source: Column) -> Column:
    base = F.regexp_replace(X.normal_path(F.concat(folder, F.lit("/"), source)), r"\.[cm]?[jt]sx?$", "")
    # An import of the root itself always resolves, so it has no candidates.
    return F.when(source.startswith(".") & (base != ""), F.array(*[F.concat(base, F.lit(e)) for e in RESOLVE_EXTENSIONS]))


def _python_candidates(folder: Column, source: Column, names: Column) -> Column:
    """One dot is the file's own folder, each further one a folder up, the root at most; a bare ``.`` takes the imported names as modules."""
    dots, rest = F.regexp_extract(source, r"^(\.*)", 1), F.regexp_replace(source, r"^\.+", "")
    modules = F.when(rest != "", F.array(F.replace(rest, F.lit("."), F.lit("/")))).otherwise(names)
    up = F.regexp_replace(X.normal_path(F.concat(folder, F.lit("/"), F.repeat(F.lit("../"), F.length(dots) - 1))), r"^(?:\.\./?)+", "")
    at = F.when(up == "", "").otherwise(F.concat(up, F.lit("/")))
    found = F.flatten(F.transform(modules, lambda m: F.array(F.concat(at, m, F.lit(".py")), F.concat(at, m, F.lit("/__init__.py")))))
    return F.when((dots != "") & (F.size(found) > 0), found)


def _jvm_candidates(source: Column, language: Column) -> Column:
    """File names of the type, or of the type that holds an imported member, in any folder; Kotlin may import Java."""
    local = source.contains(".") & ~source.endswith(".") & ~source.endswith("*")
    for prefix in JVM_LIBRARIES:
        local = local & ~source.startswith(prefix)
    own = F.substring_index(source, ".", -1)
    outer = F.substring_index(F.regexp_replace(source, r"\.[^.]*$", ""), ".", -1)
    named = lambda ext: F.array(*[F.concat(F.lit("*/"), n, F.lit(ext)) for n in (own, outer)])
    return F.when(local, F.when(language == "kotlin", F.concat(named(".kt"), named(".java"))).otherwise(named(".java")))


def missing_imports(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Imports of parsed test files that no inventory file satisfies, one issue per file and import.

    Script imports are relative paths, compared with files and folders; Python
    imports only if relative; JVM imports by type name. facts: as
    ``facts.source_facts`` gives them; files: path.
    """
    rows = facts.where((F.col("role") == "test") & (F.col("parse_status") == "parsed")).select("path", "language", F.explode("imports").alias("i"))
    rows = rows.select("path", "language", F.col("i.source").alias("source"), F.col("i.importedNames").alias("names")).where("source IS NOT NULL")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    language = F.col("language")
    kind = F.when(language == "python", "missing-python-source-import").when(language.isin("java", "kotlin"), "missing-jvm-source-import").otherwise("missing-source-import")
    candidates = F.when(language == "python", _python_candidates(folder, F.col("source"), F.col("names"))).when(language.isin("java", "kotlin"), _jvm_candidates(F.col("source"), language)).otherwise(_script_candidates(folder, F.col("source")))
    wanted = rows.select(F.col("path").alias("file"), kind.alias("kind"), "source", F.explode(candidates).alias("path"))
    types = files.where(X.extension(F.col("path")).isin(".java", ".kt")).select(F.concat(F.lit("*/"), X.basename(F.col("path"))).alias("path")).distinct()
    known = known_paths(files).unionByName(types).withColumn("there", F.lit(True))
    gone = wanted.join(known, "path", "left").groupBy("file", "kind", "source").agg(F.max("there").alias("there")).where("there IS NULL")
    cells = issue("test-rot", "import", "low", "low", F.concat_ws(":", "file", "kind", "source"), F.concat(F.lit("imports a missing file: "), F.col("source")), F.col("file"))
    certain = F.col("kind") == "missing-source-import"
    return gone.select("kind", *cells).withColumns({"severity": F.when(certain, "medium").otherwise("low"), "confidence": F.when(certain, "high").otherwise("low")})


def stale_versions(tests: DataFrame, current: str) -> DataFrame:
    """Lines of test files whose title names another version than the current one, unless they say that it is a past one."""
    found = lines(tests).withColumn("version", F.regexp_extract("text", TITLE_VERSION, 1)).where((F.col("version") != "") & (F.col("version") != current) & ~F.col("text").rlike(HISTORICAL))
    return found.select(*issue("test-rot", "stale-version-mention", "low", "low", F.concat_ws(":", "path", F.col("line").cast("string"), "version"), F.concat(F.lit("title names v"), F.col("version")), F.col("path"), F.col("line")))


def missing_test_paths(scripts: DataFrame, files: DataFrame) -> DataFrame:
    """Paths after ``vitest run`` in package scripts that are neither a file nor a folder. scripts: name, command."""
    named = scripts.select("name", F.explode(F.regexp_extract_all("command", F.lit(r"vitest run ([^\s&|]+)"), F.lit(1))).alias("path"))
    named = named.withColumn("path", F.regexp_replace("path", r"""^["']|["']$""", "")).distinct()
    gone = named.join(known_paths(files), "path", "left_anti")
    return gone.select(*issue("test-rot", "script-references-missing-test-path", "medium", "high", F.concat_ws(":", "name", "path"), F.concat(F.lit("no such test path: "), F.col("path"))))
