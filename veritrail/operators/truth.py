"""What a project says of itself: packages, lockfiles, commands and documents, from their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.operators.rot import READ_BYTES

# Groups of scripts, by patterns of their lower-case names; the first that fits counts.
SCRIPT_GROUPS = [("security", "^security|^test:security$|^test:fuzz"), ("experiment", "^experiment"), ("audit", "^audit$|^audit:"), ("test", "^test$|^test:"), ("build", "^(?:build|typecheck|clean)$|build"), ("docs", "doc"), ("release", "release|publish|pack|version")]
# What documents mention.
MENTIONS = {"audit": r"\baudit\b", "security_validation": r"security[- ]?valid|security:validate", "experiments": r"\bexperiment", "release_publish": r"\b(?:release|publish|npm publish)\b", "planned_commands": r"\bplanned\b", "current_commands": r"\bcurrent\b"}


def _text(v: str, path: str) -> Column:
    """A JSON string; null for any other value."""
    part = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(v, path, "string"))


def _texts(v: str, path: str) -> Column:
    """An object whose values are all strings; null for any other value."""
    part = F.try_variant_get(v, path, "map<string, variant>")
    fine = F.forall(F.map_values(part), lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    return F.when(fine, F.transform_values(part, lambda _, x: F.try_variant_get(x, "$", "string")))


def packages(raw: DataFrame) -> DataFrame:
    """root and the typed fields of package files (root, raw): fields of a wrong type are null, or empty for scripts and dependencies; unreadable files give no row."""
    rows = raw.select("root", F.try_parse_json("raw").alias("v")).where("v IS NOT NULL")
    none = F.create_map().cast("map<string,string>")
    listed = F.try_variant_get("v", "$.files", "array<variant>")
    names = F.transform(F.filter(listed, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))), lambda x: F.try_variant_get(x, "$", "string"))
    return rows.select(
        "root",
        *[_text("v", f"$.{name}").alias(name) for name in ("name", "version", "description", "main", "module")],
        F.coalesce(_text("v", "$.types"), _text("v", "$.typings")).alias("types"),
        F.coalesce(_texts("v", "$.bin"), F.when(_text("v", "$.bin").isNotNull(), F.create_map(F.lit(""), _text("v", "$.bin")))).alias("bin"),
        *[F.coalesce(_texts("v", f"$.{name}"), none).alias(alias) for name, alias in (("scripts", "scripts"), ("dependencies", "dependencies"), ("devDependencies", "dev_dependencies"))],
        _texts("v", "$.peerDependencies").alias("peer_dependencies"),
        _texts("v", "$.engines").alias("engines"),
        names.alias("files"),
        _text("v", "$.packageManager").alias("package_manager"),
    )


def lockfiles(raw: DataFrame, packages: DataFrame) -> DataFrame:
    """root, name, version, lockfile_version, consistent of each package's lockfile (root, raw); a root without one has present false.

    Names and versions are the file's own, else those of its root entry;
    consistent is null where either side names no package.
    """
    # The root entry's key is empty, which no path can name.
    entries = F.try_variant_get("v", "$.packages", "map<string, variant>")
    own = raw.select("root", F.try_parse_json("raw").alias("v")).where("v IS NOT NULL").withColumn("e", F.try_element_at(entries, F.lit("")))
    number = F.schema_of_variant(F.try_variant_get("v", "$.lockfileVersion", "variant"))
    facts = own.select("root", F.lit(True).alias("present"), F.coalesce(_text("v", "$.name"), _text("e", "$.name")).alias("name"), F.coalesce(_text("v", "$.version"), _text("e", "$.version")).alias("version"), F.when(number.rlike("INT|DECIMAL|DOUBLE|FLOAT"), F.try_variant_get("v", "$.lockfileVersion", "double")).alias("lockfile_version"))
    both = packages.select("root", F.col("name").alias("_n"), F.col("version").alias("_v")).join(facts, "root", "left")
    same = F.when(F.col("_n").isNotNull() & F.col("name").isNotNull(), (F.col("_n") == F.col("name")) & F.col("_v").eqNullSafe(F.col("version")))
    return both.select("root", F.coalesce("present", F.lit(False)).alias("present"), "name", "version", "lockfile_version", same.alias("consistent"))


def script_group(name: Column) -> Column:
    group = F.lit("other")
    for value, pattern in reversed(SCRIPT_GROUPS):
        group = F.when(F.lower(name).rlike(pattern), value).otherwise(group)
    return group


def commands(packages: DataFrame) -> DataFrame:
    """root, name, command, script_group of each script."""
    return packages.select("root", F.explode("scripts").alias("name", "command")).withColumn("script_group", script_group(F.col("name")))


def documents(docs: DataFrame) -> DataFrame:
    """path, title (of the first first-level heading), is_readme, is_changelog and what each document (path, content) mentions; those above the reading limit count as empty."""
    content = F.when(F.octet_length("content") <= READ_BYTES, F.col("content")).otherwise("")
    base = F.lower(F.substring_index("path", "/", -1))
    title = F.nullif(F.regexp_extract(content, r"(?m)^#\s+(.+)$", 1), F.lit(""))
    return docs.select("path", title.alias("title"), (base == "readme.md").alias("is_readme"), (base == "changelog.md").alias("is_changelog"), *[content.rlike(f"(?i){pattern}").alias(f"mentions_{name}") for name, pattern in MENTIONS.items()])
