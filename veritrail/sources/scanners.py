"""Outputs of scanners as rows: npm audit, ls, outdated and pack, Semgrep, OSV, Dependency-Check, SARIF lint.

Each reader takes rows of (source, raw), keeps malformed output as an error row
of its own, and never infers a schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.stored import spread
from veritrail.operators.audit import NPM_SEVERITY, lookup

MOST_RESULTS = 5_000
# What each tool's levels mean here; a level that is not named has no severity unless a default is given.
SEMGREP_SEVERITY = {"ERROR": "major", "WARNING": "minor"}
ADVISORY_SEVERITY = {"CRITICAL": "major", "HIGH": "major", "MODERATE": "minor", "MEDIUM": "minor", "LOW": "informational"}
LINT_SEVERITY = {"fatal": "major", "error": "major", "warning": "minor", "information": "informational", "informational": "informational"}
NPM_LEVELS = ["critical", "high", "moderate", "low", "info"]
MOST_DEPTH = 20


def malformed(raw: DataFrame) -> DataFrame:
    """source, code for output that is empty, no JSON, or no JSON object."""
    parsed = F.try_parse_json("raw")
    code = F.when(F.coalesce(F.trim("raw"), F.lit("")) == "", "empty").when(parsed.isNull(), "malformed").when(~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), "not-an-object")
    return raw.select("source", code.alias("code")).where("code IS NOT NULL")


def npm_audit(raw: DataFrame) -> DataFrame:
    """One row per package and advisory, or per package without one: source, package, severity, title, url.

    The severity is the package's own, ``moderate`` where it names none; names of
    other packages that a package is vulnerable through are no advisories.
    """
    schema = "vulnerabilities MAP<STRING, STRUCT<name: STRING, severity: STRING, range: STRING, via: STRING>>"
    found = raw.select("source", F.explode(F.from_json("raw", schema)["vulnerabilities"]).alias("package", "v"))
    via = F.from_json(F.col("v.via"), "ARRAY<STRING>")
    advisories = F.filter(F.transform(via, lambda v: F.from_json(v, "title STRING, url STRING")), lambda a: a["title"].isNotNull())
    rows = found.select("source", "package", F.coalesce("v.severity", F.lit("moderate")).alias("own"), F.explode_outer(advisories).alias("a"))
    return rows.select("source", "package", lookup(NPM_SEVERITY, F.lower("own"), "informational").alias("severity"), F.col("a.title").alias("title"), F.col("a.url").alias("url"))


def npm_audit_counts(raw: DataFrame) -> DataFrame:
    """What the output itself counts: source, level, n, 0 for a level it does not name, and the total."""
    found = raw.select("source", F.try_parse_json("raw").alias("v")).where(F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    count = lambda level: F.coalesce(F.try_variant_get("v", f"$.metadata.vulnerabilities.{level}", "bigint"), F.lit(0).cast("bigint"))
    cells = F.array(*[F.struct(F.lit(level).alias("level"), count(level).alias("n")) for level in [*NPM_LEVELS, "total"]])
    return found.select("source", F.inline(cells))


def npm_outdated(raw: DataFrame) -> DataFrame:
    schema = "MAP<STRING, STRUCT<current: STRING, wanted: STRING, latest: STRING>>"
    return raw.select("source", F.explode(F.from_json("raw", schema)).alias("package", "v")).select("source", "package", "v.*")


def npm_pack(raw: DataFrame) -> DataFrame:
    """Files of a dry run: source, path, size."""
    schema = "ARRAY<STRUCT<name: STRING, version: STRING, files: ARRAY<STRUCT<path: STRING, size: BIGINT>>>>"
    packs = raw.select("source", F.explode(F.from_json("raw", schema)).alias("p"))
    return packs.select("source", F.col("p.name").alias("package"), F.explode("p.files").alias("f")).select("source", "package", "f.*")


def npm_tree(raw: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """Nodes of dependency trees of any shape, the root at depth 0: source, path ARRAY, depth, name, missing, invalid, deeper.

    A level is the children of the one before. Nodes at ``most_depth`` have
    ``deeper`` if there are dependencies below them, which are not followed.
    Only a flag that is the JSON value true counts; a name that is no string is
    ``unknown``; null, empty and malformed outputs have no node.
    """
    openers = F.length("raw") - F.length(F.replace("raw", F.lit("{")))
    root = F.struct(F.array().cast("array<string>").alias("path"), F.lit(0).alias("depth"), F.try_parse_json("raw").alias("node"))
    part = lambda node, name: F.try_variant_get(node, f"$.{name}", "variant")
    is_a = lambda node, name, kind: F.coalesce(F.schema_of_variant(part(node, name)).startswith(kind), F.lit(False))
    flag = lambda node, name: is_a(node, name, "BOOLEAN") & F.coalesce(F.try_variant_get(node, f"$.{name}", "boolean"), F.lit(False))

    def opened(v: Column) -> Column:
        return F.struct(v.alias("v"), F.try_variant_get(v["node"], "$.dependencies", "map<string,variant>").alias("parts"))

    def row(o: Column) -> Column:
        v, node = o["v"], o["v"]["node"]
        name = F.when(is_a(node, "name", "STRING"), F.try_variant_get(node, "$.name", "string")).otherwise("unknown")
        deeper = (v["depth"] == most_depth) & (F.coalesce(F.size(o["parts"]), F.lit(0)) > 0)
        return F.struct(v["path"].alias("path"), v["depth"].alias("depth"), name.alias("name"), flag(node, "missing").alias("missing"), flag(node, "invalid").alias("invalid"), deeper.alias("deeper"))

    def below(o: Column) -> Column:
        v = o["v"]
        parts = F.transform(F.map_entries(o["parts"]), lambda e: F.struct(F.concat(v["path"], F.array(e["key"])).alias("path"), (v["depth"] + 1).alias("depth"), e["value"].alias("node")))
        return F.coalesce(parts, F.slice(F.array(v), 1, 0))

    def follow(held: Column, _: Column) -> Column:
        return F.struct(F.transform(F.flatten(F.transform(held["level"], below)), opened).alias("level"), F.concat(held["found"], F.transform(held["level"], row)).alias("found"))

    begin = F.struct(F.array(opened(root)).alias("level"), F.array().cast("array<struct<path:array<string>,depth:int,name:string,missing:boolean,invalid:boolean,deeper:boolean>>").alias("found"))
    found = F.aggregate(F.sequence(F.lit(0), F.least(F.lit(most_depth), openers)), begin, follow, lambda held: held["found"])
    rows = spread(raw.select("source", "raw"), "source").where(F.try_parse_json("raw").isNotNull())
    return rows.select("source", F.inline(found))


def npm_ls(raw: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """Missing and invalid dependencies of a tree: source, path, package (its name), problem; one row for each problem of a node."""
    tree = npm_tree(raw, most_depth)
    problems = F.array_compact(F.array(F.when(F.col("missing"), "missing"), F.when(F.col("invalid"), "invalid")))
    return tree.select("source", F.array_join("path", ">").alias("path"), F.col("name").alias("package"), F.explode(problems).alias("problem"))


def semgrep(raw: DataFrame, most: int = MOST_RESULTS) -> DataFrame:
    """Results up to the limit with whether there are more: source, rule, path, line, severity, truncated."""
    schema = "results ARRAY<STRUCT<check_id: STRING, path: STRING, start: STRUCT<line: INT>, extra: STRUCT<severity: STRING, message: STRING>>>"
    parsed = raw.select("source", F.from_json("raw", schema)["results"].alias("r"))
    rows = parsed.select("source", (F.size("r") > most).alias("truncated"), F.posexplode(F.slice("r", 1, most)).alias("pos", "x"))
    severity = lookup(SEMGREP_SEVERITY, F.upper("x.extra.severity"), "informational")
    return rows.select("source", "pos", F.col("x.check_id").alias("rule"), F.col("x.path").alias("path"), F.col("x.start.line").alias("line"), severity.alias("severity"), "truncated")


def cvss_severity(score: Column) -> Column:
    return F.when(score.isNull() | F.isnan(score), F.lit(None)).when(score >= 7, "major").when(score >= 4, "minor").otherwise("informational")


def osv(raw: DataFrame) -> DataFrame:
    """One row per vulnerability; it is a finding with a path and a severity, else a candidate."""
    schema = "results ARRAY<STRUCT<source: STRUCT<path: STRING>, packages: ARRAY<STRUCT<package: STRUCT<name: STRING, version: STRING>, vulnerabilities: ARRAY<STRUCT<id: STRING, summary: STRING, database_specific: STRUCT<severity: STRING>, severity: ARRAY<STRUCT<type: STRING, score: STRING>>>>>>>>"
    results = raw.select("source", F.explode(F.from_json("raw", schema)["results"]).alias("r"))
    packages = results.select("source", F.col("r.source.path").alias("path"), F.explode("r.packages").alias("p"))
    rows = packages.select("source", "path", F.col("p.package.name").alias("package"), F.explode("p.vulnerabilities").alias("v"))
    named = lookup(ADVISORY_SEVERITY, F.upper("v.database_specific.severity"))
    # The first score that begins with a number; a vector does not.
    numbers = F.filter(F.transform("v.severity", lambda x: F.regexp_extract(x["score"], r"^\s*([+-]?[0-9]*\.?[0-9]+)", 1).try_cast("double")), lambda n: n.isNotNull())
    scored = cvss_severity(F.get(numbers, F.lit(0)))
    severity = F.coalesce(named, scored)
    kind = F.when(F.col("path").isNotNull() & severity.isNotNull(), "finding").otherwise("candidate")
    return rows.select("source", "path", "package", F.col("v.id").alias("vulnerability"), severity.alias("severity"), kind.alias("kind"))


def dependency_check(raw: DataFrame) -> DataFrame:
    """One row per dependency and vulnerability; the severity is that of the CVSS 3 score, else of the CVSS 2 score, else the tool's word. A score of 0 has none."""
    schema = "dependencies ARRAY<STRUCT<fileName: STRING, filePath: STRING, vulnerabilities: ARRAY<STRUCT<name: STRING, severity: STRING, cvssv3: STRUCT<baseScore: DOUBLE>, cvssv2: STRUCT<score: DOUBLE>>>>>"
    found = raw.select("source", F.explode(F.from_json("raw", schema)["dependencies"]).alias("d"))
    rows = found.select("source", F.col("d.filePath").alias("path"), F.col("d.fileName").alias("package"), F.explode("d.vulnerabilities").alias("v"))
    score = F.coalesce("v.cvssv3.baseScore", "v.cvssv2.score")
    named = lookup({k: v for k, v in ADVISORY_SEVERITY.items() if k != "MODERATE"}, F.upper("v.severity"))
    severity = F.when(score.isNull(), named).when(score > 0, cvss_severity(score))
    return rows.select("source", "path", "package", F.col("v.name").alias("vulnerability"), severity.alias("severity"))


def lint_sarif(raw: DataFrame) -> DataFrame:
    schema = "runs ARRAY<STRUCT<results: ARRAY<STRUCT<ruleId: STRING, level: STRING, message: STRUCT<text: STRING>, locations: ARRAY<STRUCT<physicalLocation: STRUCT<artifactLocation: STRUCT<uri: STRING>, region: STRUCT<startLine: INT>>>>>>>>"
    results = raw.select("source", F.explode(F.from_json("raw", schema)["runs"]).alias("r")).select("source", F.explode("r.results").alias("x"))
    place = F.get("x.locations", F.lit(0))["physicalLocation"]
    severity = lookup(LINT_SEVERITY, F.lower("x.level"))
    return results.select("source", F.col("x.ruleId").alias("rule"), severity.alias("severity"), F.col("x.message.text").alias("message"), place["artifactLocation"]["uri"].alias("path"), place["region"]["startLine"].alias("line"))


def lint_xml(raw: DataFrame) -> DataFrame:
    schema = "issue ARRAY<STRUCT<_id: STRING, _severity: STRING, _message: STRING, location: ARRAY<STRUCT<_file: STRING, _line: INT>>>>"
    rows = raw.select("source", F.explode(F.from_xml("raw", schema)["issue"]).alias("x"))
    place = F.get("x.location", F.lit(0))
    severity = lookup(LINT_SEVERITY, F.lower("x._severity"))
    return rows.select("source", F.col("x._id").alias("rule"), severity.alias("severity"), F.col("x._message").alias("message"), place["_file"].alias("path"), place["_line"].alias("line"))
