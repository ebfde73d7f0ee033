"""Code-rot detectors over document lines, imports and inventories.

All work on exploded lines or facts with joins; a detector returns issue rows
of id, detector_id, severity, confidence, file, line and message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritrail.functions import text as X
from veritrail.functions.text import around, line_of, matches

READ_BYTES = 200_000
WINDOW_LINES = 15
# Words that mark a reference as planned.
PLANNED = r"(?i)\b(planned|future|roadmap|not implemented|not yet implemented|later version|coming soon|avoid)\b"
NPM_RUN = r"npm run (?:--\S+\s+)*([\w:.-]+)"
IMPORT = r"""(?:from|import|require\()\s*\(?['"]([^'"]+)['"]"""
SETUP_FILE = r"(?i)^(setup|vitest\.setup|jest\.setup|global-?setup)"
# Names that repeat by convention.
GENERIC_NAMES = ["index", "types", "config", "constants", "utils", "helpers", "main", "__init__"]
# Shell syntax that only POSIX shells take.
# Commands at the start of a script's part that Windows lacks, and calls in sources that fail there.
POSIX_ONLY = r"(^|&&)\s*(rm -rf|cp -r|mv |grep |sed |cat |find \.)"
SPLIT_AT_NEWLINE = r"""\.split\(\s*["']\\n["']\s*\)"""
SPLIT_AT_BACKSLASH = r"""\.split\(\s*["']\\\\["']\s*\)"""
SHELL_TRUE = r"shell:\s*true"
SUBPROCESS_CALL = r"\b(exec|spawn|execFile\w*|spawnSync|execSync|execFileSync)\s*\("
SHELL_REACH = 150

# Claims that documents should not make, with what nearby takes them back, and how far before and after.
_HEDGED = r"(?i)\b(optional|skipped|if available|when available|unavailable|absent)\b"
_NEGATED = r"(?i)\b(cannot|can't|not|never|no|bounded|does not|doesn't)\b"
_CURRENT = r"[^.\n]{0,40}\b(is implemented|is current|is now implemented)\b"
CLAIMS = [
    # cue, claim, hedge, characters before, characters after, severity, confidence
    ("tool-passed-without-hedge", r"(?i)\b(codeql|semgrep|osv-scanner)\b[^.\n]{0,60}\bpassed\b", _HEDGED, 80, 80, "high", "medium"),
    ("skipped-equals-passed", r"(?i)\bskipped\b[^.\n]{0,60}\b(equivalent to|same as|counts as)\b[^.\n]{0,20}\bpassed\b", None, 0, 0, "high", "high"),
    ("exhaustive-secret-claim", r"(?i)\b(exhaustive|complete|comprehensive)\b[^.\n]{0,30}\bsecret\b", _NEGATED, 60, 20, "high", "medium"),
    ("complete-network-isolation-claim", r"(?i)\b(complete|full|guaranteed)\b[^.\n]{0,30}\bnetwork isolation\b|\bguarantees? no network\b", _NEGATED, 60, 20, "high", "medium"),
    ("unsupported-current-claim:manual-pentest", "(?i)manual pentest" + _CURRENT, None, 0, 0, "high", "medium"),
    ("unsupported-current-claim:android-validation", "(?i)(?:android (?:validation|support)|mobile validation)" + _CURRENT, None, 0, 0, "high", "medium"),
    ("attack-scenarios-planned-but-implemented", r"(?i)attack scenario[^.\n]{0,40}\b(is planned|is future|is not yet implemented|not implemented)\b", None, 0, 0, "medium", "medium"),
]
OLD_VERSION, SECURITY_WORD, HISTORICAL = r"\bv0\.2\.1\b", r"(?i)\bsecurity\b", r"(?i)\b(previous|completed|historical|superseded|prior baseline)\b"


def small(documents: DataFrame, most_bytes: int = READ_BYTES) -> DataFrame:
    """Documents up to the size limit, by their content; larger ones are not read."""
    return documents.where(F.octet_length("content") <= most_bytes)


def lines(documents: DataFrame, most_bytes: int = READ_BYTES) -> DataFrame:
    """path, line (from 1), text of documents up to the size limit."""
    split = small(documents, most_bytes).select("path", F.split("content", r"\r?\n").alias("_l"))
    return split.select("path", F.posexplode_outer("_l").alias("line", "text")).where("text IS NOT NULL").withColumn("line", F.col("line") + 1)


def issue(detector: str, cue: str, severity: str, confidence: str, subject: Column, message: Column, file: Column | None = None, line: Column | None = None) -> list[Column]:
    none = F.lit(None)
    return [
        F.concat_ws(":", F.lit(detector), F.lit(cue), subject).alias("id"),
        F.lit(detector).alias("detector_id"),
        F.lit(severity).alias("severity"),
        F.lit(confidence).alias("confidence"),
        (file if file is not None else none.cast("string")).alias("file"),
        (line if line is not None else none).cast("int").alias("line"),
        message.alias("message"),
    ]


def command_references(docs: DataFrame) -> DataFrame:
    """path, line, command, planned: each ``npm run`` name of a line once.

    A reference is planned if such a word stands in it, in the ``WINDOW_LINES``
    lines before, or in a heading above it. Headings form a stack: one of depth
    d hides every earlier one at d or deeper. Windows are within a document,
    whose size the reading limit bounds.
    """
    rows = lines(docs)
    w = W.partitionBy("path").orderBy("line")
    depth = F.length(F.regexp_extract("text", r"^(#{1,6})\s+", 1))
    marked = rows.withColumns({"_depth": F.when(depth > 0, depth), "_planned": F.col("text").rlike(PLANNED)})
    near = F.max("_planned").over(w.rowsBetween(-WINDOW_LINES, 0))
    above = F.lit(False)
    for d in range(1, 7):
        last = F.last(F.when(F.col("_depth") <= d, F.struct(F.col("_depth").alias("d"), F.col("_planned").alias("p"))), ignorenulls=True).over(w)
        above = above | F.coalesce((last["d"] == d) & last["p"], F.lit(False))
    found = marked.withColumns({"_near": near, "_above": above, "_commands": F.array_distinct(F.regexp_extract_all("text", F.lit(NPM_RUN), F.lit(1)))})
    return found.where(F.size("_commands") > 0).select("path", "line", F.explode("_commands").alias("command"), (F.col("_near") | F.col("_above")).alias("planned"))


def stale_commands(docs: DataFrame, scripts: DataFrame) -> DataFrame:
    """References to scripts that do not exist and are not planned, one per document and command."""
    gone = command_references(docs).where(~F.col("planned")).join(scripts.select(F.col("name").alias("command")), "command", "left_anti")
    first = gone.groupBy("path", "command").agg(F.min("line").alias("line"))
    return first.select(*issue("stale-command-reference", "missing-script", "high", "high", F.concat_ws(":", "path", "command"), F.concat(F.lit("no script named "), F.col("command")), F.col("path"), F.col("line")))


def undocumented_scripts(scripts: DataFrame, commands_doc: str, important: list[str]) -> DataFrame:
    """Important scripts whose name the commands document does not hold anywhere."""
    rows = scripts.where(F.col("name").isin(important)).where(~F.contains(F.lit(commands_doc), F.col("name")))
    return rows.select(*issue("stale-command-reference", "undocumented-script", "medium", "medium", F.col("name"), F.concat(F.col("name"), F.lit(" is not documented"))))


def imported_names(files: DataFrame) -> DataFrame:
    """Lower-case base names that relative imports of any file name."""
    found = small(files).select(F.explode(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1))).alias("s")).where(F.col("s").startswith("."))
    return found.select(F.lower(X.basename_no_ext(F.substring_index("s", "?", 1))).alias("base")).distinct()


def unreferenced_files(sources: DataFrame, files: DataFrame, entry_points: list[str]) -> DataFrame:
    """Source files whose base name no relative import names; entry points, index and setup files and examples are left out."""
    base, name = F.lower(X.basename_no_ext(F.col("path"))), X.basename(F.col("path"))
    kept = small(sources).where(~F.col("path").startswith("benchmarks/") & ~F.col("path").startswith("examples/") & (base != "index") & ~name.rlike(SETUP_FILE) & ~F.col("path").isin(entry_points))
    alone = kept.withColumn("base", base).join(imported_names(files), "base", "left_anti")
    return alone.select(*issue("dead-code-candidate", "unreferenced-source-file", "low", "low", F.col("path"), F.lit("no relative import names this file"), F.col("path")))


def unimported_declarations(facts: DataFrame) -> DataFrame:
    """Exported declarations that no other file imports by name. facts: path, imports, declarations arrays."""
    made = facts.select("path", F.explode("declarations").alias("d")).where("d.exported").select("path", F.col("d.name").alias("name"), F.col("d.line").alias("line"))
    used = facts.select(F.col("path").alias("_by"), F.explode("imports").alias("i")).select("_by", F.explode("i.importedNames").alias("name")).distinct()
    alone = made.join(used, (made["name"] == used["name"]) & (made["path"] != used["_by"]), "left_anti")
    return alone.select(*issue("dead-code-candidate", "unreferenced-declaration", "info", "low", F.concat_ws(":", "path", "name"), F.lit("no file imports this declaration"), F.col("path"), F.col("line")))


def unreferenced_scripts(script_files: DataFrame, commands: DataFrame, importing: DataFrame | None = None) -> DataFrame:
    """Script files whose path no command of the package holds, and whose base name no relative import of ``importing`` files names.

    Containment is met by equality: a command gives each of its pieces that is as
    long as some path. Commands are short; the lengths are a few numbers. Files
    named index, and set-up files, are left out.
    """
    sizes = script_files.agg(F.collect_set(F.length("path"))).first()[0]
    pieces = lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.array(*[F.lit(n) for n in sizes]), lambda n: F.substring(c, i, n))))
    held = commands.where(F.length("command") > 0).select(F.explode(F.array_distinct(pieces(F.col("command")))).alias("path")).distinct() if sizes else commands.limit(0).select(F.col("command").alias("path"))
    base, name = F.lower(X.basename_no_ext(F.col("path"))), X.basename(F.col("path"))
    script_files = script_files.where((base != "index") & ~name.rlike(SETUP_FILE))
    alone = script_files.join(held, "path", "left_anti")
    if importing is not None:
        alone = alone.withColumn("base", F.lower(X.basename_no_ext(F.col("path")))).join(imported_names(importing), "base", "left_anti")
    return alone.select(*issue("dead-code-candidate", "unreferenced-script", "low", "medium", F.col("path"), F.lit("no package command runs this file"), F.col("path")))


def stale_test_commands(tests: DataFrame, scripts: DataFrame) -> DataFrame:
    """The first stale ``npm run`` name of each test file."""
    found = lines(tests).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(NPM_RUN), F.lit(1))).alias("command"))
    gone = found.join(scripts.select(F.col("name").alias("command")), "command", "left_anti")
    first = gone.groupBy("path").agg(F.min(F.struct("line", "command")).alias("f"))
    return first.select(*issue("test-rot", "stale-npm-run", "medium", "medium", F.col("path"), F.concat(F.lit("no script named "), F.col("f.command")), F.col("path"), F.col("f.line")))


def focused_tests(tests: DataFrame) -> DataFrame:
    """``.only`` (high) and ``.skip`` (medium) uses, one issue per line."""
    rows = lines(tests).where(F.col("text").rlike(r"\b(?:it|test|describe)\.(?:only|skip)\s*\("))
    only = F.col("text").rlike(r"\b(?:it|test|describe)\.only\s*\(")
    cells = issue("test-rot", "focus", "low", "high", F.concat_ws(":", "path", F.col("line").cast("string")), F.when(only, "a focused test hides others").otherwise("a test is skipped"), F.col("path"), F.col("line"))
    return rows.select(*cells).withColumn("severity", F.when(F.col("message").startswith("a focused"), "high").otherwise("medium"))


def duplicate_basenames(sources: DataFrame) -> DataFrame:
    """Base names below two or three folders of ``src`` or ``scripts``; generic names are left out."""
    parts = F.split("path", "/")
    rows = sources.where((F.size(parts) >= 3) & parts[0].isin("src", "scripts")).select(F.lower(X.basename_no_ext(F.col("path"))).alias("base"), F.concat_ws("/", parts[0], parts[1]).alias("root"))
    pairs = rows.where(~F.col("base").isin(GENERIC_NAMES)).distinct()
    groups = pairs.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("root")).alias("roots")).where(F.col("n").between(2, 3))
    return groups.select(*issue("duplicate-implementation-candidate", "basename-repeat", "info", "low", F.col("base"), F.array_join("roots", ", ")))


def duplicate_exports(facts: DataFrame) -> DataFrame:
    """Exported declarations of one kind and name in two to four files of one analyzer."""
    rows = facts.select("analyzer_id", "path", F.explode("declarations").alias("d")).where("d.exported").select("analyzer_id", F.col("d.kind").alias("kind"), F.lower("d.name").alias("name"), "path").distinct()
    groups = rows.groupBy("analyzer_id", "kind", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, 4))
    return groups.select(*issue("duplicate-implementation-candidate", "export-repeat", "low", "low", F.concat_ws(":", "analyzer_id", "kind", "name"), F.format_string("declared in %d files", "n")))


def duplicate_commands(scripts: DataFrame) -> DataFrame:
    """Commands that two or more script names run."""
    groups = scripts.groupBy("command").agg(F.count_distinct("name").alias("n")).where("n >= 2")
    return groups.select(*issue("duplicate-implementation-candidate", "script-target", "low", "medium", F.col("command"), F.format_string("run by %d scripts", "n")))


def parallel_directories(files: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pairs of folder names that both occur."""
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    segments = F.split("path", "/")
    met = files.select(F.explode(F.filter(cells, lambda p: F.array_contains(segments, p["a"]) | F.array_contains(segments, p["b"]))).alias("p"), segments.alias("s"))
    both = met.groupBy("p.a", "p.b").agg(F.bool_or(F.array_contains("s", F.col("p.a"))).alias("has_a"), F.bool_or(F.array_contains("s", F.col("p.b"))).alias("has_b")).where("has_a AND has_b")
    return both.select(*issue("duplicate-implementation-candidate", "parallel-directories", "info", "low", F.concat_ws(":", "a", "b"), F.lit("both folders exist")))


def undocumented_directories(sources: DataFrame, doc: str, least: int = 3) -> DataFrame:
    """Folders below ``src`` with ``least`` files or more that the architecture document does not name."""
    parts = F.split("path", "/")
    groups = sources.where((F.size(parts) >= 3) & (parts[0] == "src")).groupBy(F.concat_ws("/", parts[0], parts[1]).alias("dir")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    absent = groups.where(~F.contains(F.lit(doc), F.col("dir")))
    return absent.select(*issue("architecture-drift", "undocumented-directory", "low", "medium", F.col("dir"), F.format_string("%d files", "n")))


def stale_paths(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Paths in backticks that no inventory file or folder has."""
    found = lines(docs).select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("`((?:src|scripts|tests|docs)/[\\w./-]+)`"), F.lit(1)))).alias("named"))
    named = found.withColumn("named", F.regexp_replace("named", "/$", ""))
    parts = F.split("path", "/")
    known = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("named")).distinct()
    first = named.join(known, "named", "left_anti").groupBy("path", "named").agg(F.min("line").alias("line"))
    return first.select(*issue("architecture-drift", "stale-path", "medium", "medium", F.concat_ws(":", "path", "named"), F.concat(F.lit("no such path: "), F.col("named")), F.col("path"), F.col("line")))


def version_mismatch(package: DataFrame, lock: DataFrame) -> DataFrame:
    """A lockfile with another version than the package; the name is only compared where versions agree."""
    met = package.select("root", F.col("name").alias("a"), F.col("version").alias("v")).join(lock.select("root", F.col("name").alias("b"), F.col("version").alias("w")), "root")
    version = ~F.col("v").eqNullSafe(F.col("w"))
    rows = met.where(version | ~F.col("a").eqNullSafe(F.col("b")))
    return rows.select(*issue("package-release-rot", "version-mismatch", "blocker", "high", F.col("root"), F.when(version, "lockfile has another version").otherwise("lockfile has another name")))


def posix_scripts(scripts: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Scripts with a part, between ``&&``, that begins with a command only POSIX shells have; high where a document names Windows, else medium."""
    segment = F.get(F.filter(F.transform(F.split("command", "&&"), lambda s: F.trim(s)), lambda s: s.rlike(POSIX_ONLY)), F.lit(0))
    windows = docs is not None and bool(small(docs).agg(F.bool_or(F.col("content").rlike(r"\bWindows\b"))).first()[0])
    rows = scripts.withColumn("_s", segment).where("_s IS NOT NULL")
    return rows.select(*issue("cross-platform-rot", "posix-only-script-syntax", "high" if windows else "medium", "medium", F.col("name"), F.substring("_s", 1, 200))).dropDuplicates(["id"])


def cross_platform_sources(sources: DataFrame, under: str = "src/audits/", splitter: str = "textLines.ts") -> DataFrame:
    """Raw splits at line ends and backslashes, and shells near calls of subprocesses, in files ``under`` a folder but the one that holds the splitter."""
    rows = small(sources).where(F.col("path").startswith(under) & (F.substring_index("path", "/", -1) != splitter))
    near = F.exists(matches(F.col("content"), SHELL_TRUE), lambda m: F.substr("content", F.greatest(m["at"] - SHELL_REACH, F.lit(0)) + 1, SHELL_REACH + F.least(m["at"], F.lit(SHELL_REACH))).rlike(SUBPROCESS_CALL))
    checks = [("raw-split-newline", F.col("content").rlike(SPLIT_AT_NEWLINE), "medium", "high"), ("raw-backslash-split", F.col("content").rlike(SPLIT_AT_BACKSLASH), "medium", "medium"), ("shell-true-usage", near, "high", "medium")]
    cells = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(cue).alias("cue"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))) for cue, hit, severity, confidence in checks]))
    found = rows.select("path", F.explode(cells).alias("c"))
    return found.select(F.concat_ws(":", F.lit("cross-platform-rot"), "c.cue", "path").alias("id"), F.lit("cross-platform-rot").alias("detector_id"), "c.severity", "c.confidence", F.col("path").alias("file"), F.lit(None).cast("int").alias("line"), F.col("c.cue").alias("message"))


def unhedged(content: Column, claim: str, hedge: str | None, before: int, after: int, first_only: bool = False) -> Column:
    """The first match of a claim without a hedge near it; ``first_only`` asks no other than the first match."""
    found = matches(content, claim)
    found = F.slice(found, 1, 1) if first_only else found
    bare = found if hedge is None else F.filter(found, lambda m: ~around(content, m, before, after).rlike(hedge))
    return F.get(bare, F.lit(0))


def claims_without_hedge(docs: DataFrame, claim: str, hedge: str, detector: str, cue: str, severity: str, reach: int = 80) -> DataFrame:
    """Documents with a claim that no hedge stands near, ``reach`` characters before or behind: the first such match."""
    rows = docs.withColumn("_m", unhedged(F.col("content"), claim, hedge, reach, reach)).where("_m IS NOT NULL")
    return rows.select(*issue(detector, cue, severity, "medium", F.col("path"), F.col("_m.match"), F.col("path"), line_of(F.col("content"), F.col("_m"))))


def security_claims(docs: DataFrame, version: str | None = None, scenarios_exist: bool = False, android_exists: bool = False, first_only: bool = False) -> DataFrame:
    """What documents wrongly claim of security validation, one issue for each kind of claim and document.

    Every match of a claim is judged by its own surroundings; with ``first_only``
    the first match of each kind alone, so that a hedged one hides those behind
    it. Planned scenarios are only reported where they exist, android claims where
    it doesn't, and mentions of the old version where ``version`` is 0.2.2 or later.
    """
    skipped = {cue for cue, out in (("attack-scenarios-planned-but-implemented", not scenarios_exist), ("unsupported-current-claim:android-validation", android_exists)) if out}
    content = F.col("content")
    cells = [F.struct(F.lit(cue).alias("cue"), unhedged(content, claim, hedge, before, after, first_only).alias("m"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")) for cue, claim, hedge, before, after, severity, confidence in CLAIMS if cue not in skipped]
    read = small(docs)
    found = read.select("path", "content", F.explode(F.filter(F.array(*cells), lambda c: c["m"].isNotNull())).alias("c"))
    name = "security-validation-assumption-rot"
    issues = found.select(F.concat_ws(":", F.lit(name), "c.cue", "path").alias("id"), F.lit(name).alias("detector_id"), "c.severity", "c.confidence", F.col("path").alias("file"), line_of(content, F.col("c.m")).alias("line"), F.substring("c.m.match", 1, 200).alias("message"))
    if version is None or [int(x) for x in version.split(".")] < [0, 2, 2]:
        return issues
    dated = lines(read.where(F.lower(F.substring_index("path", "/", -1)) != "changelog.md"))
    near = W.partitionBy("path").orderBy("line").rowsBetween(-3, 3)
    seen = dated.withColumns({"_secure": F.max(F.col("text").rlike(SECURITY_WORD)).over(near), "_past": F.max(F.col("text").rlike(HISTORICAL)).over(near)}).where(F.col("text").rlike(OLD_VERSION) & F.col("_secure") & ~F.col("_past"))
    first = seen.groupBy("path").agg(F.min(F.struct("line", "text")).alias("x")).select("path", "x.*")
    return issues.unionByName(first.select(*issue(name, "stale-v021-security-mention", "medium", "low", F.concat_ws(":", "path", F.col("line").cast("string")), F.substring(F.trim("text"), 1, 200), F.col("path"), F.col("line"))))


def feature_claims(docs: DataFrame, features: list[tuple[str, str, bool]]) -> DataFrame:
    """Lines that claim a feature to be there or planned, against whether it is. features: (id, subject pattern, implemented).

    A line that says both is ambiguous; a current claim without the feature is
    high, a planned one with it medium. The few features come with the call.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(p).alias("subject"), F.lit(done).alias("done")) for i, p, done in features])
    rows = lines(docs).select("path", "line", "text", F.explode(cells).alias("f"))
    says = lambda words: F.regexp_like("text", F.concat(F.lit("(?i)"), F.col("f.subject"), F.lit(rf"[^.]*\b(?:{words})\b|\b(?:{words})\b[^.]*"), F.col("f.subject")))
    now, later = says("supports?|is implemented|is available|provides|now includes"), says("planned|future|not yet|roadmap|coming soon")
    kind = F.when(now & later, "ambiguous").when(now & ~F.col("f.done"), "current-but-missing").when(later & F.col("f.done"), "planned-but-implemented")
    found = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    issues = found.select("kind", *issue("docs-code-mismatch", "claim", "info", "medium", F.concat_ws(":", "path", F.col("line").cast("string"), "f.id", "kind"), F.col("text"), F.col("path"), F.col("line")))
    severity = F.when(F.col("kind") == "ambiguous", "info").when(F.col("kind") == "current-but-missing", "high").otherwise("medium")
    return issues.withColumn("severity", severity)


def package_manager_mismatch(docs: DataFrame, reach: int = 150) -> DataFrame:
    """Documents that tell to install with another manager than npm, with no npm install within ``reach`` characters of it. For projects with an npm lockfile."""
    rows = docs.select("path", "content", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?i)\b((?:yarn|pnpm|bun) (?:install|add))\b"), F.lit(1)))).alias("command"))
    at = F.instr("content", F.col("command"))
    start = F.greatest(at - reach, F.lit(1))
    window = F.substr("content", start, at - start + F.length("command") + reach)
    return rows.where(~window.rlike(r"(?i)npm (?:install|ci)\b")).select(*issue("dependency-environment-rot", "package-manager-mismatch", "medium", "medium", F.concat_ws(":", "path", F.lower("command")), F.col("command"), F.col("path")))


def node_versions(workflows: DataFrame) -> DataFrame:
    """path, version: inline ``node-version`` values and the items of a list below such a key, up to the first line that is none.

    A run of list items belongs to the key before it if only items lie between:
    each key and each other line starts a new island.
    """
    w = W.partitionBy("path").orderBy("line")
    item = F.regexp_extract("text", r"""^\s*-\s*["']?([\w.]+)["']?\s*$""", 1)
    rows = lines(workflows).withColumns({"_item": item, "_key": F.col("text").rlike(r"node-version:\s*$"), "_inline": F.regexp_extract("text", r"""node-version:\s*["']?([\w.]+)["']?\s*$""", 1)})
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_item") == "", 1).otherwise(0)).over(w))
    keyed = rows.withColumn("_listed", F.max("_key").over(W.partitionBy("path", "_island")))
    version = F.when(F.col("_inline") != "", F.col("_inline")).when(F.col("_listed") & (F.col("_item") != ""), F.col("_item"))
    return keyed.select("path", version.alias("version")).where("version IS NOT NULL").distinct()
