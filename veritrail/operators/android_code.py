"""Android source and rule files: calls with arguments, and pattern rules on lines, XML and database rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.text import identifier_words
from veritrail.operators.audit import lookup
from veritrail.operators.rot import lines

LOG_CALL = r"\b(?:Log\.[vdiwe]|Timber\.\w+|println)\s*\((.*)\)"
DEBUG_GUARD = r"BuildConfig\.DEBUG|isLoggable"
# Rule, pattern and severity of single lines.
LINE_RULES = [
    ("webview-javascript", r"javaScriptEnabled\s*=\s*true|setJavaScriptEnabled\(true\)", "minor"),
    ("webview-file-access", r"allowFileAccess(?:FromFileURLs)?\s*=\s*true|setAllowFileAccess(?:FromFileURLs)?\(true\)", "major"),
    ("webview-universal-access", r"allowUniversalAccessFromFileURLs\s*=\s*true|setAllowUniversalAccessFromFileURLs\(true\)", "blocker"),
    ("webview-js-bridge", r"addJavascriptInterface\(", "major"),
    ("webview-ssl-ignored", r"onReceivedSslError[^\n]*proceed\(\)|handler\.proceed\(\)", "blocker"),
    ("webview-mixed-content", r"MIXED_CONTENT_ALWAYS_ALLOW", "major"),
    ("world-readable", r"MODE_WORLD_(?:READABLE|WRITEABLE)", "blocker"),
    ("external-storage", r"getExternalStorage(?:Directory|PublicDirectory)\(|getExternalFilesDir\(", "minor"),
    ("clipboard-write", r"setPrimaryClip\(", "minor"),
]
# FileProvider path elements that share more than a folder.
WIDE_PATHS = {"root-path": "blocker", "external-path": "minor", "external-files-path": "minor"}
PROVIDER_PATHS = "`root-path` ARRAY<STRUCT<_name: STRING, _path: STRING>>, `external-path` ARRAY<STRUCT<_name: STRING, _path: STRING>>, `external-files-path` ARRAY<STRUCT<_name: STRING, _path: STRING>>, `files-path` ARRAY<STRUCT<_name: STRING, _path: STRING>>, `cache-path` ARRAY<STRUCT<_name: STRING, _path: STRING>>"


def split_arguments(x: Column) -> Column:
    """Arguments at the top level of a call: commas inside brackets or quotes do not split, an escaped quote does not end one.

    One fold over the characters with a small state, in SQL.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, c: Column) -> Column:
        quoted = s["quote"] != ""
        quote = F.when(quoted, F.when((c == s["quote"]) & ~s["escaped"], "").otherwise(s["quote"])).when(c.isin('"', "'"), c).otherwise("")
        depth = s["depth"] + F.when(quoted, 0).when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
        split = ~quoted & (c == ",") & (s["depth"] == 0)
        return F.struct(
            depth.alias("depth"),
            quote.alias("quote"),
            (quoted & (c == "\\") & ~s["escaped"]).alias("escaped"),
            (s["at"] + 1).alias("at"),
            # Places are kept, not texts, so a long argument is not built up letter by letter.
            F.when(split, F.concat(s["cuts"], F.array(s["at"] + 1))).otherwise(s["cuts"]).alias("cuts"),
        )

    last = F.aggregate(F.split(x, ""), start, step)
    ends = F.concat(last["cuts"], F.array(F.length(x) + 1))
    parts = F.transform(ends, lambda end, i: F.trim(F.substring(x, F.coalesce(F.get(ends, i - 1), F.lit(0)) + 1, end - F.coalesce(F.get(ends, i - 1), F.lit(0)) - 1)))
    return F.filter(parts, lambda a: a != "")


def log_calls(files: DataFrame, dictionary: dict[str, str]) -> DataFrame:
    """path, line, sensitivity, debug_guarded, logs_exception, dynamic of each log call.

    A tag or message is sensitive if it is an identifier, or has a template
    variable, of which a word is in the dictionary.
    """
    rows = lines(files).withColumn("_args", F.regexp_extract("text", LOG_CALL, 1)).where(F.col("text").rlike(LOG_CALL))
    arguments = split_arguments(F.col("_args"))
    names = F.flatten(F.transform(arguments, lambda a: F.when(a.rlike(r'^".*"$'), F.regexp_extract_all(a, F.lit(r"\$\{?(\w+)"), F.lit(1))).otherwise(F.regexp_extract_all(a, F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))))
    words = F.flatten(F.transform(names, identifier_words))
    hit = F.get(F.filter(words, lambda w: lookup(dictionary, w).isNotNull()), F.lit(0))
    return rows.select("path", "line", lookup(dictionary, hit).alias("sensitivity"), F.col("text").rlike(DEBUG_GUARD).alias("debug_guarded"), F.exists(names, lambda n: n.rlike("^(e|ex|err|error|throwable|exception)$")).alias("logs_exception"), (F.size(names) > 0).alias("dynamic"))


def line_rules(files: DataFrame) -> DataFrame:
    """path, line, rule, severity of every rule that a line breaks; comment lines are left out."""
    cells = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, p, s in LINE_RULES]), lambda x: x.isNotNull())
    return lines(files).where(~F.col("text").rlike(r"^\s*(//|\*)")).select("path", "line", F.inline(cells))


def provider_paths(raw: DataFrame) -> DataFrame:
    """FileProvider paths (path, raw) that share a whole root or storage: path, element, shared, severity."""
    p = raw.select("path", F.from_xml("raw", PROVIDER_PATHS).alias("p"))

    def shared(element: str) -> Column:
        paths = F.coalesce(F.col("p")[element], F.array().cast("array<struct<_name:string,_path:string>>"))
        return F.transform(paths, lambda x: F.struct(F.lit(element).alias("element"), x["_path"].alias("shared")))

    cells = F.flatten(F.array(*[shared(e) for e in [*WIDE_PATHS, "files-path", "cache-path"]]))
    rows = p.select("path", F.inline(cells))
    whole = F.coalesce(F.trim("shared"), F.lit("")).isin("", ".", "/")
    severity = F.coalesce(lookup(WIDE_PATHS, F.col("element")), F.when(whole, "minor"))
    return rows.withColumn("severity", severity).where("severity IS NOT NULL")


def database_rules(raw: DataFrame) -> DataFrame:
    """Firestore, storage and realtime rules (path, raw) that let anyone in: path, match, access, severity."""
    text = F.regexp_replace("raw", r"//[^\n]*", "")
    allows = raw.select("path", F.explode_outer(F.regexp_extract_all(text, F.lit(r"allow\s+([\w,\s]+?)\s*(?::\s*if\s+true\s*)?;"), F.lit(0))).alias("rule")).where("rule IS NOT NULL")
    access = F.trim(F.regexp_extract("rule", r"allow\s+([\w,\s]+?)\s*[:;]", 1))
    firestore = allows.select("path", F.col("rule").alias("match"), access.alias("access"))
    realtime = raw.select("path", F.explode_outer(F.regexp_extract_all("raw", F.lit(r'"\.(read|write)"\s*:\s*(?:true|"true")'), F.lit(1))).alias("access")).where("access IS NOT NULL")
    rows = firestore.unionByName(realtime.select("path", F.concat(F.lit("."), "access").alias("match"), "access"))
    return rows.withColumn("severity", F.when(F.col("access").rlike("write|create|update|delete"), "blocker").otherwise("major"))


def google_services(raw: DataFrame) -> DataFrame:
    """Clients of a google-services file (path, raw): project, package and whether an API key is in it, as a digest."""
    schema = "project_info STRUCT<project_id: STRING>, client ARRAY<STRUCT<client_info: STRUCT<android_client_info: STRUCT<package_name: STRING>>, api_key: ARRAY<STRUCT<current_key: STRING>>>>"
    g = raw.select("path", F.from_json("raw", schema).alias("g"))
    rows = g.select("path", F.col("g.project_info.project_id").alias("project_id"), F.explode("g.client").alias("c"))
    key = F.get("c.api_key", F.lit(0))["current_key"]
    return rows.select("path", "project_id", F.col("c.client_info.android_client_info.package_name").alias("package_name"), F.when(key.isNotNull(), F.concat(F.lit("sha256:"), F.sha2(key, 256))).alias("api_key_fingerprint"))
