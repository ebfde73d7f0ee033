"""Source facts: imports and declarations of files by language patterns, one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.code import code_only
from veritrail.functions.stored import once, spread
from veritrail.functions.text import line_of, matches
from veritrail.operators.audit import lookup

MOST_BYTES = 1_000_000
# Per language, how a line imports and what it declares (name in group 1).
# Imports are looked for in whole texts without comments and insides of strings, so they may go over several lines.
_SCRIPT_IMPORT = r"""(?<![\w$.])(?:import\s*\(\s*|require\s*\(\s*|import\b(?:[^"'`;()=]*?\bfrom\s*|\s*)|export\b[^"'`;()=]*?\bfrom\s*)(?:"[^"]*"|'[^']*')"""
IMPORTS = {"python": r"(?m)^[ \t]*(?:from[ \t]+[\w.]+[ \t]+import\b[ \t]*(?:\([^)]*\)|[^\n]*)|import[ \t]+[\w.][^\n]*)", "java": r"(?m)^[ \t]*import\s+(?:static\s+)?[\w.]+(?:\.\*)?", "kotlin": r"(?m)^[ \t]*import\s+[\w.]+(?:\.\*)?", "typescript": _SCRIPT_IMPORT, "javascript": _SCRIPT_IMPORT}
SOURCES = {"python": r"^\s*(?:from|import)\s+([\w.]+)", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "kotlin": r"^\s*import\s+([\w.]+)"}
DECLARES = {"python": r"^(?:async\s+)?(?:def|class)\s+(\w+)", "java": r"^\s*(?:public\s+|abstract\s+|final\s+)*(?:class|interface|enum|record)\s+(\w+)", "kotlin": r"^\s*(?:public\s+|internal\s+|open\s+|data\s+|sealed\s+)*(?:class|interface|object|fun)\s+(\w+)", "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|const|type|enum)\s+(\w+)", "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|const)\s+(\w+)"}


# Kinds of declarations by their keyword, and which analyzer reads a language.
KINDS = {"function": "function", "def": "function", "fun": "function", "class": "class", "record": "class", "object": "class", "interface": "interface", "type": "type", "const": "constant", "enum": "enum"}
ANALYZERS = {"typescript": "typescript-javascript", "javascript": "typescript-javascript", "python": "python", "java": "jvm", "kotlin": "jvm"}
KEYWORD = r"\b(function|def|fun|class|record|object|interface|type|const|enum)\s+\w+"


def bound_names(statement: Column, source: Column, language: str) -> Column:
    """The names that an import binds: ``a, {b, c as d}`` binds a, b and d; a dotted import its last part. An import that binds none has an empty list."""
    if language in ("java", "kotlin"):
        return F.filter(F.array(F.substring_index(source, ".", -1)), lambda n: n != "*")
    clause = F.regexp_extract(statement, r"(?s)\bimport\b(.*)$", 1) if language == "python" else F.regexp_extract(statement, r"(?s)^import\b(?:\s+type\b(?!\s*(?:,|from\b)))?([^\"'(]*?)\bfrom\s*[\"']", 1)
    parts = F.split(F.regexp_replace(clause, r"[{}()]", ","), ",")
    last = F.transform(parts, lambda p: F.regexp_extract(F.trim(F.regexp_replace(p, r"\s+", " ")), r"(?:^|\s|\.)([\w$]+)$", 1))
    return F.filter(last, lambda n: n != "")


def source_facts(files: DataFrame) -> DataFrame:
    """path, analyzer_id, language, role, parse_status, imports (source, importedNames, line) and declarations (name, kind, exported, line) of source and test files.

    A file above the limit or in another language is ``file-level-only`` or
    ``unsupported``, never missing. Comments and the insides of strings are no
    code. Texts are worked on within each row, so a file stays one row. files:
    path, language, role, content.
    """
    code = F.lit(None).cast("string")
    for name in IMPORTS:
        code = F.when(F.col("language") == name, code_only(F.col("content"), name)).otherwise(code)
    # Small files are much work for few bytes, so they are dealt out before it.
    kept = spread(files.where(F.col("role").isin("source", "test")), "path").withColumn("_code", F.when(F.octet_length("content") <= MOST_BYTES, code)).withColumn("_lines", F.split("_code", r"\r?\n"))
    known = F.col("language").isin(list(IMPORTS))
    small = F.coalesce(F.octet_length("content") <= MOST_BYTES, F.lit(False))
    if "size_bytes" in files.columns:  # an inventory may say that it read less than the file
        small = small & F.coalesce(F.col("size_bytes") <= MOST_BYTES, F.lit(True))
    status = F.when(~known, "unsupported").when(~small, "file-level-only").otherwise("parsed")

    def per_language(table: dict[str, str], make) -> Column:  # noqa: ANN001
        out = F.lit(None)
        for name, pattern in table.items():
            out = F.when(F.col("language") == name, make(pattern, name)).otherwise(out)
        return F.when(status == "parsed", out)

    numbered = F.transform("_lines", lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))

    def imports(pattern: str, name: str) -> Column:
        def one(m: Column) -> Column:
            if name in SOURCES:
                source = F.regexp_extract(m["match"], SOURCES[name], 1)
            else:
                # The quoted part ends the statement; what stands there is read in the text itself.
                quoted = F.length(F.regexp_extract(m["match"], r"""(?:"[^"]*"|'[^']*')$""", 0))
                source = F.substr("content", m["at"] + F.length(m["match"]) - quoted + 2, quoted - 2)
            lead = F.length(F.regexp_extract(m["match"], r"^\s*", 0))
            start = F.struct((m["at"] + lead).alias("at"))
            return F.struct(source.alias("source"), bound_names(m["match"], source, name).alias("importedNames"), line_of(F.col("_code"), start).alias("line"))

        return F.transform(matches(F.col("_code"), pattern), one)

    def declarations(pattern: str, name: str) -> Column:
        hits = F.filter(numbered, lambda x: x["text"].rlike(pattern))
        shown = {"python": lambda t, n: ~n.startswith("_"), "java": lambda t, n: t.contains("public"), "kotlin": lambda t, n: ~t.contains("private")}.get(name, lambda t, n: t.rlike(r"^\s*export\b"))
        return F.transform(hits, lambda x: F.struct(F.regexp_extract(x["text"], pattern, 1).alias("name"), lookup(KINDS, F.regexp_extract(x["text"], KEYWORD, 1), "unknown").alias("kind"), shown(x["text"], F.regexp_extract(x["text"], pattern, 1)).alias("exported"), x["line"].alias("line")))

    return kept.select("path", lookup(ANALYZERS, F.col("language"), "file-level").alias("analyzer_id"), "language", "role", status.alias("parse_status"), once(per_language(IMPORTS, imports)).alias("imports"), once(per_language(DECLARES, declarations)).alias("declarations"))
