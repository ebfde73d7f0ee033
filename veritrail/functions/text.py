"""Text functions: identifiers, paths, excerpts, redaction, digests, versions, prompt and code counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a prompt mentions, by metric.
PROMPT_COUNTS = {
    "questions": r"\?",
    "numbered_steps": r"(?m)^\s*\d+\.",
    "bullets": r"(?m)^\s*[-*]\s",
    "constraints": r"(?i)\b(must|should|never|always|do not|don't|only)\b",
    "file_mentions": r"\b[\w/.-]+\.(ts|js|py|json|md|java|kt)\b",
    "code_blocks": "```",
}

# Texts that look like secrets.
SECRET_PATTERNS = [r"sk-[A-Za-z0-9]{16,}", r"gh[pousr]_[A-Za-z0-9]{16,}", r"AKIA[A-Z0-9]{12,}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"\b[A-Fa-f0-9]{32,}\b"]

MASK = "***"


def identifier_words(x: Column) -> Column:
    """Lower-case words of a camelCase, PascalCase, snake_case or kebab-case identifier."""
    spaced = F.regexp_replace(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.split(F.trim(F.regexp_replace(spaced, "[-_.]+", " ")), r"\s+")
    return F.filter(F.transform(words, F.lower), lambda w: w != "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With its dot, in lower case; empty for a name without one or a leading dot alone."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1))


def basename_no_ext(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def first_segments(path: Column, n: int = 1) -> Column:
    return F.substring_index(path, "/", n)


def normal_path(path: Column) -> Column:
    """Without empty and ``.`` segments, each ``..`` taken back with the segment before it; those that lead above the root stay."""
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))

    def step(done: Column, s: Column) -> Column:
        back = (s == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))

    return F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")


def excerpt(x: Column, n: int) -> Column:
    """At most n characters, with three dots where cut."""
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def strip_control(x: Column) -> Column:
    """Without terminal colour codes and control characters; line breaks and tabs stay."""
    return F.regexp_replace(F.regexp_replace(x, "\x1b\\[[0-9;]*[a-zA-Z]", ""), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")


def redact(x: Column, most: int = 200) -> Column:
    """Secrets to ``[REDACTED:n chars]`` with their length, then cut to ``most`` characters with the original length.

    The text is split at secrets and put together again, so each replacement
    can name its own length without leaving SQL.
    """
    text = strip_control(x)
    for pattern in SECRET_PATTERNS:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.split(text, pattern)
        marks = F.transform(found, lambda m: F.concat(F.lit("[REDACTED:"), F.length(m).cast("string"), F.lit("chars]")))
        joined = F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
        text = F.when(F.size(found) > 0, joined).otherwise(text)
    long = F.concat(F.left(text, F.lit(most)), F.lit("... [truncated, "), F.length(x).cast("string"), F.lit(" chars total]"))
    return F.when(F.length(text) > most, long).otherwise(text)


def candidate_preview(x: Column, most: int = 60, edge: int = 3) -> Column:
    """Null, empty and short values are told apart; of longer ones only both ends show."""
    text = F.regexp_replace(strip_control(x), "\r\n|\r|\n", r"\\\\n")
    bounded = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
    shown = F.concat(F.left(bounded, F.lit(edge)), F.lit(MASK), F.right(bounded, F.lit(edge)))
    return F.when(x.isNull(), "[unavailable]").when(F.length(x) == 0, "[empty]").when(F.length(bounded) <= 2 * edge, MASK).otherwise(shown)


def fingerprint(x: Column) -> Column:
    return F.when(x.isNull(), "unavailable").otherwise(F.concat(F.lit("sha256:"), F.sha2(x, 256)))


def canonical_map(m: Column) -> Column:
    """JSON of a map with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def make_id(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def version_parts(x: Column) -> Column:
    """[major, minor, patch] of a strict x.y.z, else null."""
    return F.when(x.rlike(r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)\z"), F.transform(F.split(x, r"\."), lambda p: p.cast("int")))


def supported_major_one(x: Column) -> Column:
    """Any minor and patch of major version 1."""
    return F.coalesce(version_parts(x)[0] == 1, F.lit(False))


def version_at_least(x: Column, least: Column) -> Column:
    return version_parts(x) >= version_parts(least)


def prompt_metrics(x: Column) -> list[Column]:
    counts = [F.regexp_count(x, F.lit(p)).cast("long").alias(n) for n, p in PROMPT_COUNTS.items()]
    words = F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")).cast("long")
    return [F.length(x).cast("long").alias("chars"), words.alias("words"), F.size(F.split(x, r"\r?\n")).cast("long").alias("lines"), *counts]


def code_lines(x: Column) -> Column:
    """Lines that are neither empty nor a comment."""
    return F.size(F.filter(F.split(x, r"\r?\n"), lambda s: ~s.rlike(r"^\s*($|//|#|\*|/\*)")))


def internal_imports(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"""(?m)(?:from|import|require\()\s*['"]\.{1,2}/|^\s*from\s+\.+\w*\s+import"""))


def exported_symbols(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"(?m)^\s*export\s+|^(?:def|class)\s+[A-Za-z]"))


def functions_or_classes(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"\b(?:function|class|def)\s+\w+|=>\s*\{"))


def escape_html(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def escape_dot_label(x: Column) -> Column:
    """A text for a quoted label of a graph: backslashes, quotes, line ends and the signs of records escaped."""
    for character, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        x = F.replace(x, F.lit(character), F.lit(escaped))
    return F.regexp_replace(x, r"([<>{}|])", r"\\$1")


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds from one timestamp to another, negative if they are the other way round."""
    return F.unix_millis(end) - F.unix_millis(start)


def merge_config(left: Column, right: Column) -> Column:
    """Shallow merge of two maps; the right side wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def clean_list(x: Column) -> Column:
    """Items of a list given in lines or with commas: bullets, numbers, quotes and empty ones off, first-seen order."""
    items = F.flatten(F.transform(F.split(x, r"\r?\n"), lambda s: F.split(s, ",")))
    cleaned = F.transform(items, lambda s: F.regexp_replace(s, r"""^\s*(?:[-*]|\d+\.)?\s*[`"']*|[`"']*\s*$""", ""))
    return F.array_distinct(F.filter(cleaned, lambda s: s != ""))


def context_window(text: Column, needle: Column, reach: int) -> Column:
    """``reach`` characters to each side of the first occurrence; null without one."""
    at = F.instr(text, needle)
    start = F.greatest(at - reach, F.lit(1))
    return F.when(at > 0, F.substr(text, start, at - start + F.length(needle) + reach))


def matches(x: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<at, match>> of every match of a pattern that matches no empty text, in order; ``at`` counts characters from 0.

    A match begins after the pieces and matches before it, which together are the text.
    """
    found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(F.split(x, pattern, -1), found, lambda piece, match: F.struct(F.length(piece).alias("skip"), F.length(match).alias("size"), match.alias("match")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,match:string>>").alias("found"))

    def add(held: Column, m: Column) -> Column:
        at = held["at"] + m["skip"]
        return F.struct((at + m["size"]).alias("at"), F.concat(held["found"], F.array(F.struct(at.alias("at"), m["match"].alias("match")))).alias("found"))

    return F.aggregate(F.filter(lengths, lambda m: m["match"].isNotNull()), begin, add)["found"]


def around(x: Column, match: Column, before: int, after: int) -> Column:
    """The text from ``before`` characters before a match to ``after`` behind it."""
    start = F.greatest(match["at"] - before, F.lit(0))
    return F.substr(x, start + 1, match["at"] + F.length(match["match"]) + after - start)


def line_of(x: Column, match: Column) -> Column:
    """Line of a match, from 1."""
    head = F.substr(x, F.lit(1), match["at"])
    return F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1


def locale_order(x: Column) -> Column:
    """A sort key in the order of dictionaries: case and accents decide only between texts that are alike without them."""
    return F.collate(x, "UNICODE")


def locale_sorted(items: Column) -> Column:
    """The distinct items of a list in the order of dictionaries; texts that differ stay apart."""
    return F.array_sort(F.transform(F.array_distinct(items), lambda x: F.collate(x, "UNICODE")))


def utf16_order(x: Column) -> Column:
    """A binary sort key; ``COLLATE UNICODE`` instead gives a dictionary's order."""
    return F.encode(x, "UTF-16BE")
