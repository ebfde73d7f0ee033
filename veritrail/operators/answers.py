"""Agent answers and token usage from text, by patterns and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.semantics import unicode_trim
from veritrail.functions.text import clean_list

ANSWER = "answer STRING, relevantFiles ARRAY<STRING>, relevantSymbols ARRAY<STRING>, expectedFactsFound ARRAY<STRING>"
# Names under which a usage counter appears.
USAGE_NAMES = {"input_tokens": ["input_tokens", "inputTokens", "prompt_tokens", "promptTokens"], "output_tokens": ["output_tokens", "outputTokens", "completion_tokens", "completionTokens"], "reasoning_tokens": ["reasoning_tokens", "reasoningTokens"], "total_tokens": ["total_tokens", "totalTokens"]}
USAGE_TEXT = {"input_tokens": r"(?i)(?:input|prompt) tokens?\s*[:=]\s*([\d,]+)", "output_tokens": r"(?i)(?:output|completion) tokens?\s*[:=]\s*([\d,]+)", "reasoning_tokens": r"(?i)reasoning tokens?\s*[:=]\s*([\d,]+)", "total_tokens": r"(?i)(?:total tokens?|tokens used)\s*[:=]\s*([\d,]+)"}


def _section(text: Column, name: str) -> Column:
    """What follows ``name:`` in its line or stands in list lines below, or below a heading of that name."""
    field = F.regexp_extract(text, rf"(?im)^\s*{name}\s*:[ \t]*((?:.*)(?:\n\s*[-*] .*)*)", 1)
    heading = F.regexp_extract(text, rf"(?im)^#+\s*{name}\s*\n((?:(?!#).*\n?)*)", 1)
    return F.coalesce(F.nullif(unicode_trim(field), F.lit("")), F.nullif(unicode_trim(heading), F.lit("")))


def parse_answers(runs: DataFrame, column: str = "final_answer") -> DataFrame:
    """Adds answer_text, relevant_files, relevant_symbols, facts_found, parse_status.

    JSON, also in a fence, is parsed; else field lines or headed sections are
    looked for: with files or symbols the answer is partial, without any it failed.
    """
    text = F.col(column)
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    body = F.coalesce(fenced, F.trim(text))
    known = F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))
    j = F.when(known, F.from_json(body, ANSWER))
    lists = {"relevant_files": (j["relevantFiles"], "(?:relevant )?files"), "relevant_symbols": (j["relevantSymbols"], "(?:relevant )?symbols"), "facts_found": (j["expectedFactsFound"], "(?:expected )?facts(?: found)?")}
    none = F.array().cast("array<string>")
    made = runs.withColumns({name: F.coalesce(F.when(known, value), F.when(~known, clean_list(_section(text, title))), none) for name, (value, title) in lists.items()})
    answer = F.coalesce(F.when(known, j["answer"]), _section(text, "answer"), text, F.lit(""))
    some = F.size("relevant_files") + F.size("relevant_symbols") + F.size("facts_found") > 0
    status = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "failed").when(known, "parsed").when(some, "partial").otherwise("failed")
    return made.withColumns({"answer_text": answer, "parse_status": status})


def token_usage(runs: DataFrame, column: str = "output") -> DataFrame:
    """Adds the four counters, total (their sum if it is missing) and reliability.

    Of every mention in JSON the largest counts; without JSON mentions the text
    patterns do. high: input and output from JSON, medium: some from JSON, low:
    from text, null: none.
    """
    text = F.col(column)
    number = lambda s: F.regexp_replace(s, ",", "").try_cast("long")
    in_json = {n: F.array_max(F.transform(F.regexp_extract_all(text, F.lit(rf'"(?:{"|".join(names)})"\s*:\s*(\d+)'), F.lit(1)), number)) for n, names in USAGE_NAMES.items()}
    in_text = {n: F.array_max(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), number)) for n, p in USAGE_TEXT.items()}
    any_json = F.coalesce(*in_json.values()).isNotNull()
    values = {n: F.when(any_json, in_json[n]).otherwise(in_text[n]) for n in USAGE_NAMES}
    parts = [F.coalesce(values[n], F.lit(0)) for n in list(USAGE_NAMES)[:3]]
    some = F.coalesce(*[values[n] for n in list(USAGE_NAMES)[:3]]).isNotNull()
    values["total_tokens"] = F.coalesce(values["total_tokens"], F.when(some, sum(parts[1:], parts[0])))
    both = in_json["input_tokens"].isNotNull() & in_json["output_tokens"].isNotNull()
    reliability = F.when(both, "high").when(any_json, "medium").when(F.coalesce(*in_text.values()).isNotNull(), "low")
    return runs.withColumns(values | {"reliability": reliability})
