"""Correctness of answers against weighted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.semantics import norm_text, round_half_up

PASS_SCORE = 0.7
FILE_WEIGHT, SYMBOL_WEIGHT, FACT_WEIGHT = 0.25, 0.25, 0.5

# Why a run that did not complete fails.
STATUS_REASONS = {"agent-limit-reached": "agent limit reached", "agent-unavailable": "agent unavailable", "timeout": "timeout", "failed": "agent run failed", "skipped": "agent run skipped"}


def _norm(x: Column) -> Column:
    return norm_text(x)


def _path(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\\", "/"), r"^\.?/", ""))


def matched_items(expected: Column, actual: Column) -> Column:
    """How many expected items some actual item equals, contains, lies in, or shares a path tail with.

    An actual item that normalises to nothing lies in every expected one, as an
    empty text does; this is intended and tested.
    """

    def met(item: Column) -> Column:
        want, path = _norm(item), _path(item)
        return F.exists(actual, lambda a: _norm(a).contains(want) | want.contains(_norm(a)) | (_path(a) == path) | _path(a).endswith(F.concat(F.lit("/"), path)) | path.endswith(F.concat(F.lit("/"), _path(a))))

    return F.size(F.filter(expected, met))


def found_facts(facts: Column, named: Column, answer: Column) -> Column:
    """The facts (id, text, weight, required) whose id or text is among ``named`` or in the answer."""
    names, text = F.transform(named, _norm), _norm(answer)
    return F.filter(facts, lambda f: F.array_contains(names, _norm(f["id"])) | F.array_contains(names, _norm(f["text"])) | text.contains(_norm(f["id"])) | text.contains(_norm(f["text"])))


def normalize_facts(facts: Column, raw: Column, answer: Column) -> Column:
    """At parse time: fact ids named in ``raw`` or, for texts of over 20 normalised characters, held by the answer; raw values that name none are kept."""
    names = F.transform(raw, _norm)
    text = _norm(answer)
    ids = F.transform(F.filter(facts, lambda f: F.array_contains(names, _norm(f["id"])) | F.array_contains(names, _norm(f["text"])) | ((F.length(_norm(f["text"])) > 20) & text.contains(_norm(f["text"])))), lambda f: f["id"])
    known = F.concat(F.transform(facts, lambda f: _norm(f["id"])), F.transform(facts, lambda f: _norm(f["text"])))
    return F.array_union(ids, F.filter(raw, lambda r: ~F.array_contains(known, _norm(r))))


def _weight(facts: Column) -> Column:
    return F.aggregate(facts, F.lit(0.0), lambda s, f: s + f["weight"].cast("double"))


def weighted_fact_score(facts: Column, found: Column) -> Column:
    """Weight found over all weight, to four places; 1 without facts or weight."""
    total = _weight(facts)
    return F.when(total == 0, F.lit(1.0)).otherwise(round_half_up(F.try_divide(_weight(found), total), 4))


def _share(found: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(1.0)).otherwise(round_half_up(F.try_divide(found.cast("double"), total), 4))


def score_correctness(answers: DataFrame) -> DataFrame:
    """Scores rows of case_id, status, parse_status, answer_text, relevant_files, relevant_symbols, facts_found, expected_files, expected_symbols, expected_facts, minimum_correct_facts.

    Everything is a column expression over one row: no join and no shuffle.
    """
    step = answers.withColumns(
        {
            "_found": found_facts(F.col("expected_facts"), F.col("facts_found"), F.col("answer_text")),
            "expected_files_found": matched_items(F.col("expected_files"), F.col("relevant_files")),
            "expected_symbols_found": matched_items(F.col("expected_symbols"), F.col("relevant_symbols")),
        }
    )
    files, symbols, facts = F.size("expected_files"), F.size("expected_symbols"), F.col("expected_facts")
    step = step.withColumns(
        {
            "file_match_score": _share(F.col("expected_files_found"), files),
            "symbol_match_score": _share(F.col("expected_symbols_found"), symbols),
            "fact_match_score": weighted_fact_score(facts, F.col("_found")),
        }
    )
    score = round_half_up(FILE_WEIGHT * F.col("file_match_score") + SYMBOL_WEIGHT * F.col("symbol_match_score") + FACT_WEIGHT * F.col("fact_match_score"), 4)
    step = step.withColumn("correctness_score", score)
    ids = F.transform("_found", lambda f: f["id"])
    missing = F.transform(F.filter(facts, lambda f: f["required"] & ~F.array_contains(ids, f["id"])), lambda f: F.concat(F.lit("missing required fact: "), f["id"]))
    n = F.size("_found")
    named = F.lit(None).cast("string")
    for status, reason in STATUS_REASONS.items():
        named = F.when(F.col("status") == status, reason).otherwise(named)
    known = F.col("status").isNull() | F.col("status").isin("completed", "invalid-output", *STATUS_REASONS)
    reasons = F.concat(
        F.array(F.when(known, named).otherwise(F.col("status")), F.when(F.col("parse_status") == "failed", "invalid output")),
        missing,
        F.array(
            F.when(n < F.col("minimum_correct_facts"), F.concat_ws("", F.lit("too few facts found: "), n.cast("string"), F.lit("/"), F.col("minimum_correct_facts").cast("string"))),
            F.when((files > 0) & (F.col("expected_files_found") < files), "missing expected file"),
            F.when((symbols > 0) & (F.col("expected_symbols_found") < symbols), "missing expected symbol"),
            F.when(F.col("correctness_score") < PASS_SCORE, "score below threshold"),
        ),
    )
    step = step.withColumn("failure_reasons", F.array_distinct(F.filter(reasons, lambda r: r.isNotNull())))
    return step.withColumn("passed", F.size("failure_reasons") == 0).drop("_found")
