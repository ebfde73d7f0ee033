"""JSON artifacts and cases: reading with coded failures, validation rows, typed projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.text import supported_major_one, version_parts

CASES = "ARRAY<STRUCT<id: STRING, benchmarkProject: STRING, query: STRING, expectedFiles: ARRAY<STRING>, expectedSymbols: ARRAY<STRING>, rawIncludeGlobs: ARRAY<STRING>, answerKey: STRUCT<minimumCorrectFacts: INT, expectedFacts: ARRAY<STRUCT<id: STRING, text: STRING, weight: DOUBLE, required: BOOLEAN>>>>>"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """source, raw: one row per file, whatever it holds."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("raw"))


def failures(raw: DataFrame, kind: str) -> DataFrame:
    """The first failure of each artifact: source, code, field_path. Versions x.y.z of major 1 are accepted, unknown fields tolerated."""
    v = F.try_parse_json("raw")
    version = F.try_variant_get(v, "$.schemaVersion", "string")
    named = F.try_variant_get(v, "$.artifactKind", "string")
    failure = lambda code, path="$": F.struct(F.lit(code).alias("code"), F.lit(path).alias("field_path"))
    code = (
        F.when(F.coalesce("raw", F.lit("")) == "", failure("empty"))
        .when(v.isNull(), failure("invalid-json"))
        .when(~F.schema_of_variant(v).startswith("OBJECT"), failure("not-an-object"))
        .when(named.isNotNull() & (named != kind), failure("wrong-kind", "$.artifactKind"))
        .when(version.isNull(), failure("missing-field", "$.schemaVersion"))
        .when(version_parts(version).isNull(), failure("malformed-version", "$.schemaVersion"))
        .when(~supported_major_one(version), failure("unsupported-version", "$.schemaVersion"))
    )
    return raw.select("source", code.alias("f")).where("f IS NOT NULL").select("source", "f.code", "f.field_path")


def read_artifacts(raw: DataFrame, kind: str, schema: str) -> DataFrame:
    """source, artifact of the valid ones."""
    return raw.join(failures(raw, kind), "source", "left_anti").select("source", F.from_json("raw", schema).alias("artifact"))


def evaluation_cases(raw: DataFrame) -> DataFrame:
    """ord and the fields of each case of a JSON array."""
    rows = raw.select("source", F.posexplode(F.from_json("raw", CASES)).alias("ord", "c"))
    return rows.select("source", "ord", F.col("c.id").alias("case_id"), F.col("c.benchmarkProject").alias("project"), "c.query", F.col("c.expectedFiles").alias("expected_files"), F.col("c.expectedSymbols").alias("expected_symbols"), F.col("c.answerKey.expectedFacts").alias("expected_facts"), F.col("c.answerKey.minimumCorrectFacts").alias("minimum_correct_facts"))


def case_violations(cases: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """case_id, rule of every broken rule: unique ids, required fields, unique facts with positive weight, a minimum that can be met, a known project."""
    facts = F.col("expected_facts")
    ids = F.transform(facts, lambda f: f["id"])
    rules = F.filter(
        F.array(
            F.when(F.coalesce(F.trim("case_id"), F.lit("")) == "", "missing id"),
            F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "missing query"),
            F.when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated fact id"),
            F.when(F.exists(facts, lambda f: ~F.coalesce(f["weight"] > 0, F.lit(False))), "weight is not positive"),
            F.when((F.col("minimum_correct_facts") > F.size(facts)) | (F.col("minimum_correct_facts") < 0), "minimum cannot be met"),
        ),
        lambda r: r.isNotNull(),
    )
    found = cases.select("case_id", F.explode(rules).alias("rule"))
    repeated = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("case_id", F.lit("repeated case id").alias("rule"))
    found = found.unionByName(repeated)
    if profiles is not None:
        unknown = cases.join(profiles.select("project"), "project", "left_anti").select("case_id", F.lit("unknown project").alias("rule"))
        found = found.unionByName(unknown)
    return found


def expectation_violations(items: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """expectation_id, rule: repeated ids, repeated target keys, categories that an artifact cannot hold. items: expectation_id, source_artifact, category, target_key."""
    ids = items.groupBy("expectation_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("expectation_id", F.lit("repeated id").alias("rule"))
    keys = items.groupBy("target_key").agg(F.count(F.lit(1)).alias("n"), F.min("expectation_id").alias("expectation_id")).where("n > 1").select("expectation_id", F.lit("repeated target").alias("rule"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(c).alias("c")) for a, c in allowed])
    wrong = items.where(~F.exists(pairs, lambda p: (p["a"] == F.col("source_artifact")) & (p["c"] == F.col("category")))).select("expectation_id", F.lit("category does not fit the artifact").alias("rule"))
    return ids.unionByName(keys).unionByName(wrong)
