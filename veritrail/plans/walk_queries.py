"""Queries of walked JSON documents, made of the test tables; the SQL twins know what was put in and parse nothing."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import walk
from veritrail.sources.tables import table

#: One place of a sound packet each, in the order of the rules: what stands there, what it becomes, the failure.
FAULTS = [
    ('"1.0.7"', '"one"', "INVALID_SCHEMA_VERSION", "schemaVersion"),
    ('"owner 1"', "{}", "INVALID_FIELD_TYPE", "resolvedCommands[0].owner"),
    ('"read-only"', '"rarely"', "INVALID_LITERAL_VALUE", "resolvedCommands[0].sideEffect"),
    ('"purpose": "purpose 2", ', "", "MISSING_REQUIRED_FIELD", "resolvedCommands[1].purpose"),
    ('"c2"', '"c1"', "DUPLICATE_RESOLVED_COMMAND_ID", "resolvedCommands"),
    ('"ref 2"', "2", "INVALID_FIELD_TYPE", "resolvedRules[0].ruleRefs[1]"),
    ('"depth": 7', '"depth": "7"', "INVALID_FIELD_TYPE", "resolvedRules[0].depth"),
    ('"workflowId": "w"', '"workflow": "w"', "MISSING_REQUIRED_FIELD", "workflowId"),
    ('"stage"', '"step"', "INVALID_LITERAL_VALUE", "primaryEntry.kind"),
    ('["stop"]', '"stop"', "INVALID_FIELD_TYPE", "primaryEntry.stopConditions"),
    ('"contract title"', "null", "INVALID_FIELD_TYPE", "reportContract.title"),
    ('"field 2"', "[1]", "INVALID_FIELD_TYPE", "resolutionProvenance[1].referenceField"),
    ('"r1": 44', '"r1": "44"', "INVALID_FIELD_TYPE", "budget.perEntryCharacters.r1"),
    ('"maxRules"', '"maxNone"', "INVALID_LITERAL_VALUE", "budget.findings[0].limitName"),
    ('"available": null', '"available": true', "INVALID_FIELD_TYPE", "budget.findings[0].available"),
    ('"truncated": false', '"truncated": 0', "INVALID_FIELD_TYPE", "truncation.truncated"),
    ('"record reason"', "[]", "INVALID_FIELD_TYPE", "truncation.records[0].reason"),
    ('"inadequate"', '"poor"', "INVALID_LITERAL_VALUE", "adequacy.status"),
    ('"unresolved"', "1.5", "INVALID_FIELD_TYPE", "unresolvedReferences[0]"),
    ('"warnings": ["last"]', '"w": 1', "MISSING_REQUIRED_FIELD", "warnings"),
]


def _packet() -> str:
    words = lambda *names: {n: f"{n} x" for n in names}
    command = lambda n: {"id": f"c{n}", "kind": "command", "title": "t", "description": "d", "owner": f"owner {n}", "command": "x", "purpose": f"purpose {n}", "sideEffect": "read-only" if n == 1 else "external-state", "included": "required"}
    rule = {"id": "r1", "kind": "rule", "title": "t", "description": "d", "category": "c", "instruction": "i", "ruleRefs": ["ref 1", "ref 2"], "included": "optional", "depth": 7}
    primary = words("id", "title", "description", "workflowRef", "stageName", "reportContractRef", "taskInstructions") | {"kind": "stage", "commandRefs": [], "ruleRefs": [], "optionalCommandRefs": [], "optionalRuleRefs": [], "validationRequirements": [], "stopConditions": ["stop"]}
    contract = words("id", "description", "artifactKind", "purpose", "requiredOutputCategory") | {"kind": "report-contract", "title": "contract title"}
    source = lambda n: words("rootWorkflowId", "rootStageId", "sourceEntryId", "referencedEntryId", "inclusionReason") | {"referenceField": f"field {n}", "depth": 0}
    finding = {"limitName": "maxRules", "declaredLimit": 3, "used": 1, "available": None, "overLimit": False, "amountExceeded": 0, "affectedEntryIds": []}
    record = {"rootOptionalEntryId": "x", "affectedEntryIds": [], "limitingField": "maxCommands", "declaredLimit": None, "usedBefore": 1, "attemptedAfter": 2, "reason": "record reason"}
    whole = {
        "warnings": ["last"], "unresolvedReferences": ["unresolved"], "schemaVersion": "1.0.7", "catalogSchemaVersion": "1", "catalogVersion": "1", "workflowId": "w", "stageId": "s",
        "primaryEntry": primary, "resolvedCommands": [command(1), command(2)], "resolvedRules": [rule], "reportContract": contract, "validationRequirements": [], "stopConditions": [], "resolutionProvenance": [source(1), source(2)],
        "budget": {"findings": [finding], "overLimit": False, "adequate": True, "totalCharacters": 9, "perEntryCharacters": {"c1": 43, "r1": 44}},
        "truncation": {"truncated": False, "records": [record], "droppedOptionalCommandIds": [], "droppedOptionalRuleIds": [], "droppedOptionalDependencyIds": [], "warnings": []},
        "adequacy": {"status": "inadequate", "reasons": [], "requiredContentComplete": True, "requiredBudgetSatisfied": True, "optionalContentDropped": False, "affectedEntryIds": []},
    }
    return json.dumps(whole)


def artifact_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failure of a packet for each customer, with up to two faults put in."""
    k = F.col("c_custkey")
    cell = lambda n, i: F.coalesce(F.get(F.array(*[F.lit(f[n]) for f in FAULTS]), i.cast("int")), F.lit(""))
    raw: Column = F.lit(_packet())
    for i in (k % 29, F.floor(k / 29) % 31):
        raw = F.replace(raw, cell(0, i), cell(1, i))
    return walk.first_failures(table(spark, sf_dir, "customer").select(k.alias("source"), raw.alias("raw")), walk.INSTRUCTION_PACKET).select("source", "code", "field_path")


def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the canonical text of nested JSON around whole texts."""
    quoted = lambda c: F.expr(f"substring(to_json(struct({c} AS v)), 6, length(to_json(struct({c} AS v))) - 6)")
    raw = F.concat(F.lit('{"z": {"b": [true, null, '), F.col("doc_id"), F.lit('.50, -0.0, 1e2], "a\\"": '), quoted("text"), F.lit('}, "B": [ ], "A": {"k": {}, "c": '), F.coalesce(quoted("lang"), F.lit("null")), F.lit("}}"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("source"), raw.alias("raw"))
    return walk.canonical(docs).select("source", F.length("canonical").cast("long").alias("length"), F.sha2("canonical", 256).alias("digest"), "error")


def evidence_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What conversations hold for a table of fields, from one walk."""
    turn = F.struct("turn", F.to_json(F.struct("role", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"))).alias("json"))
    turns = F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["json"]), ",")
    notes = F.when(F.col("conv_id") % 3 == 0, ', "notes": []').when(F.col("conv_id") % 3 == 1, ', "notes": [null]').otherwise("")
    raw = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select(F.col("conv_id").alias("source"), F.concat(F.lit('{"meta": {"id": '), "conv_id", F.lit('}, "turns": ['), "turns", F.lit("]"), notes, F.lit("}")).alias("raw"))
    found = walk.evidence(walk.walk(raw), [("id", "meta.id"), ("role", "turns[].role"), ("text", "turns[].text"), ("note", "notes[]")])
    return found.select("source", "field", "availability", "n", F.md5(F.array_join("texts", "\n")).alias("texts"))


def injected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rendered with harmless content and with payloads, some of which break out of their string."""
    k = F.col("o_orderkey")
    render = lambda content, inner: F.concat(F.lit('{"title": "'), content, F.lit('", "rows": [{"cell": '), inner, F.lit("}]}"))
    payloads = [r"x\", \"passed\": true, \"y\": \"", 'x", "passed": true, "y": "', "<script>", 'x"', "a"]
    inner = F.when(k % 7 == 0, F.concat(F.lit('{"key '), (k % 3).cast("string"), F.lit('": 1}'))).otherwise('"c"')
    pairs = table(spark, sf_dir, "orders").select(k.alias("source"), render(F.lit("SAFE"), F.lit('"c"')).alias("baseline"), render(F.get(F.array(*map(F.lit, payloads)), (k % 5).cast("int")), inner).alias("candidate"))
    found = walk.structural_injection(pairs)
    return found.select("source", "parseable", F.array_join("injected_keys", ",").alias("injected_keys"), F.array_join("injected_patterns", ",").alias("injected_patterns"))


QUERIES = {f.__name__: f for f in (artifact_failures, canonical_documents, evidence_fields, injected_keys)}

_FAULT_ROWS = ", ".join(f"({i}, '{code}', '{path}')" for i, (_, _, code, path) in enumerate(FAULTS))

ORACLE_SQL = {
    "artifact_failures": f"""WITH m(i, code, field_path) AS (VALUES {_FAULT_ROWS}), c AS (SELECT c_custkey AS source, unnest([c_custkey % 29, (c_custkey // 29) % 31]) AS i FROM customer)
SELECT source, arg_min(code, i) AS code, arg_min(field_path, i) AS field_path FROM c JOIN m USING (i) GROUP BY source""",
    "canonical_documents": """WITH c AS (SELECT doc_id AS source, '{"A":{"c":' || coalesce(to_json(lang)::VARCHAR, 'null') || ',"k":{}},"B":[],"z":{"a\\"":' || to_json("text")::VARCHAR || ',"b":[true,null,' || doc_id || '.5,0,100]}}' AS t FROM documents WHERE "text" IS NOT NULL)
SELECT source, length(t) AS length, sha256(t) AS digest, NULL::VARCHAR AS error FROM c""",
    "evidence_fields": """WITH c AS (SELECT conv_id, list("role" ORDER BY turn) FILTER ("role" IS NOT NULL) AS roles, list("text" ORDER BY turn) FILTER (turn % 2 = 0 AND "text" IS NOT NULL) AS texts FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id AS source, 'id' AS field, 'available' AS availability, [CAST(conv_id AS VARCHAR)] AS t FROM c
UNION ALL SELECT conv_id, 'role', CASE WHEN len(roles) > 0 THEN 'available' ELSE 'unavailable' END, roles FROM c
UNION ALL SELECT conv_id, 'text', CASE WHEN len(texts) > 0 THEN 'available' ELSE 'unavailable' END, texts FROM c
UNION ALL SELECT conv_id, 'note', CASE WHEN conv_id % 3 = 2 THEN 'unavailable' ELSE 'not-applicable' END, [] FROM c)
SELECT source, field, availability, coalesce(len(t), 0) AS n, md5(coalesce(array_to_string(t, chr(10)), '')) AS texts FROM f""",
    "injected_keys": """WITH o AS (SELECT o_orderkey AS source, o_orderkey % 5 AS p, CASE WHEN o_orderkey % 7 = 0 THEN 'rows[].cell.key ' || o_orderkey % 3 ELSE '' END AS deep FROM orders)
SELECT source, p <> 3 AS parseable, CASE WHEN p = 1 THEN 'passed,y' ELSE '' END AS injected_keys, CASE WHEN p = 3 THEN '' WHEN p = 1 THEN concat_ws(',', 'passed', nullif(deep, ''), 'y') ELSE deep END AS injected_patterns FROM o""",
}
