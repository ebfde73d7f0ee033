"""Walked JSON documents: rules, fields, differences and canonical text."""

import json
import random

from veritrail.operators import walk as W


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "source long, raw string")


def plain(value, path="", depth=0):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    yield path, depth, kind
    for key, inner in sorted(value.items()) if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from plain(inner, f"{path}[{key}]" if isinstance(value, list) else f"{path}.{key}" if path else key, depth + 1)


def made(rnd, depth=0):
    kind = rnd.randint(0, 7 if depth < 5 else 4)
    if kind < 5:
        return [rnd.randint(-5, 10**6), rnd.choice(["", "a\"b\\\n", "é\U0001f600", "\x01\x7f"]), True, None, rnd.choice([0.5, 1e-7, 1.5e22, 123456.789, -0.001, 3.0])][kind]
    if kind < 6:
        return [made(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return {k: made(rnd, depth + 1) for k in rnd.sample(["b", "a", "Z", "é", "k.x", ""], rnd.randint(0, 5))}


def test_walk_against_plain(spark):
    rnd = random.Random(3)
    values = [made(rnd) for _ in range(120)]
    rows = {}
    for r in W.walk(table(spark, [json.dumps(v) for v in values] + [None, "", "{", "nope"])).collect():
        rows.setdefault(r.source, []).append((r.path, r.depth, r.type))
    assert set(rows) == set(range(120))
    for i, v in enumerate(values):
        assert sorted(rows[i]) == sorted(plain(v))


def test_deep_documents_are_marked(spark):
    deep = "[" * 40 + "]" * 40
    rows = W.walk(table(spark, [deep]), most_depth=5).collect()
    assert sorted((r.depth, r.deeper) for r in rows) == [(d, d == 5) for d in range(6)]
    assert W.canonical(table(spark, [deep]), most_depth=5).first()[:] == (0, None, "too deep")


def test_canonical_against_plain(spark):
    def text(v):
        if isinstance(v, dict):
            return "{" + ",".join(f"{text(k)}:{text(v[k])}" for k in sorted(v)) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(text, v)) + "]"
        return {1e-7: "1e-7", 1.5e22: "1.5e+22", 3.0: "3", 0.5: "0.5", 123456.789: "123456.789", -0.001: "-0.001"}.get(v) if isinstance(v, float) else json.dumps(v, ensure_ascii=False)

    rnd = random.Random(7)
    values = [made(rnd) for _ in range(100)]
    got = {r.source: (r.canonical, r.error) for r in W.canonical(table(spark, [json.dumps(v, indent=1) for v in values] + ["[1e999]", "{", "[1.50, 1E2, -0, 12000000000000000000000]"])).collect()}
    for i, v in enumerate(values):
        assert got[i] == (text(v), None), v
    assert got[100] == (None, "non-finite number") and got[101] == (None, "malformed") and got[102] == ("[1.5,100,0,1.2e+22]", None)


def packet():
    entry = {"id": "c", "kind": "command", "title": "t", "description": "d", "owner": "o", "command": "x", "purpose": "p", "sideEffect": "read-only", "included": "required"}
    rule = {"id": "r", "kind": "rule", "title": "t", "description": "d", "category": "c", "instruction": "i", "ruleRefs": ["a"], "included": "optional", "depth": 1}
    primary = {k: "x" for k in ("id", "title", "description", "workflowRef", "stageName", "reportContractRef", "taskInstructions")} | {"kind": "stage"} | {k: ["y"] for k in ("commandRefs", "ruleRefs", "optionalCommandRefs", "optionalRuleRefs", "validationRequirements", "stopConditions")}
    contract = {k: "x" for k in ("id", "title", "description", "artifactKind", "purpose", "requiredOutputCategory")} | {"kind": "report-contract"}
    provenance = {k: "x" for k in ("rootWorkflowId", "rootStageId", "sourceEntryId", "referenceField", "referencedEntryId", "inclusionReason")} | {"depth": 0}
    finding = {"limitName": "maxRules", "declaredLimit": None, "used": 1, "available": 2.5, "overLimit": False, "amountExceeded": 0, "affectedEntryIds": []}
    record = {"rootOptionalEntryId": "x", "affectedEntryIds": ["y"], "limitingField": "maxRules", "declaredLimit": 3, "usedBefore": 1, "attemptedAfter": 2, "reason": "r"}
    return {
        "schemaVersion": "1.2.3", "catalogSchemaVersion": "1", "catalogVersion": "1", "workflowId": "w", "stageId": "s", "primaryEntry": primary,
        "resolvedCommands": [entry, entry | {"id": "c2"}], "resolvedRules": [rule, rule | {"id": "r2"}], "reportContract": contract,
        "validationRequirements": [], "stopConditions": [], "resolutionProvenance": [provenance], "unresolvedReferences": [], "warnings": ["w"], "extra": 1,
        "budget": {"findings": [finding], "overLimit": False, "adequate": True, "totalCharacters": 9, "perEntryCharacters": {"c": 4}},
        "truncation": {"truncated": False, "records": [record], "droppedOptionalCommandIds": [], "droppedOptionalRuleIds": [], "droppedOptionalDependencyIds": [], "warnings": []},
        "adequacy": {"status": "adequate", "reasons": [], "requiredContentComplete": True, "requiredBudgetSatisfied": True, "optionalContentDropped": False, "affectedEntryIds": []},
    }


def test_first_failures_of_packets(spark):
    gone = object()
    cases = [
        ({}, None),
        ({("schemaVersion",): gone}, ("MISSING_REQUIRED_FIELD", "schemaVersion")),
        ({("schemaVersion",): 1}, ("INVALID_SCHEMA_VERSION", "schemaVersion")),
        ({("schemaVersion",): "1.2"}, ("INVALID_SCHEMA_VERSION", "schemaVersion")),
        ({("schemaVersion",): "2.0.0", ("warnings",): 1}, ("UNSUPPORTED_SCHEMA_MAJOR", "schemaVersion")),
        ({("resolvedCommands", 1, "sideEffect"): "none", ("resolvedCommands", 1, "owner"): 3, ("resolvedRules",): {}}, ("INVALID_FIELD_TYPE", "resolvedCommands[1].owner")),
        ({("resolvedCommands", 1, "id"): 7, ("resolvedCommands", 0, "included"): "x"}, ("INVALID_LITERAL_VALUE", "resolvedCommands[0].included")),
        ({("resolvedCommands", 1, "id"): "c", ("resolvedRules", 0): 5}, ("DUPLICATE_RESOLVED_COMMAND_ID", "resolvedCommands")),
        ({("resolvedCommands", 1, "id"): "c", ("resolvedCommands", 1, "purpose"): gone}, ("MISSING_REQUIRED_FIELD", "resolvedCommands[1].purpose")),
        ({("resolvedRules", 1, "id"): "r", ("workflowId",): None}, ("DUPLICATE_RESOLVED_RULE_ID", "resolvedRules")),
        ({("resolvedRules", 1, "ruleRefs"): ["a", 1]}, ("INVALID_FIELD_TYPE", "resolvedRules[1].ruleRefs[1]")),
        ({("primaryEntry", "stopConditions"): None, ("stageId",): []}, ("INVALID_FIELD_TYPE", "stageId")),
        ({("budget", "perEntryCharacters", "c"): "4", ("budget", "findings", 0, "used"): None}, ("INVALID_FIELD_TYPE", "budget.perEntryCharacters.c")),
        ({("budget", "findings", 0, "declaredLimit"): "x"}, ("INVALID_FIELD_TYPE", "budget.findings[0].declaredLimit")),
        ({("truncation", "records", 0, "limitingField"): "maxFoo"}, ("INVALID_LITERAL_VALUE", "truncation.records[0].limitingField")),
        ({("adequacy",): []}, ("INVALID_FIELD_TYPE", "adequacy")),
        ({("warnings",): gone}, ("MISSING_REQUIRED_FIELD", "warnings")),
    ]
    texts = []
    for changes, _ in cases:
        value = json.loads(json.dumps(packet()))
        for path, new in changes.items():
            at = value
            for step in path[:-1]:
                at = at[step]
            if new is gone:
                del at[path[-1]]
            else:
                at[path[-1]] = new
        texts.append(json.dumps(value))
    got = {r.source: (r.code, r.field_path) for r in W.first_failures(table(spark, texts + ["[]", "{", None]), W.INSTRUCTION_PACKET).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases) if want} | {len(cases): ("NON_OBJECT_ROOT", None), len(cases) + 1: ("MALFORMED_JSON", None), len(cases) + 2: ("MALFORMED_JSON", None)}
    assert W.first_failures(table(spark, []), W.INSTRUCTION_PACKET).count() == 0


def sound(blocks, rules):
    """A document that keeps all rules, lists with one item each."""
    value, left = {}, []
    for pattern, kind in W.expanded(rules, blocks):
        left += [pattern[1:] + "."] * pattern.startswith("?")
        if pattern.startswith(("?", *left)) or kind == "present":
            continue
        one = {"object": {}, "array": [], "version": "1.0.0", "number": 1.5, "count": 2, "boolean": True, "scalar": "s"}.get(kind.removesuffix("?"), kind[1:].split("|")[0].split("?")[0].split("+")[0] if kind.startswith("=") else "x")
        at, steps = value, pattern.replace("[]", ".[]").split(".")
        for step in steps[:-1]:
            at = at[-1] if step == "[]" else at[step]
        if steps[-1] == "[]":
            at.append(one)
        else:
            at["any" if steps[-1] == "*" else steps[-1]] = one
    return value


def test_first_failures_of_retrieval_records(spark):
    gone = object()
    provenance = ("responsibilityMappings", "mappings", 0, "provenance", 0, "category")
    cases = [
        ({}, None),
        ({("budget", "characters"): None, ("freshness", "role"): None, ("fullFileReadRecommendations", 0, "continuationOrExpansionAttempted"): False}, None),
        ({("roleContext", "changedSurface", "symbols", 0, "name"): 3}, ("INVALID_FIELD_TYPE", "roleContext.changedSurface.symbols[0].name")),
        ({("steps", 0, "inputs"): {"a": 1, "b": [1]}, ("warnings",): gone}, ("INVALID_FIELD_TYPE", "steps[0].inputs.b")),
        ({("fullFileReadRecommendations", 0, "continuationOrExpansionAttempted"): "maybe", ("fullFileReadRecommendations", 0, "filePath"): gone}, ("INVALID_LITERAL_VALUE", "fullFileReadRecommendations[0].continuationOrExpansionAttempted")),
        ({("fullFileReadRecommendations", 0, "continuationOrExpansionAttempted"): 1}, ("INVALID_FIELD_TYPE", "fullFileReadRecommendations[0].continuationOrExpansionAttempted")),
        ({("request", "role"): "cook", ("contextAdequacy", "status"): "fine"}, ("INVALID_LITERAL_VALUE", "request.role")),
        ({("contextAdequacy", "status"): "context sufficient"}, ("INVALID_LITERAL_VALUE", "contextAdequacy.status")),
        ({provenance: "none", ("responsibilityMappings", "usedCount"): -1}, ("INVALID_LITERAL_VALUE", "responsibilityMappings.mappings[0].provenance[0].category")),
        ({("responsibilityMappings", "usedCount"): 1.5}, ("INVALID_FIELD_TYPE", "responsibilityMappings.usedCount")),
        ({("responsibilityMappings", "droppedCount"): -1}, ("INVALID_FIELD_TYPE", "responsibilityMappings.droppedCount")),
        ({("responsibilityMappings", "mappings", 0, "errors", 0, "metadata"): {"k": {}}}, ("INVALID_FIELD_TYPE", "responsibilityMappings.mappings[0].errors[0].metadata.k")),
        ({("responsibilityMappings", "mappings", 0, "errors", 0, "sourceLocation"): {"line": 1}}, ("MISSING_REQUIRED_FIELD", "responsibilityMappings.mappings[0].errors[0].sourceLocation.filePath")),
        ({("budget", "characters"): gone, ("budget", "limits"): 1}, ("MISSING_REQUIRED_FIELD", "budget.characters")),
        ({("budget", "characters"): 5, ("budget", "limits", 0, "name"): 1}, ("INVALID_FIELD_TYPE", "budget.limits[0].name")),
        ({("budget", "characters"): {"measured": "1", "limit": None, "truncated": True}}, ("INVALID_FIELD_TYPE", "budget.characters.measured")),
        ({("tool",): [], ("generatedAt",): None}, ("INVALID_FIELD_TYPE", "generatedAt")),
        ({("provenance", 0): "x"}, ("INVALID_FIELD_TYPE", "provenance[0]")),
    ]
    texts = []
    for changes, _ in cases:
        value = sound(W.RECORD_BLOCKS, W.RETRIEVAL_RECORD)
        value["budget"]["characters"] = {"measured": 1, "limit": None, "truncated": False}
        for path, new in changes.items():
            at = value
            for step in path[:-1]:
                at = at[step]
            if new is gone:
                del at[path[-1]]
            else:
                at[path[-1]] = new
        texts.append(json.dumps(value))
    got = {r.source: (r.code, r.field_path) for r in W.first_failures(table(spark, texts), W.RETRIEVAL_RECORD, W.RECORD_BLOCKS).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases) if want}


def test_selected_fields_and_evidence(spark):
    walked = W.walk(table(spark, ['{"a": {"b": [{"c": "x"}, {"c": null}, {"c": 2}]}, "e": [], "d": null}', "{}"]))
    fields = [("cs", "a.b[].c"), ("es", "e[]"), ("d", "d"), ("no", "n.o")]
    assert sorted((r.field, r.path, r.type, r.text) for r in W.selected(walked, fields).collect()) == [("cs", "a.b[0].c", "string", "x"), ("cs", "a.b[1].c", "null", None), ("cs", "a.b[2].c", "number", "2"), ("d", "d", "null", None)]
    got = {(r.source, r.field): (r.availability, r.n, r.texts) for r in W.evidence(walked, fields).collect()}
    assert got == {(0, "cs"): ("available", 2, ["x", "2"]), (0, "es"): ("not-applicable", 0, []), (0, "d"): ("not-applicable", 0, []), (0, "no"): ("unavailable", 0, [])} | {(1, f): ("unavailable", 0, []) for f, _ in fields}


def test_structural_injection(spark):
    base = '{"title": "SAFE", "list": [{"k": "SAFE"}]}'
    pairs = spark.createDataFrame([(1, base, base.replace("SAFE", "x\\\", \\\"evil\\\": 1")), (2, base, base.replace("SAFE", 'x", "evil": "1', 1)), (3, base, base.replace('"SAFE"}', '"x", "own": {"er": 1}}')), (4, base, "{"), (5, None, base)], "source int, baseline string, candidate string")
    got = {r.source: (r.parseable, r.injected_keys, r.injected_patterns) for r in W.structural_injection(pairs).collect()}
    assert got == {1: (True, [], []), 2: (True, ["evil"], ["evil"]), 3: (True, [], ["list[].own", "list[].own.er"]), 4: (False, [], []), 5: (False, [], [])}


def test_levels_are_not_shuffled(spark):
    """Documents are dealt out once, whole; no recursive query sends their levels about."""
    from veritrail.sources import scanners

    docs = table(spark, ['{"a": [1, {"b": null}]}'])
    for frame in (W.walk(docs), W.canonical(docs), W.structural_injection(docs.selectExpr("source", "raw AS baseline", "raw AS candidate")), scanners.npm_tree(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "UnionLoop" not in plan and plan.count("Exchange") == 1
