"""JSON documents as rows of paths, and what can be asked of such rows: rules, selected fields, differences, canonical text.

A document is walked level by level over VARIANT, within its row, so its parts
meet without a shuffle. Every value gives a row: source, path (``a.b[0].c``; the root is empty), pattern (the
path without the numbers in brackets), name (the last key), indexes (the numbers),
steps (the place among its siblings at each level, keys in order), depth, type
(object, array, string, number, boolean, null), text (of a scalar), deeper,
which is set where there is more below ``most_depth``, and keys (of an object). Keys that JSON repeats make
a document malformed. Null, empty and malformed documents give no row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.stored import spread

MOST_DEPTH = 64
_TYPES = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
_ROW = "array<struct<path:string,pattern:string,name:string,indexes:array<int>,steps:array<int>,depth:int,type:string,text:string,deeper:boolean,keys:array<string>>>"


def _rows(raw: Column, most_depth: int) -> Column:
    """The rows of one document in an array, level by level; null where ``raw`` is no document."""
    # No value lies below more openers than the text has.
    openers = F.length(raw) - F.length(F.translate(raw, "{[", ""))
    levels = F.sequence(F.lit(0), F.least(F.lit(most_depth), openers))
    none = F.array().cast("array<int>")
    root = F.struct(F.lit("").alias("path"), F.lit("").alias("pattern"), F.lit(None).cast("string").alias("name"), none.alias("indexes"), none.alias("steps"), F.lit(0).alias("depth"), F.try_parse_json(raw).alias("node"))
    within = lambda of, part: F.when(of == "", part).otherwise(F.concat(of, F.lit("."), part))

    def opened(v: Column) -> Column:
        return F.struct(v.alias("v"), F.try_variant_get(v["node"], "$", "map<string,variant>").alias("fields"), F.try_variant_get(v["node"], "$", "array<variant>").alias("items"))

    def row(o: Column) -> Column:
        v, schema = o["v"], F.schema_of_variant(o["v"]["node"])
        kind = F.lit("number")
        for prefix in ("STRING", "BOOLEAN", "VOID"):
            kind = F.when(schema.startswith(prefix), _TYPES[prefix]).otherwise(kind)
        kind = F.when(o["fields"].isNotNull(), "object").when(o["items"].isNotNull(), "array").otherwise(kind)
        scalar = o["fields"].isNull() & o["items"].isNull()
        deeper = (v["depth"] == most_depth) & (F.coalesce(F.size(o["fields"]), F.size(o["items"]), F.lit(0)) > 0)
        cells = [v[c].alias(c) for c in ("path", "pattern", "name", "indexes", "steps", "depth")]
        return F.struct(*cells, kind.alias("type"), F.when(scalar, F.try_variant_get(v["node"], "$", "string")).alias("text"), F.coalesce(deeper, F.lit(False)).alias("deeper"), F.map_keys(o["fields"]).alias("keys"))

    def below(o: Column) -> Column:
        v = o["v"]
        step = lambda i: F.concat(v["steps"], F.array(i)).alias("steps")
        deep = (v["depth"] + 1).alias("depth")
        field = lambda e, i: F.struct(within(v["path"], e["key"]).alias("path"), within(v["pattern"], e["key"]).alias("pattern"), e["key"].alias("name"), v["indexes"].alias("indexes"), step(i), deep, e["value"].alias("node"))
        item = lambda x, i: F.struct(F.concat(v["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), F.concat(v["pattern"], F.lit("[]")).alias("pattern"), F.lit(None).cast("string").alias("name"), F.concat(v["indexes"], F.array(i)).alias("indexes"), step(i), deep, x.alias("node"))
        return F.when(o["fields"].isNotNull(), F.transform(F.map_entries(o["fields"]), field)).when(o["items"].isNotNull(), F.transform(o["items"], item)).otherwise(F.slice(F.array(v), 1, 0))

    def follow(held: Column, _: Column) -> Column:
        return F.struct(F.transform(F.flatten(F.transform(held["level"], below)), opened).alias("level"), F.concat(held["found"], F.transform(held["level"], row)).alias("found"))

    begin = F.struct(F.array(opened(root)).alias("level"), F.array().cast(_ROW).alias("found"))
    found = F.aggregate(levels, begin, follow, lambda held: held["found"])
    return F.when(F.try_parse_json(raw).isNotNull(), found)


def walk(raw: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """Rows of the documents (source, raw); each source is one document."""
    return spread(raw.select("source", "raw"), "source").select("source", F.inline(_rows(F.col("raw"), most_depth)))


# Rules ------------------------------------------------------------------------


def expanded(rules: str, blocks: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(pattern, type) in order: ``string[]`` becomes a list and its items, ``@name`` an object and the rules of a block below it."""
    found = []
    for line in filter(str.strip, rules.splitlines()):
        pattern, kind = line.strip().split(maxsplit=1)
        plain = pattern.removeprefix("?")
        if kind.endswith("[]"):
            found += [(pattern, "array")] + expanded(f"{plain}[] {kind[:-2]}", blocks)
        elif kind.startswith("@"):
            found.append((pattern, "object"))
            found += [(f"{'?' * p.startswith('?')}{plain}.{p.removeprefix('?')}", k) for p, k in expanded(blocks[kind[1:]], blocks)]
        else:
            found.append((pattern, kind))
    return found


def rule_table(rules: str, like: DataFrame, blocks: dict[str, str] | None = None) -> DataFrame:
    """Rules as rows, from lines of ``pattern type`` in the order in which they are checked; a line's parts come after it.

    A type is string, number, count (no fraction, none below 0), boolean, object,
    array, scalar, version, present (of any type), words with bars after ``=``
    that a string must be one of (``+boolean``: or true or false), or ``unique
    FIELD CODE`` for arrays whose items must not share a field. ``?`` before a
    pattern marks an optional field, after a type one that may be null. A pattern
    that ends in ``.*`` stands for every key of an object. See ``expanded`` for
    lists and blocks.
    """
    rows, number = [], {"": 0}
    for n, (pattern, kind) in enumerate(expanded(rules, blocks), 1):
        kind, *more = [kind] if kind.startswith("=") else kind.split()
        optional, pattern = pattern.startswith("?"), pattern.removeprefix("?")
        parent = pattern[:-2] if pattern.endswith("[]") else pattern.rpartition(".")[0]
        if kind not in ("unique", "present"):
            number[pattern] = n
        above, prefixes = pattern, []
        while above:
            prefixes.append(above)
            above = above[:-2] if above.endswith("[]") else above.rpartition(".")[0]
        place = []
        for p in reversed(prefixes):
            place.append((n if p == pattern else number.get(p, n), None))
            if p.endswith("[]"):
                place.append((None, sum(q.endswith("[]") for q in prefixes if len(q) < len(p))))
        allowed = kind[1:].removesuffix("?").removesuffix("+boolean").split("|") if kind.startswith("=") else None
        base = "unique" if kind == "unique" else "literal" if allowed else kind.removesuffix("?")
        name = None if pattern.endswith("[]") or pattern.endswith("*") else pattern.rpartition(".")[2]
        rows.append((n, pattern, parent, name, optional, base, kind.endswith("?"), kind.endswith("+boolean"), allowed, more[0] if more else None, more[1] if len(more) > 1 else None, place))
    schema = "n int, pattern string, parent string, field string, optional boolean, kind string, nullable boolean, flag boolean, allowed array<string>, of string, code string, place array<struct<rule:int,slot:int>>"
    return F.broadcast(like.sparkSession.createDataFrame(rows, schema))


def first_failures(raw: DataFrame, rules: str, blocks: dict[str, str] | None = None) -> DataFrame:
    """source, code, field_path, expected of the first rule that each document (source, raw) breaks, in the order of the rules, items one after another."""
    table = rule_table(rules, raw, blocks)
    failure = lambda code, path, expected: F.struct(code.alias("code"), path.alias("field_path"), expected.cast("string").alias("expected"))

    unread = spread(raw.select("source", "raw"), "source").select("source", F.try_parse_json("raw").alias("v"))
    early = unread.select("source", F.when(F.col("v").isNull(), "MALFORMED_JSON").when(F.try_variant_get("v", "$", "map<string,variant>").isNull(), "NON_OBJECT_ROOT").alias("code")).where("code IS NOT NULL").select("source", F.array(F.lit(0)).alias("key"), failure(F.col("code"), F.lit(None).cast("string"), F.lit(None)).alias("f"), F.lit(None).cast("string").alias("item"))

    # A value meets the rules of its own pattern, those of its fields, those of any key and those of lists with distinct items, all in one join.
    under = lambda use, pattern, where: table.where(where).select(F.lit(use).alias("use"), pattern.alias("at"), "field", "kind", "nullable", "flag", "allowed", "code", "place")
    met = under("own", F.col("pattern"), "kind <> 'unique' AND pattern NOT LIKE '%*'").unionByName(under("field", F.col("parent"), "field IS NOT NULL AND NOT optional AND kind <> 'unique'")).unionByName(under("any", F.col("pattern"), "kind <> 'unique' AND pattern LIKE '%*'")).unionByName(under("unique", F.concat("pattern", F.lit("[]."), "of"), "kind = 'unique'"))
    last = F.length(F.substring_index("pattern", ".", -1))
    any_key = F.concat(F.substr("pattern", F.lit(1), F.greatest(F.length("pattern") - last - 1, F.lit(0))), F.lit(".*"))
    look = lambda use, at: F.struct(F.lit(use).alias("use"), at.alias("at"))
    looks = F.array(look("own", F.col("pattern")), look("field", F.when(F.col("type") == "object", F.col("pattern"))), look("any", F.when(F.col("name").isNotNull(), any_key)), look("unique", F.when(F.col("text").isNotNull(), F.col("pattern"))))
    seen = walk(raw).select("source", "path", "indexes", "type", "text", "keys", F.inline(looks)).where("at IS NOT NULL").join(F.broadcast(met.withColumnRenamed("code", "coded")), ["use", "at"])

    use, kind, type_ = F.col("use"), F.col("kind"), F.col("type")
    exempt = (F.col("nullable") & (type_ == "null")) | (F.col("flag") & (type_ == "boolean")) | (kind == "present")
    version = F.coalesce(F.col("text").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), F.lit(False)) & (type_ == "string")
    wanted_type = F.when(kind.isin("literal", "version"), "string").when(kind == "count", "number").otherwise(kind)
    number = F.col("text").try_cast("double")
    off = F.when(kind == "scalar", type_.isin("object", "array")).otherwise(wanted_type != type_)
    code = (
        F.when(use == "field", F.when(~F.array_contains("keys", F.col("field")), "MISSING_REQUIRED_FIELD"))
        .when(use == "unique", F.col("coded"))
        .when(exempt, F.lit(None))
        .when((kind == "version") & ~version, "INVALID_SCHEMA_VERSION")
        .when((kind == "version") & (F.regexp_extract("text", "^0*([0-9]+)", 1) != "1"), "UNSUPPORTED_SCHEMA_MAJOR")
        .when((kind != "version") & off, "INVALID_FIELD_TYPE")
        .when((kind == "count") & ~F.coalesce((number >= 0) & (number == F.floor(number)), F.lit(False)), "INVALID_FIELD_TYPE")
        .when((kind == "literal") & ~F.array_contains("allowed", F.col("text")), "INVALID_LITERAL_VALUE")
    )
    expected = F.when(use == "field", "present").when(use == "unique", F.lit(None)).when(F.col("_code") == "INVALID_LITERAL_VALUE", F.array_join("allowed", " | ")).when(F.col("_code") == "UNSUPPORTED_SCHEMA_MAJOR", "1").when(F.col("_code") == "INVALID_SCHEMA_VERSION", r"^[0-9]+\.[0-9]+\.[0-9]+$").when(kind == "scalar", "string | number | boolean | null").when((kind == "count") & (type_ == "number"), "nonnegative integer").otherwise(wanted_type)
    below = F.when(F.col("path") == "", F.col("field")).otherwise(F.concat("path", F.lit("."), "field"))
    at = F.when(use == "field", below).when(use == "unique", F.regexp_replace("path", r"\[[0-9]+\]\.[^.\]]*$", "")).otherwise(F.col("path"))
    placed = F.transform("place", lambda p: F.coalesce(p["rule"], F.get("indexes", p["slot"])))
    item = F.when(use == "unique", F.col("text"))
    wrong = seen.withColumn("_code", code).where("_code IS NOT NULL").select("source", placed.alias("key"), failure(F.col("_code"), at, expected).alias("f"), item.alias("item"))

    # An item of a list with distinct items is a failure where the next in order is like it; items of one text meet in a sorted list.
    plain = F.col("item").isNull()
    first = F.struct(F.min(F.when(plain, F.col("key"))).alias("key"), F.min_by(F.when(plain, F.col("f")), F.when(plain, F.col("key"))).alias("f"))
    items = F.array_sort(F.collect_list(F.when(~plain, F.struct("key", "item", "f"))))
    met = early.unionByName(wrong).groupBy("source").agg(first.alias("first"), items.alias("items"))
    like = F.zip_with("items", F.slice("items", 2, F.greatest(F.size("items"), F.lit(1))), lambda a, b: F.when(a.eqNullSafe(b), F.struct(a["key"].alias("key"), a["f"].alias("f"))))
    found = F.array_min(F.filter(F.concat(F.array("first"), like), lambda x: x["key"].isNotNull()))
    return met.select("source", found["f"].alias("f")).where("f IS NOT NULL").select("source", "f.*")


# What the published packet of instructions must hold, in the order in which it is checked.
INSTRUCTION_PACKET = """
schemaVersion version
resolvedCommands array
resolvedCommands[] object
resolvedCommands[].id string
resolvedCommands[].kind =command
resolvedCommands[].title string
resolvedCommands[].description string
resolvedCommands[].owner string
resolvedCommands[].command string
resolvedCommands[].purpose string
resolvedCommands[].sideEffect =read-only|writes-workspace|modifies-project|external-state
resolvedCommands[].included =required|optional
resolvedCommands unique id DUPLICATE_RESOLVED_COMMAND_ID
resolvedRules array
resolvedRules[] object
resolvedRules[].id string
resolvedRules[].kind =rule
resolvedRules[].title string
resolvedRules[].description string
resolvedRules[].category string
resolvedRules[].instruction string
resolvedRules[].ruleRefs array
resolvedRules[].ruleRefs[] string
resolvedRules[].included =required|optional
resolvedRules[].depth number
resolvedRules unique id DUPLICATE_RESOLVED_RULE_ID
catalogSchemaVersion string
catalogVersion string
workflowId string
stageId string
primaryEntry object
primaryEntry.id string
primaryEntry.kind =stage
primaryEntry.title string
primaryEntry.description string
primaryEntry.workflowRef string
primaryEntry.stageName string
primaryEntry.commandRefs array
primaryEntry.commandRefs[] string
primaryEntry.ruleRefs array
primaryEntry.ruleRefs[] string
primaryEntry.optionalCommandRefs array
primaryEntry.optionalCommandRefs[] string
primaryEntry.optionalRuleRefs array
primaryEntry.optionalRuleRefs[] string
primaryEntry.reportContractRef string
primaryEntry.taskInstructions string
primaryEntry.validationRequirements array
primaryEntry.validationRequirements[] string
primaryEntry.stopConditions array
primaryEntry.stopConditions[] string
reportContract object
reportContract.id string
reportContract.kind =report-contract
reportContract.title string
reportContract.description string
reportContract.artifactKind string
reportContract.purpose string
reportContract.requiredOutputCategory string
validationRequirements array
validationRequirements[] string
stopConditions array
stopConditions[] string
resolutionProvenance array
resolutionProvenance[] object
resolutionProvenance[].rootWorkflowId string
resolutionProvenance[].rootStageId string
resolutionProvenance[].sourceEntryId string
resolutionProvenance[].referenceField string
resolutionProvenance[].referencedEntryId string
resolutionProvenance[].inclusionReason string
resolutionProvenance[].depth number
budget object
budget.perEntryCharacters object
budget.perEntryCharacters.* number
budget.findings array
budget.findings[] object
budget.findings[].limitName =maxCommands|maxRules|maxRuleDepth|maxEntryCharacters|maxTotalCharacters
budget.findings[].declaredLimit number?
budget.findings[].used number
budget.findings[].available number?
budget.findings[].overLimit boolean
budget.findings[].amountExceeded number
budget.findings[].affectedEntryIds array
budget.findings[].affectedEntryIds[] string
budget.overLimit boolean
budget.adequate boolean
budget.totalCharacters number
truncation object
truncation.truncated boolean
truncation.records array
truncation.records[] object
truncation.records[].rootOptionalEntryId string
truncation.records[].affectedEntryIds array
truncation.records[].affectedEntryIds[] string
truncation.records[].limitingField =maxCommands|maxRules|maxRuleDepth|maxEntryCharacters|maxTotalCharacters
truncation.records[].declaredLimit number?
truncation.records[].usedBefore number
truncation.records[].attemptedAfter number
truncation.records[].reason string
truncation.droppedOptionalCommandIds array
truncation.droppedOptionalCommandIds[] string
truncation.droppedOptionalRuleIds array
truncation.droppedOptionalRuleIds[] string
truncation.droppedOptionalDependencyIds array
truncation.droppedOptionalDependencyIds[] string
truncation.warnings array
truncation.warnings[] string
adequacy object
adequacy.status =adequate|inadequate
adequacy.reasons array
adequacy.reasons[] string
adequacy.requiredContentComplete boolean
adequacy.requiredBudgetSatisfied boolean
adequacy.optionalContentDropped boolean
adequacy.affectedEntryIds array
adequacy.affectedEntryIds[] string
unresolvedReferences array
unresolvedReferences[] string
warnings array
warnings[] string
"""


# What the published record of retrievals must hold, in the order in which it is checked.
_ROLE = "=architecture|implementation|test-implementation?"
_ADEQUACY = "=context sufficient for implementation|context sufficient with listed assumptions|context insufficient and more retrieval required|context conflict found and user or upstream stage decision required"
_KINDS = "=owner|dependencies|contracts|validators|constants|errors|schemas|callers|callees|closest-tests|test-infrastructure|test-commands|changed-surface|responsibility-mappings"
_CHANGE = "status =added|modified|removed|unknown\nprovenance =caller|graph-diff|both"
RECORD_BLOCKS = {
    "step": "id string\nkind string\ndescription string\ninputs object\ninputs.* scalar\noutputs object\noutputs.* scalar\nstatus =ok|skipped|failed\nwarnings string[]",
    "recommendation": "continuationOrExpansionAttempted =unavailable+boolean\nfilePath string\nreason string\nmissingContext string",
    "request": f"originalQuery string\nnormalizedQuery string\nmode =general|feature-add|subsystem\nrequestedOutputPath string\nrole {_ROLE}\nrequestFilePath string?",
    "adequacy": f"status {_ADEQUACY}\nsummary string\nassumptions string[]\ngaps string[]",
    "focusFile": "path string\nresolved boolean\nmatchedFilePaths string[]\ncontainedSymbolIds string[]",
    "focusSymbol": "symbol string\nresolved boolean\nambiguous boolean\nmatchedNodeIds string[]",
    "focus": "focusFiles @focusFile[]\nfocusSymbols @focusSymbol[]\nunresolvedFocusFiles string[]\nunresolvedFocusSymbols string[]\nambiguousFocusSymbols string[]\nwarnings string[]",
    "changedFile": f"path string\n{_CHANGE}",
    "changedSymbol": f"symbolId string\n{_CHANGE}\n?filePath string\n?name string\n?kind string",
    "changedSurface": "available boolean\ndiffRequested boolean\nfiles @changedFile[]\nsymbols @changedSymbol[]\nconflicts string[]\nwarnings string[]",
    "roleContext": f"role {_ROLE}\nfocus @focus\nchangedSurface @changedSurface\nrequestedEvidenceKinds array\nrequestedEvidenceKinds[] {_KINDS}\nunsupportedRequestedEvidenceKinds array\nunsupportedRequestedEvidenceKinds[] {_KINDS}\nwarnings string[]",
    "location": "filePath string\n?line number",
    "evidence": "id string\nitemKind =file|symbol|test-file|fixture|factory|mock|setup-file|config-file|package-script|command\nrelationship string\nbasis string\nprovenance string\n?path string\n?symbolId string\n?nodeId string\n?sourceLocation @location\n?metadata object\n?metadata.* scalar",
    "provenance": f"id string\ncategory =request|cli|request-file|focus-file|focus-symbol|caller-changed-file|caller-changed-symbol|graph-diff|active-index|before-index|after-index|code-graph|symbol-index|source-scan|test-directory-walk|import-scan|package-json|test-configuration|upstream-artifact-ref\nsourcePath string?\nsourceId string?\nevidenceId string\nrelationshipBasis string\nrole {_ROLE}\nrequestField string?\nderivedByModule string",
    "mapping": "responsibilityId string\nbehavior string?\ninvariant string?\ncriticality =critical|noncritical\nproductionSymbols @evidence[]\ncontracts @evidence[]\nvalidators @evidence[]\nconstants @evidence[]\nerrors @evidence[]\nsideEffectEvidence @evidence[]\nproposedOrExistingTestFiles @evidence[]\nreusableHelpers @evidence[]\noracleEvidence @evidence[]\ntestCommands @evidence[]\nmappingStatus =mapped|partially-mapped|unmapped|not-applicable\nunresolvedReasons string[]\nprovenance @provenance[]\nwarnings string[]",
    "mappings": "requested boolean\noperational boolean\nmappings @mapping[]\nunknownResponsibilityIds string[]\nduplicateResponsibilityIds string[]\nlimit number?\navailableCount count\nusedCount count\ntruncated boolean\ndroppedCount count\ncriticalDropped boolean\nwarnings string[]",
    "roleAdequacy": f"role {_ROLE}\nstatus {_ADEQUACY}\nrequiredConditions string[]\nsatisfiedConditions string[]\nmissingConditions string[]\nblockingConditions string[]\nwarnings string[]\nsupportingEvidence string[]\naffectedResponsibilityIds string[]\ntruncationImpact boolean\nfreshnessImpact boolean",
    "identity": "label string\nvalue string?",
    "freshness": f"state =fresh|stale|unknown\nrole {_ROLE}\nevidenceUsed string[]\nevidenceUnavailable string[]\ncomparedIdentities @identity[]\nreason string\nrelevantChangedPaths string[]\nwarnings string[]",
    "limit": "name string\ndeclaredValue number?\nusedValue number\navailableCount number?\ndroppedCount number?\ntruncated boolean\nrequiredEvidenceAffected boolean\nadequacyImpact string?",
    "budget": "characters present\nlimits @limit[]\n?characters object?\ncharacters.measured number\ncharacters.limit number?\ncharacters.truncated boolean\nwarnings string[]",
    "cut": "id string\naffectedGroup string\nlimit number?\nused number\navailable number\ndroppedCount count\ndroppedEvidenceIds string[]\nrequiredEvidenceLost boolean\nadequacyImpact string?\nreason string",
    "truncation": "truncated boolean\nrecords @cut[]\nwarnings string[]",
    "fallback": f"id string\nfilePath string\nreason string\nrequestedEvidenceKind string?\nboundedRetrievalAttempted boolean\nsourceRangesAttempted count\nincludedLineCount count\nincludedCharacterCount count\nrole {_ROLE}\nresponsibilityIdsAffected string[]\nallowed boolean\nprovenance string",
    "fallbacks": "enabled boolean\nlimit number?\nused count\nfallbacks @fallback[]\nwarnings string[]",
    "named": "name string\nversion string",
    "index": "indexPath string\nmanifestPath string",
}
RETRIEVAL_RECORD = """
schemaVersion version
generatedAt string
tool @named
request @request
index @index
steps @step[]
fallbacks string[]
fullFileReadRecommendations @recommendation[]
warnings string[]
contextAdequacy @adequacy
roleContext @roleContext
responsibilityMappings @mappings
roleAdequacy @roleAdequacy
freshness @freshness
budget @budget
truncation @truncation
fullFileFallback @fallbacks
provenance @provenance[]
"""


# Fields, differences, canonical text --------------------------------------------


def selected(walked: DataFrame, fields: Iterable[tuple[str, str]]) -> DataFrame:
    """source, field, path, type, text of the values that fields (name, pattern) point at; one pass over the rows, whatever the number of fields."""
    table = walked.sparkSession.createDataFrame(list(fields), "field string, pattern string")
    return walked.join(F.broadcast(table), "pattern").select("source", "field", "path", "type", "text")


def evidence(walked: DataFrame, fields: Iterable[tuple[str, str]]) -> DataFrame:
    """source, field, availability, n, texts (scalars, in order): a field that no value has is ``unavailable``, one with empty lists or nulls alone ``not-applicable``."""
    fields = list(fields)
    spark = walked.sparkSession
    table = F.broadcast(spark.createDataFrame(fields, "field string, pattern string"))
    # A list says that its field is there even if it holds nothing.
    lists = F.broadcast(spark.createDataFrame([(f, p[:-2]) for f, p in fields if p.endswith("[]")], "field string, pattern string"))
    found = walked.join(table, "pattern").select("source", "field", F.when(F.col("type") != "null", F.struct("steps", "text")).alias("x"))
    empty = walked.join(lists, "pattern").where("type = 'array'").select("source", "field", F.lit(None).cast(found.schema["x"].dataType).alias("x"))
    seen = found.unionByName(empty).groupBy("source", "field").agg(F.count("x").alias("n"), F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]).alias("texts"))
    every = walked.where("depth = 0").select("source", F.explode(F.array(*[F.lit(f) for f, _ in fields])).alias("field"))
    state = F.when(F.col("n").isNull(), "unavailable").when(F.col("n") == 0, "not-applicable").otherwise("available")
    return every.join(seen, ["source", "field"], "left").select("source", "field", state.alias("availability"), F.coalesce("n", F.lit(0)).alias("n"), F.array_compact(F.coalesce("texts", F.array().cast("array<string>"))).alias("texts"))


def structural_injection(pairs: DataFrame) -> DataFrame:
    """Whether content broke out of its strings: source, parseable, injected_keys (top-level ones that only the candidate has), injected_patterns (at any level).

    pairs: source, baseline, candidate, one document rendered twice, with harmless and with hostile content.
    """
    named = lambda side: F.transform(F.filter(_rows(F.col(side), MOST_DEPTH), lambda r: r["name"].isNotNull()), lambda r: F.struct(r["pattern"].alias("pattern"), r["depth"].alias("depth")))
    patterns = lambda rows: F.transform(rows, lambda r: r["pattern"])
    walked = spread(pairs, "source").select("source", named("baseline").alias("b"), named("candidate").alias("c"))
    new = walked.withColumn("new", F.array_sort(F.array_except(patterns(F.col("c")), patterns(F.col("b")))))
    top = patterns(F.filter("c", lambda r: r["depth"] == 1))
    none = F.array().cast("array<string>")
    return new.select("source", (F.col("b").isNotNull() & F.col("c").isNotNull()).alias("parseable"), F.coalesce(F.array_sort(F.array_intersect("new", top)), none).alias("injected_keys"), F.coalesce("new", none).alias("injected_patterns"))


def number_text(x: Column) -> Column:
    """A double as JavaScript writes it, with the digits of Spark's own text of it; null for what is not finite."""
    d = x.cast("double")
    plain = F.regexp_replace(F.regexp_replace(d.cast("decimal(38,16)").cast("string"), "0+$", ""), r"\.$", "")
    small = F.regexp_replace(F.regexp_replace(d.cast("decimal(38,30)").cast("string"), "0+$", ""), r"\.$", "")
    shown = d.cast("string")
    exponent = F.concat(F.regexp_replace(F.regexp_extract(shown, "^(.*)E", 1), r"\.0$", ""), F.lit("e"), F.when(F.abs(d) >= 1, "+").otherwise(""), F.regexp_extract(shown, "E(.*)$", 1))
    finite = ~(F.isnan(d) | (F.abs(d) == float("inf")))
    return F.when(finite, F.when(d == 0, "0").when(F.abs(d) >= 1e21, exponent).when(F.abs(d) < 1e-6, exponent).when(F.abs(d) < 1, small).otherwise(plain))


def canonical(raw: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """source, canonical, error: JSON text without spaces, keys in order at every level, numbers in one form.

    error is ``malformed``, ``non-finite number`` or ``too deep``, and canonical is null then.
    Each value gives the pieces of text before and after its parts, which are put in order by the values' places.
    """
    last = 2**31 - 1
    quoted = lambda s: F.regexp_replace(F.to_json(F.struct(s.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")

    def pieces(r: Column) -> Column:
        scalar = F.when(r["type"] == "string", quoted(r["text"])).when(r["type"] == "number", number_text(r["text"])).when(r["type"] == "null", "null").otherwise(r["text"])
        comma = F.when(F.element_at(r["steps"], -1) > 0, ",").otherwise("")
        lead = F.when(r["depth"] == 0, "").when(r["name"].isNull(), comma).otherwise(F.concat(comma, quoted(r["name"]), F.lit(":")))
        opened = F.when(r["type"] == "object", "{").when(r["type"] == "array", "[").otherwise(scalar)
        closed = F.when(r["type"] == "object", "}").when(r["type"] == "array", "]")
        error = F.when(opened.isNull(), "non-finite number").when(r["deeper"], "too deep")
        start = F.struct(r["steps"].alias("steps"), F.concat(lead, F.coalesce(opened, F.lit("?"))).alias("piece"), error.alias("error"))
        end = F.struct(F.concat(r["steps"], F.array(F.lit(last))).alias("steps"), closed.alias("piece"), F.lit(None).cast("string").alias("error"))
        return F.when(closed.isNull(), F.array(start)).otherwise(F.array(start, end))

    texts = spread(raw.select("source", "raw"), "source").select("source", F.flatten(F.transform(_rows(F.col("raw"), most_depth), pieces)).alias("p"))
    error = F.array_max(F.transform("p", lambda p: p["error"]))
    whole = texts.select("source", error.alias("error"), F.array_join(F.transform(F.array_sort("p"), lambda p: p["piece"]), "").alias("canonical"))
    return whole.select("source", F.when(F.col("error").isNull(), F.col("canonical")).alias("canonical"), F.coalesce("error", F.when(F.col("canonical").isNull(), "malformed")).alias("error"))
