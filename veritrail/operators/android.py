"""Android manifests, Gradle files and configuration: rule checks over typed tables.

manifests: manifest_path, package_name, application_permission, permissions
ARRAY<STRUCT<name>>, components ARRAY<STRUCT<kind, name, exported, exportedRaw,
permission, readPermission, writePermission, intentFilterCount, isLauncher>>.
``exported`` has three states; unknown is never taken for false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritrail.functions.semantics import let
from veritrail.operators.audit import lookup

PLATFORM = "android.permission."
# Permissions of the platform that are no finding, and those that want a review, by group.
LOW_RISK = ["INTERNET", "ACCESS_NETWORK_STATE", "ACCESS_WIFI_STATE", "VIBRATE", "WAKE_LOCK", "RECEIVE_BOOT_COMPLETED"]
SENSITIVE = {
    "location": ["ACCESS_FINE_LOCATION", "ACCESS_COARSE_LOCATION"],
    "background-location": ["ACCESS_BACKGROUND_LOCATION"],
    "camera": ["CAMERA"],
    "microphone": ["RECORD_AUDIO"],
    "contacts": ["READ_CONTACTS", "WRITE_CONTACTS", "GET_ACCOUNTS"],
    "calendar": ["READ_CALENDAR", "WRITE_CALENDAR"],
    "sms": ["SEND_SMS", "READ_SMS", "RECEIVE_SMS", "RECEIVE_MMS"],
    "call-log": ["READ_CALL_LOG", "WRITE_CALL_LOG", "PROCESS_OUTGOING_CALLS"],
    "phone": ["READ_PHONE_STATE", "CALL_PHONE"],
    "nearby-devices": ["BLUETOOTH_CONNECT", "BLUETOOTH_SCAN", "BLUETOOTH_ADVERTISE", "NEARBY_WIFI_DEVICES"],
    "storage-legacy": ["READ_EXTERNAL_STORAGE", "WRITE_EXTERNAL_STORAGE", "MANAGE_EXTERNAL_STORAGE"],
    "media": ["READ_MEDIA_IMAGES", "READ_MEDIA_VIDEO", "READ_MEDIA_AUDIO"],
    "notifications": ["POST_NOTIFICATIONS"],
    "body-sensors": ["BODY_SENSORS", "BODY_SENSORS_BACKGROUND"],
    "activity-recognition": ["ACTIVITY_RECOGNITION"],
    "foreground-service": ["FOREGROUND_SERVICE"],
    "package-install": ["REQUEST_INSTALL_PACKAGES"],
    "package-visibility": ["QUERY_ALL_PACKAGES"],
}
GROUP_OF = {PLATFORM + name: group for group, names in SENSITIVE.items() for name in names}
# Severity of each rule.
COMPONENT_SEVERITY = {
    "android-component-malformed-exported": "minor",
    "android-component-unspecified-exported-with-filter": "minor",
    "android-provider-exported-unprotected": "major",
    "android-provider-exported-partial-protection": "minor",
    "android-provider-exported-protected": "informational",
    "android-component-exported-protected": "informational",
    "android-component-launcher-activity-exported": "informational",
    "android-component-exported-unprotected": "minor",
}
VIEW, BROWSABLE, MAIN = "android.intent.action.VIEW", "android.intent.category.BROWSABLE", "android.intent.action.MAIN"
STANDARD_ACTION, STANDARD_CATEGORY = "android.intent.action.", "android.intent.category."
LAUNCHER_CATEGORIES = ["android.intent.category.LAUNCHER", "android.intent.category.DEFAULT"]
BROAD_PATH = r"[*.]{1,2}\*|\.\*|^\*$"
# Check categories that a verdict requires, and those judged by their findings alone.
REQUIRED_CHECKS = ["android-detection", "android-manifest", "android-permissions", "android-components", "android-intent-filters", "android-deep-links", "android-gradle"]
FINDING_DRIVEN = ["android-permissions", "android-components", "android-intent-filters", "android-deep-links"]
COMPONENT_KINDS = ["activity", "activity-alias", "service", "receiver", "provider"]
MOST_DEPTH = 10


def _rules(*cells: tuple[Column, str, str]) -> Column:
    """ARRAY<STRUCT<rule, severity>> of those that apply, in order."""
    made = [F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for when, rule, severity in cells]
    return F.filter(F.array(*made), lambda r: r.isNotNull())


def permission_findings(manifests: DataFrame) -> DataFrame:
    """manifest_path, permission, rule, grp, severity for each distinct permission that wants a review.

    Sensitive ones of the platform are minor, background location beside a
    foreground one under a rule of its own; names outside the platform are custom
    and informational; the rest is no finding.
    """
    names = F.array_distinct(F.transform("permissions", lambda p: p["name"]))
    foreground = F.arrays_overlap(names, F.array(*[F.lit(PLATFORM + n) for n in SENSITIVE["location"]]))
    rows = manifests.select("manifest_path", F.explode(names).alias("permission"), foreground.alias("foreground")).where("permission IS NOT NULL")
    group = lookup(GROUP_OF, F.col("permission"))
    rule = (
        F.when((group == "background-location") & F.col("foreground"), "android-permission-background-and-foreground-location")
        .when(group.isNotNull(), "android-permission-sensitive")
        .when(~F.col("permission").startswith(PLATFORM), "android-permission-unknown-custom")
    )
    severity = F.when(group.isNotNull(), "minor").otherwise("informational")
    return rows.select("manifest_path", "permission", rule.alias("rule"), group.alias("grp"), severity.alias("severity")).where("rule IS NOT NULL")


def exported_findings(manifests: DataFrame) -> DataFrame:
    """manifest_path, kind, name, rule, severity of components that other apps can reach, or of which this cannot be told.

    A provider is protected by a permission of its own, or by one for reading and
    one for writing; other components by their own or the application's. A value
    of ``exported`` that is neither true nor false (``exportedRaw``) stays unknown.
    """
    rows = manifests.select("manifest_path", "application_permission", F.explode("components").alias("c"))
    set_ = lambda name: F.coalesce(F.col(f"c.{name}"), F.lit("")) != ""
    provider = F.col("c.kind") == "provider"
    own, both, one = set_("permission"), set_("readPermission") & set_("writePermission"), set_("readPermission") | set_("writePermission")
    guarded = own | (F.coalesce("application_permission", F.lit("")) != "")
    unknown = F.col("c.exported").isNull()
    rule = (
        F.when(unknown & F.col("c.exportedRaw").isNotNull(), "android-component-malformed-exported")
        .when(unknown, F.when(F.col("c.intentFilterCount") > 0, "android-component-unspecified-exported-with-filter"))
        .when(~F.col("c.exported"), F.lit(None))
        .when(provider & (own | both), "android-provider-exported-protected")
        .when(provider & one, "android-provider-exported-partial-protection")
        .when(provider, "android-provider-exported-unprotected")
        .when(guarded, "android-component-exported-protected")
        .when(F.coalesce("c.isLauncher", F.lit(False)), "android-component-launcher-activity-exported")
        .otherwise("android-component-exported-unprotected")
    )
    return rows.select("manifest_path", F.col("c.kind").alias("kind"), F.col("c.name").alias("name"), rule.alias("rule"), lookup(COMPONENT_SEVERITY, rule).alias("severity")).where("rule IS NOT NULL")


def intent_filter_findings(filters: DataFrame) -> DataFrame:
    """Rules on what a filter holds. filters: as of ``sources.android.intent_filters``. A launcher's own filter is never a finding."""
    actions, categories = F.coalesce("actions", F.array().cast("array<string>")), F.coalesce("categories", F.array().cast("array<string>"))
    empty = (F.size(actions) == 0) & (F.coalesce(F.size("data"), F.lit(0)) == 0)
    twice = (F.size(F.array_distinct(actions)) < F.size(actions)) | (F.size(F.array_distinct(categories)) < F.size(categories))
    launcher = (F.size(actions) == 1) & F.array_contains(actions, MAIN) & F.forall(categories, lambda c: c.isin(LAUNCHER_CATEGORIES))
    reachable = F.coalesce(F.col("exported"), F.col("exported_raw").isNull())
    judged = ~empty & ~launcher
    rules = _rules(
        (empty, "android-intent-filter-empty-or-malformed", "informational"),
        (~empty & twice, "android-intent-filter-duplicate-entries", "informational"),
        (judged & reachable & F.exists(actions, lambda a: ~a.startswith(STANDARD_ACTION)), "android-intent-filter-custom-action-reachable", "minor"),
        (judged & F.exists(categories, lambda c: ~c.startswith(STANDARD_CATEGORY)), "android-intent-filter-non-standard-category", "informational"),
    )
    return filters.select("manifest_path", "kind", "component", F.inline(rules))


def deep_link_findings(filters: DataFrame) -> DataFrame:
    """The first rule that applies to each filter that opens links: placeholders, broad path patterns, links without a host; every other one is listed as bounded.

    filters: as of ``sources.android.intent_filters``. A broad pattern is major
    only on a component that is exported without a permission.
    """
    has = lambda column, value: F.coalesce(F.array_contains(column, value), F.lit(False))
    view, browsable = has("actions", VIEW), has("categories", BROWSABLE)
    some = lambda test: F.coalesce(F.exists("data", lambda d: F.coalesce(test(d), F.lit(False))), F.lit(False))
    filled = lambda d, name: F.coalesce(d[name], F.lit("")) != ""
    schemes = some(lambda d: filled(d, "scheme"))
    web = some(lambda d: d["scheme"].isin("http", "https"))
    host = some(lambda d: filled(d, "host"))
    held = lambda d, name: d[name].contains("${") | d[name].startswith("@")
    placeholder = some(lambda d: F.exists(F.array(*[F.coalesce(held(d, n), F.lit(False)) for n in ("scheme", "host", "path", "pathPrefix", "pathPattern")]), lambda x: x))
    broad = some(lambda d: d["pathPattern"].rlike(BROAD_PATH))
    open_ = F.coalesce("exported", F.lit(False)) & (F.coalesce("permission", F.lit("")) == "")
    nothing = view & ~browsable & (F.coalesce(F.size("data"), F.lit(0)) == 0)
    rule = (
        F.when(browsable & ~view, "android-deep-link-browsable-without-view")
        .when(~view | nothing, F.lit(None))
        .when(placeholder, "android-deep-link-placeholder-value")
        .when(broad, "android-deep-link-broad-path-pattern")
        .when(web & ~host, "android-deep-link-web-link-without-host")
        .when(schemes & ~web & ~host, "android-deep-link-custom-scheme-without-host")
        .otherwise("android-deep-link-bounded")
    )
    minor = F.col("rule").isin("android-deep-link-web-link-without-host", "android-deep-link-custom-scheme-without-host")
    severity = F.when(F.col("rule") == "android-deep-link-broad-path-pattern", F.when(F.col("_open"), "major").otherwise("minor")).when(minor, "minor").otherwise("informational")
    judged = filters.select("manifest_path", "kind", "component", rule.alias("rule"), open_.alias("_open")).where("rule IS NOT NULL")
    return judged.select("manifest_path", "kind", "component", "rule", severity.alias("severity"))


def effective_network_policy(configs: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """What holds in each network-security config.

    configs: those of ``network_security_configs``, or any table with path, doc,
    node, parent, kind, position, cleartext, domains, trust, pins, line and column.
    Returns path, doc, node, scope, kind, depth, domains, domains_inherited,
    cleartext, cleartext_source, trust (a chain of lists, the nearest first),
    trust_source, pins, too_deep, line, column. Cleartext is a config's own or the
    base config's, never that of a domain config around it; domains are inherited
    where a config has none; trust is chained up to the base config; pins are
    never inherited; debug configs only have their own trust. Domain configs below
    ``most_depth``, or in a ring of parents, have ``too_deep`` and nothing
    inherited.
    """
    one = F.struct("node", "parent", "kind", "position", "cleartext", "domains", "trust", "pins", "line", "column")
    return network_policies(configs.groupBy("path", "doc").agg(F.sort_array(F.collect_list(one)).alias("configs")), most_depth)


def network_policies(documents: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """``effective_network_policy`` of documents (path, doc, configs by node): configs are followed up within their rows, so nothing is shuffled."""
    configs = F.col("configs")
    at = lambda i: F.get(configs, i)
    last = lambda a: F.element_at(a, -1)

    def climbed(i: Column, above: Column) -> Column:
        """The places of a config and of the domain configs around it, the nearest first, ``most_depth`` of them at most."""
        up = lambda a, _: let(F.get(above, last(a)), lambda p: F.when((p >= 0) & (at(p)["kind"] == "domain"), F.concat(a, F.array(p))).otherwise(a))
        return F.aggregate(F.sequence(F.lit(1), F.lit(most_depth)), F.array(i), up)

    def judged(x: Column, way: Column, base: Column) -> Column:
        """What holds at a config: way has its place and, unless it is too deep, those of the configs around it; top is the outermost."""

        def cells(top: Column, deep: Column) -> Column:
            step = lambda j: F.concat(F.lit("domain-config["), at(j)["position"], F.lit("]"))
            outer = F.when(top["kind"] == "base", "base-config").when(top["kind"] == "domain", step(last(way))).otherwise("debug-overrides")
            inner = F.transform(F.reverse(F.slice(way, 1, F.size(way) - 1)), step)
            under = ~deep & (top["kind"] == "domain")
            named = F.get(F.filter(F.transform(way, lambda j: at(j)["domains"]), lambda d: F.size(d) > 0), F.lit(0))
            domains = F.when(deep, x["domains"]).otherwise(F.coalesce(named, top["domains"]))
            trusts = F.filter(F.transform(way, lambda j: at(j)["trust"]), lambda t: t.isNotNull())
            chain = F.when(under & base["trust"].isNotNull(), F.concat(trusts, F.array(base["trust"]))).otherwise(trusts)
            clear = F.when(under, base["cleartext"])
            source = F.when(x["cleartext"].isNotNull(), "explicit").when(clear.isNotNull(), "inherited-from-base").otherwise("unspecified")
            return F.struct(
                x["node"].alias("node"),
                F.when(~deep, F.concat_ws(">", F.array(outer), inner)).alias("scope"),
                x["kind"].alias("kind"),
                F.when(~deep, F.size(way) - 1).alias("depth"),
                domains.alias("domains"),
                ((F.size(way) > 1) & (F.size(x["domains"]) == 0) & named.isNotNull()).alias("domains_inherited"),
                F.coalesce(x["cleartext"], clear).alias("cleartext"),
                source.alias("cleartext_source"),
                chain.alias("trust"),
                F.when(x["trust"].isNotNull(), "own").when(F.size(chain) > 0, "inherited").otherwise("unspecified").alias("trust_source"),
                x["pins"].alias("pins"),
                deep.alias("too_deep"),
                x["line"].alias("line"),
                x["column"].alias("column"),
            )

        return let(F.struct(at(last(way)).alias("top"), at(last(way))["parent"].isNotNull().alias("deep")), lambda t: cells(t["top"], t["deep"]))

    def policies(above: Column, base: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            whole = lambda a: F.when(at(last(a))["parent"].isNull(), a).otherwise(F.array(i))
            return let(climbed(i, above), lambda a: let(whole(a), lambda way: judged(x, way, base)))

        return F.transform(configs, one)

    above = let(F.transform(configs, lambda x: x["node"]), lambda nodes: F.transform(configs, lambda x: (F.array_position(nodes, x["parent"]) - 1).cast("int")))
    base = F.get(F.filter(configs, lambda x: x["kind"] == "base"), F.lit(0))
    return documents.select("path", "doc", F.inline(let(F.struct(above.alias("above"), base.alias("base")), lambda g: policies(g["above"], g["base"]))))


def network_findings(policy: DataFrame) -> DataFrame:
    """path, scope, rule, line of what a policy permits: cleartext traffic, and certificates of users in ordinary configs."""
    user = F.exists(F.flatten("trust"), lambda c: c["kind"] == "user") & (F.col("kind") != "debug")
    rules = F.array_compact(F.array(F.when(F.col("cleartext"), "cleartext-permitted"), F.when(user, "user-certificates-trusted")))
    return policy.select("path", "scope", F.explode(rules).alias("rule"), "line")


def module_kind(modules: DataFrame) -> DataFrame:
    """Adds kind and ui_toolkit from plugins and dependencies. modules: module, plugins, dependencies, has_layouts."""
    has = lambda *ids: F.arrays_overlap("plugins", F.array(*[F.lit(i) for i in ids]))
    kind = F.when(has("com.android.application", "android-application"), "application").when(has("com.android.library", "android-library"), "library").when(has("com.android.test", "com.android.dynamic-feature"), "other-android").otherwise("unknown")
    compose = F.exists("dependencies", lambda d: d.contains("androidx.compose")) | has("org.jetbrains.kotlin.plugin.compose")
    views = F.coalesce("has_layouts", F.lit(False)) | F.exists("dependencies", lambda d: d.contains("appcompat") | d.contains("com.google.android.material"))
    toolkit = F.when(compose & views, "mixed").when(compose, "compose").when(views, "views").otherwise("unknown")
    return modules.withColumns({"kind": kind, "ui_toolkit": toolkit, "confidence": F.when(kind == "unknown", "low").when(toolkit == "unknown", "medium").otherwise("high")})


def release_findings(build_types: DataFrame) -> DataFrame:
    """Release build types that can be debugged, are not minified, or have no signing config. build_types: module, module_kind, build_type, debuggable, minify, signing_config."""
    release = build_types.where("build_type = 'release'")
    rules = F.filter(
        F.array(
            F.when(F.col("debuggable"), F.struct(F.lit("release-debuggable").alias("rule"), F.lit("blocker").alias("severity"))),
            F.when(~F.col("minify"), F.struct(F.lit("release-not-minified").alias("rule"), F.lit("minor").alias("severity"))),
            F.when((F.col("module_kind") == "application") & F.col("signing_config").isNull(), F.struct(F.lit("release-unsigned").alias("rule"), F.lit("minor").alias("severity"))),
        ),
        lambda r: r.isNotNull(),
    )
    return release.select("module", F.inline(rules))


def backup_findings(manifests: DataFrame) -> DataFrame:
    """Backup that is on, or not declared, without rules. manifests: manifest_path, allow_backup, backup_rules."""
    allowed = F.coalesce("allow_backup", F.lit(True))
    rule = F.when(allowed & F.col("backup_rules").isNull(), F.when(F.col("allow_backup").isNull(), "backup-by-default").otherwise("backup-without-rules"))
    return manifests.select("manifest_path", rule.alias("rule")).where("rule IS NOT NULL")


def logging_findings(calls: DataFrame) -> DataFrame:
    """Log calls whose arguments classify as sensitive: minor behind a debug guard, else major; exceptions and dynamic values are only candidates. calls: path, line, sensitivity, debug_guarded, logs_exception, dynamic."""
    severity = F.when(F.col("sensitivity").isNotNull(), F.when(F.col("debug_guarded"), "minor").otherwise("major"))
    kind = F.when(F.col("sensitivity").isNotNull(), "finding").when(F.col("logs_exception") | F.col("dynamic"), "candidate")
    return calls.select("path", "line", kind.alias("kind"), severity.alias("severity")).where("kind IS NOT NULL")


#: Stages of a verdict: the first that has a reason decides.
STAGES = ["blocker", "major", "target", "failed", "mismatch", "inconclusive", "advisory"]
# What each stage means for a release.
VERDICTS = {"blocker": "not-ready-security-blocker-remains", "major": "not-ready-security-blocker-remains", "target": "not-ready-security-blocker-remains", "failed": "not-ready-security-blocker-remains", "mismatch": "inconclusive-audit-environment-incomplete", "inconclusive": "inconclusive-audit-environment-incomplete", "advisory": "ready-except-optional-manual-checks"}
READY = "ready-for-release-preparation"
IMPACT = {s: "blocking" if s in STAGES[:4] else "inconclusive" if s in STAGES[4:6] else "advisory" for s in STAGES}


def verdict_reasons(checks: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, code, related_id, impact, stage: the reasons of the first stage that has one, for each run.

    checks: run_id, id, category, requirement_level, status; findings: run_id, id,
    severity; runs: run_id, project_kind, unexpected_changes INT,
    multiple_application_modules, manual_play_items INT. Failed audits of the
    categories that are judged by their findings do not count as failed checks.
    """
    place = {s: F.lit(i) for i, s in enumerate(STAGES)}

    def rows(df: DataFrame, when: Column, stage: str, code: str, related: str | None) -> DataFrame:
        return df.where(when).select("run_id", place[stage].alias("_stage"), F.lit(code).alias("code"), (F.col(related).cast("string") if related else F.lit(None).cast("string")).alias("related_id"))

    required = (F.col("requirement_level") == "required") & F.col("category").isin(REQUIRED_CHECKS)
    optional, status = F.col("requirement_level") == "optional", F.col("status")
    partial = F.col("project_kind").isin("partial", "unknown")
    found = [
        rows(findings, F.col("severity") == "blocker", "blocker", "android-blocker-finding", "id"),
        rows(findings, F.col("severity") == "major", "major", "android-major-finding", "id"),
        rows(runs, F.col("unexpected_changes") > 0, "target", "android-unexpected-target-modification", None),
        rows(checks, required & (status == "failed") & ~F.col("category").isin(FINDING_DRIVEN), "failed", "android-required-check-failed", "id"),
        rows(runs, F.col("project_kind") == "non-android", "mismatch", "android-profile-mismatch", None),
        rows(runs, partial, "inconclusive", "android-partial-detection", None),
        rows(checks, required & status.isin("inconclusive", "error"), "inconclusive", "android-required-check-inconclusive", "id"),
        rows(checks, required & (status == "unsupported"), "inconclusive", "android-required-check-unsupported", "id"),
        rows(runs, F.coalesce("multiple_application_modules", F.lit(False)), "inconclusive", "android-multiple-application-modules", None),
        rows(findings, F.col("severity").isin("minor", "informational"), "advisory", "android-review-finding", "id"),
        rows(checks, optional & status.isin("skipped", "not-run"), "advisory", "android-optional-check-not-run", "id"),
        rows(checks, optional & (status == "failed"), "advisory", "android-optional-check-failed", "id"),
        rows(runs, F.col("manual_play_items") > 0, "advisory", "android-play-readiness-manual-items", None),
    ]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    first = every.groupBy("run_id").agg(F.min("_stage").alias("_first"))
    stage = F.get(F.array(*[F.lit(s) for s in STAGES]), F.col("_stage"))
    kept = every.join(first, "run_id").where(F.col("_stage") == F.col("_first"))
    return kept.select("run_id", "code", "related_id", lookup(IMPACT, stage).alias("impact"), stage.alias("stage"))


def verdict(checks: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, verdict, reasons (their number) for each run; inputs as of ``verdict_reasons``."""
    one = verdict_reasons(checks, findings, runs).groupBy("run_id").agg(F.first("stage").alias("stage"), F.count(F.lit(1)).alias("reasons"))
    met = runs.select("run_id").distinct().join(one, "run_id", "left")
    return met.select("run_id", F.coalesce(lookup(VERDICTS, F.col("stage")), F.lit(READY)).alias("verdict"), F.coalesce("reasons", F.lit(0)).alias("reasons"))


def catalog_versions(lines: DataFrame) -> DataFrame:
    """Libraries and plugins of a TOML catalog with their version, one ``version.ref`` resolved. lines: path, line, text.

    The section of a line is the last header above it; a catalog is one file, so
    its window is as large as that file.
    """
    w = W.partitionBy("path").orderBy("line")
    header = F.regexp_extract("text", r"^\s*\[([\w.-]+)\]\s*$", 1)
    rows = lines.withColumn("section", F.last(F.when(header != "", header), ignorenulls=True).over(w)).where(header == "")
    key = F.regexp_extract("text", r"^\s*([\w.-]+)\s*=", 1)
    body = F.regexp_replace("text", r"^\s*[\w.-]+\s*=\s*", "")
    named = rows.select("path", "section", key.alias("alias"), body.alias("body")).where("alias <> ''")
    versions = named.where("section = 'versions'").select("path", F.col("alias").alias("ref"), F.regexp_extract("body", r'^"([^"]*)"', 1).alias("resolved"))
    entries = named.where(F.col("section").isin("libraries", "plugins"))
    ref = F.regexp_extract("body", r'version\.ref\s*=\s*"([^"]*)"', 1)
    own = F.coalesce(F.nullif(F.regexp_extract("body", r'version\s*=\s*"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract("body", r'^"[^":]+:[^":]+:([^"]+)"', 1), F.lit("")))
    return entries.withColumn("ref", F.nullif(ref, F.lit(""))).join(versions, ["path", "ref"], "left").select("path", "section", "alias", F.coalesce(own, "resolved").alias("version"), (F.col("ref").isNotNull() & F.col("resolved").isNull()).alias("unresolved"))


def play_readiness(facts: DataFrame, least_target_sdk: int) -> DataFrame:
    """Checklist rows per module: item, state (pass, fail, unknown). facts: module, target_sdk, version_code, debuggable, signed."""
    tri = lambda c: F.when(c.isNull(), "unknown").when(c, "pass").otherwise("fail")
    items = {"target-sdk": F.col("target_sdk") >= least_target_sdk, "version-code": F.col("version_code") > 0, "not-debuggable": ~F.col("debuggable"), "signed": F.col("signed")}
    return facts.select("module", F.inline(F.array(*[F.struct(F.lit(n).alias("item"), tri(c).alias("state")) for n, c in items.items()])))


def rule_category(rule_id: Column, categories: dict[str, str]) -> Column:
    """The category of a rule id by its table, else ``other``."""
    return lookup(categories, rule_id, "other")
