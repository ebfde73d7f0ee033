"""Android readers and rules on small hand-written inputs."""

from veritrail.operators import android as A
from veritrail.plans import markup_queries
from veritrail.sources import android as R

MANIFEST = """<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="a.b">
<uses-permission android:name="android.permission.CAMERA"/><uses-permission android:name="android.permission.ACCESS_BACKGROUND_LOCATION"/>
<application android:allowBackup="true">
<activity android:name=".Main" android:exported="true"><intent-filter><action android:name="android.intent.action.MAIN"/><category android:name="android.intent.category.LAUNCHER"/></intent-filter></activity>
<activity android:name=".Open" android:exported="true"/><service android:name=".Bound" android:exported="true" android:permission="p"/>
<receiver android:name=".R"><intent-filter><action android:name="x"/></intent-filter></receiver>
<provider android:name=".P" android:exported="@bool/x"/><provider android:name=".Q" android:exported="true" android:readPermission="r"/>
</application></manifest>"""


def test_manifest_rules(spark):
    m = R.manifests(spark.createDataFrame([("m.xml", MANIFEST)], "path string, raw string"))
    assert {(r.permission, r.grp, r.severity) for r in A.permission_findings(m).collect()} == {("android.permission.CAMERA", "camera", "minor"), ("android.permission.ACCESS_BACKGROUND_LOCATION", "background-location", "minor")}
    assert {(r.name, r.rule.removeprefix("android-"), r.severity) for r in A.exported_findings(m).collect()} == {
        (".Main", "component-launcher-activity-exported", "informational"),
        (".Open", "component-exported-unprotected", "minor"),
        (".Bound", "component-exported-protected", "informational"),
        (".R", "component-unspecified-exported-with-filter", "minor"),
        (".P", "component-malformed-exported", "minor"),
        (".Q", "provider-exported-partial-protection", "minor"),
    }
    filters = R.intent_filters(m)
    assert {(r.component, tuple(r.actions)) for r in filters.collect()} == {(".Main", ("android.intent.action.MAIN",)), (".R", ("x",))}
    assert {(r.component, r.rule) for r in A.intent_filter_findings(filters).collect()} == {(".R", "android-intent-filter-custom-action-reachable")}
    assert [r.rule for r in A.backup_findings(m).collect()] == ["backup-without-rules"]


def test_gradle(spark):
    raw = lambda t: spark.createDataFrame([("f", t)], "path string, raw string")
    w = R.wrapper_properties(raw("distributionUrl=https\\://s.org/gradle-8.7-bin.zip\n")).first()
    assert (w.gradle_version, w.sha256) == ("8.7", None)
    assert sorted(r.module for r in R.settings_modules(raw("include(\":app\", ':lib:core')\ninclude ':x'")).collect()) == [":app", ":lib:core", ":x"]
    build = spark.createDataFrame([("app", 'android { buildTypes { release { isDebuggable = true\n isMinifyEnabled = false\n signingConfig = signingConfigs.getByName("rel") } debug { minifyEnabled true } } }')], "module string, raw string")
    got = {r.build_type: (r.debuggable, r.minify, r.signing_config) for r in R.build_types(build).collect()}
    assert got == {"release": (True, False, "rel"), "debug": (None, True, None)}
    types = R.build_types(build).selectExpr("*", "'application' AS module_kind")
    assert {r.rule for r in A.release_findings(types).collect()} == {"release-debuggable", "release-not-minified"}
    toml = '[versions]\nk = "1.9"\n[libraries]\na = { module = "g:a", version.ref = "k" }\nb = "g:b:2.0"\nc = { module = "g:c", version.ref = "no" }'
    lines = spark.createDataFrame([("c", i, t) for i, t in enumerate(toml.split("\n"))], "path string, line int, text string")
    assert {r.alias: (r.version, r.unresolved) for r in A.catalog_versions(lines).collect()} == {"a": ("1.9", False), "b": ("2.0", False), "c": (None, True)}


NETWORK = """<?xml version="1.0"?>
<network-security-config>
  <base-config cleartextTrafficPermitted="false"><trust-anchors><certificates src="system"/></trust-anchors></base-config>
  <base-config cleartextTrafficPermitted="true"/>
  <domain-config cleartextTrafficPermitted="true">
    <domain includeSubdomains="true"> A.Example. </domain><domain/>
    <pin-set expiration="soon"><pin digest="SHA-256"> a b </pin><pin digest="MD5"/></pin-set>
    <odd/>
    <domain-config><trust-anchors><certificates src="@raw/own" overridePins="true"/><certificates src="user"/></trust-anchors>
      <domain-config cleartextTrafficPermitted="maybe"><domain>b</domain></domain-config>
    </domain-config>
  </domain-config>
  <debug-overrides><trust-anchors><certificates src="user"/></trust-anchors></debug-overrides>
</network-security-config>"""


def test_network_security(spark):
    deep = "<network-security-config>" + "<domain-config>" * 13 + "</domain-config>" * 13 + "</network-security-config>"
    raw = spark.createDataFrame([("n", NETWORK), ("bad", "<a>"), ("other", "<x/>"), ("deep", deep), ("null", None)], "path string, raw string")
    states = {r.path: (r.state, r.reason) for r in R.network_security_states(raw).collect()}
    assert states == {"n": ("parsed", None), "bad": ("malformed-xml", 'Unterminated element "<a>" (missing closing tag)'), "other": ("unsupported-root", "x"), "deep": ("parsed", None), "null": ("malformed-xml", "No root element found")}
    configs = R.network_security_configs(raw)
    own = {(r.kind, r.line): r for r in configs.where("path = 'n'").collect()}
    assert sorted(own) == [("base", 3), ("debug", 13), ("domain", 5), ("domain", 9), ("domain", 10)]
    outer = own["domain", 5]
    assert [(d.name, d.subdomains, d.malformed) for d in outer.domains] == [("a.example", True, False), ("", None, True)]
    assert (outer.pins.expiration, outer.pins.malformed, [(p.value, p.supported, p.malformed) for p in outer.pins.pins]) == ("soon", True, [("ab", True, False), ("", False, True)])
    assert outer.unsupported == ["<odd> at line 8"] and outer.trust is None
    assert [(c.kind, c.resource, c.override_pins) for c in own["domain", 9].trust] == [("raw-resource", "own", True), ("user", None, None)]
    policy = A.effective_network_policy(configs)
    got = {r.scope: ([d.name for d in r.domains], r.domains_inherited, r.cleartext, r.cleartext_source, [[c.source for c in cs] for cs in r.trust], r.trust_source, r.pins is not None) for r in policy.where("path = 'n'").collect()}
    chain = [["@raw/own", "user"], ["system"]]
    assert got == {
        "base-config": ([], False, False, "explicit", [["system"]], "own", False),
        "debug-overrides": ([], False, None, "unspecified", [["user"]], "own", False),
        "domain-config[0]": (["a.example", ""], False, True, "explicit", [["system"]], "inherited", True),
        "domain-config[0]>domain-config[0]": (["a.example", ""], True, False, "inherited-from-base", chain, "own", False),
        "domain-config[0]>domain-config[0]>domain-config[0]": (["b"], False, False, "inherited-from-base", chain, "inherited", False),
    }
    assert sorted((r.scope, r.rule) for r in A.network_findings(policy).collect() if r.path == "n") == [("domain-config[0]", "cleartext-permitted"), ("domain-config[0]>domain-config[0]", "user-certificates-trusted"), ("domain-config[0]>domain-config[0]>domain-config[0]", "user-certificates-trusted")]
    assert policy.where("path = 'deep' AND too_deep").count() == 2 and policy.where("path = 'deep' AND NOT too_deep").count() == 11
    assert A.effective_network_policy(configs.limit(0)).count() == 0


def test_policies_of_odd_parents(spark):
    """Rings, parents that are missing or no domain config, and several texts in one table."""
    schema = "path string, doc long, node long, parent long, kind string, position int, cleartext boolean, domains array<struct<name:string>>, trust array<struct<source:string>>, pins struct<pins:array<string>>, line long, column long"
    a, own = [("a",)], [("own",)]
    rows = [(1, None, "base", 0, True, [], [("base",)]), (2, 3, "domain", 0, None, a, None), (3, 2, "domain", 0, False, [], own), (4, 9, "domain", 1, None, [], None), (5, 1, "domain", 2, None, [], None), (6, None, "domain", 3, None, a, None), (7, 6, "domain", 0, None, [], own)]
    table = spark.createDataFrame([("p", d, *r, None, 1, 1) for d in (1, 2) for r in rows if d == 1 or r[0] > 5], schema)
    got = {(r.doc, r.node): (r.scope, r.depth, [d.name for d in r.domains], r.domains_inherited, r.cleartext, r.cleartext_source, [[t.source for t in ts] for ts in r.trust], r.trust_source, r.too_deep) for r in A.effective_network_policy(table).collect()}
    alone = ([], False, None, "unspecified", [], "unspecified", True)
    assert got == {
        (1, 1): ("base-config", 0, [], False, True, "explicit", [["base"]], "own", False),
        (1, 2): (None, None, ["a"], *alone[1:]),
        (1, 3): (None, None, [], False, False, "explicit", [["own"]], "own", True),
        (1, 4): (None, None, *alone),
        (1, 5): (None, None, *alone),
        (1, 6): ("domain-config[3]", 0, ["a"], False, True, "inherited-from-base", [["base"]], "inherited", False),
        (1, 7): ("domain-config[3]>domain-config[0]", 1, ["a"], True, True, "inherited-from-base", [["own"], ["base"]], "own", False),
        (2, 6): ("domain-config[3]", 0, ["a"], False, None, "unspecified", [], "unspecified", False),
        (2, 7): ("domain-config[3]>domain-config[0]", 1, ["a"], True, None, "unspecified", [["own"]], "own", False),
    }


def test_network_policy_shuffles_keys_alone(spark, sf_dir):
    """Texts and their configs stay in their rows: the keys of customers are the only thing that is shuffled."""
    plan = markup_queries.network_policy(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not any(x in plan for x in ("Join", "Aggregate", "Window", "UnionLoop", "ExistingRDD"))
    assert plan.rindex("network-security-config") < plan.index("Exchange")


def test_manifest_places(spark):
    text = '<manifest xmlns:android="http://schemas.android.com/apk/res/android">\n <uses-permission android:name="p"/>\n <application>\n  <activity android:name=".A" android:exported="true">\n   <intent-filter><action android:name="x"/></intent-filter>\n  </activity>\n  <meta-data android:name="m"/>\n </application>\n</manifest>'
    rows = {r.tag: (r.name, r.exported, r.component, r.line, r.column) for r in R.manifest_places(spark.createDataFrame([("m", text)], "path string, raw string")).collect()}
    assert rows == {"manifest": (None, None, None, 1, 1), "uses-permission": ("p", None, None, 2, 2), "application": (None, None, None, 3, 2), "activity": (".A", "true", None, 4, 3), "intent-filter": (None, None, ".A", 5, 4), "action": ("x", None, ".A", 5, 19), "meta-data": ("m", None, None, 7, 3)}


def test_policies_and_ladders(spark):
    view, browsable = ["android.intent.action.VIEW"], ["android.intent.category.BROWSABLE"]
    link = lambda *d: [dict(zip(("scheme", "host", "path", "pathPrefix", "pathPattern"), d))]
    rows = [("web", True, None, view, browsable, link("https")), ("own", True, None, view, browsable, link("my")), ("wide", True, None, view, browsable, link("https", "h", None, None, ".*")), ("guarded", True, "p", view, browsable, link("https", "h", None, None, "*")), ("held", None, None, view, browsable, link("https", "${h}")), ("fine", True, None, view, browsable, link("https", "h")), ("half", True, None, [], browsable, []), ("none", True, None, view, [], [])]
    links = spark.createDataFrame([("m", "activity", n, e, None, p, a, k, d) for n, e, p, a, k, d in rows], "manifest_path string, kind string, component string, exported boolean, exported_raw string, permission string, actions array<string>, categories array<string>, data array<struct<scheme:string,host:string,path:string,pathPrefix:string,pathPattern:string>>")
    assert {r.component: (r.rule.removeprefix("android-deep-link-"), r.severity) for r in A.deep_link_findings(links).collect()} == {
        "web": ("web-link-without-host", "minor"),
        "own": ("custom-scheme-without-host", "minor"),
        "wide": ("broad-path-pattern", "major"),
        "guarded": ("broad-path-pattern", "minor"),
        "held": ("placeholder-value", "informational"),
        "fine": ("bounded", "informational"),
        "half": ("browsable-without-view", "informational"),
    }
    mods = spark.createDataFrame([("a", ["com.android.application"], ["androidx.compose.ui:ui"], True), ("b", [], [], None)], "module string, plugins array<string>, dependencies array<string>, has_layouts boolean")
    assert [(r.kind, r.ui_toolkit, r.confidence) for r in A.module_kind(mods).orderBy("module").collect()] == [("application", "mixed", "high"), ("unknown", "unknown", "low")]
    checks = spark.createDataFrame([("a", "1", "android-permissions", "required", "failed"), ("a", "2", "x", "optional", "skipped"), ("b", "1", "android-gradle", "required", "failed"), ("c", "1", "android-manifest", "required", "error")], "run_id string, id string, category string, requirement_level string, status string")
    findings = spark.createDataFrame([("d", "f", "major"), ("e", "f", "informational")], "run_id string, id string, severity string")
    runs = spark.createDataFrame([(x, "application", 0, False, 0) for x in "abcdef"], "run_id string, project_kind string, unexpected_changes int, multiple_application_modules boolean, manual_play_items int")
    not_ready, partly = "not-ready-security-blocker-remains", "ready-except-optional-manual-checks"
    assert {r.run_id: r.verdict for r in A.verdict(checks, findings, runs).collect()} == {"a": partly, "b": not_ready, "c": "inconclusive-audit-environment-incomplete", "d": not_ready, "e": partly, "f": "ready-for-release-preparation"}
    assert {(r.run_id, r.code, r.impact) for r in A.verdict_reasons(checks, findings, runs).where("run_id IN ('a', 'd')").collect()} == {("a", "android-optional-check-not-run", "advisory"), ("d", "android-major-finding", "blocking")}
    facts = spark.createDataFrame([("m", 33, None, False, True)], "module string, target_sdk int, version_code int, debuggable boolean, signed boolean")
    assert {r.item: r.state for r in A.play_readiness(facts, 34).collect()} == {"target-sdk": "fail", "version-code": "unknown", "not-debuggable": "pass", "signed": "pass"}
    calls = spark.createDataFrame([("f", 1, "password", True, False, False), ("f", 2, "password", False, False, False), ("f", 3, None, False, True, False), ("f", 4, None, False, False, False)], "path string, line int, sensitivity string, debug_guarded boolean, logs_exception boolean, dynamic boolean")
    assert [(r.kind, r.severity) for r in A.logging_findings(calls).orderBy("line").collect()] == [("finding", "minor"), ("finding", "major"), ("candidate", None)]
