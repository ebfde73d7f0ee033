"""Android manifests and Gradle files as rows, by XML schemas and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.semantics import let
from veritrail.operators import markup

_FILTER = "`intent-filter` ARRAY<STRUCT<action: ARRAY<STRUCT<`_android:name`: STRING>>, category: ARRAY<STRUCT<`_android:name`: STRING>>, data: ARRAY<STRUCT<`_android:scheme`: STRING, `_android:host`: STRING, `_android:path`: STRING, `_android:pathPrefix`: STRING, `_android:pathPattern`: STRING>>, `_android:autoVerify`: BOOLEAN>>"
_COMPONENT = f"ARRAY<STRUCT<`_android:name`: STRING, `_android:exported`: STRING, `_android:permission`: STRING, `_android:readPermission`: STRING, `_android:writePermission`: STRING, {_FILTER}>>"
_KINDS = {"activity": "activity", "activity-alias": "activity-alias", "service": "service", "receiver": "receiver", "provider": "provider"}
_APPLICATION = "STRUCT<`_android:permission`: STRING, `_android:allowBackup`: STRING, `_android:fullBackupContent`: STRING, `_android:dataExtractionRules`: STRING, " + ", ".join(f"`{tag}`: {_COMPONENT}" for tag in _KINDS) + ">"
MANIFEST = f"_package STRING, `uses-permission` ARRAY<STRUCT<`_android:name`: STRING>>, application {_APPLICATION}"


_DATA = ["scheme", "host", "path", "pathPrefix", "pathPattern"]
_DATA_TYPE = f"array<struct<{','.join(n + ':string' for n in _DATA)}>>"
_FILTER_TYPE = f"array<struct<actions:array<string>,categories:array<string>,data:{_DATA_TYPE}>>"


def _tri(text: Column) -> Column:
    """true and false; anything else, such as a resource reference, is unknown."""
    return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)


def manifests(raw: DataFrame) -> DataFrame:
    """One row per manifest (path, raw): permissions, components and backup settings."""
    m = raw.select(F.col("path").alias("manifest_path"), F.from_xml("raw", MANIFEST).alias("m"))
    app = F.col("m.application")

    def components(tag: str, kind: str) -> Column:
        def one(c: Column) -> Column:
            filters = c["intent-filter"]
            named = lambda items, name: F.exists(items, lambda k: k["_android:name"] == name)
            launcher = F.exists(filters, lambda f: named(f["category"], "android.intent.category.LAUNCHER") & named(f["action"], "android.intent.action.MAIN"))
            names = lambda items: F.coalesce(F.transform(items, lambda k: k["_android:name"]), F.array().cast("array<string>"))
            data = lambda f: F.coalesce(F.transform(f["data"], lambda d: F.struct(*[d[f"_android:{n}"].alias(n) for n in _DATA])), F.array().cast(_DATA_TYPE))
            each = F.transform(filters, lambda f: F.struct(names(f["action"]).alias("actions"), names(f["category"]).alias("categories"), data(f).alias("data")))
            exported = _tri(c["_android:exported"])
            return F.struct(
                F.lit(kind).alias("kind"),
                c["_android:name"].alias("name"),
                exported.alias("exported"),
                F.when(exported.isNull(), c["_android:exported"]).alias("exportedRaw"),
                c["_android:permission"].alias("permission"),
                c["_android:readPermission"].alias("readPermission"),
                c["_android:writePermission"].alias("writePermission"),
                F.coalesce(F.size(filters), F.lit(0)).alias("intentFilterCount"),
                F.coalesce(launcher, F.lit(False)).alias("isLauncher"),
                F.coalesce(each, F.array().cast(_FILTER_TYPE)).alias("filters"),
            )

        return F.coalesce(F.transform(app[tag], one), F.array().cast(f"array<struct<kind:string,name:string,exported:boolean,exportedRaw:string,permission:string,readPermission:string,writePermission:string,intentFilterCount:int,isLauncher:boolean,filters:{_FILTER_TYPE}>>"))

    permissions = F.transform(F.col("m")["uses-permission"], lambda p: F.struct(p["_android:name"].alias("name")))
    return m.select(
        "manifest_path",
        F.col("m._package").alias("package_name"),
        app["_android:permission"].alias("application_permission"),
        F.coalesce(permissions, F.array().cast("array<struct<name:string>>")).alias("permissions"),
        F.concat(*[components(tag, kind) for tag, kind in _KINDS.items()]).alias("components"),
        _tri(app["_android:allowBackup"]).alias("allow_backup"),
        F.coalesce(app["_android:dataExtractionRules"], app["_android:fullBackupContent"]).alias("backup_rules"),
    )


def intent_filters(manifests: DataFrame) -> DataFrame:
    """One row per filter of ``manifests``: manifest_path, kind, component, exported, exported_raw, permission, actions, categories, data."""
    rows = manifests.select("manifest_path", F.explode("components").alias("c")).select("manifest_path", "c", F.explode("c.filters").alias("f"))
    return rows.select("manifest_path", F.col("c.kind").alias("kind"), F.col("c.name").alias("component"), F.col("c.exported").alias("exported"), F.col("c.exportedRaw").alias("exported_raw"), F.col("c.permission").alias("permission"), "f.*")


ANDROID = "http://schemas.android.com/apk/res/android"


def manifest_places(raw: DataFrame) -> DataFrame:
    """Where the elements of manifests (path, raw) stand: path, tag, name, exported, component (the name of the component around it), line, column."""
    rows = markup.elements(raw)
    named = rows.select("path", "doc", "node", "parent", "depth", F.col("local_name").alias("tag"), markup.attribute(F.col("attributes"), "name", ANDROID).alias("name"), markup.attribute(F.col("attributes"), "exported", ANDROID).alias("exported"), "line", "column")
    # Elements come in the order of their openers, so the component around one is the last before it, if it lies deeper.
    opened = F.when(F.col("tag").isin(*_KINDS), F.struct("depth", "name"))
    before = Window.partitionBy("doc").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    around = F.last(opened, ignorenulls=True).over(before)
    return named.withColumn("_c", around).select("path", "tag", "name", "exported", F.when(F.col("depth") > F.col("_c.depth"), F.col("_c.name")).alias("component"), "line", "column")


def _flag(attributes: Column, name: str) -> Column:
    """STRUCT(value, raw): only ``true`` and ``false`` are values."""
    return let(markup.plain(markup.attribute(attributes, name)), lambda raw: F.struct(F.when(raw == "true", True).when(raw == "false", False).alias("value"), raw.alias("raw")))


def _domain(e: Column) -> Column:
    text = markup.plain(e["text"])
    lower = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    name = let(lower, lambda x: F.when((F.length(x) > 1) & x.endswith("."), F.left(x, F.length(x) - 1)).otherwise(x))
    return let(name, lambda n: F.struct(text.alias("text"), n.alias("name"), _flag(e["attributes"], "includeSubdomains")["value"].alias("subdomains"), (n == "").alias("malformed"), e["line"].alias("line")))


def _certificate(e: Column) -> Column:
    def of(source: Column) -> Column:
        kind = F.when(source.isin("system", "user"), source).when(source.startswith("@raw/"), "raw-resource").otherwise("unknown")
        return F.struct(source.alias("source"), kind.alias("kind"), F.when(source.startswith("@raw/"), F.substr(source, F.lit(6))).alias("resource"), _flag(e["attributes"], "overridePins")["value"].alias("override_pins"), e["line"].alias("line"))

    return let(markup.plain(markup.attribute(e["attributes"], "src")), of)


def _pin(e: Column) -> Column:
    both = F.struct(markup.plain(markup.attribute(e["attributes"], "digest")).alias("digest"), F.regexp_replace(markup.plain(e["text"]), r"(?U)\s+", "").alias("value"))
    return let(both, lambda b: F.struct(b["digest"].alias("digest"), F.coalesce(b["digest"] == "SHA-256", F.lit(False)).alias("supported"), b["value"].alias("value"), ((b["value"] == "") | b["digest"].isNull()).alias("malformed"), e["line"].alias("line")))


def network_security_documents(raw: DataFrame, dealt: bool = False) -> DataFrame:
    """path, doc and configs of network-security texts (path, raw), a row each; configs as of ``network_security_configs``, by node.

    Trees are read within their rows: nothing but the texts is shuffled, and with
    ``dealt`` not even these.
    """
    named = lambda elements, tag: F.filter(elements, lambda e: e["local_name"] == tag)
    children = lambda e: F.transform(F.slice("by_parent", e["child_at"] + 1, e["children"]), lambda n: F.get("elements", n))
    kinds = lambda e: F.when(e["local_name"] == "base-config", "base").when(e["local_name"] == "domain-config", "domain").when(e["local_name"] == "debug-overrides", "debug")

    # The root of a sound text is its node 0.
    fits = lambda e: (e["local_name"] == "domain-config") | e["local_name"].isin("base-config", "debug-overrides") & (e["parent"] == 0) & (e["nth"] == 0)
    held = F.transform(F.filter("elements", fits), lambda e: F.struct(e.alias("e"), children(e).alias("within")))
    first = F.transform(held, lambda h: F.struct(h["e"].alias("e"), h["within"].alias("within"), F.get(named(h["within"], "trust-anchors"), F.lit(0)).alias("anchors"), F.get(named(h["within"], "pin-set"), F.lit(0)).alias("pin_set")))

    def pins(pin_set: Column) -> Column:
        listed = F.transform(named(children(pin_set), "pin"), _pin)
        return let(markup.plain(markup.attribute(pin_set["attributes"], "expiration")), lambda x: F.struct(x.alias("expiration"), (x.isNotNull() & ~x.rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("malformed"), listed.alias("pins")))

    def config(c: Column) -> Column:
        e, known = c["e"], ("domain", "trust-anchors", "pin-set", "domain-config")
        odd = F.filter(c["within"], lambda x: ~x["local_name"].isin(*known))
        return let(
            _flag(e["attributes"], "cleartextTrafficPermitted"),
            lambda flag: F.struct(
                e["node"].alias("node"),
                F.when(e["parent"] != 0, e["parent"]).alias("parent"),
                kinds(e).alias("kind"),
                e["nth"].alias("position"),
                flag["value"].alias("cleartext"),
                flag["raw"].alias("cleartext_raw"),
                F.transform(named(c["within"], "domain"), _domain).alias("domains"),
                F.when(c["anchors"].isNotNull(), F.transform(named(children(c["anchors"]), "certificates"), _certificate)).alias("trust"),
                F.when(c["pin_set"].isNotNull(), pins(c["pin_set"])).alias("pins"),
                F.transform(odd, lambda x: F.concat(F.lit("<"), x["tag"], F.lit("> at line "), x["line"].cast("string"))).alias("unsupported"),
                e["line"].alias("line"),
                e["column"].alias("column"),
            ),
        )

    rows = markup.trees(raw, dealt).where(F.get("elements", F.lit(0))["local_name"] == "network-security-config")
    return rows.select("path", "doc", F.transform(first, config).alias("configs"))


def network_security_configs(raw: DataFrame) -> DataFrame:
    """Configs of network-security texts (path, raw) with their places.

    path, doc, node, parent (null unless within a domain config), kind (``base``,
    ``domain``, ``debug``), position (among its siblings), cleartext,
    cleartext_raw, domains (text, name, subdomains, malformed, line), trust
    (certificates with source, resource, override_pins; null without anchors),
    pins (expiration, malformed, pins; null without a set), unsupported, line,
    column. Only the first base and debug config of a text count, and domain
    configs in the root or in each other.
    """
    return network_security_documents(raw).select("path", "doc", F.inline("configs"))


def network_security_states(raw: DataFrame) -> DataFrame:
    """path, state (``parsed``, ``malformed-xml``, ``unsupported-root``), reason, line, column of each text."""
    wrong = markup.problems(raw).where("severity = 'error'").select("path", F.lit("malformed-xml").alias("state"), F.col("message").alias("reason"), "line", "column")
    state = F.when(F.col("local_name") == "network-security-config", "parsed").otherwise("unsupported-root")
    return wrong.unionByName(markup.elements(raw).where("depth = 0").select("path", state.alias("state"), F.when(state == "unsupported-root", F.col("tag")).alias("reason"), "line", "column"))


def wrapper_properties(raw: DataFrame) -> DataFrame:
    """Gradle version and checksum of a wrapper file (path, raw)."""
    version = F.nullif(F.regexp_extract("raw", r"distributionUrl\s*=.*gradle-([\d.]+(?:-\w+)*?)-(?:bin|all)\.zip", 1), F.lit(""))
    digest = F.nullif(F.regexp_extract("raw", r"(?m)^distributionSha256Sum\s*=\s*([0-9a-fA-F]{64})\s*$", 1), F.lit(""))
    return raw.select("path", version.alias("gradle_version"), digest.alias("sha256"))


def settings_modules(raw: DataFrame) -> DataFrame:
    """Modules that a settings file (path, raw) includes."""
    calls = F.array_join(F.regexp_extract_all("raw", F.lit(r"(?m)^\s*include\s*\(?([^)\n]+)"), F.lit(1)), ",")
    return raw.select("path", F.explode(F.array_distinct(F.regexp_extract_all(calls, F.lit("[\"'](:[\\w:.-]+)[\"']"), F.lit(1)))).alias("module"))


def build_types(raw: DataFrame) -> DataFrame:
    """Release and debug blocks of a module's build file (module, raw): debuggable, minify, signing config."""
    rows = raw.select("module", F.explode(F.array(F.lit("release"), F.lit("debug"))).alias("build_type"), "raw")
    block = F.expr("regexp_extract(raw, concat('(?s)buildTypes\\\\s*\\\\{.*?\\\\b', build_type, '\\\\b\"?\\\\)?\\\\s*\\\\{([^}]*)\\\\}'), 1)")
    flag = lambda pattern: _tri(F.nullif(F.regexp_extract(block, pattern, 1), F.lit("")))
    return rows.select("module", "build_type", block.alias("block"), flag(r"(?:isDebuggable|debuggable)\s*=?\s*(true|false)").alias("debuggable"), flag(r"(?:isMinifyEnabled|minifyEnabled)\s*=?\s*(true|false)").alias("minify"), F.nullif(F.regexp_extract(block, r"signingConfig\s*=?\s*signingConfigs\.(?:getByName\(\")?(\w+)", 1), F.lit("")).alias("signing_config")).where("block <> ''").drop("block")
