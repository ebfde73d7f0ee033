"""Queries of elements, dependency trees and network-security policies; texts are made of the test tables.

The SQL twins compute places, parents and what is inherited from the tables by
arithmetic; they parse no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.stored import spread
from veritrail.operators import android, markup
from veritrail.sources import android as readers
from veritrail.sources import scanners
from veritrail.sources.tables import table


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def order_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested elements, a line each: their numbers, parents and places."""
    line = F.struct("l_linenumber", _text(F.col("l_returnflag"), F.col("l_partkey"), "<").alias("o"), _text('\n\t<line n="', F.col("l_linenumber"), '" mode=\'', F.col("l_returnflag"), "'><part>", F.col("l_partkey"), "</part></line>").alias("x"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(line))["x"], "").alias("lines"))
    # Merged, as lines are larger as texts than Spark expects when it broadcasts them; orders are dealt out so as well.
    orders = table(spark, sf_dir, "orders").hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    raw = orders.select(F.col("o_orderkey").alias("path"), _text('<?xml version="1.0"?><order key="', F.col("o_orderkey"), '">', F.coalesce("lines", F.lit("")), "\n</order>").alias("raw"))
    found = markup.elements(raw, dealt=True).where("depth > 0")
    return found.select("path", "node", "parent", "depth", "tag", "line", "column", F.array_join(F.transform("attributes", lambda a: F.concat(a["name"], F.lit("="), a["value"])), ",").alias("attributes"), "text")


def document_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents in comments, sections and attributes: places behind them, and their content."""
    inner = F.replace("text", F.lit("--"), F.lit("- -"))
    value = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL AND NOT contains(text, ']]>')")
    raw = rows.select(F.col("doc_id").alias("path"), _text("<doc><!--", inner, " --><t><![CDATA[", F.col("text"), ']]></t><e a="', value, '" b=""/></doc>').alias("raw"))
    found = markup.elements(raw).where("depth = 1")
    return found.select("path", "tag", "line", "column", F.md5("text").alias("text"), F.md5(F.coalesce(F.get("attributes", F.lit(0))["value"], F.lit(""))).alias("value"), F.get("attributes", F.lit(1))["line"].alias("b_line"), F.get("attributes", F.lit(1))["column"].alias("b_column"))


def npm_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dependency tree of 1 to 25 levels for each part: nodes followed, with a mark where the tree goes on."""
    k = F.col("p_partkey")
    flag = lambda of, i, name: F.when((k + i) % of == 0, f',"{name}":true').when((k + i) % of == 1, f',"{name}":"yes"').otherwise("")
    head = F.transform(F.sequence(F.lit(0), k % 25), lambda i: F.concat(F.lit('{"name":"n'), i.cast("string"), F.lit('"'), flag(4, i, "missing"), flag(6, i, "invalid"), F.lit(',"dependencies":{"side":{"invalid":true},"p":')))
    raw = table(spark, sf_dir, "part").select(k.cast("string").alias("source"), F.concat(F.array_join(head, ""), F.lit("{}"), F.repeat(F.lit("}}"), (k % 25 + 1).cast("int"))).alias("raw"))
    return scanners.npm_tree(raw).select("source", F.array_join("path", ">").alias("path"), "depth", "name", "missing", "invalid", "deeper")


def network_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network-security text for each customer, with up to 13 levels of domain configs: what holds at each."""
    k = F.col("c_custkey")

    def level(j: Column) -> Column:
        clear = F.when((k + j) % 3 == 0, ' cleartextTrafficPermitted="true"').when((k + j) % 3 == 1, ' cleartextTrafficPermitted="false"').otherwise("")
        domain = F.when((k + j) % 2 == 0, _text('<domain includeSubdomains="true"> D', k, "-", j, ".Example.com. </domain>")).otherwise("")
        source = F.when(j % 3 == 0, "system").when(j % 3 == 1, "user").otherwise(_text("@raw/ca", j))
        trust = F.when((k + j * j) % 4 == 1, _text('<trust-anchors><certificates src="', source, '"/></trust-anchors>')).otherwise("")
        pins = F.when(j % 5 == 0, '<pin-set expiration="2030-01-01"><pin digest="SHA-256">AA=</pin><pin>BB=</pin></pin-set>').otherwise("")
        return _text("\n<domain-config", clear, ">", domain, trust, pins)

    levels = F.transform(F.sequence(F.lit(0), k % 13), level)
    clear = F.when(k % 4 == 0, ' cleartextTrafficPermitted="true"').when(k % 4 == 1, ' cleartextTrafficPermitted="false"').otherwise("")
    base = F.when(k % 4 == 3, "<!-- <base-config/> -->").otherwise(_text("<base-config", clear, ">", F.when(k % 5 == 0, '<trust-anchors><certificates src="system"/></trust-anchors>').otherwise(""), "</base-config>"))
    customers = spread(table(spark, sf_dir, "customer"), "c_custkey")  # before their texts are made, which are far larger
    raw = customers.select(k.alias("path"), _text("<network-security-config>\n", base, F.array_join(levels, ""), F.repeat(F.lit("</domain-config>"), (k % 13 + 1).cast("int")), "\n</network-security-config>").alias("raw"))
    found = android.network_policies(readers.network_security_documents(raw, dealt=True))
    names = F.array_join(F.transform("domains", lambda d: d["name"]), ",")
    sources = F.array_join(F.transform(F.flatten("trust"), lambda c: c["source"]), ",")
    return found.select("path", "scope", "depth", names.alias("domains"), "domains_inherited", "cleartext", "cleartext_source", sources.alias("trust"), "trust_source", F.coalesce(F.size("pins.pins"), F.lit(0)).alias("n_pins"), "too_deep", "line")


QUERIES = {f.__name__: f for f in (order_elements, document_elements, npm_tree, network_policy)}

ORACLE_SQL = {
    "order_elements": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag || CAST(l_partkey AS VARCHAR) || '<') AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey AS path, 2 * i - 1 AS node, 0 AS parent, 1 AS depth, 'line' AS tag, i + 1 AS line, 2 AS "column", 'n=' || l_linenumber || ',mode=' || l_returnflag AS attributes, '' AS "text" FROM l
UNION ALL SELECT l_orderkey, 2 * i, 2 * i - 1, 2, 'part', i + 1, 2 + length('<line n="' || l_linenumber || '" mode=''' || l_returnflag || '''>'), '', CAST(l_partkey AS VARCHAR) FROM l""",
    "document_elements": """WITH d AS (SELECT doc_id AS path, "text" AS t, replace("text", '--', '- -') AS c, replace(replace(replace("text", '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS v FROM documents WHERE "text" IS NOT NULL AND NOT contains("text", ']]>')),
p AS (SELECT path, t, v, '<doc><!--' || c || ' -->' AS before_t, before_t || '<t><![CDATA[' || t || ']]></t>' AS before_e, before_e || '<e a="' || v || '" ' AS before_b FROM d),
u AS (SELECT path, 't' AS tag, before_t AS b, t AS "text", '' AS value, NULL AS bb FROM p UNION ALL SELECT path, 'e', before_e, '', t, before_b FROM p),
s AS (SELECT *, length(b) - length(replace(b, chr(10), '')) + 1 AS line, string_split(b, chr(10))[-1] AS tail, length(bb) - length(replace(bb, chr(10), '')) + 1 AS b_line, string_split(bb, chr(10))[-1] AS b_tail FROM u)
SELECT path, tag, line, length(tail) + length(regexp_replace(tail, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) + 1 AS "column", md5("text") AS "text", md5(value) AS value, b_line, length(b_tail) + length(regexp_replace(b_tail, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) + 1 AS b_column FROM s""",
    "npm_tree": """WITH n AS (SELECT p_partkey AS k, unnest(range(0, p_partkey % 25 + 2)) AS i FROM part),
m AS (SELECT k, i, i > k % 25 AS last FROM n WHERE i <= 20)
SELECT CAST(k AS VARCHAR) AS source, rtrim(repeat('p>', i::INTEGER), '>') AS path, CAST(i AS INTEGER) AS depth, CASE WHEN last THEN 'unknown' ELSE 'n' || i END AS name, NOT last AND (k + i) % 4 = 0 AS missing, NOT last AND (k + i) % 6 = 0 AS invalid, i = 20 AND NOT last AS deeper FROM m
UNION ALL SELECT CAST(k AS VARCHAR), repeat('p>', i::INTEGER) || 'side', CAST(i + 1 AS INTEGER), 'unknown', false, true, false FROM m WHERE NOT last AND i < 20""",
    "network_policy": """WITH RECURSIVE c AS (SELECT c_custkey AS k, c_custkey % 13 AS d, c_custkey % 4 <> 3 AS has_base, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS base_clear, c_custkey % 4 <> 3 AND c_custkey % 5 = 0 AS base_trust FROM customer),
l AS (SELECT c.*, j, CASE (k + j) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS clear, CASE WHEN (k + j) % 2 = 0 THEN 'd' || k || '-' || j || '.example.com' ELSE '' END AS dom,
  CASE WHEN (k + j * j) % 4 = 1 THEN CASE j % 3 WHEN 0 THEN 'system' WHEN 1 THEN 'user' ELSE '@raw/ca' || j END END AS own_trust FROM c, LATERAL (SELECT unnest(range(0, d + 1)) AS j)),
t AS (SELECT k, j, 'domain-config[0]' AS scope, dom, false AS inherited, concat_ws(',', own_trust, CASE WHEN base_trust THEN 'system' END) AS chain FROM l WHERE j = 0
  UNION ALL SELECT l.k, l.j, scope || '>domain-config[0]', CASE WHEN l.dom <> '' THEN l.dom ELSE t.dom END, l.dom = '' AND t.dom <> '', concat_ws(',', own_trust, nullif(chain, '')) FROM t JOIN l ON l.k = t.k AND l.j = t.j + 1 WHERE l.j <= 10)
SELECT l.k AS path, scope, CAST(t.j AS INTEGER) AS depth, CASE WHEN t.k IS NULL THEN l.dom ELSE t.dom END AS domains, coalesce(inherited, false) AS domains_inherited,
  CASE WHEN t.k IS NULL THEN clear ELSE coalesce(clear, base_clear) END AS cleartext, CASE WHEN clear IS NOT NULL THEN 'explicit' WHEN t.k IS NOT NULL AND base_clear IS NOT NULL THEN 'inherited-from-base' ELSE 'unspecified' END AS cleartext_source,
  CASE WHEN t.k IS NULL THEN coalesce(own_trust, '') ELSE chain END AS trust, CASE WHEN own_trust IS NOT NULL THEN 'own' WHEN chain <> '' THEN 'inherited' ELSE 'unspecified' END AS trust_source,
  CASE WHEN l.j % 5 = 0 THEN 2 ELSE 0 END AS n_pins, t.k IS NULL AS too_deep, l.j + 3 AS line FROM l LEFT JOIN t ON t.k = l.k AND t.j = l.j
UNION ALL SELECT k, 'base-config', 0, '', false, base_clear, CASE WHEN base_clear IS NULL THEN 'unspecified' ELSE 'explicit' END, CASE WHEN base_trust THEN 'system' ELSE '' END, CASE WHEN base_trust THEN 'own' ELSE 'unspecified' END, 0, false, 2 FROM c WHERE has_base""",
}
