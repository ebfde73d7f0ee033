"""Operator 1: URL filters by host-suffix and path-prefix expressions.

Every URL is expanded into expressions: each suffix of its host that has as many
labels as some rule's host, times each prefix of its path that has the length of
some rule's path; others fit no rule. Expressions and rules meet in an equi-join on a short prefix of their
SHA-256 digests; the full digest then confirms the match, and the most specific
rule that fits decides.

Precedence: the longest rule string (host plus path) wins; of equally long
ones the one with the longer host; of one expression with two verdicts, block.

Cases: a null URL, or one without ``://``, has an empty host and path and fits
no rule, nor does any URL fit a rule with an empty or null host; a null rule
path counts as empty; repeated rows are judged each and all returned; a null
key is kept; columns other than the key and the URL are left out. Without
rules every URL gets the default verdict with a null rule.

Scale: rules are broadcast only when a bounded count says that they are few, and
are otherwise shuffled, where Spark splits the URLs of a hot rule over tasks; the
rule table is written before, so that nothing binds it to its partitioning. A
URL makes no more expressions than rules have pairs of sizes, however long it is. All expressions of a URL are reduced to
one row without a second shuffle of the URLs. The one
shuffle is keyed by the row and the partition it came from, so no host, URL or
group of repeated rows is hot; copies of a row are counted before it and
restored at the end, and the final grouping reuses its partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.lineage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Every host suffix of one of ``labels`` labels with every path prefix of one of ``lengths``; none for an empty host."""
    among = lambda sizes, most: F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= most)
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    suffix = lambda n: F.call_function("substring_index", host, F.lit("."), -n)
    suffixes = F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(among(labels, dots + 1), suffix))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(among(lengths, F.length(path)), lambda n: F.concat(h, F.lit("\n"), F.substring(path, F.lit(1), n)))))


def _digest(expression: Column) -> Column:
    return F.sha2(F.encode(expression, "UTF-8"), 256)


def _rule_table(rules: DataFrame) -> DataFrame:
    """One row per expression: r_digest, r_short, r_rule, r_verdict, r_rank."""
    host = F.translate(F.col("host").cast("string"), UPPER, LOWER)
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    kept = rules.select(host.alias("_h"), path.alias("_p"), F.col("verdict").cast("string").alias("_v")).where("_h <> ''")
    one = kept.groupBy("_h", "_p").agg(F.max(F.struct((F.col("_v") == "block").alias("b"), F.col("_v").alias("v"))).alias("_m"))
    digest = _digest(F.concat("_h", F.lit("\n"), "_p"))
    return one.select(
        digest.alias("r_digest"),
        F.substring(digest, 1, PREFIX_HEX).alias("r_short"),
        F.concat("_h", "_p").alias("r_rule"),
        F.col("_m.v").alias("r_verdict"),
        F.struct((F.length("_h") + F.length("_p")).alias("size"), F.length("_h").alias("host"), F.concat("_h", F.lit("\n"), "_p").alias("text")).alias("r_rank"),
    )


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Returns key, host, path, rule, verdict and n_fitting (rules that fit) for each row of ``pages``.

    ``rules``: host, path, verdict. ``default`` is the verdict where no rule fits.
    """
    table = _rule_table(rules)
    # Distinct sizes are bounded by the longest rule, however many rules there are.
    sizes = rules.where("host <> ''").select(F.size(F.split(F.col("host").cast("string"), r"\.")).alias("h"), F.length(F.coalesce(F.col("path").cast("string"), F.lit(""))).alias("p"))
    bounds = sizes.agg(F.collect_set("h").alias("h"), F.collect_set("p").alias("p")).first()
    rows = pages.select(F.col(key).alias("_key"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"), F.spark_partition_id().alias("_part"))
    row_key = ["_key", "_host", "_path", "_part"]
    rows = rows.groupBy(*row_key).agg(F.count(F.lit(1)).alias("_copies"))
    made = rows.select("*", F.explode_outer(expressions(F.col("_host"), F.col("_path"), sorted(bounds["h"]), sorted(bounds["p"]))).alias("_expr"))
    made = made.withColumn("_digest", _digest(F.col("_expr"))).withColumn("_short", F.substring("_digest", 1, PREFIX_HEX)).drop("_expr")
    if table.limit(broadcast_rules + 1).count() <= broadcast_rules:
        found = made.join(F.broadcast(table), F.col("_short") == F.col("r_short"), "left")
    else:
        found = made.join(cut(table), F.col("_short") == F.col("r_short"), "left")
    confirmed = F.col("_digest") == F.col("r_digest")
    best = found.groupBy(*row_key, "_copies").agg(F.max(F.when(confirmed, F.struct("r_rank", "r_rule", "r_verdict"))).alias("_best"), F.count_if(confirmed).alias("n_fitting"))
    judged = best.select(
        F.col("_key").alias(key),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.r_rule").alias("rule"),
        F.coalesce(F.col("_best.r_verdict"), F.lit(default)).alias("verdict"),
        "n_fitting",
        F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"),
    )
    return judged.drop("_copy")


def duckdb_sql(rules: list[tuple[str, str, str]], default: str = "allow") -> str:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH r(h, p, v) AS (VALUES {rows}),
u0 AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, row_number() OVER () AS n, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u0),
m AS (SELECT n, h || p AS rule, v, count(*) OVER (PARTITION BY n) AS k, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC, h || p DESC) AS i
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, '{default}') AS verdict, CAST(coalesce(k, 0) AS BIGINT) AS n_fitting
FROM u LEFT JOIN (SELECT * FROM m WHERE i = 1) AS b ON u.n = b.n"""
