"""Connected components of a link table by alternating large and small stars.

Every step keeps the links' components and pulls nodes toward the smallest node
of their neighbourhood; the number of steps grows with the logarithm of the
longest path. Nothing is collected: a step is two groupings with map-side
minimum and two joins, and is cut off from its past by a checkpoint. A hub's
links meet its minimum in several tasks (``spread_join``), not in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.lineage import cut

MOST_STEPS = 64
#: A keyed table of at most so many rows is broadcast.
BROADCAST_KEYS = 500_000
#: A key of more rows is dealt over several tasks; at most HOT_KEYS of them are told apart.
HOT_ROWS, HOT_KEYS = 100_000, 10_000


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, broadcast_keys: int = BROADCAST_KEYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, one written row per key with ``_n``, its number of rows.

    Few keys are broadcast, behind a count; beyond that both sides are shuffled
    and a key of over ``hot_rows`` rows is dealt over as many copies of its row.
    """
    if keyed.limit(broadcast_keys + 1).count() <= broadcast_keys:
        return rows.join(F.broadcast(keyed), key)
    # Fewer than HOT_KEYS keys can hold as many rows each, so their list is bounded.
    hot_rows = max(hot_rows, keyed.agg(F.sum("_n")).first()[0] // HOT_KEYS + 1)
    salts = F.ceil(F.col("_n") / hot_rows).cast("int")
    hot = F.broadcast(keyed.where(F.col("_n") > hot_rows).select(key, salts.alias("_salts")))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_salts", F.lit(1))).cast("int"))
    return dealt.join(keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))), [key, "_salt"]).drop("_salt", "_salts")


def _large_star(links: DataFrame, broadcast_keys: int, hot_rows: int) -> DataFrame:
    """Connects the larger neighbours of each node with the smallest of its neighbourhood."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("_n")))
    return spread_join(both.where("b > a"), least, "a", broadcast_keys, hot_rows).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame, broadcast_keys: int, hot_rows: int) -> DataFrame:
    """Connects each node and its smaller neighbours with the smallest of them; links point downward here (a > b)."""
    least = cut(links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")))
    moved = spread_join(links, least, "a", broadcast_keys, hot_rows).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def roots(links: DataFrame, broadcast_keys: int = BROADCAST_KEYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """links: a LONG, b LONG. Returns node, root for every node with a link to another; root is the smallest node of the component.

    Loops and repeated links are allowed; rows with a null end are left out.
    """
    ends = F.greatest("a", "b"), F.least("a", "b")
    now = cut(links.where("a <> b").select(ends[0].alias("a"), ends[1].alias("b")).distinct())
    mark = None
    for _ in range(MOST_STEPS):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
        above = cut(_large_star(now, broadcast_keys, hot_rows))
        now = cut(_small_star(above, broadcast_keys, hot_rows))
    raise RuntimeError(f"components did not settle in {MOST_STEPS} steps")
