"""Queries of the task-analytics family: orders stand for tasks, market segments for projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import tasks as T
from veritrail.sources.tables import table

AS_OF = "2001-08-05"


def order_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("project_id"))
    return orders.join(segments, "o_custkey").select(
        "project_id",
        F.col("o_orderkey").alias("task_id"),
        (F.col("o_orderstatus") == "F").alias("completed"),
        F.col("o_totalprice").alias("story_points"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("updated_day"),
    )


def project_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = 11539  # AS_OF in days since 1970-01-01
    m = T.project_metrics(order_tasks(spark, sf_dir), day)
    m = m.withColumn("quality_label", T.quality_label(F.col("total_tasks"), F.col("completion_rate"), F.col("stale_tasks")))
    return T.leaderboard(m)


_METRICS = """
SELECT c_mktsegment AS project_id, count(*) AS total_tasks,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS completed_tasks,
  count(*) FILTER (WHERE o_orderstatus <> 'F') AS open_tasks,
  count(*) FILTER (WHERE o_orderstatus <> 'F' AND DATE '2001-08-05' - CAST(o_orderdate AS DATE) >= 10) AS stale_tasks,
  floor(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0::DOUBLE / count(*) * 100 + 0.5) / 100 AS completion_rate,
  floor(avg(o_totalprice) * 100 + 0.5) / 100 AS average_points
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"""

QUERIES = {"project_metrics": project_metrics}

ORACLE_SQL = {
    "project_metrics": f"""
WITH m AS ({_METRICS})
SELECT *, CASE WHEN total_tasks = 0 THEN 'empty' WHEN completion_rate >= 80 AND stale_tasks = 0 THEN 'healthy'
  WHEN completion_rate >= 50 AND stale_tasks <= 1 THEN 'watch' ELSE 'risk' END AS quality_label,
  CAST(row_number() OVER (ORDER BY completion_rate DESC, stale_tasks, project_id) AS INTEGER) AS "rank"
FROM m"""
}
