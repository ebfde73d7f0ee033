"""Task analytics: metrics per project, totals, quality labels and the leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.semantics import all_of, positions, round_half_up

STALE_DAYS = 10


def project_metrics(tasks: DataFrame, current_day: int, key: str = "project_id") -> DataFrame:
    """Per project: total, completed, open, stale (open for ``STALE_DAYS`` or more), completion percentage and average points, to two places.

    tasks: key, completed BOOLEAN, story_points, updated_day INT. One aggregation; null flags count as open.
    """
    done = F.coalesce(F.col("completed"), F.lit(False))
    stale = ~done & (F.lit(current_day) - F.col("updated_day") >= STALE_DAYS)
    grouped = tasks.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(done).alias("completed_tasks"),
        F.count_if(~done).alias("open_tasks"),
        F.count_if(stale).alias("stale_tasks"),
        F.avg("story_points").alias("_points"),
    )
    rate = F.col("completed_tasks") * 100.0 / F.col("total_tasks")
    return grouped.withColumn("completion_rate", round_half_up(rate, 2)).withColumn("average_points", round_half_up(F.col("_points"), 2)).drop("_points")


def quality_label(total: Column, rate: Column, stale: Column) -> Column:
    """empty, healthy (80 % and nothing stale), watch (50 % and at most one stale), else risk."""
    return F.when(total == 0, "empty").when((rate >= 80) & (stale == 0), "healthy").when((rate >= 50) & (stale <= 1), "watch").otherwise("risk")


def leaderboard(metrics: DataFrame, key: str = "project_id") -> DataFrame:
    """Position by completion rate (high first), stale tasks (few first), then id. One row per project meets here, never the tasks."""
    return metrics.withColumn("rank", positions([F.col("completion_rate").desc(), F.col("stale_tasks").asc(), F.col(key).asc()]))


def analytics_snapshot(projects: DataFrame, tasks: DataFrame, current_day: int, key: str = "project_id") -> DataFrame:
    """Metrics for every project, 0 where it has no task; tasks of unknown projects are left out."""
    m = project_metrics(tasks, current_day, key)
    return projects.select(key).distinct().join(m, key, "left").na.fill(0)


def grand_totals(metrics: DataFrame) -> DataFrame:
    names = ["total_tasks", "completed_tasks", "open_tasks", "stale_tasks"]
    return metrics.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def task_summary(projects: DataFrame, tasks: DataFrame, key: str = "project_id") -> DataFrame:
    """total, completed and open per project: every project, and every id that only tasks name."""
    done = F.coalesce(F.col("completed"), F.lit(False))
    rows = tasks.select(key, F.lit(1).alias("_t"), done.cast("int").alias("_c")).unionByName(projects.select(key, F.lit(0).alias("_t"), F.lit(0).alias("_c")))
    return rows.groupBy(key).agg(F.sum("_t").alias("total"), F.sum("_c").alias("completed"), (F.sum("_t") - F.sum("_c")).alias("open"))


def high_priority_open(tasks: DataFrame, key: str = "project_id") -> DataFrame:
    """Open tasks of high priority as rows: key, position in the project's task order (from 1), how many the project has, title.

    A project with very many is counted and numbered by its partition of the sort alone, never held in one row.
    """
    rows = tasks.where(~F.coalesce(F.col("completed"), F.lit(False)) & (F.col("priority") == "high"))
    counted = rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_open")), key)
    return counted.select(key, F.row_number().over(Window.partitionBy(key).orderBy("ord")).alias("position"), "n_open", "title")


def import_tasks(store: DataFrame, batch: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(imported, skipped): rows of ``batch`` whose (project, normalised title) is neither in the store nor earlier in the batch.

    An unknown project is an error. store: project_id, title; batch adds ord.
    """
    unknown = batch.join(projects.select("project_id"), "project_id", "left_anti").select("project_id").first()
    if unknown is not None:
        raise ValueError(f"unknown project id: {unknown[0]}")
    norm = F.regexp_replace(F.lower(F.trim("title")), r"\s+", " ")
    own = batch.withColumn("_title", norm)
    first = own.groupBy("project_id", "_title").agg(F.min("ord").alias("_first"))
    known = store.select("project_id", norm.alias("_title")).distinct().withColumn("_known", F.lit(True))
    marked = own.join(first.join(known, ["project_id", "_title"], "left"), ["project_id", "_title"])
    new = F.col("_known").isNull() & (F.col("ord") == F.col("_first"))
    return marked.where(new).select(*batch.columns), marked.where(~new).select(*batch.columns)


def filter_tasks(tasks: DataFrame, project_id: str | None = None, completed: bool | None = None, priority: str | None = None, tag: str | None = None, query: str | None = None) -> DataFrame:
    """Rows that meet every given condition; the query is looked for in title, notes and tags, whatever its case."""
    conditions = []
    if project_id:
        conditions.append(F.col("project_id") == project_id)
    if completed is not None:
        conditions.append(F.col("completed") == completed)
    if priority:
        conditions.append(F.col("priority") == priority)
    if tag:
        conditions.append(F.array_contains("tags", tag.strip().lower()))
    if query and query.strip():
        hay = F.lower(F.concat_ws(" ", "title", "notes", F.array_join("tags", " ")))
        conditions.append(hay.contains(query.strip().lower()))
    return tasks.where(all_of(conditions))


def normalize_tags(tags: Column) -> Column:
    """Trimmed, lower-cased, without empty and repeated ones, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")))


def parse_rows(rows: DataFrame) -> DataFrame:
    """Text columns to task types; any non-empty text is true, as the row format has it."""
    return rows.select("task_id", "project_id", F.col("story_points").cast("int").alias("story_points"), (F.length("completed") > 0).alias("completed"), F.col("updated_day").cast("int").alias("updated_day"))


# The priorities a task can have, and its range of story points.
PRIORITIES = ["low", "medium", "high"]
LEAST_POINTS, MOST_POINTS = 1, 13


def rejected_rows(tasks: DataFrame) -> DataFrame:
    """task_id and reasons for rows that break a rule: empty title, unknown priority, points that are no whole number of 1 to 13."""
    reasons = F.filter(
        F.array(
            F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "title is empty"),
            F.when(~F.coalesce(F.col("priority").isin(PRIORITIES), F.lit(False)), "priority is unknown"),
            F.when(~F.coalesce((F.col("story_points") % 1 == 0) & F.col("story_points").between(LEAST_POINTS, MOST_POINTS), F.lit(False)), "story points are out of range"),
        ),
        lambda r: r.isNotNull(),
    )
    return tasks.select("task_id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def health_line(m: DataFrame, key: str = "project_id") -> DataFrame:
    """One line of text per project."""
    return m.select(key, F.format_string("%s: %d/%d complete, %d stale", key, "completed_tasks", "total_tasks", "stale_tasks").alias("line"))
