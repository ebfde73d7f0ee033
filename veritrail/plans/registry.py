"""Collects the query modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritrail.plans import audit_queries, detector_queries, evidence_queries, experiment_queries, markup_queries, rot_queries, security_queries, task_queries, walk_queries

MODULES = (task_queries, experiment_queries, audit_queries, rot_queries, security_queries, evidence_queries, markup_queries, walk_queries, detector_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
