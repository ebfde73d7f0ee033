"""Sinks: result tables as Parquet or JSON, and small reports as single documents.

Tables are written by Spark. A report is a roll-up whose rows the caller bounds
(``most``); only these come to the driver, through Spark's own writer again.
"""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_document(df: DataFrame, path: str, title: str, most: int = 1_000) -> None:
    """One JSON document: title, total, displayed, omitted and the first rows in the table's order."""
    schema = f"array<struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in df.schema)}>>"
    total = df.count()
    rows = df.limit(most).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("rows"))
    shown = F.from_json("rows", schema)
    body = rows.select(F.lit(title).alias("title"), F.lit(total).alias("total"), F.size(shown).alias("displayed"), (F.lit(total) - F.size(shown)).alias("omitted"), shown.alias("rows"))
    body.coalesce(1).write.mode("overwrite").json(path)


def html_table(df: DataFrame, title: str, most: int = 1_000) -> str:
    """The first rows as an escaped HTML table with a line about what was left out."""
    total, rows = df.count(), df.limit(most).collect()
    safe = lambda v: html.escape("" if v is None else str(v))
    head = "".join(f"<th>{safe(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{safe(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<h1>{safe(title)}</h1><table><tr>{head}</tr>{body}</table><p>{len(rows)} of {total} rows</p>"


def padded_domain(df: DataFrame, column: str) -> DataFrame:
    """Axis limits of a chart: a tenth of the range on both sides, or one unit where all values are equal."""
    span = F.max(column) - F.min(column)
    pad = F.when(span == 0, F.lit(1.0)).otherwise(span * 0.1)
    return df.agg((F.min(column) - pad).alias("low"), (F.max(column) + pad).alias("high"))
