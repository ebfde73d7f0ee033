"""Tables that are read more than once, written where all executors find them, and rows that are too much work to stay in few tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """``df`` as written to the folder that ``spark.checkpoint.dir`` names; a local master without one, as in tests, gets a temporary folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` by a hash of ``columns``, in as many tasks as shuffles have.

    Rows of a small file lie in one task, however long each of them is worked on;
    the number is given, as adaptive plans would put small rows together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def once(column: Column) -> Column:
    """``column``, evaluated once for each row: its always true condition keeps Spark from repeating it in filters that it infers, and from moving these before ``spread``."""
    return F.when(F.monotonically_increasing_id() >= 0, column)
