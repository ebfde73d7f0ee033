"""Cuts lineage through the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else what the context has; on a local master alone, as in tests, else a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
        named = context.getCheckpointDir()
    return named


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints ``df`` in the shared folder and returns what was written."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
