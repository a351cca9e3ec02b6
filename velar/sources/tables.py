"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared folder named by spark.checkpoint.dir.

    Only where that setting is absent, and the session runs inside one machine, is a folder of our own set.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="velar-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/velar-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read again from there.

    Cuts the lineage: a lost executor costs a re-read and not a recomputation, and a plan stays as small as its parts.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
