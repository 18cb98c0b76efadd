"""Tables written once and read by several parts of a query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that the cluster names, in spark.checkpoint.dir or by setCheckpointDir.

    One machine needs none: its temporary folder serves. A cluster without one is told so, as its executors could not read each
    other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark.sparkContext, "_mdloom_store", None) or tempfile.mkdtemp(prefix="mdloom-")
        spark.sparkContext._mdloom_store = root
    return f"{root.rstrip('/')}/mdloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, and read again: readers prune its columns."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
