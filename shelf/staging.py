"""Tables that a job writes for itself, where driver and executors both find them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path under the folder that the cluster names in spark.checkpoint.dir; one of our own only where
    it is unset and all run on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints/shelf")
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str | None = None, compression: str | None = None) -> DataFrame:
    """df written and read again: computed once whoever reads it, its lineage cut, no executor needed to keep it."""
    path = path or folder(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
