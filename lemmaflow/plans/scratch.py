"""A folder that driver and executors share, for queries that write and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path not used before, in the cluster's shared folder; only a local session may go without the setting."""
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lemmaflow-")
    return f"{base.rstrip('/')}/lemmaflow/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in that folder, made once for all uses and of a size that Catalyst knows."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
