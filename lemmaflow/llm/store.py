"""Tables and files in the folder that the cluster shares.

``spark.checkpoint.dir`` names it. Only where it is unset, as in tests, a local
folder is made and set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..batches import small_batches

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lemmaflow-")
        spark.sparkContext.setCheckpointDir(found)
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lemmaflow/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and a
    lost executor costs no recomputation of what came before."""
    small_batches(df.sparkSession)
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
