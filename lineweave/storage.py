"""Results kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_top() -> str:
    """Of a session without a cluster: a folder of this process, removed at its end."""
    top = tempfile.mkdtemp(prefix="lineweave-")
    atexit.register(shutil.rmtree, top, ignore_errors=True)
    return top


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _local_top()
    return f"{top.rstrip('/')}/lineweave-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts lineage, survives a lost executor."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
