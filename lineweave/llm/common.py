"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from ..storage import written as written

#: Rows per Arrow batch handed to Python; together with Spark's own limit of
#: bytes per batch this bounds a worker's memory whatever the texts' lengths.
BATCH_ROWS = 1000


def session(df: DataFrame) -> SparkSession:
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a private key, and its name: written, so that every later read sees the same keys, also after executors are lost."""
    name = unused(df, "row_key")
    return written(df.withColumn(name, F.monotonically_increasing_id())), name
