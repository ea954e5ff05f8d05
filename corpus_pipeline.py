"""A pipeline over documents: each stage takes what its predecessor kept, and all but the last return the columns of documents.

Rows are rows, whatever their doc_id: where a stage has to know them again it gives them a private key and drops it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import bpe, jaccard, mixing, quality, secrets
from lineweave.llm.common import keyed
from lineweave.storage import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go.

    A null or empty text has no words and is rejected; each row is judged by itself, so repeated rows and null or repeated
    ids change nothing; further columns are kept, whatever their names; an empty table stays empty.
    """
    return quality.apply_policy(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, one row stays: that with the least id, nulls last, ties by the order of rows.

    Two rows of one text are linked, whatever their ids; a row whose text is null or empty is linked with nothing and
    stays; further columns are kept; an empty table stays empty.
    """
    rows, key = keyed(docs)
    comps = jaccard.components(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("member"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "member")
    ids = rows.select(F.col(key).alias("member"), "doc_id")
    heads = comps.join(ids, "member").groupBy("component_id").agg(F.min(order).getField("member").alias("head"))
    return rows.join(heads, F.col(key) == F.col("head"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kinds.

    A null text stays null; one row out for each row in, with all its columns; an empty table stays empty.
    """
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is one source; a null text has size 0 and is taken like the others of its source, or not at all if the
    source has no words; rows that share an id are taken each by itself; further columns are kept; an empty table stays empty.
    """
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each copy.

    A null text has no ids; one row out for each row in; an empty table stays empty.
    """
    return bpe.encode(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("source_mix", source_mix), ("encoded", encoded)]

#: A stage by systematic sampling on a hash, and token ids, have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
