"""The Parquet tables and the roles they play."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT = "consumer_complaint_narrative"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def complaints(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` in the shape of the complaint table.

    Language stands for the product and source for the issue; dates run through
    one year by document number.
    """
    return read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("sample_id"),
        F.col("text").alias(TEXT),
        F.col("lang").alias("product"),
        F.lit(None).cast("string").alias("sub_product"),
        F.col("source").alias("issue"),
        F.lit(None).cast("string").alias("sub_issue"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias(
            "date_received"
        ),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select("vec_id", "embedding")


def given_topics(spark: SparkSession, folder: str) -> DataFrame:
    """An assignment that does not depend on a clusterer: the label, every seventh row noise."""
    return read_table(spark, folder, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, F.lit(-1)).otherwise(F.col("label")).alias("topic")
    )


def topic_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select(
        "vec_id",
        "embedding",
        F.when(F.col("vec_id") % 7 == 0, F.lit(-1)).otherwise(F.col("label")).alias("topic"),
    )


def topic_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All complaints, each with the given topic of one vector: by number, round and round."""
    return with_vector(complaints(spark, folder), spark, folder).join(
        given_topics(spark, folder), "vec_id"
    ).drop("vec_id")


def with_vector(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """``rows`` (sample_id) with the number of a vector; vectors are numbered from 0."""
    n = read_table(spark, folder, "embeddings").count()
    return rows.withColumn("vec_id", F.pmod("sample_id", F.lit(n)))
