"""Cleaning a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.cleaning import clean_v2
from themeloom.plans.lineage import scratch_path
from themeloom.plans.unnest import computed_once


def clean_and_filter(docs: DataFrame, key: str, text: str, min_length: int = 50) -> DataFrame:
    """Drop short texts, clean, drop blank results. Holds no state."""
    long_enough = docs.where(F.length(text) > min_length)
    cleaned = computed_once(long_enough, clean_v2(text), "text_clean")
    return cleaned.where(F.trim("text_clean") != "").select(key, "text_clean")


def clean_stream(spark: SparkSession, folder: str, table: str, key: str, text: str) -> DataFrame:
    """Run a table's files through a stream once, to the end, and read the result.

    The table is one file or a folder of files. A stream does not start from a
    file's own path; a pattern that only the table matches stands for either.
    """
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    source = (
        spark.readStream.schema(schema)
        .parquet(f"{folder}/{table}.parque[t]")
        .repartition(spark.sparkContext.defaultParallelism)
    )
    out = scratch_path(spark, "stream")
    cleaned = clean_and_filter(source, key, text)
    running = (
        cleaned.writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start(f"{out}/rows")
    )
    running.awaitTermination()
    return spark.read.schema(cleaned.schema).parquet(f"{out}/rows")
