"""Quoted, multi-line CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from themeloom.functions.names import snake_case_columns

# The columns of the complaint table known by name, all strings.
COMPLAINT_COLUMNS = (
    "date_received",
    "product",
    "sub_product",
    "issue",
    "sub_issue",
    "consumer_complaint_narrative",
)
# Columns that no later step uses.
UNUSED_COLUMNS = (
    "zip_code",
    "consumer_consent_provided",
    "tags",
    "consumer_disputed",
    "submitted_via",
    "date_sent_to_company",
    "timely_response",
    "state",
    "company_response_to_consumer",
    "company_public_response",
    "company",
)
DATE_FORMAT = "yyyy-MM-dd"
# End of fixed values.

_QUOTING = {"quote": '"', "escape": '"'}


def string_schema(names: tuple[str, ...] | list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read quoted CSV whose fields may span lines, every column a string.

    Multi-line CSV cannot be split: each file is one task. For few huge files
    use :func:`read_csv_by_line`.
    """
    reader = spark.read.options(header=True, multiLine=True, inferSchema=False, **_QUOTING)
    if schema is not None:
        reader = reader.schema(schema)
    return snake_case_columns(reader.csv(path))


def read_csv_by_line(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same rows as :func:`read_csv`, with huge files split over many tasks.

    Lines are read in parallel. A line starts a record when the number of
    quotes before it in its file is even, so the quotes per file block are
    counted first; their running totals tell every block whether it begins
    inside a quoted field. Lines of one record are then joined and parsed. Only
    one running total is computed per file, over blocks, not over lines.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
        )
    )
    per_block = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block_start = per_block.select(
        F.col("file"),
        F.col("block"),
        F.coalesce(F.sum("quotes").over(before), F.lit(0)).alias("quotes_before"),
    )
    within = Window.partitionBy("file", "block").orderBy("line")
    placed = lines.join(block_start, ["file", "block"]).withColumn(
        "open",
        F.col("quotes_before")
        + F.coalesce(F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    # A record is named by the block and line it starts in. Lines that continue a
    # record from an earlier block take the last start before their own block.
    starts = F.when(F.col("open") % 2 == 0, F.struct("block", "line"))
    # The header is the record of the first line of a file's first block.
    is_header = (F.col("block") == 0) & (F.row_number().over(within) == 1)
    local = placed.withColumn("start", F.last(starts, ignorenulls=True).over(within)).withColumn(
        "header", is_header
    )
    last_start = local.groupBy("file", "block").agg(F.max("start").alias("last_start"))
    carried = last_start.select(
        "file",
        "block",
        F.last("last_start", ignorenulls=True).over(before).alias("carried"),
    )
    body = (
        local.join(carried, ["file", "block"])
        .withColumn("start", F.coalesce("start", "carried"))
        .groupBy("file", "start")
        .agg(
            F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("lines"),
            F.bool_or("header").alias("header"),
        )
        .where(~F.col("header"))
    )
    text = F.concat_ws("\n", F.transform("lines", lambda l: l["value"]))
    parsed = body.select(
        F.from_csv(
            F.regexp_replace(text, "\r$", ""),
            F.lit(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)),
            {**_QUOTING, "multiLine": "true", "maxCharsPerColumn": "-1"},
        ).alias("r")
    ).select("r.*")
    return snake_case_columns(parsed)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write UTF-8 CSV that :func:`read_csv` gives back unchanged.

    White space around values is kept; the writer would trim it by default.
    """
    df.write.mode(mode).options(
        header=True,
        encoding="UTF-8",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        **_QUOTING,
    ).csv(path)


def write_by_topic(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write Parquet partitioned by topic.

    The rebalance hint lets adaptive execution split large topics over tasks
    and put small ones together, so there are few files and no hot writer.
    """
    df.hint("rebalance", "topic").write.mode(mode).partitionBy("topic").parquet(path)
