"""Counts, audits and health checks, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import vectors as V

NOISE = -1


def filter_audit(df: DataFrame, text: str, min_length: int = 50) -> DataFrame:
    """Rows before and after the text filters, from a single scan."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count(text).alias("rows_with_text"),
        F.count_if(F.length(text) > min_length).alias("rows_long_enough"),
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per combination of values, NULL included."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("pop"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct values, NULL counting as one."""
    return df.select(column).distinct().agg(F.count(F.lit(1)).alias("n_distinct"))


def largest_value(counts: DataFrame, column: str) -> DataFrame:
    """The most frequent value; the greater value wins a tie."""
    return counts.agg(F.max(F.struct("pop", column)).alias("top")).select(
        F.col(f"top.{column}").alias(column), F.col("top.pop").alias("pop")
    )


def topic_sizes(assignments: DataFrame, topic: str = "topic") -> DataFrame:
    """Documents per topic, noise left out."""
    return (
        assignments.where(F.col(topic) != NOISE)
        .groupBy(F.col(topic).alias("topic"))
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )


def topic_size_stats(assignments: DataFrame, small: int = 100, large: int = 1000) -> DataFrame:
    return topic_sizes(assignments).agg(
        F.min("n_docs").alias("min_size"),
        F.max("n_docs").alias("max_size"),
        F.avg("n_docs").alias("mean_size"),
        F.percentile("n_docs", 0.5).alias("median_size"),
        F.count_if(F.col("n_docs") < small).alias("n_small"),
        F.count_if(F.col("n_docs") > large).alias("n_large"),
    )


def topic_summary(assignments: DataFrame) -> DataFrame:
    """Topics without noise, share of noise, documents."""
    per_topic = assignments.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return per_topic.agg(
        F.count_if(F.col("topic") != NOISE).alias("n_topics"),
        (
            F.sum(F.when(F.col("topic") == NOISE, F.col("n")).otherwise(F.lit(0)))
            / F.sum("n").cast("double")
        ).alias("noise_ratio"),
        F.sum("n").alias("n_docs"),
    )


def topic_assignment_profile(assignments: DataFrame, key: str, first: int = 5) -> DataFrame:
    """Whether an assignment is usable: length, first values, distinct topics, NULLs."""
    head = (
        assignments.orderBy(key)
        .limit(first)
        .agg(F.array_sort(F.collect_list(F.struct(key, "topic"))).alias("h"))
        .select(F.concat_ws(",", F.transform("h", lambda e: e["topic"].cast("string"))).alias("v"))
    )
    per_topic = assignments.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return per_topic.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col("topic").isNotNull() & (F.col("topic") != NOISE)).alias("n_topics"),
        F.coalesce(F.bool_or(F.col("topic") == NOISE), F.lit(False)).alias("has_noise"),
        F.coalesce(F.sum(F.when(F.col("topic").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
    ).select(
        "*",
        ((F.col("n_rows") > 0) & (F.col("n_null") == 0)).alias("is_valid"),
        head.scalar().alias("first_topics"),
    )


def embedding_health(df: DataFrame, vector: str) -> DataFrame:
    """Shape, NaN, infinity and range of an embedding table, and whether all are equal.

    "All equal" is decided by comparing every vector with the smallest and the
    greatest one, which two running values per task suffice for.
    """
    v = F.col(vector)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size(v)).alias("min_dim"),
        F.max(F.size(v)).alias("max_dim"),
        F.coalesce(F.bool_or(F.exists(v, F.isnan)), F.lit(False)).alias("any_nan"),
        F.coalesce(F.bool_or(F.exists(v, _is_infinite)), F.lit(False)).alias("any_inf"),
        F.min(F.array_min(v)).cast("double").alias("min_value"),
        F.max(F.array_max(v)).cast("double").alias("max_value"),
        (F.min(v) == F.max(v)).alias("all_identical"),
    )


def _is_infinite(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))


def embedding_variance(df: DataFrame, vector: str) -> DataFrame:
    """Population variance and range of every dimension."""
    return (
        df.select(F.posexplode(V.doubles(vector)).alias("dim", "x"))
        .groupBy("dim")
        .agg(
            F.var_pop("x").alias("variance"),
            F.min("x").alias("min_value"),
            F.max("x").alias("max_value"),
        )
        .withColumn("is_constant", F.col("variance") < 1e-10)
    )


def embedding_norms(
    df: DataFrame, vector: str, rtol: float = 1e-5, atol: float = 1e-8
) -> DataFrame:
    """Range of the L2 norms, and whether all are 1 within the usual tolerances."""
    return df.select(V.norm(V.doubles(vector)).alias("norm")).agg(
        F.min("norm").alias("min_norm"),
        F.max("norm").alias("max_norm"),
        F.bool_and(F.abs(F.col("norm") - 1.0) <= F.lit(atol + rtol)).alias("all_unit"),
    )


def length_distribution(df: DataFrame, text: str) -> DataFrame:
    """Words per text: mean, quartiles and range, as a box plot needs them.

    Exact percentiles keep one counter per distinct length, so their state is
    bounded by the longest text and not by the number of texts.
    """
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != F.lit("")))
    quartiles = F.percentile("words", [0.25, 0.5, 0.75])
    return (
        df.select(words.alias("words"))
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.min("words").alias("min_words"),
            F.max("words").alias("max_words"),
            F.avg("words").alias("mean_words"),
            quartiles.alias("q"),
        )
        .select(
            "n_docs",
            "min_words",
            "max_words",
            "mean_words",
            F.col("q")[0].alias("q1_words"),
            F.col("q")[1].alias("median_words"),
            F.col("q")[2].alias("q3_words"),
        )
    )


def topic_crosstab(df: DataFrame, topic: str, field: str) -> DataFrame:
    """Documents per topic and field value, with the share inside the topic."""
    cells = df.groupBy(F.col(topic).alias("topic"), F.col(field).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sizes = cells.groupBy("topic").agg(F.sum("n").alias("n_topic"))
    return cells.join(sizes, "topic").select(
        "topic", "value", "n", (F.col("n") / F.col("n_topic")).alias("share")
    )


def topic_purity(df: DataFrame, topic: str, field: str) -> DataFrame:
    """Agreement of topics with a structured field: purity and normalised mutual information.

    Works on the table of counts only; NMI uses the mean of both entropies.
    """
    cells = df.groupBy(F.col(topic).alias("topic"), F.col(field).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )

    def nlogn(n: Column) -> Column:
        return F.sum(n * F.log(n.cast("double")))

    n = F.col("n")
    by_topic = (
        cells.groupBy("topic")
        .agg(F.sum("n").alias("n"), F.max("n").alias("largest"))
        .agg(nlogn(n).alias("t"), F.sum("largest").alias("pure"), F.sum("n").alias("total"))
    )
    by_value = cells.groupBy("value").agg(F.sum("n").alias("n")).agg(nlogn(n).alias("v"))
    joint = cells.agg(nlogn(n).alias("j"))
    total = F.col("total").cast("double")
    # Entropies from sums of n*ln(n): H = ln(N) - sum/N.
    h_topic = F.log(total) - F.col("t") / total
    h_value = F.log(total) - F.col("v") / total
    mutual = h_topic + h_value - (F.log(total) - F.col("j") / total)
    return (
        by_topic.select("*", by_value.scalar().alias("v"), joint.scalar().alias("j"))
        .select(
            F.col("total").alias("n_docs"),
            (F.col("pure") / total).alias("purity"),
            F.when(h_topic + h_value > 0, 2 * mutual / (h_topic + h_value))
            .otherwise(F.lit(0.0))
            .alias("nmi"),
        )
    )
