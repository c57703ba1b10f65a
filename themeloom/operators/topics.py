"""Topics from an assignment of documents: words, sizes, similarity, trends.

An assignment is ``(key, topic)`` with -1 for noise. Term tables are
``(topic, term, tf)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions import vectors as V
from themeloom.operators.profiles import NOISE, topic_sizes
from themeloom.operators.vocabulary import (
    document_terms,
    grouped_term_counts,
    grouped_term_frequencies,
    most_frequent,
    prune_terms,
    topic_vocabulary,
    vocabulary,
)
from themeloom.options import VocabularyOptions
from themeloom.plans.joins import lookup_join
from themeloom.plans.lineage import cut
from themeloom.plans.unnest import unnest


def attach_topics(docs: DataFrame, assignments: DataFrame, key: str) -> DataFrame:
    """Documents with ``topic`` and ``topic_probability`` (NULL where unknown)."""
    return docs.join(assignments.select(key, "topic", "topic_probability"), key, "left")


def topic_label(topic: str = "topic") -> Column:
    return F.concat(F.lit("T"), F.col(topic).cast("string"))


def relabel_by_size(assignments: DataFrame, key: str) -> DataFrame:
    """Topic 0 is the largest, ties by old number; noise stays -1."""
    order = Window.orderBy(F.desc("n_docs"), "topic")
    new = cut(
        topic_sizes(assignments).select(
            "topic", (F.row_number().over(order) - 1).alias("new_topic")
        )
    )
    return lookup_join(assignments.select(key, "topic"), new, ["topic"], "left").select(
        key, F.coalesce("new_topic", F.lit(NOISE)).alias("topic")
    )


def topic_term_counts(
    docs: DataFrame,
    text: str,
    options: VocabularyOptions,
    terms: DataFrame | None = None,
) -> DataFrame:
    """``(topic, term, tf)`` of documents that carry a ``topic`` column.

    Documents are counted where they are read, so a dominant topic only adds
    partial sums. ``terms`` restricts to a vocabulary.
    """
    counted = grouped_term_counts(docs, "topic", text, options)
    return counted if terms is None else lookup_join(counted, terms.select("term"), ["term"])


def vocabulary_terms(docs: DataFrame, text: str, options: VocabularyOptions) -> DataFrame:
    """The vocabulary by the option's unit: documents or topics."""
    if options.df_unit == "document":
        return cut(vocabulary(docs, text, options).select("term"))
    if options.df_unit == "topic":
        counts = cut(topic_term_counts(docs, text, options))
        return cut(topic_vocabulary(counts, options).select("term"))
    raise ValueError(f"df_unit is 'document' or 'topic', not {options.df_unit!r}")


def vocabulary_counts(docs: DataFrame, text: str, options: VocabularyOptions) -> DataFrame:
    """``(topic, term, tf)`` of the vocabulary, chosen by the option's unit from the same pass over the texts."""
    if options.df_unit == "topic":
        counts = cut(topic_term_counts(docs, text, options))
        return lookup_join(counts, cut(topic_vocabulary(counts, options).select("term")), ["term"])
    if options.df_unit != "document":
        raise ValueError(f"df_unit is 'document' or 'topic', not {options.df_unit!r}")
    whole = Window.partitionBy("term")
    counted = grouped_term_frequencies(docs, "topic", text, options).select(
        "topic", "term", "tf", F.sum("tf").over(whole).alias("whole"), F.sum("df").over(whole).alias("df")
    )
    kept = cut(prune_terms(counted, docs.count(), options))
    terms = most_frequent(kept.select("term", F.col("whole").alias("tf")).distinct(), options.max_features)
    return lookup_join(kept.select("topic", "term", "tf"), cut(terms.select("term")), ["term"])


def term_weights(topic_terms: DataFrame) -> DataFrame:
    """``(term, idf)`` with ``idf = ln(1 + A / f)``: A words per topic, f uses of the term."""
    average = topic_terms.agg(
        (F.sum("tf") / F.count_distinct("topic")).alias("a")
    ).scalar()
    return (
        topic_terms.groupBy("term")
        .agg(F.sum("tf").alias("f"))
        .select("term", F.log(F.lit(1.0) + average / F.col("f")).alias("idf"))
    )


def c_tf_idf(topic_terms: DataFrame) -> DataFrame:
    """``(topic, term, weight)``: share of the topic's words times the term's idf.

    ``topic_terms`` is read four times: pass a cut table when it is costly.
    """
    totals = cut(topic_terms.groupBy("topic").agg(F.sum("tf").alias("n_words")))
    weighed = topic_terms.join(term_weights(topic_terms), "term")
    return lookup_join(weighed, totals, ["topic"]).select(
        "topic", "term", (F.col("tf") / F.col("n_words") * F.col("idf")).alias("weight")
    )


def topic_words(weights: DataFrame, top: int = 10) -> DataFrame:
    """``(topic, rank, term, weight)``: the heaviest terms, ties alphabetical."""
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    return weights.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)


def topic_representation(weights: DataFrame, top: int = 10) -> DataFrame:
    """One row per topic with its words in order, as ``array<struct<term, weight>>``."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "term", "weight")))
    return (
        topic_words(weights, top)
        .groupBy("topic")
        .agg(
            F.transform(ranked, lambda e: F.struct(e["term"].alias("term"), e["weight"].alias("weight")))
            .alias("words")
        )
    )


def topic_info(assignments: DataFrame, weights: DataFrame, top: int = 10) -> DataFrame:
    """``(topic, count, name, representation)``, noise included, largest first."""
    sizes = assignments.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    terms = F.transform("words", lambda w: w["term"])
    return (
        sizes.join(topic_representation(weights, top), "topic", "left")
        .select(
            "topic",
            "count",
            F.concat_ws("_", F.col("topic").cast("string"), F.slice(terms, 1, 4)).alias("name"),
            F.concat_ws(", ", terms).alias("representation"),
        )
        .orderBy(F.desc("count"), "topic")
    )


def cluster_sizes_keywords(
    assignments: DataFrame, weights: DataFrame, top_topics: int = 10, top_terms: int = 3
) -> DataFrame:
    """The most common topics and their first words."""
    largest = topic_sizes(assignments).orderBy(F.desc("n_docs"), "topic").limit(top_topics)
    words = topic_representation(weights, top_terms).select(
        "topic", F.concat_ws(", ", F.transform("words", lambda w: w["term"])).alias("keywords")
    )
    return largest.join(words, "topic", "left")


def topic_barchart_data(
    assignments: DataFrame, weights: DataFrame, top_topics: int = 15, top_terms: int = 5
) -> DataFrame:
    """Words and weights of the largest topics, one bar per row."""
    largest = topic_sizes(assignments).orderBy(F.desc("n_docs"), "topic").limit(top_topics)
    return topic_words(weights, top_terms).join(largest.select("topic"), "topic")


def topic_distribution(assignments: DataFrame) -> DataFrame:
    """Documents per topic with the label of its bar."""
    return topic_sizes(assignments).select("topic", topic_label().alias("label"), "n_docs")


def topic_centroids(vectors: DataFrame, vector: str) -> DataFrame:
    """``(topic, n_docs, centroid)``: mean vector per topic, noise left out.

    Means are taken per topic and dimension with partial sums, so no topic is
    gathered in one task.
    """
    means = (
        vectors.where(F.col("topic") != NOISE)
        .select("topic", F.posexplode(V.doubles(vector)).alias("dim", "x"))
        .groupBy("topic", "dim")
        .agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    )
    return means.groupBy("topic").agg(
        F.max("n").alias("n_docs"),
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias(
            "centroid"
        ),
    )


# Vectors scored against a table of centroids see it in chunks of about this many,
# which with vectors of up to 1,024 dimensions take some 4 MiB.
CENTROID_CHUNK = 512


def centroid_chunks(centroids: DataFrame, n_chunks: int) -> DataFrame:
    """``(chunk, entries)``: the centroids spread over ``n_chunks`` rows by a hash of the topic."""
    chunk = F.pmod(F.xxhash64("topic"), F.lit(n_chunks)).cast("int")
    return centroids.groupBy(chunk.alias("chunk")).agg(
        F.collect_list(F.struct("topic", "centroid")).alias("entries")
    )


def score_arrays(
    rows: DataFrame, centroids: DataFrame, score, name: str = "scores"
) -> tuple[DataFrame, int]:
    """Rows with an array of ``struct<topic, score>`` per chunk of centroids, and the chunks.

    The whole result is a full matrix by nature. Rows stay in their tasks, and
    centroid chunks of bounded size come to them.
    """
    n_chunks = max(1, -(-centroids.count() // CENTROID_CHUNK))
    chunks = cut(centroid_chunks(centroids, n_chunks))
    chunk_ids = F.sequence(F.lit(0), F.lit(n_chunks - 1))
    joined = lookup_join(
        rows.withColumn("chunk", F.explode(chunk_ids)),
        chunks,
        ["chunk"],
    )
    scored = F.transform(
        "entries", lambda e: F.struct(e["topic"].alias("topic"), score(e["centroid"]).alias("score"))
    )
    return joined.select(*rows.columns, scored.alias(name)), n_chunks


def topic_similarity(vectors: DataFrame, vector: str) -> DataFrame:
    """Cosine of every pair of topic centroids."""
    centroids = cut(topic_centroids(vectors, vector))
    unit = centroids.select(
        "topic", F.transform("centroid", lambda x: x / V.norm(F.col("centroid"))).alias("centroid")
    )
    unit = cut(unit)
    scored, _ = score_arrays(unit, unit, lambda c: V.dot(F.col("centroid"), c))
    return unnest(scored, ["topic"], "scores", "s").select(
        F.col("topic").alias("topic_a"), F.col("s.topic").alias("topic_b"), F.col("s.score").alias("similarity")
    )


def topic_probabilities(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, topic, given_topic, prob)``: shares of inverse distance to the centroids.

    ``prob`` sums to 1 per key. A vector that equals a centroid is put a
    billionth away from it. ``given_topic`` is the topic the row came with.
    """
    centroids = cut(topic_centroids(vectors, vector))
    rows = vectors.select(key, F.col("topic").alias("given_topic"), V.doubles(vector).alias("_v"))
    scored, n_chunks = score_arrays(
        rows, centroids, lambda c: F.lit(1.0) / F.greatest(V.distance(F.col("_v"), c), F.lit(1e-9))
    )
    summed = F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + s["score"])
    scored = scored.select(key, "given_topic", "scores", summed.alias("total"))
    if n_chunks > 1:
        scored = scored.withColumn("total", F.sum("total").over(Window.partitionBy(key)))
    return unnest(scored, [key, "given_topic", "total"], "scores", "s").select(
        key,
        F.col("s.topic").alias("topic"),
        "given_topic",
        (F.col("s.score") / F.col("total")).alias("prob"),
    )


def topic_probability(probabilities: DataFrame, key: str) -> DataFrame:
    """Per key the greatest probability and that of the topic the key was given.

    The two differ after outliers were assigned anew. Noise has no
    ``assigned_probability``.
    """
    return probabilities.groupBy(key).agg(
        F.max("prob").alias("max_probability"),
        F.max(F.when(F.col("topic") == F.col("given_topic"), F.col("prob"))).alias(
            "assigned_probability"
        ),
    )


def topics_over_time(
    docs: DataFrame,
    text: str,
    date: str,
    options: VocabularyOptions,
    bins: int = 20,
    top_terms: int = 5,
) -> DataFrame:
    """``(topic, bin, bin_start, frequency, words)`` in equal-width date bins.

    Word weights are those of the topic's texts inside the bin with idf taken
    over all bins. Noise takes part in idf and is not reported.
    """
    span = docs.agg(F.min(date).alias("first"), F.max(date).alias("last")).first()
    first, last = span["first"], span["last"]
    width = ((last - first).days / bins) if first is not None and last > first else 1.0
    offset = F.date_diff(F.col(date), F.lit(first))
    binned = docs.where(F.col(date).isNotNull()).withColumn(
        "bin", F.least(F.floor(offset / F.lit(width)), F.lit(bins - 1)).cast("int")
    )
    counts = cut(
        unnest(
            document_terms(binned.select("topic", "bin", text), text, options),
            ["topic", "bin"],
            "terms",
            "term",
        )
        .groupBy("topic", "bin", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    overall = counts.groupBy("topic", "term").agg(F.sum("tf").alias("tf"))
    idf = term_weights(overall)
    shown = counts.where(F.col("topic") != NOISE)
    totals = cut(shown.groupBy("topic", "bin").agg(F.sum("tf").alias("n_words")))
    weighted = lookup_join(shown.join(idf, "term"), totals, ["topic", "bin"]).withColumn(
        "weight", F.col("tf") / F.col("n_words") * F.col("idf")
    )
    order = Window.partitionBy("topic", "bin").orderBy(F.desc("weight"), "term")
    words = (
        weighted.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_terms)
        .groupBy("topic", "bin")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda e: e["term"]
            ).alias("words")
        )
    )
    frequency = (
        binned.where(F.col("topic") != NOISE)
        .groupBy("topic", "bin")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
    return frequency.join(words, ["topic", "bin"], "left").select(
        "topic",
        "bin",
        F.date_add(F.lit(first), F.floor(F.col("bin") * F.lit(width)).cast("int")).alias("bin_start"),
        "frequency",
        "words",
    )


def update_topics(
    docs: DataFrame,
    assignments: DataFrame,
    key: str,
    text: str,
    options: VocabularyOptions,
    terms: DataFrame | None = None,
) -> DataFrame:
    """Word weights ``(topic, term, weight)`` for new topics, with the same vocabulary."""
    labelled = docs.drop("topic").join(assignments.select(key, "topic"), key)
    return c_tf_idf(cut(topic_term_counts(labelled, text, options, terms)))
