"""From texts to term tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions import tokens as K
from themeloom.options import VocabularyOptions
from themeloom.plans.joins import lookup_join
from themeloom.plans.lineage import cut
from themeloom.plans.unnest import unnest

# What a task holds at once: tokens (or rows without any) whose terms are counted together.
TOKENS_AT_ONCE = 1_000_000


def document_tokens(
    docs: DataFrame, text: str, options: VocabularyOptions, name: str = "tokens"
) -> DataFrame:
    """Adds the words of each text without stop words; the text itself goes."""
    source = K.lemmatize(text) if options.lemmas else F.col(text)
    words = options.stop_words
    if words is None:
        words = K.stop_words(K.EXTRA_STOP_WORDS if options.extra_stop_words else ())
    tokens = K.without_words(K.tokenize(source, options.min_chars), words)
    return docs.select(*[c for c in docs.columns if c != text], tokens.alias(name))


def document_terms(
    docs: DataFrame, text: str, options: VocabularyOptions, name: str = "terms"
) -> DataFrame:
    """Adds all n-grams of each text as one array."""
    tokens = document_tokens(docs, text, options, "_tokens")
    rest = [c for c in tokens.columns if c != "_tokens"]
    return tokens.select(*rest, K.ngrams(F.col("_tokens"), options.ngram_max).alias(name))


def _counted(
    docs: DataFrame, keep: list[str], text: str, options: VocabularyOptions, columns: str, summary: Callable
) -> DataFrame:
    """``columns``, made from the terms of some rows at a time, those of about TOKENS_AT_ONCE tokens.

    Tokens are found in the JVM and become numbers, as do n-grams, so that equal
    terms are found by sorting numbers; text is put together once per distinct
    term. ``summary(rows, row, number, terms)`` gets the rows' ``keep`` columns
    and, of every occurrence, the place of its row and its number in ``terms``.
    """
    upto, schema = options.ngram_max, T.StructType.fromDDL(columns)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(len(keep)).value_lengths().fill_null(0).to_numpy().astype(np.int64)
            # Rows go on together while their tokens fit; a longer row goes alone.
            part = (np.cumsum(sizes) + np.arange(len(sizes))) // TOKENS_AT_ONCE
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(sizes) else []
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                rows = batch.slice(start, end - start)
                for row, number, terms in numbered(rows.column(len(keep)), sizes[start:end]):
                    yield pa.RecordBatch.from_arrays(summary(rows, row, number, terms), names)

    def numbered(lists: pa.ListArray, sizes: np.ndarray) -> Iterator[tuple]:
        coded = lists.flatten().dictionary_encode()
        words, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        row, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(word))
        number, terms = word, words
        yield row, number, terms
        for n in range(2, upto + 1):
            inside = at + n - 1 < len(word)
            inside[inside] = row[at[inside]] == row[at[inside] + n - 1]
            at = at[inside]
            last = word[at + n - 1]
            _, first, number = np.unique(number[inside] * len(words) + last, return_index=True, return_inverse=True)
            parts = [words.take(pa.array(word[at[first] + i])) for i in range(n)]
            terms = pc.binary_join_element_wise(*parts, " ")
            yield row[at], number, terms

    tokens = document_tokens(docs.select(*keep, text), text, options, "_tokens")
    return tokens.select(*keep, "_tokens").mapInArrow(run, schema)


def _pairs(group: np.ndarray, number: np.ndarray, n_terms: int) -> tuple[np.ndarray, ...]:
    """Distinct pairs of a group and a term, and how often each occurs."""
    pairs, times = np.unique(group * max(n_terms, 1) + number, return_counts=True)
    return *np.divmod(pairs, max(n_terms, 1)), times


def term_counts(docs: DataFrame, key: str, text: str, options: VocabularyOptions) -> DataFrame:
    """``(key, term, tf)`` for every term of every text, before any pruning; keys are unique.

    Each row's terms are counted where it is read: nothing is shuffled.
    """

    def summary(rows: pa.RecordBatch, row: np.ndarray, number: np.ndarray, terms: pa.Array) -> list[pa.Array]:
        place, term, tf = _pairs(row, number, len(terms))
        return [rows.column(0).take(pa.array(place)), terms.take(pa.array(term)), pa.array(tf)]

    kind = docs.schema[key].dataType.simpleString()
    return _counted(docs, [key], text, options, f"`{key}` {kind}, term string, tf bigint", summary)


def grouped_term_counts(docs: DataFrame, group: str, text: str, options: VocabularyOptions) -> DataFrame:
    """``(group, term, tf)``: occurrences of every term in the texts of every group; only partial sums are shuffled."""

    def summary(rows: pa.RecordBatch, row: np.ndarray, number: np.ndarray, terms: pa.Array) -> list[pa.Array]:
        coded = rows.column(0).dictionary_encode("encode")
        place, term, tf = _pairs(coded.indices.to_numpy().astype(np.int64)[row], number, len(terms))
        return [coded.dictionary.take(pa.array(place)), terms.take(pa.array(term)), pa.array(tf)]

    kind = docs.schema[group].dataType.simpleString()
    counted = _counted(docs, [group], text, options, f"`{group}` {kind}, term string, tf bigint", summary)
    return counted.groupBy(group, "term").agg(F.sum("tf").alias("tf"))


def grouped_term_frequencies(docs: DataFrame, group: str, text: str, options: VocabularyOptions) -> DataFrame:
    """``(group, term, tf, df)``: occurrences and documents of every term in every group.

    All rows of a term stand in one partition, so what goes on by term moves nothing again.
    """

    def summary(rows: pa.RecordBatch, row: np.ndarray, number: np.ndarray, terms: pa.Array) -> list[pa.Array]:
        coded = rows.column(0).dictionary_encode("encode")
        place, term, times = _pairs(row, number, len(terms))
        pairs = coded.indices.to_numpy().astype(np.int64)[place] * max(len(terms), 1) + term
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
        at, term = np.divmod(pairs[starts], max(len(terms), 1))
        tf = np.add.reduceat(times[order], starts) if len(pairs) else times
        df = np.diff(np.append(starts, len(pairs)))
        return [coded.dictionary.take(pa.array(at)), terms.take(pa.array(term)), pa.array(tf), pa.array(df)]

    kind = docs.schema[group].dataType.simpleString()
    counted = _counted(docs, [group], text, options, f"`{group}` {kind}, term string, tf bigint, df bigint", summary)
    sums = [F.sum(c).alias(c) for c in ("tf", "df")]
    return counted.repartition("term").groupBy(group, "term").agg(*sums)


def term_frequencies(docs: DataFrame, text: str, options: VocabularyOptions) -> DataFrame:
    """``(term, tf, df)``: occurrences and documents of every term.

    Only partial sums per term are shuffled, never a row per document and term.
    """

    def summary(rows: pa.RecordBatch, row: np.ndarray, number: np.ndarray, terms: pa.Array) -> list[pa.Array]:
        _, term, _ = _pairs(row, number, len(terms))
        tf, df = (np.bincount(x, minlength=len(terms)).astype(np.int64) for x in (number, term))
        return [terms, pa.array(tf), pa.array(df)]

    counted = _counted(docs, [], text, options, "term string, tf bigint, df bigint", summary)
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def prune_terms(frequencies: DataFrame, n_units: int, options: VocabularyOptions) -> DataFrame:
    """Terms within the document-frequency bounds; ``max_df`` is a share of ``n_units``."""
    least = max(options.min_df, n_units // options.min_df_divisor if options.min_df_divisor else 0)
    return frequencies.where(
        (F.col("df") >= least) & (F.col("df") <= F.lit(options.max_df * n_units))
    )


def most_frequent(frequencies: DataFrame, n: int | None) -> DataFrame:
    """The ``n`` terms of greatest total frequency, ties in alphabetical order; all for ``None``.

    A histogram of the frequencies tells at which one the vocabulary ends (it
    has a row per distinct frequency, of which T tokens allow no more than about
    the root of 2T). Only the terms of that one frequency are put in order.
    """
    if n is None:
        return frequencies
    table = cut(frequencies)
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("tf"))
    histogram = table.groupBy("tf").agg(F.count(F.lit(1)).alias("terms"))
    end = (
        histogram.withColumn("upto", F.sum("terms").over(above))
        .where(F.col("upto") >= n)
        .agg(F.max(F.struct("tf", "upto", "terms")).alias("e"))
        .first()["e"]
    )
    if end is None:
        return table
    rest = n - (end["upto"] - end["terms"])
    ties = table.where(F.col("tf") == end["tf"]).orderBy("term").limit(rest)
    return table.where(F.col("tf") > end["tf"]).unionByName(ties)


def vocabulary(docs: DataFrame, text: str, options: VocabularyOptions) -> DataFrame:
    """The pruned, capped vocabulary ``(term, tf, df)`` counted over documents."""
    frequencies = term_frequencies(docs, text, options)
    return most_frequent(prune_terms(frequencies, docs.count(), options), options.max_features)


def topic_vocabulary(topic_terms: DataFrame, options: VocabularyOptions) -> DataFrame:
    """The same, with topics as the unit of document frequency.

    ``topic_terms`` is ``(topic, term, tf)``.
    """
    n_topics = topic_terms.select("topic").distinct().count()
    frequencies = topic_terms.groupBy("term").agg(
        F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df")
    )
    return most_frequent(prune_terms(frequencies, n_topics, options), options.max_features)


def document_term_matrix(
    docs: DataFrame, key: str, text: str, options: VocabularyOptions
) -> DataFrame:
    """``(key, term, tf)`` of vocabulary terms."""
    terms = cut(vocabulary(docs, text, options).select("term"))
    return lookup_join(term_counts(docs, key, text, options), terms, ["term"])


def lemmatize_with_table(
    docs: DataFrame, key: str, text: str, lemmas: DataFrame, name: str = "text_lemma"
) -> DataFrame:
    """Lemmas from a ``(form, lemma)`` table, suffix rules for other words."""
    words = docs.select(
        key,
        F.posexplode_outer(
            F.filter(
                F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"),
                lambda w: w != F.lit(""),
            )
        ).alias("pos", "form"),
    )
    found = lookup_join(words, lemmas.select("form", "lemma"), ["form"], "left")
    return (
        found.withColumn("lemma", F.coalesce("lemma", K.noun_lemma(F.col("form"))))
        .groupBy(key)
        .agg(
            F.concat_ws(
                " ",
                F.transform(
                    F.array_sort(F.collect_list(F.struct("pos", "lemma"))), lambda e: e["lemma"]
                ),
            ).alias(name)
        )
    )


def stop_word_usage(docs: DataFrame, text: str, first: list[str], second: list[str]) -> DataFrame:
    """How often each word of the union of two lists occurs; unused words give 0."""
    spark = docs.sparkSession

    def as_table(words: list[str]) -> DataFrame:
        return spark.createDataFrame([(w,) for w in words], "word string")

    listed = as_table(first).union(as_table(second)).distinct()
    members = sorted(set(first) | set(second))
    tokens = F.filter(K.tokenize(text), lambda t: t.isin(members))
    used = (
        unnest(docs, [], tokens, "word")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return listed.join(used, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def sliding_windows(tokens: str, size: int = 4) -> Column:
    """All runs of ``size`` tokens, one step apart; a shorter text is one run."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.slice(F.col(tokens), i, F.lit(size)))
