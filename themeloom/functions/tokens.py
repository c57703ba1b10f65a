"""Tokens, stop words, n-grams and lemmas as array expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words added to the English list (45 distinct).
EXTRA_STOP_WORDS = (
    "please", "thank", "hello", "dear", "regarding", "however", "therefore",
    "also", "get", "make", "time", "still", "even", "though", "well",
    "really", "actually", "basically", "complaint", "complaints", "consumer",
    "cfpb", "company", "bank", "account", "would", "could", "said", "us",
    "one", "two", "three", "first", "second", "may", "see",
    "like", "just", "know", "need", "want", "asked", "told", "called", "went",
)

# End of fixed values.

# Plural endings and what replaces them, tried in this order. Endings that need a
# lexicon (-ves, -men) are left alone: an unchanged word does less harm than a broken one.
NOUN_ENDINGS = (
    ("abuses", "abuse"),
    ("buses", "bus"),
    ("bonuses", "bonus"),
    ("statuses", "status"),
    ("sses", "ss"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("xes", "x"),
    ("ies", "y"),
    ("s", ""),
)
UNCHANGED_ENDINGS = "(ss|us|is|ves)$"
UNCHANGED_WORDS = ("always", "does", "goes", "has", "perhaps", "series", "species", "was", "news")

# Words of letters, digits and "_" in any script. Java's own \w is ASCII only.
WORD = r"[\p{L}\p{N}_]+"


def english_stop_words() -> list[str]:
    """The English list that ships with Spark."""
    return StopWordsRemover.loadDefaultStopWords("english")


def stop_words(extra: Iterable[str] = EXTRA_STOP_WORDS) -> list[str]:
    """English and extra words, with the pieces that the tokeniser makes of contractions."""
    english = english_stop_words()
    pieces = {p for w in english if "'" in w for p in re.findall(r"\w+", w)}
    return sorted({*english, *pieces, *extra})


def tokenize(text: Column | str, min_chars: int = 1, lower: bool = True) -> Column:
    """All words of the whole text, in order."""
    column = F.col(text) if isinstance(text, str) else text
    column = F.coalesce(column, F.lit(""))
    if lower:
        column = F.lower(column)
    pattern = WORD if min_chars <= 1 else rf"[\p{{L}}\p{{N}}_]{{{min_chars},}}"
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(0))


def without_words(tokens: Column, words: Iterable[str]) -> Column:
    """Tokens not in ``words``; the list becomes a hash set in the plan."""
    listed = sorted(set(words))
    return F.filter(tokens, lambda t: ~t.isin(listed)) if listed else tokens


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs joined by a blank. Pass a column, not a long expression."""
    return F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )


def ngrams(tokens: Column, upto: int = 2) -> Column:
    """All runs of 1..``upto`` tokens."""
    if upto == 1:
        return tokens
    if upto == 2:
        return F.concat(tokens, bigrams(tokens))
    return F.concat(tokens, *[_runs(tokens, n) for n in range(2, upto + 1)])


def _runs(tokens: Column, n: int) -> Column:
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1))
    joined = F.transform(starts, lambda i: F.concat_ws(" ", F.slice(tokens, i, F.lit(n))))
    return F.coalesce(joined, F.array().cast("array<string>"))


def noun_lemma(word: Column) -> Column:
    """Strip a plural ending from a lower-case word of four letters or more."""
    rule = F.when(
        (F.length(word) < 4) | word.rlike(UNCHANGED_ENDINGS) | word.isin(*UNCHANGED_WORDS), word
    )
    for ending, replacement in NOUN_ENDINGS:
        rule = rule.when(word.endswith(ending), F.regexp_replace(word, ending + "$", replacement))
    return rule.otherwise(word)


def lemmatize(text: Column | str) -> Column:
    """Lower-case, reduce every blank-separated word to its lemma, join again."""
    column = F.col(text) if isinstance(text, str) else text
    words = F.filter(
        F.split(F.lower(F.coalesce(column, F.lit(""))), r"\s+"), lambda w: w != F.lit("")
    )
    return F.concat_ws(" ", F.transform(words, noun_lemma))
