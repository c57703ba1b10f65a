import pytest

from themeloom.operators import topics, vocabulary
from themeloom.options import VocabularyOptions

TEXTS = [
    (1, "loan rate loan", 0), (1, "loan rate loan", 0), (2, "card fee card", 1), (3, "loan fee", 0),
    (4, None, 0), (5, "", 2), (6, "card loan rate", -1), (None, "fee card fee", 1), (7, "zzz", None),
]
OPTIONS = [
    VocabularyOptions(ngram_max=2, min_df=2, max_df=0.6, stop_words=()),
    VocabularyOptions(ngram_max=2, min_df=1, max_df=1.0, max_features=4, stop_words=()),
    VocabularyOptions(ngram_max=1, min_df=1, max_df=1.0, max_features=None, stop_words=()),
    VocabularyOptions(ngram_max=1, min_df=2, max_df=1.0, df_unit="topic", stop_words=()),
]


@pytest.mark.parametrize("options", OPTIONS)
def test_vocabulary_and_counts_come_from_one_pass(spark, monkeypatch, options):
    docs = spark.createDataFrame(TEXTS, "id long, text string, topic int")
    terms = topics.vocabulary_terms(docs, "text", options)
    expected = sorted(map(tuple, topics.topic_term_counts(docs, "text", options, terms).collect()), key=str)
    passes, counted = [], vocabulary._counted
    monkeypatch.setattr(vocabulary, "_counted", lambda *a: passes.append(1) or counted(*a))
    found = topics.vocabulary_counts(docs, "text", options)
    assert found.columns == ["topic", "term", "tf"]
    assert sorted(map(tuple, found.collect()), key=str) == expected and expected
    assert len(passes) == 1


def test_no_texts(spark):
    docs = spark.createDataFrame([], "id long, text string, topic int")
    assert topics.vocabulary_counts(docs, "text", OPTIONS[0]).isEmpty()
