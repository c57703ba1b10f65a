from collections import Counter

import pytest
from pyspark.sql import functions as F

from themeloom.functions import tokens as K
from themeloom.operators import model, outliers, topics, vocabulary
from themeloom.options import ClusterOptions, TopicOptions, VocabularyOptions

PLAIN = VocabularyOptions(ngram_max=1, min_df=1, max_df=1.0, stop_words=())


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, topic int")


def test_golden_weights(spark):
    counts = topics.topic_term_counts(docs(spark, [(1, "a a", 0), (2, "b", 0), (3, "b c", 1)]), "text", PLAIN)
    got = {(r["topic"], r["term"]): round(r["weight"], 6) for r in topics.c_tf_idf(counts).collect()}
    assert got == {(0, "a"): 0.540620, (0, "b"): 0.270310, (1, "b"): 0.405465, (1, "c"): 0.626381}


def test_term_frequencies_equal_the_plain_count(spark):
    texts = docs(spark, [(1, "a b a b", 0), (2, "", 0), (3, "b", 0), (4, None, 0)])
    options = VocabularyOptions(ngram_max=2, min_df=1, max_df=1.0, stop_words=())
    got = {r["term"]: (r["tf"], r["df"]) for r in vocabulary.term_frequencies(texts, "text", options).collect()}
    assert got == {"a": (2, 1), "b": (3, 2), "a b": (2, 1), "b a": (1, 1)}


def test_vocabulary_bounds(spark):
    texts = docs(spark, [(i, "all " + ("few" if i < 2 else "some"), i % 2) for i in range(10)])
    terms = vocabulary.vocabulary(texts, "text", VocabularyOptions(ngram_max=1, min_df=3, max_df=0.9, stop_words=()))
    assert [r["term"] for r in terms.collect()] == ["some"]
    by_topic = VocabularyOptions(ngram_max=1, min_df=2, max_df=1.0, df_unit="topic", stop_words=())
    assert {r["term"] for r in topics.vocabulary_terms(texts, "text", by_topic).collect()} == {"all", "few", "some"}


def test_longer_ngrams(spark):
    t = docs(spark, [(1, "a b c d", 0)]).select(K.tokenize("text").alias("t"))
    got = t.select(K.ngrams(F.col("t"), 3).alias("g")).first()["g"]
    assert got == ["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d"]


def test_lemma_table_before_rules(spark):
    texts = docs(spark, [(1, "Mice eat berries  on buses", 0), (2, "", 0)])
    lemmas = spark.createDataFrame([("mice", "mouse")], "form string, lemma string")
    got = {r["id"]: r["l"] for r in vocabulary.lemmatize_with_table(texts, "id", "text", lemmas, "l").collect()}
    assert got == {1: "mouse eat berry on bus", 2: ""}
    rules = {r["id"]: r["l"] for r in texts.select("id", K.lemmatize("text").alias("l")).collect()}
    assert rules == {1: "mice eat berry on bus", 2: ""}


def test_outliers_move_to_shared_words(spark):
    texts = docs(spark, [(1, "loan rate loan", 0), (2, "card fee card", 1), (3, "card late", -1), (4, "zzz", -1)])
    counts = topics.topic_term_counts(texts, "text", PLAIN)
    for move in (outliers.reduce_outliers_ctfidf, outliers.reduce_outliers_distributions):
        got = {r["id"]: r["topic"] for r in move(texts, "id", "text", counts, PLAIN).collect()}
        assert got == {1: 0, 2: 1, 3: 1, 4: -1}


def test_probabilities_sum_to_one_in_any_chunking(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(i, [float(i % 5), float(i % 3)], i % 5 - 1) for i in range(50)], "id long, v array<double>, topic int"
    )
    whole = topics.topic_probabilities(rows, "id", "v").withColumn("prob", F.round("prob", 9))
    sums = whole.groupBy("id").agg(F.sum("prob").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums) and len(sums) == 50
    monkeypatch.setattr(topics, "CENTROID_CHUNK", 2)
    chunked = topics.topic_probabilities(rows, "id", "v").withColumn("prob", F.round("prob", 9))
    assert whole.exceptAll(chunked).isEmpty() and whole.count() == chunked.count()


def test_single_date_makes_one_bin(spark):
    texts = docs(spark, [(1, "a b", 0), (2, "b", 0)]).withColumn("d", F.lit("2024-01-01").cast("date"))
    got = topics.topics_over_time(texts, "text", "d", PLAIN, 20, 2).collect()
    assert [(r["topic"], r["bin"], r["frequency"]) for r in got] == [(0, 0, 2)]


def test_model_from_given_vectors(spark):
    words = ["loan rate house", "card fee late", "phone call debt"]
    rows = [(i, f"{words[i % 3]} w{i % 2}", [float(j == i % 3) * 5 + (i * 7 % 11) / 50.0 for j in range(4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, text string, embedding array<double>")
    options = TopicOptions(
        components=3,
        vocabulary=VocabularyOptions(ngram_max=1, min_df=1, max_df=1.0),
        clusters=ClusterOptions(min_samples=3, min_cluster_size=10, epsilon=0.1),
    )
    fitted = model.fit_topics(df, "id", "text", options, vectors=df, outlier_strategy="c-tf-idf")
    info = {r["topic"]: r for r in fitted.info.collect()}
    assert {t for t in info if t >= 0} == {0, 1, 2}
    top = fitted.assignments.where("topic >= 0 and assigned_probability = topic_probability")
    assert top.count() == 90


def test_terms_are_counted_in_their_rows(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "TOKENS_AT_ONCE", 7)
    rows = [(1, "a b a b", 0), (2, None, 0), (3, "", None), (4, "b a " * 9, None), (None, "c", 1), (4, "b", 0)]
    texts = docs(spark, rows).coalesce(1)
    options = VocabularyOptions(ngram_max=3, min_df=1, max_df=1.0, stop_words=())

    def plain(text):
        words = (text or "").split()
        return Counter(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))

    found = vocabulary.term_counts(texts, "id", "text", options)
    assert Counter(map(tuple, found.collect())) == Counter(
        (key, term, tf) for key, text, _ in rows for term, tf in plain(text).items()
    )
    tf, df = sum((plain(r[1]) for r in rows), Counter()), Counter(t for r in rows for t in plain(r[1]))
    frequencies = vocabulary.term_frequencies(texts, "text", options)
    assert {tuple(r) for r in frequencies.collect()} == {(t, tf[t], df[t]) for t in tf}
    grouped = topics.topic_term_counts(texts, "text", options)
    by_topic = Counter()
    for _, text, topic in rows:
        by_topic.update({(topic, t): n for t, n in plain(text).items()})
    assert {tuple(r) for r in grouped.collect()} == {(*pair, n) for pair, n in by_topic.items()}
    # No row per occurrence is made to be counted.
    for table in (found, frequencies, grouped):
        assert "Generate" not in table._jdf.queryExecution().toString()
