"""Cases that earlier versions got wrong."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.functions import tokens as K
from themeloom.operators import density, embeddings, neighbours, vocabulary
from themeloom.options import SMALL_SAMPLE, ClusterOptions, VocabularyOptions


def test_far_neighbours_get_their_sum(spark):
    rows = [(0, i, float(1000 * i)) for i in range(1, 9)]
    near = spark.createDataFrame(rows, "src long, dst long, dist double")
    weights = [r["weight"] for r in neighbours.fuzzy_graph(near, 8).collect()]
    assert sum(weights) == pytest.approx(math.log2(8))


def test_too_few_rows_for_a_core_distance(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id long, v array<double>")
    with pytest.raises(ValueError, match="min_samples=6"):
        density.density_components(df, "id", "v", ClusterOptions(min_samples=6, min_cluster_size=2, epsilon=1.0))


def test_lemmas_do_no_harm(spark):
    words = "cases expenses purchases houses always wolves does specimen series losses companies days"
    found = spark.createDataFrame([(words,)], "t string").select(K.lemmatize("t")).first()[0]
    assert found == "case expense purchase house always wolves does specimen series loss company day"


def test_pieces_of_contractions_are_stop_words(spark):
    assert {"didn", "ll", "ve", "re", "isn", "wasn", "d", "m", "t", "s"} <= set(K.stop_words())
    assert {"company"} <= set(K.stop_words()) and "company" not in K.stop_words(())


def test_small_setting(spark):
    docs = spark.createDataFrame([(f"the company word{i % 50} x",) for i in range(600)], "t string")
    found = {r["term"] for r in vocabulary.vocabulary(docs, "t", SMALL_SAMPLE.vocabulary).collect()}
    assert found == {f"word{i}" for i in range(50)}  # 12 of 600 each; "company" is in more than 85 %
    assert SMALL_SAMPLE.vocabulary.max_features is None


@pytest.mark.parametrize("n", [1, 3, 4, 7, 100, None])
def test_vocabulary_cap(spark, n):
    table = [("a", 5), ("b", 3), ("c", 3), ("d", 3), ("e", 1), ("f", 1)]
    found = vocabulary.most_frequent(spark.createDataFrame(table, "term string, tf long"), n)
    assert sorted(r["term"] for r in found.collect()) == [t for t, _ in table][:n]


def test_embedders_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, t string")
    for found in (embeddings.hash_embed(docs, "id", "t", 8), embeddings.chunk_mean_embed(docs, "id", "t", 2, 8)):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        rows = {r["id"]: r["embedding"] for r in found.collect()}
        assert any(rows[1]) and not any(rows[2]) and not any(rows[3]) and len(rows[2]) == 8
    assert embeddings.hash_embed(docs.where("false"), "id", "t").count() == 0


def test_encoder_plug_in(spark):
    def make():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], np.float32).reshape(-1, 2)

    docs = spark.createDataFrame([(1, "banana"), (2, None), (3, "")], "id long, t string")
    rows = {r["id"]: list(r["embedding"]) for r in embeddings.encode(docs, "t", make).collect()}
    assert rows == {1: [6.0, 3.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    assert embeddings.encode(docs.where(F.lit(False)), "t", make).count() == 0


def test_small_options_differ_from_the_large():
    assert VocabularyOptions().max_features == 40_000 and SMALL_SAMPLE.vocabulary.min_df_divisor == 100
