"""Named queries: every operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import cleaning as C
from themeloom.functions import names as N
from themeloom.functions import tokens as K
from themeloom.operators import (
    density,
    descent,
    embeddings,
    membership,
    model,
    neighbours,
    outliers,
    profiles,
    quotas,
    sampling,
    topics,
    vocabulary,
)
from themeloom.options import ClusterOptions, SampleOptions, TopicOptions, VocabularyOptions
from themeloom.plans.lineage import cut, scratch_path
from themeloom.plans.spread import spread
from themeloom.plans.unnest import computed_once
from themeloom.sources import delimited, guards
from themeloom.sources.tables import (
    TEXT,
    complaints,
    given_topics,
    read_table,
    topic_documents,
    topic_vectors,
    vectors,
    with_vector,
)
from themeloom.streaming.cleaning import clean_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DOCUMENT_SAMPLE = SampleOptions(total=400, min_per_stratum=60, min_per_substratum=2, seed=25)
ORDER_SAMPLE = SampleOptions(total=2000, min_per_stratum=300, min_per_substratum=5, seed=25)
BERNOULLI_FRACTION, BERNOULLI_SEED, BERNOULLI_CAP = 0.05, 256, 5000
UNIGRAMS = VocabularyOptions(ngram_max=1, min_df=1, max_df=1.0)
BIGRAMS = VocabularyOptions(ngram_max=2, min_df=4, max_df=0.85, max_features=40_000)
NEIGHBOURS = 25
FUZZY_NEIGHBOURS = 15
CLUSTERS = ClusterOptions(min_samples=3, min_cluster_size=3, epsilon=1.1)
PROJECTION = (64, 12, 24)
DIMENSIONS = 64
CHUNK_TOKENS = 128
SENT_DATE = "date_sent_to_company"


def query(name: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return add


def _r(column: Column | str, places: int = 6) -> Column:
    """Rounded for comparison with another engine; -0.0 becomes 0.0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, places) + F.lit(0.0)


def _narratives(spark: SparkSession, sf: str) -> DataFrame:
    """Valid rows: the text is there and longer than 50 characters."""
    return complaints(spark, sf).where(F.col(TEXT).isNotNull() & (F.length(TEXT) > 50))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Complaints for costly text expressions."""
    return spread(complaints(spark, sf))


def _topic_texts(spark: SparkSession, sf: str) -> DataFrame:
    return topic_documents(spark, sf)


# Sources and sinks


@query("csv_scan")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    table = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    delimited.write_csv(table, path)
    back = delimited.read_csv(spark, path, delimited.string_schema(table.columns))
    return back.select(
        F.col("doc_id").cast("bigint"), "text", "lang", "source", F.col("n_chars").cast("bigint")
    )


@query("csv_scan_by_line")
def csv_scan_by_line(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    table = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    delimited.write_csv(table, path)
    back = delimited.read_csv_by_line(spark, path, delimited.string_schema(table.columns))
    return back.select(
        F.col("doc_id").cast("bigint"), "text", "lang", "source", F.col("n_chars").cast("bigint")
    )


@query("require_columns")
def require_columns(spark: SparkSession, sf: str) -> DataFrame:
    return guards.require_columns(read_table(spark, sf, "documents"), ["doc_id", "text"])


def _sample_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "text_clean", "product", "sub_product", "issue", "sub_issue", "date_received", "sample_id"
    )


@query("sample_projection")
def sample_projection(spark: SparkSession, sf: str) -> DataFrame:
    return _sample_columns(complaints(spark, sf).withColumn("text_clean", F.col(TEXT)))


@query("sample_sink")
def sample_sink(spark: SparkSession, sf: str) -> DataFrame:
    rows = _narratives(spark, sf)
    sample = sampling.stratified_sample(rows, "product", "issue", "sample_id", DOCUMENT_SAMPLE)
    out = _sample_columns(sample.withColumn("text_clean", C.clean_v2(TEXT)))
    path = scratch_path(spark, "sample")
    delimited.write_csv(out, path)
    back = delimited.read_csv(spark, path, delimited.string_schema(out.columns))
    return back.select(
        F.col("sample_id").cast("bigint"),
        "text_clean",
        "product",
        "issue",
        F.col("date_received").cast("date"),
    )


@query("clustered_sink")
def clustered_sink(spark: SparkSession, sf: str) -> DataFrame:
    probabilities = topics.topic_probability(
        topics.topic_probabilities(topic_vectors(spark, sf), "vec_id", "embedding"), "vec_id"
    )
    assigned = given_topics(spark, sf).join(probabilities, "vec_id").select(
        "vec_id", "topic", F.col("max_probability").alias("topic_probability")
    )
    rows = with_vector(complaints(spark, sf), spark, sf).join(assigned, "vec_id").drop("vec_id")
    path = scratch_path(spark, "clustered")
    delimited.write_by_topic(rows, path)
    return spark.read.parquet(path).select(
        "sample_id", "product", "issue", "topic", _r("topic_probability").alias("topic_probability")
    )


@query("embedding_scan")
def embedding_scan(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select(
        "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x")
    ).select("vec_id", "dim", _r("x").alias("x"))


# Projections


@query("snake_case_columns")
def snake_case_columns(spark: SparkSession, sf: str) -> DataFrame:
    raw = read_table(spark, sf, "documents").toDF("Doc ID", "Narrative?", "Sub-product", " Source ", "n chars")
    return N.snake_case_columns(raw)


@query("drop_columns")
def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    raw = read_table(spark, sf, "documents").withColumnsRenamed({"lang": "tags", "source": "timely_response"})
    return N.drop_named(raw, ["Timely response?", *delimited.UNUSED_COLUMNS])


@query("parse_date")
def parse_date(spark: SparkSession, sf: str) -> DataFrame:
    text = F.date_format("date_received", "yyyy-MM-dd")
    broken = F.when(F.col("sample_id") % 10 == 0, F.concat(text, F.lit("?"))).otherwise(text)
    return complaints(spark, sf).select(
        "sample_id", F.try_to_date(broken, delimited.DATE_FORMAT).alias("date_received")
    )


@query("format_date")
def format_date(spark: SparkSession, sf: str) -> DataFrame:
    return complaints(spark, sf).select(
        "sample_id", F.date_format("date_received", delimited.DATE_FORMAT).alias("date_text")
    )


@query("clean_v2")
def clean_v2(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("sample_id", C.clean_v2(TEXT).alias("text_clean"))


@query("clean_v1")
def clean_v1(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("sample_id", C.clean_v1(TEXT).alias("text_clean"))


@query("clean_conversations")
def clean_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "conversations")).select(
        "conv_id", "turn", C.clean_v2("text").alias("text_clean")
    )


# A phrase for every act name, citation and redaction rule, put behind all texts in turn.
PLANTED_MARK = "qqmark"
PLANTED = (
    "fair debt collection practices act 809",
    "Truth in Lending Act section 226",
    "the Equal Credit Opportunity Act",
    "Real Estate Settlement Procedures Act § 6",
    "health insurance portability and accountability act",
    "Gramm Leach Bliley Act (501)",
    "USC 1681",
    "TILA [226]",
    "Fair Credit Reporting Act [section 611]",
    "a ** b (REDACTED) c [removed] d",
    "paid XXXX to Xxxx",
    "§1692 and § 12",
    "well - known",
    "title 12 U.S.C. 2605",
    "part 1006.14b rule",
    "cost 1,50 now",
)


@query("clean_planted")
def clean_planted(spark: SparkSession, sf: str) -> DataFrame:
    phrase = F.get(F.array(*[F.lit(p) for p in PLANTED]), F.pmod("sample_id", F.lit(len(PLANTED))).cast("int"))
    longer = _texts(spark, sf).withColumn(
        TEXT, F.concat_ws(" ", F.coalesce(TEXT, F.lit("")), F.lit(PLANTED_MARK), phrase)
    )
    ending = F.substring_index(C.clean_v2(TEXT), f"{PLANTED_MARK} ", -1)
    return longer.select("sample_id", ending.alias("ending"))


@query("surrogate_id")
def surrogate_id(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.surrogate_id(
        read_table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", seed=25
    )


@query("coalesce_text")
def coalesce_text(spark: SparkSession, sf: str) -> DataFrame:
    labelled = read_table(spark, sf, "labels").select("doc_id", "quality")
    docs = read_table(spark, sf, "documents").select("doc_id")
    return docs.join(labelled, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("quality_text")
    )


@query("attach_topics")
def attach_topics(spark: SparkSession, sf: str) -> DataFrame:
    probabilities = topics.topic_probability(
        topics.topic_probabilities(topic_vectors(spark, sf), "vec_id", "embedding"), "vec_id"
    )
    assigned = given_topics(spark, sf).join(probabilities, "vec_id").select(
        F.col("vec_id").alias("sample_id"), "topic", _r("max_probability").alias("topic_probability")
    )
    docs = complaints(spark, sf).select("sample_id", "product", "issue")
    return topics.attach_topics(docs, assigned, "sample_id")


@query("topic_label")
def topic_label(spark: SparkSession, sf: str) -> DataFrame:
    return given_topics(spark, sf).select("vec_id", topics.topic_label().alias("label"))


# Filters


@query("filter_not_null")
def filter_not_null(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id", "left")
    return docs.where(F.col("quality").isNotNull()).select("doc_id", "quality")


@query("filter_min_length")
def filter_min_length(spark: SparkSession, sf: str) -> DataFrame:
    return _narratives(spark, sf).select("sample_id", F.length(TEXT).alias("n_chars"))


@query("filter_non_blank")
def filter_non_blank(spark: SparkSession, sf: str) -> DataFrame:
    turns = spread(read_table(spark, sf, "conversations"))
    cleaned = computed_once(turns, C.clean_v2("text"), "text_clean")
    return cleaned.where(F.trim("text_clean") != "").select("conv_id", "turn")


@query("drop_nulls")
def drop_nulls(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id", "left")
    return docs.na.drop(subset=["toxic"]).select("doc_id", "toxic")


@query("topic_sizes")
def topic_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.topic_sizes(given_topics(spark, sf))


# Profiles


@query("filter_audit")
def filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.filter_audit(complaints(spark, sf), TEXT)


@query("stratum_counts")
def stratum_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.value_counts(_narratives(spark, sf), "product").orderBy(F.desc("pop"), "product")


@query("distinct_strata")
def distinct_strata(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.distinct_values(_narratives(spark, sf), "product")


@query("issue_counts")
def issue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.value_counts(_narratives(spark, sf), "product", "issue")


@query("event_counts")
def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.value_counts(read_table(spark, sf, "events"), "event_type")


@query("largest_stratum")
def largest_stratum(spark: SparkSession, sf: str) -> DataFrame:
    counts = profiles.value_counts(_narratives(spark, sf), "product")
    return profiles.largest_value(counts, "product")


@query("topic_size_stats")
def topic_size_stats(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.topic_size_stats(given_topics(spark, sf)).select(
        "min_size",
        "max_size",
        _r("mean_size").alias("mean_size"),
        _r("median_size").alias("median_size"),
        "n_small",
        "n_large",
    )


@query("topic_summary")
def topic_summary(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.topic_summary(given_topics(spark, sf)).select(
        "n_topics", _r("noise_ratio").alias("noise_ratio"), "n_docs"
    )


@query("topic_assignment_profile")
def topic_assignment_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.topic_assignment_profile(given_topics(spark, sf), "vec_id")


@query("embedding_health")
def embedding_health(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.embedding_health(vectors(spark, sf), "embedding").withColumns(
        {"min_value": _r("min_value"), "max_value": _r("max_value")}
    )


@query("embedding_variance")
def embedding_variance(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.embedding_variance(vectors(spark, sf), "embedding").select(
        "dim",
        _r("variance", 9).alias("variance"),
        _r("min_value").alias("min_value"),
        _r("max_value").alias("max_value"),
        "is_constant",
    )


@query("embedding_norms")
def embedding_norms(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.embedding_norms(vectors(spark, sf), "embedding").select(
        _r("min_norm").alias("min_norm"), _r("max_norm").alias("max_norm"), "all_unit"
    )


@query("length_distribution")
def length_distribution(spark: SparkSession, sf: str) -> DataFrame:
    out = profiles.length_distribution(complaints(spark, sf), TEXT)
    return out.select(
        "n_docs",
        "min_words",
        "max_words",
        *[_r(c).alias(c) for c in ("mean_words", "q1_words", "median_words", "q3_words")],
    )


@query("topic_product_crosstab")
def topic_product_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.topic_crosstab(topic_documents(spark, sf), "topic", "product").select(
        "topic", F.col("value").alias("product"), "n", _r("share").alias("share")
    )


@query("topic_purity")
def topic_purity(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.topic_purity(topic_documents(spark, sf), "topic", "product").select(
        "n_docs", _r("purity").alias("purity"), _r("nmi").alias("nmi")
    )


# Samples


def _order_counts(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("stratum"), F.col("o_orderstatus").alias("substratum")
    )
    return cut(profiles.value_counts(orders, "stratum", "substratum"))


def _order_allocation(counts: DataFrame) -> DataFrame:
    return quotas.allocate_strata(
        counts.groupBy("stratum").agg(F.sum("pop").alias("pop")), ORDER_SAMPLE
    )


@query("allocate_strata")
def allocate_strata(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _order_allocation(_order_counts(spark, sf))
        .select("stratum", "pop", _r("quota").alias("quota"))
        .orderBy(F.desc("quota"), "stratum")
    )


@query("allocate_substrata")
def allocate_substrata(spark: SparkSession, sf: str) -> DataFrame:
    counts = _order_counts(spark, sf)
    return quotas.allocate_substrata(counts, _order_allocation(counts), ORDER_SAMPLE).select(
        "stratum", "substratum", "pop", _r("quota").alias("quota")
    )


@query("capped_sample")
def capped_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.capped_sample(
        read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 1000, "o_orderkey", 25
    )


@query("bernoulli_sample")
def bernoulli_sample(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.bernoulli_sample(
        orders, BERNOULLI_FRACTION, "o_orderkey", BERNOULLI_SEED, BERNOULLI_CAP
    )


@query("stratified_sample_bernoulli")
def stratified_sample_bernoulli(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_sample_bernoulli(
        _narratives(spark, sf), "product", "issue", "sample_id", DOCUMENT_SAMPLE
    ).select("sample_id", "product", "issue", "sampling_stage")


@query("stratified_sample_exact")
def stratified_sample_exact(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_sample(
        _narratives(spark, sf), "product", "issue", "sample_id", DOCUMENT_SAMPLE
    ).select("sample_id", "product", "issue", "sampling_stage")


@query("stratified_sample_orders")
def stratified_sample_orders(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_sample(
        read_table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "o_orderkey", ORDER_SAMPLE
    ).select("o_orderkey", "o_orderpriority", "o_orderstatus", "sampling_stage")


@query("union_parts")
def union_parts(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select(
        "doc_id", "lang", F.lit(quotas.PRODUCT_STAGE).alias("sampling_stage")
    )
    english = docs.where(F.col("lang") == "en").withColumn("sampling_stage", F.lit(quotas.ISSUE_STAGE))
    return english.unionByName(docs)


# Terms


@query("tokenize")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _texts(spark, sf).select("sample_id", K.tokenize(TEXT).alias("t"))
    return tokens.select("sample_id", F.size("t").alias("n_tokens"), F.concat_ws(" ", "t").alias("tokens"))


@query("lemmatize")
def lemmatize(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("sample_id", K.lemmatize(TEXT).alias("text_lemma"))


@query("remove_stopwords")
def remove_stopwords(spark: SparkSession, sf: str) -> DataFrame:
    tokens = vocabulary.document_tokens(
        _texts(spark, sf).select("sample_id", TEXT), TEXT, UNIGRAMS, "t"
    )
    return tokens.select("sample_id", F.size("t").alias("n_tokens"), F.concat_ws(" ", "t").alias("tokens"))


@query("stopword_union")
def stopword_union(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.stop_word_usage(
        _texts(spark, sf), TEXT, K.english_stop_words(), list(K.EXTRA_STOP_WORDS)
    )


@query("ngrams")
def ngrams(spark: SparkSession, sf: str) -> DataFrame:
    terms = vocabulary.document_terms(
        _texts(spark, sf).select("sample_id", TEXT), TEXT, BIGRAMS, "t"
    )
    return terms.select("sample_id", F.size("t").alias("n_terms"), F.concat_ws("|", "t").alias("terms"))


@query("df_filter")
def df_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = _texts(spark, sf)
    return vocabulary.prune_terms(
        vocabulary.term_frequencies(docs, TEXT, BIGRAMS), docs.count(), BIGRAMS
    ).select("term", "df")


@query("vocabulary")
def vocabulary_table(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.vocabulary(_texts(spark, sf), TEXT, BIGRAMS)


@query("term_counts")
def term_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.document_term_matrix(_texts(spark, sf), "sample_id", TEXT, BIGRAMS).select(
        "sample_id", "term", "tf"
    )


# Vectors


def _long(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, F.posexplode(vector).alias("dim", "x")).select(key, "dim", _r("x").alias("x"))


@query("hash_embed")
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    return _long(
        embeddings.hash_embed(_texts(spark, sf), "sample_id", TEXT, DIMENSIONS), "sample_id", "embedding"
    )


@query("chunk_mean_embed")
def chunk_mean_embed(spark: SparkSession, sf: str) -> DataFrame:
    return _long(
        embeddings.chunk_mean_embed(_texts(spark, sf), "sample_id", TEXT, CHUNK_TOKENS, DIMENSIONS),
        "sample_id",
        "embedding",
    )


@query("pca_reduce")
def pca_reduce(spark: SparkSession, sf: str) -> DataFrame:
    return _long(embeddings.pca_reduce(vectors(spark, sf), "embedding", 12), "vec_id", "reduced")


@query("random_projection")
def random_projection(spark: SparkSession, sf: str) -> DataFrame:
    dimensions, components, seed = PROJECTION
    return _long(
        embeddings.random_projection(vectors(spark, sf), "embedding", dimensions, components, seed),
        "vec_id",
        "reduced",
    )


@query("knn_cosine")
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    found = neighbours.nearest_neighbours(vectors(spark, sf), "vec_id", "embedding", NEIGHBOURS, "cosine")
    return found.select("src", "dst", "rank", _r("similarity").alias("similarity"))


@query("knn_descent")
def knn_descent(spark: SparkSession, sf: str) -> DataFrame:
    found = neighbours.nearest_neighbours(
        vectors(spark, sf), "vec_id", "embedding", NEIGHBOURS, "cosine", search=descent.descend
    )
    return found.select("src", "dst", "rank", _r("similarity").alias("similarity"))


@query("fuzzy_graph")
def fuzzy_graph(spark: SparkSession, sf: str) -> DataFrame:
    found = neighbours.nearest_neighbours(
        vectors(spark, sf), "vec_id", "embedding", FUZZY_NEIGHBOURS, "cosine"
    )
    found = neighbours.cosine_distances(found)
    return neighbours.fuzzy_graph(found, FUZZY_NEIGHBOURS).select("src", "dst", _r("weight").alias("weight"))


def _near(spark: SparkSession, sf: str) -> DataFrame:
    return cut(
        neighbours.nearest_neighbours(vectors(spark, sf), "vec_id", "embedding", CLUSTERS.min_samples - 1)
    )


@query("core_distance")
def core_distance(spark: SparkSession, sf: str) -> DataFrame:
    cores = density.core_distances(_near(spark, sf), CLUSTERS.min_samples)
    return cores.select("id", _r("core").alias("core"))


@query("mutual_reachability")
def mutual_reachability(spark: SparkSession, sf: str) -> DataFrame:
    near = _near(spark, sf)
    cores = cut(density.core_distances(near, CLUSTERS.min_samples))
    return density.mutual_reachability(near, cores).select("src", "dst", _r("w").alias("w"))


@query("density_components")
def density_components(spark: SparkSession, sf: str) -> DataFrame:
    return density.density_components(vectors(spark, sf), "vec_id", "embedding", CLUSTERS)


@query("mst_edges")
def mst_edges(spark: SparkSession, sf: str) -> DataFrame:
    return density.spanning_tree(vectors(spark, sf), "vec_id", "embedding", CLUSTERS.min_samples).select(
        "src", "dst", _r("w").alias("w")
    )


@query("hdbscan_levels")
def hdbscan_levels(spark: SparkSession, sf: str) -> DataFrame:
    return density.hdbscan_levels(vectors(spark, sf), "vec_id", "embedding", CLUSTERS)


@query("membership_vectors")
def membership_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut(vectors(spark, sf))
    found, chosen = density.hierarchy_of(rows, "vec_id", "embedding", CLUSTERS)
    shares = membership.membership_vectors(rows, "vec_id", "embedding", found, chosen)
    return shares.select("id", "topic", _r("membership").alias("membership"))


@query("topic_probabilities")
def topic_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_probabilities(topic_vectors(spark, sf), "vec_id", "embedding").select(
        "vec_id", "topic", _r("prob").alias("prob")
    )


@query("topic_probability")
def topic_probability(spark: SparkSession, sf: str) -> DataFrame:
    out = topics.topic_probability(
        topics.topic_probabilities(topic_vectors(spark, sf), "vec_id", "embedding"), "vec_id"
    )
    return out.select(
        "vec_id",
        _r("max_probability").alias("max_probability"),
        _r("assigned_probability").alias("assigned_probability"),
    )


# Topics


def _topic_terms(spark: SparkSession, sf: str) -> DataFrame:
    return cut(topics.topic_term_counts(_topic_texts(spark, sf), TEXT, UNIGRAMS))


@query("relabel_by_size")
def relabel_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return topics.relabel_by_size(given_topics(spark, sf), "vec_id")


@query("c_tf_idf")
def c_tf_idf(spark: SparkSession, sf: str) -> DataFrame:
    return topics.c_tf_idf(_topic_terms(spark, sf)).select("topic", "term", _r("weight", 9).alias("weight"))


@query("topic_words")
def topic_words(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_words(topics.c_tf_idf(_topic_terms(spark, sf)), 10).select(
        "topic", "rank", "term", _r("weight").alias("weight")
    )


@query("topic_info")
def topic_info(spark: SparkSession, sf: str) -> DataFrame:
    weights = topics.c_tf_idf(_topic_terms(spark, sf))
    return topics.topic_info(topic_documents(spark, sf), weights, 10)


@query("cluster_sizes_keywords")
def cluster_sizes_keywords(spark: SparkSession, sf: str) -> DataFrame:
    weights = topics.c_tf_idf(_topic_terms(spark, sf))
    return topics.cluster_sizes_keywords(topic_documents(spark, sf), weights, 10, 3)


@query("topic_barchart_data")
def topic_barchart_data(spark: SparkSession, sf: str) -> DataFrame:
    weights = topics.c_tf_idf(_topic_terms(spark, sf))
    return topics.topic_barchart_data(topic_documents(spark, sf), weights, 5, 5).select(
        "topic", "rank", "term", _r("weight").alias("weight")
    )


@query("topic_distribution")
def topic_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_distribution(given_topics(spark, sf))


@query("topic_similarity")
def topic_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_similarity(topic_vectors(spark, sf), "embedding").select(
        "topic_a", "topic_b", _r("similarity").alias("similarity")
    )


@query("topic_map_data")
def topic_map_data(spark: SparkSession, sf: str) -> DataFrame:
    return model.topic_map(topic_vectors(spark, sf), "embedding")


@query("topics_over_time")
def topics_over_time(spark: SparkSession, sf: str) -> DataFrame:
    out = topics.topics_over_time(_topic_texts(spark, sf), TEXT, "date_received", UNIGRAMS, 20, 5)
    return out.select("topic", "bin", "bin_start", "frequency", F.concat_ws(", ", "words").alias("words"))


@query("reduce_outliers_ctfidf")
def reduce_outliers_ctfidf(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.reduce_outliers_ctfidf(
        _topic_texts(spark, sf), "sample_id", TEXT, _topic_terms(spark, sf), UNIGRAMS
    )


@query("reduce_outliers_distributions")
def reduce_outliers_distributions(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.reduce_outliers_distributions(
        _topic_texts(spark, sf), "sample_id", TEXT, _topic_terms(spark, sf), UNIGRAMS, threshold=0.12
    )


@query("update_topics")
def update_topics(spark: SparkSession, sf: str) -> DataFrame:
    docs = _topic_texts(spark, sf)
    terms = _topic_terms(spark, sf)
    moved = cut(outliers.reduce_outliers_ctfidf(docs, "sample_id", TEXT, terms, UNIGRAMS))
    weights = topics.update_topics(docs, moved, "sample_id", TEXT, UNIGRAMS)
    return topics.topic_words(weights, 10).select("topic", "rank", "term", _r("weight").alias("weight"))


FIT = TopicOptions(
    dimensions=64,
    components=12,
    vocabulary=VocabularyOptions(ngram_max=2, min_df=4, max_df=0.85),
    clusters=ClusterOptions(min_samples=5, min_cluster_size=15, epsilon=0.05),
)


@query("fit_topics")
def fit_topics(spark: SparkSession, sf: str) -> DataFrame:
    docs = computed_once(spread(_narratives(spark, sf)), C.clean_v2(TEXT), "text")
    return model.fit_topics(docs.where(F.trim("text") != ""), "sample_id", "text", FIT).info


@query("stream_clean")
def stream_clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_stream(spark, sf, "documents", "doc_id", "text")


@query("sampled_topic_info")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Valid narratives, exact stratified sample, cleaning, topic words and sizes."""
    rows = topic_documents(spark, sf).where(F.length(TEXT) > 50)
    sample = sampling.stratified_sample(rows, "product", "issue", "sample_id", DOCUMENT_SAMPLE)
    cleaned = cut(
        computed_once(sample, C.clean_v2(TEXT), "text_clean")
        .where(F.trim("text_clean") != "")
        .select("sample_id", "topic", "text_clean")
    )
    counts = cut(topics.topic_term_counts(cleaned, "text_clean", UNIGRAMS))
    return topics.topic_info(cleaned, topics.c_tf_idf(counts), 10)
