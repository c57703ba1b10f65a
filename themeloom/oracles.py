"""The same results in SQL for DuckDB, one statement per query.

Nothing here runs in a job: the statements state independently what the
queries of ``catalog`` have to return, over the same whole tables.
"""

from __future__ import annotations

import glob
import os
import zipfile

import pyspark

from themeloom import catalog as Q
from themeloom.functions import cleaning as C
from themeloom.functions import tokens as K
from themeloom.operators.embeddings import projection_sign
from themeloom.options import SampleOptions, VocabularyOptions

ORACLES: dict[str, str] = {}

COMPLAINTS = """complaints AS (
  SELECT doc_id AS sample_id, text AS consumer_complaint_narrative, lang AS product,
         source AS issue, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS date_received
  FROM documents)"""
VALID = "valid AS (SELECT * FROM complaints WHERE length(consumer_complaint_narrative) > 50)"
GIVEN = """given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS topic,
         CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
TOPIC_DOCS = "topic_docs AS (SELECT c.*, g.topic FROM complaints c JOIN given g ON g.vec_id = c.sample_id % (SELECT count(*) FROM embeddings))"


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _english_stop_words() -> list[str]:
    """The list inside Spark's own library, read without a session."""
    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    for home in filter(None, homes):
        for jar in glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar")):
            with zipfile.ZipFile(jar) as z:
                name = "org/apache/spark/ml/feature/stopwords/english.txt"
                return z.read(name).decode("utf-8").split()
    return K.english_stop_words()


ENGLISH = _english_stop_words()
STOP = sorted({*ENGLISH, *K.EXTRA_STOP_WORDS, *(p for w in ENGLISH if "'" in w for p in w.split("'"))})

# Cleaning. RE2 sees only ASCII letters as word characters, Java sees all. Every
# other letter or digit is therefore wrapped in an ASCII word while the rules run.
_MARK = "qzjqvkqz"
_OTHER_LETTER = r"([^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}\p{M}\p{No}\p{Nl}])"
_BLANK = r"[ \t\n\x0B\f\r]"


def _clean(column: str, rules: tuple[C.Rule, ...], lower: bool) -> str:
    sql = f"regexp_replace(coalesce({column}, ''), '{_OTHER_LETTER}', '{_MARK}\\1{_MARK}', 'g')"
    for rule in rules:
        pattern = rule.pattern.replace(r"\s", _BLANK).replace(r"\u00A0", r"\x{00A0}")
        replacement = rule.replacement.replace("$1", "\\1").replace("$2", "\\2")
        sql = f"regexp_replace({sql}, '{pattern}', '{replacement}', 'g')"
    if lower:
        sql = f"lower({sql})"
    return f"trim(replace(regexp_replace({sql}, '{_BLANK}+', ' ', 'g'), '{_MARK}', ''))"


def _tokens(column: str, words: list[str] | None = None) -> str:
    tokens = f"regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{N}}_]+')"
    return tokens if words is None else f"list_filter({tokens}, lambda t: t NOT IN ({_quoted(words)}))"


# Sources, projections and filters
ORACLES["csv_scan"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
ORACLES["csv_scan_by_line"] = ORACLES["csv_scan"]
ORACLES["require_columns"] = "SELECT doc_id, text FROM documents"
ORACLES["sample_projection"] = _with(COMPLAINTS) + """
SELECT consumer_complaint_narrative AS text_clean, product, CAST(NULL AS VARCHAR) AS sub_product, issue,
       CAST(NULL AS VARCHAR) AS sub_issue, date_received, sample_id FROM complaints"""
ORACLES["embedding_scan"] = """
SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(CAST(embedding[i] AS DOUBLE), 6) + 0.0 AS x
FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i)"""
ORACLES["snake_case_columns"] = """
SELECT doc_id, text AS narrative, lang AS sub_product, source, n_chars FROM documents"""
ORACLES["drop_columns"] = "SELECT doc_id, text, n_chars FROM documents"
ORACLES["parse_date"] = _with(COMPLAINTS) + """
SELECT sample_id, try_cast(strftime(date_received, '%Y-%m-%d') || CASE WHEN sample_id % 10 = 0 THEN '?' ELSE '' END
       AS DATE) AS date_received FROM complaints"""
ORACLES["format_date"] = _with(COMPLAINTS) + """
SELECT sample_id, strftime(date_received, '%Y-%m-%d') AS date_text FROM complaints"""
ORACLES["clean_v2"] = f"SELECT doc_id AS sample_id, {_clean('text', C.rules_v2(), True)} AS text_clean FROM documents"
ORACLES["clean_v1"] = f"SELECT doc_id AS sample_id, {_clean('text', C.rules_v1(), False)} AS text_clean FROM documents"
ORACLES["clean_conversations"] = (
    f"SELECT conv_id, turn, {_clean('text', C.rules_v2(), True)} AS text_clean FROM conversations"
)
# Written out by hand, in the order of the phrases: nothing of the rules is used here.
_ENDINGS = (
    "fdcpa_809",
    "tila_226",
    "the ecoa",
    "respa_6",
    "hipaa",
    "glba_501",
    "us_code_1681",
    "tila_226",
    "fcra_611",
    "a b c d",
    "paid to",
    "section_1692 and section_12",
    "well-known",
    "us_code_12_2605",
    "part_1006.14b rule",
    "cost [num] now",
)
ORACLES["clean_planted"] = f"""
SELECT doc_id AS sample_id, ([{_quoted(_ENDINGS)}])[CAST(doc_id % {len(_ENDINGS)} + 1 AS INTEGER)] AS ending
FROM documents"""
ORACLES["surrogate_id"] = """
SELECT doc_id, lang, row_number() OVER (ORDER BY md5('25:' || doc_id), doc_id) - 1 AS sample_id FROM documents"""
ORACLES["coalesce_text"] = """
SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality_text
FROM documents LEFT JOIN labels USING (doc_id)"""
ORACLES["topic_label"] = _with(GIVEN) + "SELECT vec_id, 'T' || topic AS label FROM given"
ORACLES["filter_not_null"] = """
SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL"""
ORACLES["filter_min_length"] = _with(COMPLAINTS, VALID) + """
SELECT sample_id, CAST(length(consumer_complaint_narrative) AS INTEGER) AS n_chars FROM valid"""
ORACLES["filter_non_blank"] = (
    f"SELECT conv_id, turn FROM conversations WHERE {_clean('text', C.rules_v2(), True)} <> ''"
)
ORACLES["drop_nulls"] = """
SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NOT NULL"""
ORACLES["stream_clean"] = f"""
SELECT * FROM (SELECT doc_id, {_clean('text', C.rules_v2(), True)} AS text_clean FROM documents WHERE length(text) > 50)
WHERE text_clean <> ''"""

# Profiles
SIZES = "sizes AS (SELECT topic, count(*) AS n_docs FROM given WHERE topic <> -1 GROUP BY topic)"
ORACLES["topic_sizes"] = _with(GIVEN, SIZES) + "SELECT topic, n_docs FROM sizes"
ORACLES["topic_distribution"] = _with(GIVEN, SIZES) + "SELECT topic, 'T' || topic AS label, n_docs FROM sizes"
ORACLES["filter_audit"] = """
SELECT count(*) AS rows_total, count(text) AS rows_with_text,
       count(*) FILTER (length(text) > 50) AS rows_long_enough FROM documents"""
ORACLES["stratum_counts"] = _with(COMPLAINTS, VALID) + """
SELECT product, count(*) AS pop FROM valid GROUP BY product ORDER BY pop DESC, product"""
ORACLES["distinct_strata"] = _with(COMPLAINTS, VALID) + "SELECT count(DISTINCT product) AS n_distinct FROM valid"
ORACLES["issue_counts"] = _with(COMPLAINTS, VALID) + """
SELECT product, issue, count(*) AS pop FROM valid GROUP BY product, issue"""
ORACLES["event_counts"] = "SELECT event_type, count(*) AS pop FROM events GROUP BY event_type"
ORACLES["largest_stratum"] = _with(COMPLAINTS, VALID) + """
SELECT product, count(*) AS pop FROM valid GROUP BY product ORDER BY pop DESC, product DESC LIMIT 1"""
ORACLES["topic_size_stats"] = _with(GIVEN, SIZES) + """
SELECT min(n_docs) AS min_size, max(n_docs) AS max_size, round(avg(n_docs), 6) AS mean_size,
       round(quantile_cont(n_docs, 0.5), 6) AS median_size,
       count(*) FILTER (n_docs < 100) AS n_small, count(*) FILTER (n_docs > 1000) AS n_large FROM sizes"""
ORACLES["topic_summary"] = _with(GIVEN) + """
SELECT count(DISTINCT topic) FILTER (topic <> -1) AS n_topics,
       round(avg(CASE WHEN topic = -1 THEN 1.0 ELSE 0.0 END), 6) AS noise_ratio, count(*) AS n_docs FROM given"""
ORACLES["topic_assignment_profile"] = _with(GIVEN) + """
SELECT count(*) AS n_rows, count(DISTINCT topic) FILTER (topic <> -1) AS n_topics,
       bool_or(topic = -1) AS has_noise, count(*) FILTER (topic IS NULL) AS n_null,
       count(*) > 0 AND count(*) FILTER (topic IS NULL) = 0 AS is_valid,
       (SELECT string_agg(topic, ',' ORDER BY vec_id) FROM (SELECT vec_id, topic FROM given ORDER BY vec_id LIMIT 5))
         AS first_topics FROM given"""
ORACLES["embedding_health"] = """
SELECT count(*) AS n_rows, CAST(min(len(embedding)) AS INTEGER) AS min_dim, CAST(max(len(embedding)) AS INTEGER) AS max_dim,
       bool_or(len(list_filter(embedding, lambda x: isnan(x))) > 0) AS any_nan,
       bool_or(len(list_filter(embedding, lambda x: isinf(x))) > 0) AS any_inf,
       round(min(CAST(list_min(embedding) AS DOUBLE)), 6) AS min_value,
       round(max(CAST(list_max(embedding) AS DOUBLE)), 6) AS max_value,
       count(DISTINCT embedding) = 1 AS all_identical FROM embeddings"""
LONG = """long AS (SELECT vec_id, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS x
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i))"""
ORACLES["embedding_variance"] = _with(LONG) + """
SELECT CAST(dim AS INTEGER) AS dim, round(var_pop(x), 9) AS variance, round(min(x), 6) AS min_value, round(max(x), 6) AS max_value,
       var_pop(x) < 1e-10 AS is_constant FROM long GROUP BY dim"""
ORACLES["embedding_norms"] = _with(GIVEN) + """
SELECT round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, bool_and(abs(n - 1) <= 1e-8 + 1e-5) AS all_unit
FROM (SELECT sqrt(list_dot_product(v, v)) AS n FROM given)"""
ORACLES["length_distribution"] = f"""
WITH w AS (SELECT CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS INTEGER) AS words FROM documents)
SELECT count(*) AS n_docs, min(words) AS min_words, max(words) AS max_words, round(avg(words), 6) AS mean_words,
       round(quantile_cont(words, 0.25), 6) AS q1_words, round(quantile_cont(words, 0.5), 6) AS median_words,
       round(quantile_cont(words, 0.75), 6) AS q3_words FROM w"""
ORACLES["topic_product_crosstab"] = _with(COMPLAINTS, GIVEN, TOPIC_DOCS) + """
SELECT topic, product, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY topic), 6) AS share
FROM topic_docs GROUP BY topic, product"""
ORACLES["topic_purity"] = _with(
    COMPLAINTS,
    GIVEN,
    TOPIC_DOCS,
    "cells AS (SELECT topic, product, count(*) AS n FROM topic_docs GROUP BY ALL)",
    "total AS (SELECT sum(n)::DOUBLE AS n FROM cells)",
    "t AS (SELECT topic, sum(n) AS n, max(n) AS top FROM cells GROUP BY topic)",
    "p AS (SELECT product, sum(n) AS n FROM cells GROUP BY product)",
    """mi AS (SELECT sum(c.n / total.n * ln(c.n * total.n / (t.n * p.n))) AS v
      FROM cells c JOIN t USING (topic) JOIN p USING (product), total)""",
    "ht AS (SELECT -sum(t.n / total.n * ln(t.n / total.n)) AS v FROM t, total)",
    "hp AS (SELECT -sum(p.n / total.n * ln(p.n / total.n)) AS v FROM p, total)",
) + """
SELECT CAST(total.n AS BIGINT) AS n_docs, round((SELECT sum(top) FROM t) / total.n, 6) AS purity,
       round(2 * mi.v / (ht.v + hp.v), 6) AS nmi FROM total, mi, ht, hp"""


# Samples
def _strata(counts: str, o: SampleOptions) -> list[str]:
    """CTEs ``strata(stratum, pop, quota)`` and ``fine(stratum, substratum, pop, quota)``."""
    return [
        "pops AS (SELECT stratum, sum(pop)::BIGINT AS pop FROM counts GROUP BY stratum)",
        f"""budget AS (SELECT {o.total} - coalesce(sum(pop) FILTER (pop <= {o.min_per_stratum}), 0)
            - {o.min_per_stratum} * count(*) FILTER (pop > {o.min_per_stratum}) AS remaining,
            sum(pop) FILTER (pop > {o.min_per_stratum}) AS large FROM pops)""",
        f"""strata AS (SELECT stratum, pop, CASE WHEN pop <= {o.min_per_stratum} THEN pop::DOUBLE
            ELSE least({o.min_per_stratum} + least(remaining * (pop / large::DOUBLE), {o.total * o.max_share}), pop) END AS quota
            FROM pops, budget)""",
        "top AS (SELECT stratum, quota FROM strata ORDER BY pop DESC, stratum DESC LIMIT 1)",
        f"""inner_counts AS (SELECT c.*, top.quota AS target, sum(c.pop) OVER () AS total, count(*) OVER () AS n
            FROM counts c JOIN top USING (stratum) WHERE top.quota > {2 * o.min_per_substratum})""",
        f"""first AS (SELECT stratum, substratum, pop, target,
            CASE WHEN target - n * {o.min_per_substratum} < 0 THEN greatest(1.0, floor(target * (pop / total)))
                 ELSE least({o.min_per_substratum} + (target - n * {o.min_per_substratum}) * (pop / total), pop) END AS quota
            FROM inner_counts)""",
        """gaps AS (SELECT *, target - sum(quota) OVER () AS gap FROM first)""",
        """room AS (SELECT *, CASE WHEN gap > 0 THEN pop - quota ELSE quota END AS room FROM gaps)""",
        """taken AS (SELECT *, coalesce(sum(room) OVER (ORDER BY pop DESC, substratum DESC NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM room)""",
        """fine AS (SELECT stratum, substratum, pop, quota + CASE WHEN abs(gap) < 1e-6 THEN 0 ELSE
             sign(gap) * greatest(least(abs(gap) - before, room), 0) END AS quota FROM taken)""",
        """parted AS (SELECT stratum, true AS split, substratum, pop, quota, 'issue_stratified' AS sampling_stage FROM fine
             UNION ALL SELECT stratum, false, NULL, pop, quota, 'product_stratified' FROM strata
             WHERE stratum NOT IN (SELECT stratum FROM fine))""",
        """downs AS (SELECT *, floor(quota + 1e-6) AS down FROM parted WHERE quota > 0)""",
        """cells AS (SELECT *, down + CASE WHEN down < pop AND row_number() OVER (ORDER BY round(quota - down, 6) DESC,
             stratum NULLS FIRST, split, substratum NULLS FIRST) <= round(sum(quota) OVER ()) - sum(down) OVER ()
             THEN 1 ELSE 0 END AS take FROM downs)""",
    ]


ORDER_COUNTS = """counts AS (SELECT o_orderpriority AS stratum, o_orderstatus AS substratum, count(*) AS pop
  FROM orders GROUP BY ALL)"""
DOC_COUNTS = "counts AS (SELECT product AS stratum, issue AS substratum, count(*) AS pop FROM valid GROUP BY ALL)"
ORACLES["allocate_strata"] = _with(ORDER_COUNTS, *_strata("counts", Q.ORDER_SAMPLE)) + """
SELECT stratum, pop, round(quota, 6) AS quota FROM strata ORDER BY quota DESC, stratum"""
ORACLES["allocate_substrata"] = _with(ORDER_COUNTS, *_strata("counts", Q.ORDER_SAMPLE)) + """
SELECT stratum, substratum, pop, round(quota, 6) AS quota FROM fine"""
ORACLES["capped_sample"] = """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('25:' || o_orderkey), o_orderkey LIMIT 1000"""


def _chance(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0)"


ORACLES["bernoulli_sample"] = f"""
SELECT o_orderkey, o_orderpriority FROM orders
WHERE {_chance('o_orderkey', Q.BERNOULLI_SEED)} < {Q.BERNOULLI_FRACTION}
ORDER BY md5('{Q.BERNOULLI_SEED}:' || o_orderkey), o_orderkey LIMIT {Q.BERNOULLI_CAP}"""
_DOC_CELLS = (COMPLAINTS, VALID, DOC_COUNTS, *_strata("counts", Q.DOCUMENT_SAMPLE))
_DOC_PLACED = """placed AS (SELECT v.*, c.pop, c.quota, c.take, c.sampling_stage, c.split FROM valid v JOIN cells c
  ON c.stratum = v.product AND (NOT c.split OR c.substratum IS NOT DISTINCT FROM v.issue))"""
_DOC_SAMPLE = """ranked AS (SELECT *, row_number() OVER (PARTITION BY product, CASE WHEN split THEN issue END
  ORDER BY md5('25:' || sample_id), sample_id) AS rn FROM placed),
sampled AS (SELECT * FROM ranked WHERE rn <= take)"""
ORACLES["stratified_sample_bernoulli"] = _with(*_DOC_CELLS, _DOC_PLACED) + f"""
SELECT sample_id, product, issue, sampling_stage FROM placed
WHERE quota >= pop OR {_chance('sample_id', 25)} < quota / pop"""
ORACLES["stratified_sample_exact"] = _with(*_DOC_CELLS, _DOC_PLACED, _DOC_SAMPLE) + """
SELECT sample_id, product, issue, sampling_stage FROM sampled"""
ORACLES["sample_sink"] = _with(*_DOC_CELLS, _DOC_PLACED, _DOC_SAMPLE) + f"""
SELECT sample_id, nullif({_clean('consumer_complaint_narrative', C.rules_v2(), True)}, '') AS text_clean, product, issue, date_received
FROM sampled"""
ORACLES["stratified_sample_orders"] = _with(ORDER_COUNTS, *_strata("counts", Q.ORDER_SAMPLE)) + """
SELECT o_orderkey, o_orderpriority, o_orderstatus, sampling_stage FROM (
  SELECT o.*, c.take, c.sampling_stage, row_number() OVER (
    PARTITION BY o_orderpriority, CASE WHEN c.split THEN o_orderstatus END
    ORDER BY md5('25:' || o_orderkey), o_orderkey) AS rn
  FROM orders o JOIN cells c ON c.stratum = o_orderpriority AND (NOT c.split OR c.substratum = o_orderstatus))
WHERE rn <= take"""
ORACLES["union_parts"] = """
SELECT doc_id, lang, 'issue_stratified' AS sampling_stage FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, lang, 'product_stratified' FROM documents"""

# Terms
ORACLES["tokenize"] = f"""
SELECT doc_id AS sample_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)"""
ORACLES["remove_stopwords"] = f"""
SELECT doc_id AS sample_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {_tokens('text', STOP)} AS t FROM documents)"""


def _lemma(word: str) -> str:
    cases = [f"WHEN length({word}) < 4 OR regexp_matches({word}, '{K.UNCHANGED_ENDINGS}') OR {word} IN ({_quoted(K.UNCHANGED_WORDS)}) THEN {word}"]
    for ending, replacement in K.NOUN_ENDINGS:
        cases.append(
            f"WHEN ends_with({word}, '{ending}') THEN {word}[:length({word}) - {len(ending)}] || '{replacement}'"
        )
    return f"CASE {' '.join(cases)} ELSE {word} END"


ORACLES["lemmatize"] = f"""
SELECT doc_id AS sample_id, array_to_string(list_transform(
  regexp_extract_all(lower(text), '[^ \\t\\n\\x0B\\f\\r]+'), lambda w: {_lemma('w')}), ' ') AS text_lemma FROM documents"""
ORACLES["stopword_union"] = f"""
WITH words AS (SELECT unnest([{_quoted(ENGLISH)}]) AS word UNION SELECT unnest([{_quoted(K.EXTRA_STOP_WORDS)}])),
used AS (SELECT word, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS word FROM documents) GROUP BY word)
SELECT word, coalesce(n, 0) AS n FROM words LEFT JOIN used USING (word)"""


def _terms(o: VocabularyOptions, relation: str, columns: str, text: str) -> list[str]:
    """CTE ``terms``: one row per term occurrence with the given columns."""
    grams = "t" if o.ngram_max == 1 else "t || list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])"
    return [
        f"toks AS (SELECT {columns}, {_tokens(text, STOP)} AS t FROM {relation})",
        f"grams AS (SELECT {columns}, {grams} AS g FROM toks)",
        f"terms AS (SELECT {columns}, unnest(g) AS term FROM grams)",
    ]


ORACLES["ngrams"] = _with(*_terms(Q.BIGRAMS, "documents", "doc_id", "text")) + """
SELECT doc_id AS sample_id, CAST(len(g) AS INTEGER) AS n_terms, array_to_string(g, '|') AS terms FROM grams"""
_FREQUENCIES = [
    *_terms(Q.BIGRAMS, "documents", "doc_id", "text"),
    "tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL)",
    f"""pruned AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM tf GROUP BY term
      HAVING count(*) >= {Q.BIGRAMS.min_df} AND count(*) <= {Q.BIGRAMS.max_df} * (SELECT count(*) FROM documents))""",
    f"vocab AS (SELECT * FROM pruned ORDER BY tf DESC, term LIMIT {Q.BIGRAMS.max_features})",
]
ORACLES["df_filter"] = _with(*_FREQUENCIES) + "SELECT term, df FROM pruned"
ORACLES["vocabulary"] = _with(*_FREQUENCIES) + "SELECT term, tf, df FROM vocab"
ORACLES["term_counts"] = _with(*_FREQUENCIES) + """
SELECT doc_id AS sample_id, term, tf.tf FROM tf SEMI JOIN vocab USING (term)"""

# Vectors
_D = Q.DIMENSIONS
_HASHED = f"""hashed AS (SELECT doc_id, pos, CAST(('0x' || substr(md5(token), 1, 8))::BIGINT % {_D} AS INTEGER) AS bucket,
    CASE WHEN ('0x' || substr(md5(token), 9, 1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS sign
  FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos
        FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)))"""
_GRID = f"grid AS (SELECT doc_id, CAST(d AS INTEGER) AS dim FROM documents, range({_D}) AS r(d))"
ORACLES["hash_embed"] = _with(
    _HASHED,
    _GRID,
    "sums AS (SELECT doc_id, bucket, sum(sign) AS s FROM hashed GROUP BY ALL)",
    "lengths AS (SELECT doc_id, sqrt(sum(s * s)) AS l FROM sums GROUP BY doc_id)",
) + """
SELECT g.doc_id AS sample_id, g.dim, round(coalesce(CASE WHEN l > 0 THEN s / l END, 0), 6) + 0.0 AS x
FROM grid g LEFT JOIN sums s ON s.doc_id = g.doc_id AND s.bucket = g.dim LEFT JOIN lengths n ON n.doc_id = g.doc_id"""
ORACLES["chunk_mean_embed"] = _with(
    _HASHED,
    _GRID,
    f"sums AS (SELECT doc_id, pos // {Q.CHUNK_TOKENS} AS chunk, bucket, sum(sign) AS s FROM hashed GROUP BY ALL)",
    "lengths AS (SELECT doc_id, chunk, sqrt(sum(s * s)) AS l FROM sums GROUP BY ALL)",
    "n AS (SELECT doc_id, count(*) AS n FROM lengths GROUP BY doc_id)",
    """added AS (SELECT doc_id, bucket, sum(s / l) AS s FROM sums JOIN lengths USING (doc_id, chunk) WHERE l > 0
      GROUP BY doc_id, bucket)""",
) + """
SELECT g.doc_id AS sample_id, g.dim, round(coalesce(a.s / n.n, 0), 6) + 0.0 AS x
FROM grid g LEFT JOIN added a ON a.doc_id = g.doc_id AND a.bucket = g.dim LEFT JOIN n ON n.doc_id = g.doc_id"""


def _projection() -> str:
    dimensions, components, seed = Q.PROJECTION
    rows = [
        f"({c}, [{', '.join(str(float(projection_sign(seed, c, d))) for d in range(dimensions))}]::DOUBLE[])"
        for c in range(components)
    ]
    return _with(GIVEN, f"matrix(dim, signs) AS (VALUES {', '.join(rows)})") + f"""
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(list_dot_product(v, signs) / sqrt({components}::DOUBLE), 6) + 0.0 AS x
FROM given, matrix"""


ORACLES["random_projection"] = _projection()


def _near(k: int, unit: bool) -> list[str]:
    vector = "list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))" if unit else "v"
    return [
        GIVEN,
        f"vecs AS (SELECT vec_id AS id, {vector} AS v FROM given)",
        """dists AS (SELECT a.id AS src, b.id AS dst, round(list_distance(a.v, b.v), 9) AS dist
           FROM vecs a JOIN vecs b ON a.id <> b.id)""",
        f"""near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM dists)
           WHERE rank <= {k})""",
    ]


ORACLES["knn_cosine"] = _with(*_near(Q.NEIGHBOURS, True)) + """
SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(1 - dist * dist / 2, 6) + 0.0 AS similarity FROM near"""
ORACLES["fuzzy_graph"] = _with(
    *_near(Q.FUZZY_NEIGHBOURS, True),
    "spread AS (SELECT src, dst, dist * dist / 2 AS dist FROM near)",
    """local AS (SELECT src, list(dist ORDER BY dist, dst) AS ds, coalesce(min(dist) FILTER (dist > 0), 0) AS rho
       FROM spread GROUP BY src)""",
    f"""bisect AS (SELECT src, ds, rho, 0 AS step, 0.0::DOUBLE AS lo, list_min(list_filter(
         list_transform(range(65), lambda e: 2.0::DOUBLE ** e), lambda h: list_sum(list_transform(ds, lambda d:
           CASE WHEN d - rho <= 0 THEN 1.0::DOUBLE ELSE exp(-(d - rho) / h) END)) >= ln({Q.FUZZY_NEIGHBOURS}) / ln(2))) AS hi
       FROM local
       UNION ALL SELECT src, ds, rho, step + 1, CASE WHEN s > ln({Q.FUZZY_NEIGHBOURS}) / ln(2) THEN lo ELSE (lo + hi) / 2 END,
         CASE WHEN s > ln({Q.FUZZY_NEIGHBOURS}) / ln(2) THEN (lo + hi) / 2 ELSE hi END
       FROM (SELECT *, list_sum(list_transform(ds, lambda d: CASE WHEN d - rho <= 0 THEN 1.0::DOUBLE
               ELSE exp(-(d - rho) / ((lo + hi) / 2)) END)) AS s FROM bisect WHERE step < 64))""",
    "scaled AS (SELECT src, rho, greatest(hi, 1e-9) AS sigma FROM bisect WHERE step = 64)",
    """directed AS (SELECT src, dst, CASE WHEN dist - rho <= 0 THEN 1.0 ELSE exp(-(dist - rho) / sigma) END AS w
       FROM spread JOIN scaled USING (src))""",
    """sides AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst,
         coalesce(max(w) FILTER (src < dst), 0) AS a, coalesce(max(w) FILTER (src > dst), 0) AS b
       FROM directed GROUP BY 1, 2)""",
    recursive=True,
).replace("GROUP BY 1, 2)", "GROUP BY least(src, dst), greatest(src, dst))") + """
SELECT src, dst, round(a + b - a * b, 6) AS weight FROM sides"""

_CORE = [
    *_near(Q.CLUSTERS.min_samples - 1, False),
    f"cores AS (SELECT src AS id, dist AS core FROM near WHERE rank = {Q.CLUSTERS.min_samples - 1})",
]
ORACLES["core_distance"] = _with(*_CORE) + "SELECT id, round(core, 6) AS core FROM cores"
ORACLES["mutual_reachability"] = _with(*_CORE) + """
SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, round(greatest(dist, a.core, b.core), 6) AS w
FROM near JOIN cores a ON a.id = src JOIN cores b ON b.id = dst"""
_REACH = "reach AS (SELECT src, dst, greatest(dist, a.core, b.core) AS w FROM dists JOIN cores a ON a.id = src JOIN cores b ON b.id = dst)"
ORACLES["density_components"] = _with(
    *_CORE,
    _REACH,
    f"linked AS MATERIALIZED (SELECT src, dst FROM reach WHERE w <= {Q.CLUSTERS.epsilon})",
    """labelled AS (SELECT id AS node, id AS label FROM vecs
       UNION SELECT l.dst, p.label FROM labelled p JOIN linked l ON l.src = p.node WHERE p.label < l.dst)""",
    "named AS (SELECT node, min(label) AS label FROM labelled GROUP BY node)",
    "sized AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM named)",
    recursive=True,
) + f"""
SELECT node AS id, CASE WHEN n >= {Q.CLUSTERS.min_cluster_size} THEN label ELSE -1 END AS component FROM sized"""
# Prim's tree: the state is the list of rows outside the tree, each with its least edge.
_PRIM = (
    """adjacent AS MATERIALIZED (SELECT src, list({'w': w, 'lo': least(src, dst), 'hi': greatest(src, dst), 'node': dst}
         ORDER BY dst) AS edges FROM reach GROUP BY src)""",
    "start AS (SELECT min(src) AS s FROM adjacent)",
    """prim AS (
       SELECT s AS node, (SELECT edges FROM adjacent WHERE src = s) AS best,
              NULL::STRUCT(w DOUBLE, lo BIGINT, hi BIGINT, node BIGINT) AS pick FROM start
       UNION ALL
       SELECT pick.node, list_transform(list_filter(best, lambda b: b.node <> pick.node),
                lambda b: CASE WHEN e[b.node] < b THEN e[b.node] ELSE b END), pick
       FROM (SELECT p.best, list_min(p.best) AS pick FROM prim p WHERE len(p.best) > 0)
       JOIN (SELECT src, map_from_entries(list_transform(edges, lambda x: {'k': x.node, 'v': x})) AS e FROM adjacent)
         ON src = pick.node)""",
)
ORACLES["mst_edges"] = (
    _with(*_CORE, _REACH, *_PRIM, recursive=True)
    + "SELECT pick.lo AS src, pick.hi AS dst, round(pick.w, 6) AS w FROM prim WHERE pick IS NOT NULL"
)
# The hierarchy: one merge a step, of which the last step of each weight is a level.
_HIERARCHY = (
    "tree AS MATERIALIZED (SELECT pick.lo AS lo, pick.hi AS hi, pick.w AS w FROM prim WHERE pick IS NOT NULL)",
    "numbered AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM vecs)",
    """ordered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY w, lo, hi) AS k, w, a.pos AS a, b.pos AS b
       FROM tree JOIN numbered a ON a.id = lo JOIN numbered b ON b.id = hi)""",
    """merging AS (
       SELECT 0::BIGINT AS k, (SELECT list(pos ORDER BY pos) FROM numbered) AS labels
       UNION ALL
       SELECT o.k, list_transform(labels, lambda l: CASE WHEN l = greatest(labels[a], labels[b])
                THEN least(labels[a], labels[b]) ELSE l END) FROM merging m JOIN ordered o ON o.k = m.k + 1)""",
    "heights AS (SELECT row_number() OVER (ORDER BY w) AS level, w, max(k) AS k FROM ordered GROUP BY w)",
    "floor AS (SELECT coalesce(min(w) FILTER (w > 0), 1) / 2 AS f FROM tree)",
    """placed AS MATERIALIZED (SELECT level, w, unnest(labels) AS rep, unnest(range(1, len(labels) + 1)) AS pos
       FROM merging JOIN heights USING (k))""",
    f"""large AS MATERIALIZED (SELECT level, w, rep, count(*) AS n FROM placed GROUP BY ALL
       HAVING count(*) >= {Q.CLUSTERS.min_cluster_size})""",
    """linked AS MATERIALIZED (SELECT c.level, c.rep, c.n, c.w, p.rep AS up
       FROM large c LEFT JOIN placed p ON p.level = c.level + 1 AND p.pos = c.rep)""",
    """merged AS MATERIALIZED (SELECT l.level, l.rep, l.n, l.w, l.up, count(c.rep) AS n_large, coalesce(sum(c.n), 0) AS held,
         min(c.rep) AS only
       FROM linked l LEFT JOIN linked c ON c.level = l.level - 1 AND c.up = l.rep GROUP BY ALL)""",
    """named AS (  -- a cluster has the name of the component it starts with
       SELECT level, rep, up, rep AS c_rep, n AS c_n FROM merged WHERE n_large <> 1
       UNION ALL
       SELECT m.level, m.rep, m.up, c_rep, c_n FROM named x JOIN merged m ON m.level = x.level + 1 AND m.rep = x.up
       WHERE m.n_large = 1)""",
    """summed AS (SELECT c_rep, c_n, sum((CASE WHEN n_large = 1 THEN n - held ELSE n END) / greatest(w, f)) AS lam,
         coalesce(max(w) FILTER (n_large > 1), -1) AS split
       FROM named JOIN merged USING (level, rep), floor GROUP BY ALL)""",
    """born AS (SELECT x.c_rep, x.c_n, c.n AS size, p.w AS birth, p.rep AS p_rep, p.n AS p_n
       FROM named x JOIN merged c USING (level, rep) JOIN merged p ON p.level = c.level + 1 AND p.rep = c.up WHERE p.n_large > 1)""",
    """clusters AS MATERIALIZED (SELECT row_number() OVER (ORDER BY split, c_rep, c_n) AS i, c_rep, c_n, split, size, p_rep, p_n,
         lam - size / greatest(birth, f) AS own FROM summed LEFT JOIN born USING (c_rep, c_n), floor)""",
    """kin AS MATERIALIZED (SELECT c.i, c.own, c.split, c.size, c.c_rep, c.c_n, p.i AS parent
       FROM clusters c LEFT JOIN clusters p ON p.c_rep = c.p_rep AND p.c_n = c.p_n)""",
    """weighed AS (  -- from the leaves up; the state is the best choice below each cluster
       SELECT 0::BIGINT AS i, (SELECT list_transform(list(i), lambda x: 0.0::DOUBLE) FROM kin) AS inside, false AS keeps
       UNION ALL
       SELECT i, list_transform(inside, lambda x, nr: CASE WHEN nr <> coalesce(parent, 0) THEN x
                WHEN own >= below * (1 - 1e-9) THEN x + own ELSE x + below END), coalesce(own >= below * (1 - 1e-9), false)
       FROM (SELECT k.*, x.inside, x.inside[k.i] AS below FROM weighed x JOIN kin k ON k.i = x.i + 1))""",
    f"""labelled AS (
       SELECT i, NULL::BIGINT AS label FROM kin WHERE parent IS NULL
       UNION ALL
       SELECT k.i, coalesce(label, CASE WHEN keeps OR split <= {Q.CLUSTERS.epsilon} THEN k.i END)
       FROM labelled l JOIN kin k ON k.parent = l.i JOIN weighed w ON w.i = k.i)""",
    """topics AS (SELECT c_rep, c_n, t.topic FROM labelled JOIN kin USING (i) JOIN (
       SELECT i AS label, row_number() OVER (ORDER BY size DESC, c_rep, c_n) - 1 AS topic FROM kin
       WHERE i IN (SELECT label FROM labelled)) t USING (label))""",
    """entered AS MATERIALIZED (SELECT id, min(level) AS level FROM placed JOIN large USING (level, rep) JOIN numbered USING (pos) GROUP BY id)""",
    """dropped AS MATERIALIZED (SELECT id, level, w AS height, c_rep, c_n FROM entered JOIN numbered USING (id)
       JOIN placed USING (level, pos) JOIN named USING (level, rep))""",
)
ORACLES["hdbscan_levels"] = _with(*_CORE, _REACH, *_PRIM, *_HIERARCHY, recursive=True) + """
SELECT id, coalesce(topic, -1)::INTEGER AS topic FROM vecs LEFT JOIN dropped USING (id) LEFT JOIN topics USING (c_rep, c_n)"""

CENTROIDS = """centroids AS (SELECT topic, list(x ORDER BY dim) AS c FROM (
    SELECT topic, dim, avg(v[dim]) AS x FROM given, range(1, 65) AS r(dim) WHERE topic <> -1 GROUP BY topic, dim)
  GROUP BY topic)"""
PROBABILITIES = """closeness AS (SELECT vec_id, given.topic AS given_topic, c.topic, 1 / greatest(list_distance(v, c.c), 1e-9) AS s
  FROM given, centroids c),
probabilities AS (SELECT vec_id, given_topic, topic, s / sum(s) OVER (PARTITION BY vec_id) AS prob FROM closeness),
best AS (SELECT vec_id, max(prob) AS max_probability, max(prob) FILTER (topic = given_topic) AS assigned_probability
  FROM probabilities GROUP BY vec_id)"""
ORACLES["topic_probabilities"] = _with(GIVEN, CENTROIDS, PROBABILITIES) + """
SELECT vec_id, topic, round(prob, 6) AS prob FROM probabilities"""
ORACLES["topic_probability"] = _with(GIVEN, CENTROIDS, PROBABILITIES) + """
SELECT vec_id, round(max_probability, 6) AS max_probability, round(assigned_probability, 6) AS assigned_probability FROM best"""
ORACLES["attach_topics"] = _with(COMPLAINTS, GIVEN, CENTROIDS, PROBABILITIES) + """
SELECT sample_id, product, issue, g.topic, round(max_probability, 6) AS topic_probability
FROM complaints LEFT JOIN given g ON g.vec_id = sample_id LEFT JOIN best b ON b.vec_id = sample_id"""
ORACLES["clustered_sink"] = _with(COMPLAINTS, GIVEN, CENTROIDS, PROBABILITIES) + """
SELECT sample_id, product, issue, g.topic, round(max_probability, 6) AS topic_probability
FROM complaints JOIN given g ON g.vec_id = sample_id % (SELECT count(*) FROM embeddings) JOIN best b ON b.vec_id = g.vec_id"""
ORACLES["topic_similarity"] = _with(GIVEN, CENTROIDS) + """
SELECT a.topic AS topic_a, b.topic AS topic_b, round(list_cosine_similarity(a.c, b.c), 6) + 0.0 AS similarity
FROM centroids a, centroids b"""

# Topics
_DOCS = (COMPLAINTS, GIVEN, TOPIC_DOCS)


def _weights(relation: str, name: str = "") -> list[str]:
    """CTEs ``tt``, ``idf`` and ``weights`` for documents with topics."""
    return [
        *_terms(Q.UNIGRAMS, relation, "sample_id, topic, date_received", "consumer_complaint_narrative"),
        "tt AS MATERIALIZED (SELECT topic, term, count(*) AS tf FROM terms GROUP BY ALL)",
        "average AS (SELECT sum(tf) / count(DISTINCT topic)::DOUBLE AS a FROM tt)",
        "idf AS MATERIALIZED (SELECT term, ln(1 + a / sum(tf)) AS idf FROM tt, average GROUP BY term, a)",
        """weights AS MATERIALIZED (SELECT topic, term, tf / sum(tf) OVER (PARTITION BY topic)::DOUBLE * idf AS weight
           FROM tt JOIN idf USING (term))""",
        "ranked_words AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM weights)",
        "doc_sizes AS (SELECT topic, count(*) AS n_docs FROM " + relation + " WHERE topic <> -1 GROUP BY topic)",
    ]


_W = (*_DOCS, *_weights("topic_docs"))
ORACLES["relabel_by_size"] = _with(
    GIVEN, SIZES, "renamed AS (SELECT topic, row_number() OVER (ORDER BY n_docs DESC, topic) - 1 AS new_topic FROM sizes)"
) + """
SELECT vec_id, CAST(coalesce(new_topic, -1) AS INTEGER) AS topic FROM given LEFT JOIN renamed USING (topic)"""
ORACLES["c_tf_idf"] = _with(*_W) + "SELECT topic, term, round(weight, 9) AS weight FROM weights"
_WORDS = "SELECT topic, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS weight FROM ranked_words WHERE rank <= 10"
ORACLES["topic_words"] = _with(*_W) + _WORDS


def _info(relation: str) -> str:
    return f"""
SELECT s.topic, s.count, s.topic || '_' || array_to_string(w[1:4], '_') AS name, array_to_string(w, ', ') AS representation
FROM (SELECT topic, count(*) AS count FROM {relation} GROUP BY topic) s
JOIN (SELECT topic, list(term ORDER BY rank) AS w FROM ranked_words WHERE rank <= 10 GROUP BY topic) r USING (topic)
ORDER BY s.count DESC, s.topic"""


ORACLES["topic_info"] = _with(*_W) + _info("topic_docs")
ORACLES["cluster_sizes_keywords"] = _with(*_W) + """
SELECT topic, n_docs, keywords FROM doc_sizes JOIN
  (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS keywords FROM ranked_words WHERE rank <= 3 GROUP BY topic) USING (topic)
ORDER BY n_docs DESC, topic LIMIT 10"""
ORACLES["topic_barchart_data"] = _with(*_W) + """
SELECT topic, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS weight FROM ranked_words
SEMI JOIN (SELECT topic FROM doc_sizes ORDER BY n_docs DESC, topic LIMIT 5) USING (topic) WHERE rank <= 5"""
ORACLES["topics_over_time"] = _with(
    *_W,
    "span AS (SELECT min(date_received) AS d0, (max(date_received) - min(date_received)) / 20.0::DOUBLE AS width FROM topic_docs)",
    """binned AS (SELECT sample_id, topic, CAST(least(floor((date_received - d0) / width), 19) AS INTEGER) AS bin,
         d0, width FROM topic_docs, span)""",
    "bt AS (SELECT t.topic, bin, term, count(*) AS tf FROM terms t JOIN binned b USING (sample_id) WHERE t.topic <> -1 GROUP BY ALL)",
    """bw AS (SELECT topic, bin, term, row_number() OVER (PARTITION BY topic, bin ORDER BY w DESC, term) AS rank FROM (
         SELECT topic, bin, term, tf / sum(tf) OVER (PARTITION BY topic, bin)::DOUBLE * idf AS w FROM bt JOIN idf USING (term)))""",
    "words AS (SELECT topic, bin, string_agg(term, ', ' ORDER BY rank) AS words FROM bw WHERE rank <= 5 GROUP BY topic, bin)",
    """freq AS (SELECT topic, bin, any_value(d0) + CAST(floor(bin * any_value(width)) AS INTEGER) AS bin_start, count(*) AS frequency
       FROM binned WHERE topic <> -1 GROUP BY topic, bin)""",
) + """
SELECT topic, bin, CAST(bin_start AS DATE) AS bin_start, frequency, coalesce(words, '') AS words FROM freq LEFT JOIN words USING (topic, bin)"""
_LENGTHS = [
    "topic_length AS (SELECT topic, sqrt(sum(weight * weight)) AS l FROM weights WHERE topic <> -1 GROUP BY topic)",
]
_MOVED = [
    *_LENGTHS,
    "dt AS MATERIALIZED (SELECT sample_id, term, count(*) * any_value(idf) AS w FROM terms JOIN idf USING (term) WHERE topic = -1 GROUP BY ALL)",
    "doc_length AS (SELECT sample_id, sqrt(sum(w * w)) AS l FROM dt GROUP BY sample_id)",
    """cosines AS (SELECT sample_id, t.topic, sum(w * weight) / any_value(d.l * t.l) AS score
       FROM dt JOIN weights x USING (term) JOIN topic_length t ON t.topic = x.topic JOIN doc_length d USING (sample_id) GROUP BY ALL)""",
    """moved AS (SELECT sample_id, topic AS new_topic FROM (SELECT *, row_number() OVER (
         PARTITION BY sample_id ORDER BY score DESC, topic) AS r FROM cosines) WHERE r = 1 AND score > 0)""",
]
ORACLES["reduce_outliers_ctfidf"] = _with(*_W, *_MOVED) + """
SELECT sample_id, coalesce(new_topic, topic) AS topic FROM topic_docs LEFT JOIN moved USING (sample_id)"""
ORACLES["reduce_outliers_distributions"] = _with(
    *_W,
    *_LENGTHS,
    """runs AS (SELECT sample_id, pos, unnest(t[pos:pos + 3]) AS term FROM (
         SELECT sample_id, t, unnest(range(1, greatest(len(t) - 3, 1) + 1)) AS pos FROM toks WHERE topic = -1))""",
    "rt AS MATERIALIZED (SELECT sample_id, pos, term, count(*) * any_value(idf) AS w FROM runs JOIN idf USING (term) GROUP BY ALL)",
    "run_length AS (SELECT sample_id, pos, sqrt(sum(w * w)) AS l FROM rt GROUP BY ALL)",
    "summed AS MATERIALIZED (SELECT sample_id, term, sum(w / l) AS w FROM rt JOIN run_length USING (sample_id, pos) GROUP BY ALL)",
    """sims AS (SELECT sample_id, x.topic, sum(w * weight) / any_value(t.l) AS s FROM summed
       JOIN weights x USING (term) JOIN topic_length t ON t.topic = x.topic GROUP BY ALL)""",
    "shares AS (SELECT sample_id, topic, s / sum(s) OVER (PARTITION BY sample_id) AS score FROM sims)",
    """moved AS (SELECT sample_id, topic AS new_topic FROM (SELECT *, row_number() OVER (
         PARTITION BY sample_id ORDER BY score DESC, topic) AS r FROM shares) WHERE r = 1 AND score >= 0.12)""",
) + """
SELECT sample_id, coalesce(new_topic, topic) AS topic FROM topic_docs LEFT JOIN moved USING (sample_id)"""
ORACLES["update_topics"] = _with(
    *_W,
    *_MOVED,
    "new_topics AS (SELECT sample_id, coalesce(new_topic, topic) AS topic FROM topic_docs LEFT JOIN moved USING (sample_id))",
    "ntt AS (SELECT n.topic, term, count(*) AS tf FROM terms JOIN new_topics n USING (sample_id) GROUP BY ALL)",
    "naverage AS (SELECT sum(tf) / count(DISTINCT topic)::DOUBLE AS a FROM ntt)",
    "nidf AS (SELECT term, ln(1 + a / sum(tf)) AS idf FROM ntt, naverage GROUP BY term, a)",
    """nweights AS (SELECT topic, term, tf / sum(tf) OVER (PARTITION BY topic)::DOUBLE * idf AS weight
       FROM ntt JOIN nidf USING (term))""",
    "nranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM nweights)",
) + "SELECT topic, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS weight FROM nranked WHERE rank <= 10"
_SAMPLE_CELLS = [
    *_DOCS,
    "valid AS (SELECT * FROM topic_docs WHERE length(consumer_complaint_narrative) > 50)",
    DOC_COUNTS,
    *_strata("counts", Q.DOCUMENT_SAMPLE),
    _DOC_PLACED,
    _DOC_SAMPLE,
    f"""cleaned AS (SELECT sample_id, topic, date_received, {_clean('consumer_complaint_narrative', C.rules_v2(), True)}
       AS consumer_complaint_narrative FROM sampled)""",
    "kept AS (SELECT * FROM cleaned WHERE consumer_complaint_narrative <> '')",
]
ORACLES["sampled_topic_info"] = _with(*_SAMPLE_CELLS, *_weights("kept")) + _info("kept")
