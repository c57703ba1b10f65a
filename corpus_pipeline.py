"""From raw documents to token ids: language, copies, near copies, mixture, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from themeloom.llm import bpe, exact, language, mixing, simhash  # noqa: E402
from themeloom.llm.catalog import MIX, VOCABULARY  # noqa: E402
from themeloom.plans.lineage import scratch_path  # noqa: E402


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose n-grams are known to a learnt language, in the share the learnt rows set.

    Null texts, texts without a letter, foreign scripts, noise and code go.
    Repeated rows and null keys are judged alike by their text; an empty table
    stays empty.
    """
    return language.identify(docs).where("_language.p.trusted").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, also of rows that repeat and of null keys only.

    Null texts count as empty; an empty table stays empty.
    """
    return exact.first_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHashes within 4 bits the document that names it stays.

    Four-word shingles, as in the operator's own query. Empty and null texts have
    fingerprint zero and are linked like others; null keys stay where a group
    has no other; an empty table stays empty.
    """
    groups = simhash.near_duplicates(docs)
    return _only(docs, groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, once for each epoch they are taken in, the last of a leaf cut to its budget."""
    return mixing.taken_rows(mixing.mix(docs, MIX), docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded bytes of every row of the mixture."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def _only(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    keys = chosen.select(F.col("doc_id").alias("_chosen"))
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("_chosen")), "left_semi")


STAGES = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

# A trained language model and XXH64 fingerprints are beyond SQL; the tests
# compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
