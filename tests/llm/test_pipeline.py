"""The pipeline's stages against brute force, and its queries against SQL."""

import re

import compare
import corpus_pipeline
import public_tokenizers as P
import pytest
from test_simhash import groups, plain_fingerprint

import __spark_entry__
from themeloom.llm import bpe, mixing
from themeloom.llm.catalog import QUERIES
from themeloom.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    found = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, SF)
        if name != "encoding":
            assert current.columns == docs.columns
        found[name] = current.collect()
        current = spark.createDataFrame(found[name], current.schema)
    kept = sorted(r.doc_id for r in found["language"])
    assert kept == sorted(i for i, r in rows.items() if r.text and any(c.isalpha() for c in r.text))  # all are clean
    plain = {i: re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text) for i in kept}
    first = {}
    for i in kept:
        first.setdefault(plain[i], i)
    assert sorted(r.doc_id for r in found["exact"]) == sorted(first.values())
    values = [(i, plain_fingerprint(rows[i].text)) for i in sorted(first.values())]
    near = sorted({c for c in groups(values)})
    assert sorted(r.doc_id for r in found["near"]) == near
    mixed = mixing.mix(spark.createDataFrame([rows[i] for i in near], docs.schema), corpus_pipeline.MIX)
    assert sorted(r.doc_id for r in found["mixing"]) == sorted(r.doc_id for r in mixed.select("row.doc_id").collect())
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        encoder = bpe.TextEncoder(bpe.Vocabulary.load(file.read()), P.PATTERN)
    assert sorted(map(tuple, found["encoding"])) == sorted((r.doc_id, *encoder.digest(r.text)) for r in found["mixing"])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = compare.connect("/root/testdata/sf0.01")
    assert compare.differences(QUERIES[name](spark, "/root/testdata/sf0.01"), con, ORACLES[name]) is None


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {*QUERIES, "pipeline"} <= names
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(i) for i in range(1, 14)}
