"""The extendible-hash index and what it keeps."""

import hashlib
import re

from pyspark.sql import functions as F

from themeloom.llm import exact

DOCS = "doc_id long, text string"


def test_groups(table):
    long = "x y\t" * 30000
    rows = [(5, "a  b"), (3, "a\n\tb"), (9, "a b "), (4, None), (2, ""), (None, "a b"), (None, "only"), (7, long), (7, long),
            (8, long + " z"), (6, "A b"), (1, "a b")]
    docs = table(rows, DOCS)
    found = exact.exact_duplicates(docs, capacity=2).collect()
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    expected = []
    for (key, _), text in zip(rows, plain, strict=True):
        group = [k for (k, _), t in zip(rows, plain, strict=True) if t == text]
        keep = min((k for k in group if k is not None), default=None)
        expected.append((key, keep, len(group), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(((r[0], r[1], r[2], r[4]) for r in found), key=str) == sorted(expected, key=str)
    kept = [(r.doc_id, r.text_sha256) for r in found if r.kept]
    assert sorted(kept, key=str) == sorted({(k, sha) for _, k, _, sha in expected}, key=str)  # one row a group
    rows_kept = exact.first_rows(docs, capacity=2)
    assert rows_kept.columns == docs.columns
    texts = [(r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in rows_kept.collect()]
    assert sorted(texts, key=str) == sorted(kept, key=str)
    assert exact.exact_duplicates(table([], DOCS)).count() == 0


def test_buckets_split_until_they_fit(spark):
    hashes = spark.range(4000).select(F.xxhash64("id").alias("h"))
    pointers = exact.directory(hashes, 100)
    held = {r.bucket: (r.depth, r["count"]) for r in pointers.groupBy("bucket", "depth").count().collect()}
    sizes = hashes.join(pointers, exact._slot("h") == F.col("slot")).groupBy("bucket").count().collect()
    assert sum(r["count"] for r in sizes) == 4000
    assert max(r["count"] for r in sizes) <= 100
    assert len(held) == len(sizes) > 40


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, "a")], DOCS)
    plan = exact.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_texts_of_equal_hash_stay_apart(table, monkeypatch):
    """With a hash of two values nearly all chains hold several texts; bytes tell them apart."""
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: (F.crc32(F.col(c[0]).cast("string").cast("binary")) % 2).cast("long"))
    rows = [(i, f"text {i % 40}" + " " * (i % 3)) for i in range(200)]
    index = exact.build_index(table(rows, DOCS))
    assert max(r["chain"] for r in index.entries.collect()) > 10
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_duplicates(table(rows, DOCS)).collect()}
    groups = {}
    for key, text in rows:
        groups.setdefault(re.sub(" +", " ", text), []).append(key)
    assert found == {key: (min(keys), len(keys)) for keys in groups.values() for key in keys}
