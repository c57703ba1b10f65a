"""Exact sizes, gapless slots, all rows, and the law of the matrix."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.llm import sharding
from themeloom.llm.catalog import QUERIES

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def check_shards(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert sizes == sharding.shard_sizes(len(rows), shards)
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())


@pytest.mark.parametrize("good,bad,drawn", [(5, 7, 4), (1, 9, 3), (40, 3, 41), (30, 200, 17)])
def test_law_of_one_draw(good, bad, drawn):
    rng = np.random.default_rng(5)
    n = 20_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(n))
    ways = math.comb(good + bad, drawn)
    for k in range(drawn + 1):
        chance = math.comb(good, k) * math.comb(bad, drawn - k) / ways
        assert abs(seen[k] / n - chance) < 5 * math.sqrt(chance / n) + 1e-3


def test_large_counts():
    rng = np.random.default_rng(6)
    good, bad, drawn = 6 * 10**9, 9 * 10**10, 10**8
    mean = drawn * good / (good + bad)
    deviation = math.sqrt(mean * bad / (good + bad))
    values = [sharding.hypergeometric(rng, good, bad, drawn) for _ in range(200)]
    assert abs(np.mean(values) - mean) < 5 * deviation / math.sqrt(200)
    assert 0.7 < np.std(values) / deviation < 1.3


def test_matrix_has_exact_margins(spark):
    blocks = spark.range(3000).select(F.col("id").alias("block"), (F.col("id") % 7 * F.col("id") + 1).alias("n"))
    sizes = {r.block: r.n for r in blocks.collect()}
    matrix = sharding.communication_matrix(blocks, 5, 1).collect()
    assert {r.block: sum(r.counts) for r in matrix} == sizes
    assert [sum(c) for c in zip(*[r.counts for r in matrix], strict=True)] == sharding.shard_sizes(sum(sizes.values()), 5)
    again = sharding.communication_matrix(blocks.repartition(3), 5, 1).collect()
    assert sorted(matrix) == sorted(again)


def test_all_orders_are_equally_likely():
    """Two blocks of three and two rows into two shards, as the operator does it, by hand."""
    rng = np.random.default_rng(8)
    seen, n = Counter(), 24_000
    for _ in range(n):
        matrix = sharding.deal_all(rng, sharding.shard_sizes(5, 2), [3, 2])
        arrived = [[], []]
        for rows, counts in zip((["a", "b", "c"], ["d", "e"]), matrix, strict=True):
            mixed = list(rng.permutation(rows))
            arrived[0] += mixed[: counts[0]]
            arrived[1] += mixed[counts[0] :]
        seen["".join(rng.permutation(arrived[0])) + "|" + "".join(rng.permutation(arrived[1]))] += 1
    assert len(seen) == 120
    assert sum((c - n / 120) ** 2 / (n / 120) for c in seen.values()) < 119 + 5 * math.sqrt(2 * 119)


def test_odd_rows(table):
    rows = [(None, None), (None, None), (1, ""), (1, "x" * 200_000), (1, "a"), (1, "a"), (2, "b")] * 3
    docs = table(rows, DOCS).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit("clash")).withColumn("at", F.lit(None))
    dealt = sharding.shuffle_into_shards(docs, 4)
    found = dealt.collect()
    assert Counter((r.row.doc_id, r.row.text) for r in found) == Counter(rows)
    assert found[0].row.asDict().keys() == set(docs.columns) and found[0].row.shard == "clash"
    check_shards(found, 4)
    check_shards(sharding.shuffle_into_shards(table(rows[:3], DOCS), 8).collect(), 8)
    check_shards(sharding.shuffle_into_shards(table(rows, DOCS), 1).collect(), 1)
    assert sharding.shuffle_into_shards(table([], DOCS)).collect() == []
    with pytest.raises(ValueError, match="one shard"):
        sharding.shuffle_into_shards(docs, 0)


def test_several_blocks_in_a_partition(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_BITS", 5)
    numbers = spark.range(0, 5000, 1, 3)
    dealt = sharding.shuffle_into_shards(numbers, 7, seed=3).collect()
    check_shards(dealt, 7)
    assert sorted(r.row.id for r in dealt) == list(range(5000))
    order = [r.row.id for r in sorted(dealt, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(5000))[0, 1]) < 0.08
    other = sharding.shuffle_into_shards(numbers, 7, seed=4).collect()
    assert sum(a.shard == b.shard for a, b in zip(sorted(dealt), sorted(other), strict=True)) < 1100


def test_query_and_files(spark, tmp_path):
    found = QUERIES["op13_sharding"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").selectExpr(
        "doc_id", "octet_length(coalesce(text, '')) + 1 AS size", "crc32(encode(coalesce(text, ''), 'UTF-8')) AS c").collect()}
    check_shards(found, 16)
    assert {(r.doc_id, r.size, r.text_crc32) for r in found} == {(r.doc_id, r.size, r.c) for r in docs.values()}
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
    sharding.write_shards(sharding.shuffle_into_shards(spark.range(100), 4), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    check_shards(back.collect(), 4)
    assert sorted(r.id for r in back.collect()) == list(range(100))
