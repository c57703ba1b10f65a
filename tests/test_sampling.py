import pytest
from pyspark.sql import functions as F

from themeloom.operators import quotas, sampling
from themeloom.options import SampleOptions
from themeloom.sources.guards import require_columns, require_rows

COUNTS = [("A", 6000), ("B", 3000), ("C", 900), ("D", 100)]


def allocation(spark, **options):
    counts = spark.createDataFrame(COUNTS, "stratum string, pop long")
    out = quotas.allocate_strata(counts, SampleOptions(**{"total": 2000, **options}))
    return {r["stratum"]: round(r["quota"], 4) for r in out.collect()}


def test_golden_quotas(spark):
    assert allocation(spark) == {"A": 906.0606, "B": 603.0303, "C": 390.9091, "D": 100.0}


def test_cap_leaves_shortfall(spark):
    assert allocation(spark, max_share=0.10) == {"A": 500.0, "B": 500.0, "C": 390.9091, "D": 100.0}


def test_budget_guard(spark):
    with pytest.raises(ValueError, match="1000"):
        allocation(spark, total=900)


def test_scale_to_total(spark):
    over = spark.createDataFrame([("A", 5000, 900.0), ("B", 100, 100.0)], "stratum string, pop long, quota double")
    out = quotas.scale_to_total(over, SampleOptions(total=500))
    assert {r["stratum"]: r["quota"] for r in out.collect()} == {"A": 400.0, "B": 100.0}


def substrata(spark, issues, quota, pop=6000):
    counts = spark.createDataFrame([("A", i, n) for i, n in issues], "stratum string, substratum string, pop long")
    alloc = spark.createDataFrame([("A", pop, quota)], "stratum string, pop long, quota double")
    out = quotas.allocate_substrata(counts, alloc, SampleOptions())
    return {r["substratum"]: round(r["quota"], 4) for r in out.collect()}


def test_golden_second_level(spark):
    got = substrata(spark, [("x", 5000), ("y", 990), ("z", 10)], 906.0606)
    assert got == {"x": 747.5505, "y": 152.025, "z": 6.4851}


def test_remainder_spills_within_populations(spark):
    got = substrata(spark, [("x", 20), ("y", 19), (None, 1)], 39.5, pop=40)
    assert sum(got.values()) == pytest.approx(39.5)
    assert got["x"] <= 20 and got["y"] <= 19 and got[None] <= 1


def test_small_budget_gives_at_least_one(spark):
    got = substrata(spark, [(str(i), 10) for i in range(30)], 25.0, pop=300)
    assert all(0 <= v <= 10 for v in got.values())
    assert sum(got.values()) == pytest.approx(25.0)


def hot_rows(spark, n=6000):
    """Two thirds in one stratum, with a NULL issue and a NULL product."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 50 == 2, None).otherwise("cold").alias("p"),
        F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("i"), F.col("id") % 4)).alias("q"),
    )


def test_exact_sizes_and_repartitioning(spark):
    rows = hot_rows(spark)
    options = SampleOptions(total=1000, min_per_stratum=100, min_per_substratum=2, max_share=0.5)
    a = sampling.stratified_sample(rows, "p", "q", "id", options)
    b = sampling.stratified_sample(rows.repartition(13), "p", "q", "id", options)
    ids = sorted(r["id"] for r in a.select("id").collect())
    assert ids == sorted(r["id"] for r in b.select("id").collect())
    counts = rows.groupBy(F.col("p").alias("stratum"), F.col("q").alias("substratum")).agg(F.count("*").alias("pop"))
    cells = quotas.sample_cells(counts, options).collect()
    expected = sum(c["take"] for c in cells)
    assert len(ids) == expected == round(sum(c["quota"] for c in cells)) <= options.total
    assert a.where("p is null").count() > 0
    assert a.where("q is null and p = 'hot'").count() > 0


def test_few_buckets_give_the_same_sample(spark):
    rows = hot_rows(spark).withColumn("cell", F.lit(1))
    cells = spark.createDataFrame([(1, 777)], "cell int, take long")
    fine = sampling.take_per_cell(rows, cells, ["cell"], "id", 3)
    coarse = sampling.take_per_cell(rows, cells, ["cell"], "id", 3, digits=1)
    assert fine.count() == 777
    assert fine.select("id").exceptAll(coarse.select("id")).isEmpty()


def test_capped_sample_of_few_rows(spark):
    assert sampling.capped_sample(spark.range(5), 10, "id", 1).count() == 5


def test_bernoulli_size(spark):
    n = sampling.bernoulli_sample(spark.range(20000), 0.05, "id", 256).count()
    assert abs(n - 1000) < 5 * (20000 * 0.05 * 0.95) ** 0.5
    assert sampling.bernoulli_sample(spark.range(20000), 0.05, "id", 256, cap=100).count() == 100


def test_surrogate_ids_are_consecutive(spark):
    out = sampling.surrogate_id(spark.range(1000).repartition(5), "id")
    assert sorted(r["sample_id"] for r in out.collect()) == list(range(1000))


def test_guards(spark):
    with pytest.raises(ValueError, match="no valid"):
        require_rows(spark.range(0))
    with pytest.raises(ValueError, match="text_clean"):
        require_columns(spark.range(1), ["text_clean"])
