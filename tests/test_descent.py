"""Approximate neighbours: recall against all pairs, distances exact, bounded work at hubs."""

import numpy as np
from test_neighbours import brute, found, table

from themeloom.operators import descent, neighbours


def recall(got, expected):
    return len({x[:2] for x in got} & {x[:2] for x in expected}) / len(expected)


def test_recall_and_exact_distances(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(c, 1, (220, 8)) for c in (0, 3, 9)])
    points[100:130] = points[100]  # copies
    got = found(neighbours.nearest_neighbours(table(spark, points), "id", "v", 10, block_rows=40, search=descent.descend))
    expected = brute(points, 10)
    assert recall(got, expected) >= 0.95
    for src, dst, _, dist in got:
        assert dist == round(float(np.sqrt(((points[src] - points[dst]) ** 2).sum())), 9)
    assert len({x[0] for x in got}) == len(points)


def test_embeddings(spark):
    """The hard case: 64 dimensions without structure, blocks a tenth of the rows."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    exact = neighbours.nearest_neighbours(rows, "vec_id", "embedding", 10, "cosine")
    about = neighbours.nearest_neighbours(rows, "vec_id", "embedding", 10, "cosine", block_rows=50, search=descent.descend)
    assert recall([(r.src, r.dst) for r in about.collect()], [(r.src, r.dst) for r in exact.collect()]) >= 0.95


def test_few_rows(spark):
    got = neighbours.nearest_neighbours(table(spark, [0.0, 1.0, 3.0]), "id", "v", 5, search=descent.descend)
    assert found(got) == brute([0.0, 1.0, 3.0], 5)
