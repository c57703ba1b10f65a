import numpy as np
import pytest

from themeloom.operators import density, forest, neighbours
from themeloom.options import ClusterOptions


def table(spark, points):
    rows = [(i, [float(x) for x in np.atleast_1d(p)]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(4)


def brute(points, k):
    points = np.asarray(points, dtype=float).reshape(len(points), -1)
    d = np.round(np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(2)), 9)
    out = set()
    for i in range(len(points)):
        order = [j for j in np.lexsort((np.arange(len(points)), d[i])) if j != i][:k]
        out |= {(i, int(j), r + 1, float(d[i, j])) for r, j in enumerate(order)}
    return out


def found(df):
    return {(r["src"], r["dst"], r["rank"], round(r["dist"], 9)) for r in df.collect()}


def test_same_as_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.05, (60, 3)) for c in (0, 1, 5)])
    got = neighbours.nearest_neighbours(table(spark, points), "id", "v", 7, block_rows=16)
    assert found(got) == brute(points, 7)


def test_copies_of_one_vector(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(0, 1, (60, 4))
    points[10:40] = points[10]  # half of the rows are copies
    got = neighbours.nearest_neighbours(table(spark, points), "id", "v", 5, block_rows=8)
    assert found(got) == brute(points, 5)


def test_fewer_rows_than_neighbours(spark):
    got = neighbours.nearest_neighbours(table(spark, [0.0, 1.0, 3.0]), "id", "v", 5)
    assert found(got) == brute([0.0, 1.0, 3.0], 5)


def test_far_blocks_are_not_compared(spark):
    points = [float(100 * c + i / 100) for c in range(8) for i in range(20)]
    reps = neighbours.distinct_vectors(table(spark, points), "id", "v", 4)
    blocks = neighbours.to_blocks(reps, len(points), 3, 20)
    n = blocks.count()
    assert neighbours._work_items(blocks).count() < n * n


def tree_of(points, min_samples):
    """Prim's tree over all pairs, by plain loops."""
    points = np.asarray(points, dtype=float).reshape(len(points), -1)
    d = np.round(np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(2)), 9)
    core = np.sort(d, axis=1)[:, min_samples - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    inside, edges = {0}, set()
    while len(inside) < len(points):
        best = min(
            (w[i, j], min(i, j), max(i, j), j) for i in inside for j in range(len(points)) if j not in inside
        )
        inside.add(best[3])
        edges.add((best[1], best[2], round(float(best[0]), 9)))
    return edges


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_spanning_tree(spark, block_rows):
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(0, 1, (40, 2)), 1)  # rounding makes ties and copies
    tree = density.spanning_tree(table(spark, points), "id", "v", 3, block_rows=block_rows)
    got = {(r["src"], r["dst"], round(r["w"], 9)) for r in tree.collect()}
    assert got == tree_of(points, 3)


LINE = [0, 1, 2, 10, 11, 12, 50]


def test_golden_density_groups(spark):
    options = ClusterOptions(min_samples=2, min_cluster_size=3, epsilon=1.5)
    out = density.density_components(table(spark, LINE), "id", "v", options, block_rows=3)
    assert {r["id"]: r["component"] for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: -1}
    tree = density.spanning_tree(table(spark, LINE), "id", "v", 2, block_rows=3).collect()
    assert sorted(r["w"] for r in tree) == [1, 1, 1, 1, 8, 38]


@pytest.mark.parametrize("unit_edges", [0, 30, 1000])
def test_components_of_a_long_chain_and_a_star(spark, unit_edges):
    chain = [(i, i + 1, float(i)) for i in range(60)]
    star = [(1000, 1001 + i, 1.0) for i in range(60)]
    edges = spark.createDataFrame(chain + star, "src long, dst long, w double").repartition(5)
    tree, labels = forest.spanning_forest(edges, unit_edges)
    assert tree.count() == 120
    groups = {}
    for r in labels.collect():
        groups.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(len, groups.values())) == [61, 61]


def test_no_edges(spark):
    tree, labels = forest.spanning_forest(spark.createDataFrame([], "src long, dst long, w double"))
    assert tree.count() == 0 and labels.count() == 0


def test_levels_find_separated_groups(spark):
    rng = np.random.default_rng(4)
    centres = [(0, 0), (5, 0), (0, 5)]
    points = np.concatenate([rng.normal(c, 0.2, (30, 2)) for c in centres] + [[[20.0, 20.0]]])
    options = ClusterOptions(min_samples=3, min_cluster_size=10, epsilon=0.0)
    out = density.hdbscan_levels(table(spark, points), "id", "v", options, block_rows=40)
    topic = {r["id"]: r["topic"] for r in out.collect()}
    blocks = [{topic[i] for i in range(30 * b, 30 * b + 30)} - {-1} for b in range(3)]
    assert all(len(b) == 1 for b in blocks) and len(set.union(*blocks)) == 3
    assert topic[90] == -1


def test_epsilon_keeps_near_groups_together(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in [(0, 0), (1, 0), (50, 50), (51, 50)]])
    near = ClusterOptions(min_samples=3, min_cluster_size=10, epsilon=0.0)
    far = ClusterOptions(min_samples=3, min_cluster_size=10, epsilon=2.0)
    count = lambda o: len({r["topic"] for r in density.hdbscan_levels(table(spark, points), "id", "v", o).collect()} - {-1})
    assert count(near) == 4
    assert count(far) == 2


def test_tree_without_far_pairs_of_blocks(spark):
    rng = np.random.default_rng(6)
    line = np.concatenate([rng.normal((10 * c, 0), 0.3, (24, 2)) for c in range(5)])
    df = table(spark, line)
    near = neighbours.nearest_neighbours(df, "id", "v", 2, block_rows=8)
    cores = density.core_distances(near, 3)
    blocks = neighbours.to_blocks(df.selectExpr("id as rep", "v"), len(line), 8, 8)
    members = density.cut(density._block_trees(blocks, cores))
    n = members.count()
    assert density._bridgeable(members).count() < n * (n - 1) // 2
    assert density._bridgeable(members, 0.2).count() < density._bridgeable(members).count()
    tree = density.spanning_tree(df, "id", "v", 3, block_rows=8)
    assert {(r["src"], r["dst"], round(r["w"], 9)) for r in tree.collect()} == tree_of(line, 3)


def test_nearest_of_many_blocks_are_held_one_list_at_a_time():
    """Blocks met one after another leave what all of them at once would."""
    rng = np.random.default_rng(9)
    points = rng.integers(0, 4, (70, 3)).astype(float)  # many ties
    ids = rng.permutation(70)
    whole = neighbours.nearest_in(ids, points, ids, points, 5)
    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    for start in range(0, 70, 9):
        part = slice(start, start + 9)
        held = neighbours.nearer_of(held, neighbours.nearest_in(ids, points, ids[part], points[part], 5), 5)
        assert np.bincount(held[0]).max() <= 5
    assert all((a == b).all() for a, b in zip(whole, held, strict=True))
