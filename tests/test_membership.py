"""Membership vectors against a plain version over all pairs."""

import numpy as np
import pytest
from test_hierarchy import plain_choice, plain_tree
from test_neighbours import table, tree_of

from themeloom.operators import density, membership
from themeloom.operators.hierarchy import Hierarchy
from themeloom.options import ClusterOptions


def plain_membership(points, edges, min_size, epsilon):
    clusters, rows = plain_tree(edges, min_size)
    labels = plain_choice(clusters, epsilon)
    floor = min([w for *_, w in edges if w > 0]) / 2
    density_at = lambda h: 1 / max(h, floor)
    groups = sorted(set(labels.values()), key=lambda c: (-clusters[c][3], c))

    def path(c):
        return [] if c is None else [*path(clusters[c][0]), c]

    distance = lambda a, b: max(round(float(np.sqrt(((points[a] - points[b]) ** 2).sum())), 9), 1e-9)
    models = {}
    for group in groups:
        models[group] = []
        for leaf, (_, _, split, _, _) in clusters.items():
            if split is None and labels.get(leaf) == group:
                last = min(h for c, h in rows.values() if c == leaf)
                models[group] += [v for v, (c, h) in rows.items() if c == leaf and h == last]
    densest = {g: max(density_at(h) for c, h in rows.values() if labels.get(c) == g) for g in groups}
    out = {}
    for v, (own, height) in rows.items():
        joint = {}
        for g in groups:
            shared = [c for c in path(own) if c in path(g)]
            comparable = shared == path(g) or shared == path(own)
            joint[g] = density_at(height) if comparable else density_at(clusters[shared[-1]][2]) if shared else 0.0
        share = {g: joint[g] / min(distance(v, e) for e in models[g]) for g in groups}
        best = max(groups, key=lambda g: (joint[g], -groups.index(g)))
        sure = joint[best] / max(density_at(height), densest[best])
        for i, g in enumerate(groups):
            out[(v, i)] = sure * share[g] / sum(share.values())
    return out


@pytest.mark.parametrize("block_rows", [16, None])
def test_same_as_plain_version(spark, block_rows):
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.normal(c, s, (25, 2)) for c, s in ((0, 0.2), (2, 0.3), (2.9, 0.2), (9, 0.5))])
    points[3:9] = points[3]  # copies
    rows = table(spark, points)
    options = ClusterOptions(min_samples=3, min_cluster_size=6, epsilon=0.0)
    found, chosen = density.hierarchy_of(rows, "id", "v", options, block_rows)
    got = membership.membership_vectors(rows, "id", "v", found, chosen, block_rows).collect()
    expected = plain_membership(points, sorted(tree_of(points, 3)), 6, 0.0)
    assert len({t for _, t in expected}) >= 3 and len(got) == len(expected)
    for r in got:
        assert r.membership == pytest.approx(expected[(r.id, r.topic)], rel=1e-6)
    sums = {}
    for r in got:
        sums[r.id] = sums.get(r.id, 0.0) + r.membership
    assert max(sums.values()) <= 1 + 1e-9 and min(r.membership for r in got) >= 0
    assert max(sums.values()) == pytest.approx(1)
    hard = {r.id: r.topic for r in density.label_rows(rows.select("id"), found, chosen).collect()}
    best = {}
    for r in got:
        best[r.id] = max(best.get(r.id, (0, 0)), (r.membership, r.topic))
    agree = [best[i][1] == t for i, t in hard.items() if t >= 0]
    assert sum(agree) > 0.95 * len(agree)


def test_no_groups(spark):
    rows = table(spark, [[0.0], [1.0], [2.1]])
    found, chosen = density.hierarchy_of(rows, "id", "v", ClusterOptions(min_samples=2, min_cluster_size=2, epsilon=0.0))
    assert chosen.count() == 0
    assert membership.membership_vectors(rows, "id", "v", found, chosen).count() == 0


def test_deep_tree_in_one_task_and_by_paths(spark):
    # A chain of splits 40 deep with a leaf beside each, and a tree of its own.
    rows = [((i, 500 - i), (i - 1, 501 - i) if i else None, 50.0 - i) for i in range(40)]
    rows += [((100 + i, 5), (i, 500 - i), None) for i in range(40)] + [((900, 7), None, None)]
    kind = "cluster struct<rep:long,size:long>, parent struct<rep:long,size:long>, split double"
    found = Hierarchy(spark.createDataFrame(rows, kind), None, 0.5)
    chosen = [((39, 461), 0), ((107, 5), 1), ((20, 480), 2), ((900, 7), 3)]
    numbered = spark.createDataFrame(chosen, "label struct<rep:long,size:long>, topic int")
    got = [
        {(tuple(r.cluster), r.topic): r.joint for r in membership.joint_densities(found, numbered, *units).collect()}
        for units in ((1000, 10_000), (1000, 81), (10, 81))
    ]
    assert got[0] == got[1] == got[2] and len(got[0]) == 81 * 4
    assert got[0][(107, 5), 0] == 1 / 43 and got[0][(130, 5), 2] == membership.INSIDE == got[0][(3, 497), 1]
    assert got[0][(900, 7), 0] == 0.0 and got[0][(900, 7), 3] == membership.INSIDE


def test_parting_densities_walk_no_paths_between_tables(spark, monkeypatch):
    monkeypatch.setattr(membership, "cluster_paths", lambda clusters: pytest.fail("paths of all clusters"))
    test_no_groups(spark)
