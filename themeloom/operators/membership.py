"""Soft membership of every row in the chosen density groups, from the hierarchy.

Two things are combined. How near a row is to a group: the distance to its
nearest exemplar, the rows that stay longest in the leaves below the group. And
how dense the hierarchy still is where row and group come together: the density
at which the row drops out, if its cluster is part of the group or holds it,
else the density at which the two clusters split from each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import vectors as V
from themeloom.operators.density import group_numbers
from themeloom.operators.hierarchy import UNIT_CLUSTERS, Hierarchy, density_of
from themeloom.operators.neighbours import (
    CHUNK_BLOCKS,
    DECIMALS,
    _squared,
    _tiles,
    _units,
    _unpack,
    block_rows_for,
    block_summary,
    least_distance,
    pivots_of,
    to_blocks,
    work_tasks,
)
from themeloom.operators.topics import score_arrays
from themeloom.plans.joins import lookup_join
from themeloom.plans.lineage import cut
from themeloom.plans.unnest import unnest

INSIDE = -1.0  # the row's own density counts
NEAREST = 1e-9  # a row that is an exemplar is put so far away
_SLACK = 1e-6
UNIT_PAIRS = 2_000_000  # of a cluster and a topic, whose joint densities a task gives


def cluster_paths(clusters: DataFrame) -> DataFrame:
    """``(cluster, path)``: from the root down to the cluster, each as (cluster, split), in doubling steps."""
    own = F.array(F.struct("cluster", "split"))
    paths = cut(clusters.select("cluster", own.alias("path"), F.col("parent").alias("up")))
    while not paths.where(F.col("up").isNotNull()).isEmpty():
        above = paths.select(F.col("cluster").alias("up"), F.col("path").alias("higher"), F.col("up").alias("beyond"))
        joined = lookup_join(paths, cut(above), ["up"], "left")
        longer = F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("higher", "path"))
        paths = cut(joined.select("cluster", longer.alias("path"), F.col("beyond").alias("up")))
    return paths.select("cluster", "path")


def joint_densities(found: Hierarchy, numbered: DataFrame, unit_clusters: int = UNIT_CLUSTERS, unit_pairs: int = UNIT_PAIRS) -> DataFrame:
    """``(cluster, topic, joint)``: the density at which a cluster and a chosen one part, or INSIDE.

    They part at the nearest cluster that is above both, or one of the two. It is
    found by doubling steps up the tree in a task that holds the tree and gets
    some of the topics, so many that it gives ``unit_pairs`` rows. A tree of more than
    ``unit_clusters`` clusters is too large for a task: there whole paths are compared.
    """
    n, n_topics = found.clusters.count(), numbered.count()
    if n > unit_clusters:
        return _joint_of_paths(found, numbered)
    chunks = max(1, -(-n * n_topics // unit_pairs))
    tree = found.clusters.join(numbered.withColumnRenamed("label", "cluster"), "cluster", "left").select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
        "cluster.rep", "cluster.size",
        F.coalesce("parent.rep", F.lit(0)).alias("up_rep"), F.coalesce("parent.size", F.lit(0)).alias("up_size"),
        F.coalesce("split", F.lit(-1.0)).alias("split"), F.coalesce("topic", F.lit(-1)).alias("topic"),
    )
    floor = found.floor

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mine = frame["chunk"].iloc[0]
        topics = frame["topic"].to_numpy()
        density = 1.0 / np.maximum(frame["split"].to_numpy(), floor)
        labels = np.flatnonzero((topics >= 0) & (topics % chunks == mine))
        joint = parting_densities(_parents(frame), density, labels)
        whole = {c: np.tile(frame[c].to_numpy(), len(labels)) for c in ("rep", "size")}
        return pd.DataFrame({**whole, "topic": np.repeat(topics[labels], len(frame)), "joint": joint.ravel()})

    joint = tree.groupBy("chunk").applyInPandas(run, "rep long, size long, topic int, joint double")
    return joint.select(F.struct("rep", "size").alias("cluster"), "topic", "joint")


def _parents(frame: pd.DataFrame) -> np.ndarray:
    """The place of each cluster's parent; of a root one after the last."""
    own = frame[["rep", "size"]].assign(at=np.arange(len(frame)))
    above = frame[["up_rep", "up_size"]].merge(own, how="left", left_on=["up_rep", "up_size"], right_on=["rep", "size"])
    return above["at"].fillna(len(frame)).to_numpy().astype(np.int64)


def parting_densities(parents: np.ndarray, density: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each of ``labels`` a row: the density of the split at which every cluster parts from it, 0 in another tree."""
    n = len(parents)
    upward, own = np.append(parents, n), np.arange(n + 1)
    below = np.append(density, 0.0)
    joint = np.empty((len(labels), n))
    for row, label in zip(joint, labels.tolist(), strict=True):
        path, at = [], label
        while at < n:
            path.append(at)
            at = parents[at]
        nearest = upward.copy()  # the nearest cluster of the path, as far up as was looked
        nearest[path] = path
        while True:
            further = nearest[nearest]
            if np.array_equal(further, nearest):
                break
            nearest = further
        inside = (nearest == label) | (nearest == own)
        row[:] = np.where(inside[:n], INSIDE, below[nearest[:n]])
    return joint


def _joint_of_paths(found: Hierarchy, numbered: DataFrame) -> DataFrame:
    paths = cut(cluster_paths(found.clusters).select("cluster", "path", F.transform("path", lambda e: e["cluster"]).alias("names")))
    labels = paths.select(F.col("cluster").alias("label"), F.col("names").alias("centroid"))
    targets = cut(labels.join(numbered, "label").select("topic", "centroid"))

    def joint(other):
        shared = F.size(F.array_intersect("names", other))
        part = F.get("path", shared - 1)["split"]
        inside = (shared == F.size(other)) | (shared == F.size("names"))
        return F.when(shared == 0, 0.0).when(inside, INSIDE).otherwise(density_of(part, found.floor))

    scored, _ = score_arrays(paths, targets, joint)
    return unnest(scored, ["cluster"], "scores", "s").select(
        "cluster", F.col("s.topic").alias("topic"), F.col("s.score").alias("joint")
    )


def exemplars(found: Hierarchy, chosen: DataFrame, numbered: DataFrame) -> DataFrame:
    """``(id, topic)``: of each leaf below a chosen cluster the rows that drop out last."""
    leaves = found.clusters.where(F.col("split").isNull()).select("cluster")
    topics = cut(leaves.join(chosen, "cluster").join(numbered, "label").select("cluster", "topic"))
    last = cut(found.rows.groupBy("cluster").agg(F.min("height").alias("last")).join(topics, "cluster"))
    placed = lookup_join(found.rows, last, ["cluster"])
    return placed.where(F.col("height") == F.col("last")).select("id", "topic")


def nearest_exemplars(rows: DataFrame, samples: DataFrame, block_rows: int | None = None) -> DataFrame:
    """``(id, topic, dist)`` of ``rows`` (id, v) to the nearest of ``samples`` (topic, v) of every topic.

    Rows and samples stand in blocks that know their distances to some pivots. A
    block of samples is left out where another one of its topic is nearer to
    every row of the block by the triangle inequality.
    """
    reps = cut(rows.select(F.col("id").alias("rep"), "v"))
    n = reps.count()
    size = block_rows or block_rows_for(n, rows.sparkSession.sparkContext.defaultParallelism)
    pivots = pivots_of(reps)
    blocks = to_blocks(reps, n, 1, size, pivots)
    packs = cut(_packs(samples.distinct(), size, pivots))
    items = _needed(blocks, packs)
    query = lookup_join(items.select("block", "chunk").distinct(), blocks.select("block", "ids", "vectors"), ["block"])
    others = lookup_join(items, packs.select(F.col("pack").alias("other"), "topic", F.col("vectors").alias("samples")), ["other"])

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = _unpack(left.iloc[0])
        best: dict[int, np.ndarray] = {}
        for topic, packed in zip(right["topic"], right["samples"], strict=True):
            held = np.frombuffer(packed).reshape(-1, vectors.shape[1])
            near = np.concatenate([_nearest(vectors[t], held) for t in _tiles(len(vectors), len(held))])
            best[topic] = np.minimum(best[topic], near) if topic in best else near
        topics = np.repeat(list(best), len(ids))
        return pd.DataFrame({"id": np.tile(ids, len(best)), "topic": topics, "dist": np.concatenate(list(best.values()))})

    tasks = work_tasks(items)
    found = _units(query, tasks).cogroup(_units(others, tasks)).applyInPandas(nearest, "id long, topic int, dist double")
    return found.groupBy("id", "topic").agg(F.min("dist").alias("dist"))


def _nearest(rows: np.ndarray, samples: np.ndarray) -> np.ndarray:
    at = _squared(rows, samples).argmin(1)
    diff = rows - samples[at]
    return np.round(np.sqrt((diff * diff).sum(1)), DECIMALS)


def _packs(samples: DataFrame, size: int, pivots: np.ndarray) -> DataFrame:
    """Samples of one topic each in blocks of at most ``size``, with their range of distances to the pivots."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        topic, held = None, []

        def whole() -> Iterator[pd.DataFrame]:
            nonlocal number, held
            if held:
                block = np.stack(held)
                d = np.sqrt(_squared(block, pivots))
                yield pd.DataFrame({"pack": [number], "topic": [topic], "vectors": [block.tobytes()],
                                    "lo": [d.min(0).tolist()], "hi": [d.max(0).tolist()]})
                number, held = number + 1, []

        for frame in frames:
            for next_topic, v in zip(frame["topic"], frame["v"], strict=True):
                if next_topic != topic or len(held) >= size:
                    yield from whole()
                    topic = next_topic
                held.append(v)
        yield from whole()

    dealt = samples.select("topic", "v").repartitionByRange("topic", F.xxhash64("v"))
    ordered = dealt.sortWithinPartitions("topic", F.element_at("v", 1))
    return ordered.mapInPandas(pack, "pack long, topic int, vectors binary, lo array<double>, hi array<double>")


def _needed(blocks: DataFrame, packs: DataFrame) -> DataFrame:
    """``(block, chunk, other)``: the packs that may hold the nearest sample of a topic for a row of the block."""
    names, lo, hi, _ = block_summary(blocks)
    position = {int(b): i for i, b in enumerate(names)}
    rows = packs.select("pack", "topic", "lo", "hi").orderBy("topic", "pack").collect()  # a row of bounds per pack
    pack_names = np.array([r["pack"] for r in rows], dtype="int64")
    topics = np.array([r["topic"] for r in rows], dtype="int64")
    pack_lo, pack_hi = (np.array([r[c] for r in rows], dtype=float).reshape(len(rows), lo.shape[1]) for c in ("lo", "hi"))
    starts = np.flatnonzero(np.r_[True, topics[1:] != topics[:-1]]) if len(rows) else np.empty(0, np.int64)
    slack = _SLACK * (1.0 + hi.max(initial=0.0))

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame["block"] if len(rows) else []:
                i = position[int(b)]
                gap = least_distance(0, np.vstack([lo[i], pack_lo]), np.vstack([hi[i], pack_hi]))[1:]
                most = (hi[i][None, :] + pack_lo).min(axis=1)  # some sample of the pack is no further off
                bound = np.repeat(np.minimum.reduceat(most, starts), np.diff(np.r_[starts, len(rows)]))
                near = np.flatnonzero(gap <= bound + slack)
                chunk = (np.arange(len(near)) // CHUNK_BLOCKS).astype("int32")
                yield pd.DataFrame({"block": int(b), "chunk": chunk, "other": pack_names[near]})

    return cut(blocks.select("block").mapInPandas(plan, "block long, chunk int, other long"))


def membership_vectors(
    df: DataFrame, key: str, vector: str, found: Hierarchy, chosen: DataFrame, block_rows: int | None = None
) -> DataFrame:
    """``(id, topic, membership)`` for every row of ``df`` in a large component and every chosen group.

    The shares of the groups, joint density over distance, are scaled by how
    sure it is that the row belongs to any: the greatest joint density over
    the greatest density within that group, or the row's own if it is greater.
    So the memberships of a row sum to 1 at most, and to 1 for the rows that stay
    longest. Without a chosen group the result is empty; rows that never reach a
    large component have no row in it.
    """
    numbered = cut(group_numbers(found, chosen))
    rows = cut(df.select(F.col(key).cast("bigint").alias("id"), V.doubles(vector).alias("v")))
    samples = rows.join(exemplars(found, chosen, numbered), "id").select("topic", "v")
    near = nearest_exemplars(rows, cut(samples), block_rows)
    joint = cut(joint_densities(found, numbered))
    own = found.rows.select("id", "cluster", density_of(F.col("height"), found.floor).alias("own"))
    pairs = lookup_join(near.join(own, "id"), joint, ["cluster", "topic"])
    joined = F.when(F.col("joint") == INSIDE, F.col("own")).otherwise(F.col("joint"))
    share = F.col("joined") / F.greatest("dist", F.lit(NEAREST))
    pairs = cut(pairs.withColumn("joined", joined).select("id", "topic", "own", "joined", share.alias("share")))

    inside = lookup_join(found.rows, cut(chosen.join(numbered, "label").select("cluster", "topic")), ["cluster"])
    densest = cut(inside.groupBy("topic").agg(density_of(F.min("height"), found.floor).alias("densest")))
    best = F.max(F.struct("joined", (-F.col("topic")).alias("against"))).alias("best")
    sums = pairs.groupBy("id").agg(F.sum("share").alias("shares"), best, F.max("own").alias("own"))
    sums = sums.select("id", "shares", F.col("best.joined").alias("most"), (-F.col("best.against")).alias("topic"), "own")
    sure = F.col("most") / F.greatest("own", "densest")
    scale = lookup_join(sums, densest, ["topic"]).select(
        "id", F.when(F.col("shares") > 0, sure / F.col("shares")).otherwise(0.0).alias("scale")
    )
    return pairs.join(scale, "id").select("id", "topic", (F.col("share") * F.col("scale")).alias("membership"))
