"""Approximate nearest neighbours by descent over neighbours of neighbours.

For collections where comparing all blocks that may matter is too much. Rows
start with the exact neighbours inside blocks of several orders: by nearest
pivot for two sets of pivots, and at random, which links far parts. Then, round
by round, the neighbours of a row and those that have it as a neighbour are
compared with each other: whoever is close to a common third is likely close.
Only pairs with a link that is new since the round before are looked at, and
only what beats the farthest neighbour so far is sent on. Lists are wider than
what is asked for, as many dimensions need. No pair is compared
because of a shared bucket, and a row that very many others point to compares
a list's length of the nearest only, so no row's work grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.neighbours import (
    DECIMALS,
    _squared,
    _unpack,
    block_rows_for,
    nearest_in,
    pivots_of,
    to_blocks,
)
from themeloom.plans.lineage import cut

ORDERS = 2  # sets of pivots
ROUNDS = 12
SPARE = 10  # how many more than twice the neighbours asked for a list holds
SETTLED = 0.001  # stop once fewer of the links are replaced in a round


def descend(reps: DataFrame, n: int, k: int, block_rows: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``(src, dst, dist, rank)``: about the k nearest other vectors of ``(rep, v)``, by distance and key."""
    reps = cut(reps.select("rep", "v"))
    asked, k = k, 2 * k + SPARE
    size = block_rows or block_rows_for(n, reps.sparkSession.sparkContext.defaultParallelism)
    lists = cut(_first(_started(reps, n, k, size), k).withColumn("fresh", F.lit(True)))
    for _ in range(rounds):
        reach = lists.groupBy("src").agg(F.count(F.lit(1)).alias("held"), F.max("dist").alias("far"))
        farthest = F.when(F.col("held") < k, F.lit(float("inf"))).otherwise(F.col("far"))
        rows = reps.join(reach.select(F.col("src").alias("rep"), farthest.alias("reach")), "rep")
        found = cut(_compared(_around(lists, k), rows))
        known = lists.select("src", "dst", "dist", F.lit(False).alias("fresh"))
        both = known.unionByName(found.withColumn("fresh", F.lit(True)))
        once = both.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
        lists = cut(_first(once, k))
        if lists.where("fresh").count() <= SETTLED * n * k:
            break
    return lists.where(F.col("rank") <= asked).select("src", "dst", "dist", "rank")


def _first(links: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return links.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _started(reps: DataFrame, n: int, k: int, size: int) -> DataFrame:
    """Exact neighbours inside the blocks of several orders."""

    def inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, block in frame.iterrows():
                ids, vectors = _unpack(block)
                if len(ids) > 1:
                    r, dst, dist = nearest_in(ids, vectors, ids, vectors, k)
                    yield pd.DataFrame({"src": ids[r], "dst": dst, "dist": dist})

    def shuffled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), size):
                part = frame.iloc[start : start + size]
                vectors = np.stack(part["v"].to_numpy()).astype(float)
                yield pd.DataFrame({"ids": [part["rep"].to_numpy("int64").tobytes()], "vectors": [vectors.tobytes()]})

    found = []
    for seed in range(ORDERS):
        blocks = to_blocks(reps, n, k, size, pivots_of(reps, seed))
        found.append(blocks.select("ids", "vectors").mapInPandas(inside, "src long, dst long, dist double"))
    mixed = reps.repartition(max(1, n // (4 * size)), F.xxhash64("rep")).sortWithinPartitions(F.xxhash64("rep"))
    blocks = mixed.mapInPandas(shuffled, "ids binary, vectors binary")
    found.append(blocks.mapInPandas(inside, "src long, dst long, dist double"))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def _around(lists: DataFrame, k: int) -> DataFrame:
    """``(mid, other, fresh)``: the neighbours of each row, and the ``k`` nearest of those it is a neighbour of.

    Rows without a fresh link among these have no pair to look at and are left out.
    """
    forward = lists.select(F.col("src").alias("mid"), F.col("dst").alias("other"), "fresh")
    order = Window.partitionBy("dst").orderBy("dist", "src")
    nearest = lists.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    backward = nearest.select(F.col("dst").alias("mid"), F.col("src").alias("other"), "fresh")
    links = forward.unionByName(backward).repartition("mid")  # serves the grouping and the window
    once = links.groupBy("mid", "other").agg(F.max("fresh").alias("fresh"))
    moved = once.withColumn("_any", F.max("fresh").over(Window.partitionBy("mid")))
    return moved.where("_any").drop("_any")


def _compared(around: DataFrame, rows: DataFrame) -> DataFrame:
    """``(src, dst, dist)`` of pairs around a row that are nearer than the farthest neighbour of ``src``."""

    def pairs(vectors: np.ndarray, fresh: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rough = _squared(vectors, vectors)
        slack = 1e-9 * (1.0 + rough.max())
        asked = fresh[:, None] | fresh[None, :]
        np.fill_diagonal(asked, False)
        a, b = np.nonzero(asked & (rough <= (reach * reach)[:, None] + slack))
        diff = vectors[a] - vectors[b]
        dist = np.round(np.sqrt((diff * diff).sum(1)), DECIMALS)
        near = dist < reach[a]
        return a[near], b[near], dist[near]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            mids = frame["mid"].to_numpy()
            if not len(mids):
                continue
            # The last group may go on in the next frame.
            last = int(np.searchsorted(mids, mids[-1]))
            held = frame.iloc[last:]
            yield from compare(frame.iloc[:last])
        if held is not None:
            yield from compare(held)

    def compare(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(frame):
            return
        mids, others = frame["mid"].to_numpy(), frame["other"].to_numpy()
        vectors = np.stack(frame["v"].to_numpy())
        fresh, reach = frame["fresh"].to_numpy(bool), frame["reach"].to_numpy()
        edges = np.flatnonzero(np.r_[True, mids[1:] != mids[:-1], True])
        found = []
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            a, b, dist = pairs(vectors[start:end], fresh[start:end], reach[start:end])
            found.append((others[start + a], others[start + b], dist))
        src, dst, dist = (np.concatenate(c) for c in zip(*found, strict=True))
        yield pd.DataFrame({"src": src, "dst": dst, "dist": dist}).drop_duplicates()

    placed = around.join(rows.select(F.col("rep").alias("other"), "v", "reach"), "other")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(parts, "mid").sortWithinPartitions("mid").select("mid", "other", "fresh", "reach", "v")
    return dealt.mapInPandas(run, "src long, dst long, dist double").distinct()
