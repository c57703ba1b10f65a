"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows stand in blocks. How many rows each block sends to each shard is drawn
first: the matrix has the block sizes as row sums, the shard sizes as column
sums, and the law that a uniform permutation of all rows would give it, that is
multivariate hypergeometric, row by row without replacement from the room the
shards have left. Then every block permutes its own rows and cuts them by its
row of the matrix, the rows are exchanged once, and every shard permutes what
it has received. All orders of all rows are equally likely, and the sizes are
right by construction, not by chance.

The matrix is drawn as a tree: the driver draws for BRANCHES groups of blocks, a
bounded number whatever the data, and a task per group draws for its blocks. A
row's fate depends on the seed and on its place in the written copy of the
input only, so tasks that run again after a lost executor decide alike.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from themeloom.plans.joins import lookup_join
from themeloom.plans.lineage import cut

BLOCK_BITS = 16  # a block has at most 65,536 rows
BRANCHES = 256
SLICE_ROWS = 32_768  # about as many rows of a shard are put in order at once
LEAST_SLICES = 256  # so that even few rows are dealt evenly over many tasks


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart; the first shards are the larger ones."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows, taken without replacement, are among the ``good`` ones.

    By inversion from the ratios of neighbouring probabilities around the mode, for
    counts of any size. Twelve deviations (and 40 counts, for skew laws) hold all
    that a uniform number of 53 bits can tell apart.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mode = (drawn + 1) * (good + 1) // (total + 2)
    spread = math.sqrt(drawn * (good / total) * (bad / total) * ((total - drawn) / (total - 1)))
    reach = int(12 * spread) + 40
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratios = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (bad - drawn + k + 1))
    weight = np.concatenate([[0.0], np.cumsum(ratios)])
    chance = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(chance, rng.random() * chance[-1], side="right"))


def deal(rng: np.random.Generator, room: list[int], rows: int) -> list[int]:
    """How ``rows`` rows fall on shards with ``room`` left: multivariate hypergeometric."""
    counts, left = [], sum(room)
    for free in room:
        left -= free
        counts.append(hypergeometric(rng, free, left, rows))
        rows -= counts[-1]
    return counts


def deal_all(rng: np.random.Generator, room: list[int], sizes: list[int]) -> list[list[int]]:
    """The matrix of ``sizes`` rows each: every row of it takes from the room that is left."""
    matrix = []
    for size in sizes:
        matrix.append(deal(rng, room, size))
        room = [free - taken for free, taken in zip(room, matrix[-1], strict=True)]
    return matrix


def communication_matrix(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(block, n, counts, bounds)`` for blocks ``(block, n)``: what each shard gets from each block, and running sums."""
    branched = blocks.select("block", "n", F.pmod(F.xxhash64("block"), F.lit(BRANCHES)).cast("int").alias("branch"))
    branches = sorted(branched.groupBy("branch").agg(F.sum("n")).collect())  # BRANCHES rows at most
    sizes = [n for _, n in branches]
    drawn = deal_all(np.random.default_rng([seed, 1]), shard_sizes(sum(sizes), shards), sizes)
    rooms = {b: counts for (b, _), counts in zip(branches, drawn, strict=True)}

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        branch = int(group["branch"].iloc[0])
        rng = np.random.default_rng([seed, 2, branch])
        counts = deal_all(rng, rooms[branch], group["n"].tolist())
        bounds = [np.cumsum(row) for row in counts]
        return pd.DataFrame({"block": group["block"], "n": group["n"], "counts": counts, "bounds": bounds})

    schema = "block long, n long, counts array<long>, bounds array<long>"
    return branched.groupBy("branch").applyInPandas(draw, schema)


def permuted(block: Column, size: Column, position: Column, seed: int) -> Column:
    """The place of ``position`` in a random order of its block's ``size`` positions."""
    held: dict[tuple[int, int], np.ndarray] = {}

    @F.pandas_udf("long")
    def place(block: pd.Series, size: pd.Series, position: pd.Series) -> pd.Series:
        blocks, at = block.to_numpy(), position.to_numpy()
        places = np.empty(len(blocks), np.int64)
        edges = np.flatnonzero(np.diff(blocks)) + 1
        for start, end in zip([0, *edges], [*edges, len(blocks)], strict=True):
            if start == end:
                continue
            name = int(blocks[start]), int(size.iloc[start])
            if name not in held:
                held.clear()
                held[name] = np.random.default_rng([seed, 3, name[0]]).permutation(name[1])
            places[start:end] = held[name][at[start:end]]
        return pd.Series(places)

    return place(block, size, position)


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """Every row of ``docs``, with all its columns, in ``row``, and its ``shard`` and ``slot``.

    Shards are numbered from 0 and differ by one row at most; ``slot`` counts the
    rows of a shard from 0 without gaps, in random order. The rows move once.

    Rows are told apart by where they stand, never by what they hold: nulls in any
    column, rows that repeat, long texts and clashing names mean nothing here. An
    empty table gives an empty result; with fewer rows than shards some are empty.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    tagged = cut(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")))
    # The lower 33 bits of the number count the rows of a partition, so a block is part of one.
    placed = tagged.select("row", "at", F.shiftright("at", BLOCK_BITS).alias("block"))
    blocks = cut(placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")))
    matrix = cut(communication_matrix(blocks, shards, seed))
    rows = matrix.agg(F.sum("n")).first()[0] or 0

    position = F.col("at").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    cuts = matrix.select("block", "n", "bounds")
    local = lookup_join(placed, cuts, ["block"]).withColumn("place", permuted(F.col("block"), F.col("n"), position, seed))
    sent = local.select(
        "row",
        "at",
        F.size(F.filter("bounds", lambda b: b <= F.col("place"))).alias("shard"),
        F.xxhash64(F.lit(seed), F.lit(4), "at").alias("h"),
    )
    bits = (max(LEAST_SLICES, rows // shards // SLICE_ROWS) - 1).bit_length()
    sent = sent.withColumn("slice", F.shiftrightunsigned("h", 64 - bits))

    held = sent.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(W.partitionBy("shard").orderBy("slice")) - F.col("held")
    starts = cut(held.select("shard", "slice", before.alias("start")))
    order = F.row_number().over(W.partitionBy("shard", "slice").orderBy("h", "at"))
    received = sent.join(starts, ["shard", "slice"])
    return received.select("row", "shard", (F.col("start") + order - 1).alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Shards as Parquet folders ``shard=N``; the files of one hold its rows by ``slot``, in order of file name."""
    rows = shuffled.select("row.*", F.col("shard"), F.col("slot")).repartitionByRange("shard", "slot")
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
