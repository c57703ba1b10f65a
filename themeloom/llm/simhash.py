"""Near-duplicate documents by SimHash, compared in vertical bit planes.

Fingerprints that differ in at most ``radius`` bits are linked. Of ``blocks``
bit blocks at least ``blocks - radius`` then agree, so every linked pair meets
under one of the keys made of that many blocks. Within a key the fingerprints
stand in bit planes (plane j holds bit j of all of them); one query updates the
distances to all with carry-save counters and stops once all exceed the radius.
A breadth-first search that only asks for fingerprints not reached yet leaves
one tree of links per connected group, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.components import components
from themeloom.plans.lineage import cut

BITS = 64
SEED = 42


def shingle_fingerprint(text: str | None, width: int) -> int:
    """Majority bits of the XXH64 of all ``width``-word shingles; 0 without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    last = max(len(words) - width, 0)
    hashes = np.fromiter(
        (digest(b" ".join(words[i : i + width]), SEED) for i in range(last + 1)), np.uint64, last + 1
    )
    counts = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, last // 65536 + 1):
        bits = np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, BITS)
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > last + 1).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """``(key, fp)``: one row per document; null text counts as empty, a null key stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingle_fingerprint(t.as_py(), width) for t in batch.column(1)]
            signed = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], ["k", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"k {kind}, fp long").withColumnRenamed("k", key)


def table_masks(blocks: int, radius: int) -> list[int]:
    """The bits of each choice of ``blocks - radius`` bit blocks: a table of keys each."""
    if radius >= blocks:
        raise ValueError("more blocks than the radius are needed")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    bits = [((1 << (high - low)) - 1) << low for low, high in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(bits, blocks - radius)]


def block_keys(fp: Column, blocks: int, radius: int) -> Column:
    """One key per table, with the number of the table."""
    keys = []
    for number, mask in enumerate(table_masks(blocks, radius)):
        signed = mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask
        keys.append(F.struct(F.lit(number).alias("table"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


class BitPlanes:
    """Fingerprints stored as bit planes, one lane each."""

    def __init__(self, values: np.ndarray, bits: int = BITS) -> None:
        self.values = [int(v) for v in values]
        self.full = (1 << len(values)) - 1
        rows = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        packed = np.packbits(rows.T, axis=1, bitorder="little")
        # Plane 0 is the highest bit; planes on which all lanes agree come last or not at all.
        planes = [int.from_bytes(p.tobytes(), "little") for p in packed]
        self.planes = [(BITS - 1 - i, p) for i, p in enumerate(planes) if p not in (0, self.full)]

    def within(self, lane: int, radius: int, asked: int) -> int:
        """Which of the ``asked`` lanes differ from ``lane`` in at most ``radius`` bits."""
        full, value = self.full, self.values[lane]
        size = (radius + 1).bit_length()
        start = (1 << size) - 1 - radius  # a counter overflows at radius + 1 differences
        counters = [full if start >> b & 1 else 0 for b in range(size)]
        alive = asked
        for bit, plane in self.planes:
            carry = plane ^ full if value >> bit & 1 else plane
            for b in range(size):
                counters[b], carry = counters[b] ^ carry, counters[b] & carry
                if not carry:
                    break
            else:
                alive &= ~carry
                if not alive:
                    break
        return alive


def tree_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Lane pairs that connect what is linked: one tree per connected group."""
    planes = BitPlanes(values)
    unseen, links = planes.full, []
    while unseen:
        start = (unseen & -unseen).bit_length() - 1
        unseen ^= 1 << start
        queue = [start]
        while queue and unseen:
            lane = queue.pop()
            near = planes.within(lane, radius, unseen)
            unseen ^= near
            while near:
                low = near & -near
                near ^= low
                found = low.bit_length() - 1
                links.append((lane, found))
                queue.append(found)
    return links


def dealt(rows: DataFrame, fp: str, radius: int, blocks: int, tile: int) -> DataFrame:
    """``rows`` once per unit of comparison, named in ``unit``; rows that may be linked share one.

    ``table`` is the table of its key, ``own`` the row's tile, ``diagonal`` tells
    whether the unit is a tile with itself.

    A key with more than ``tile`` rows is dealt in tiles, and every pair of
    tiles is a unit of its own, so no task holds more than two tiles at a time
    and none of the pairs is lost.
    """
    keyed = rows.select("*", F.explode(block_keys(F.col(fp), blocks, radius)).alias("_key"))
    large = cut(
        keyed.groupBy("_key").count().where(F.col("count") > tile)
        .select(F.col("_key").alias("_large"), F.ceil(F.col("count") / tile).cast("int").alias("_tiles"))
    )
    tiles = F.coalesce("_tiles", F.lit(1))
    tiled = keyed.join(large, F.col("_key") == F.col("_large"), "left").withColumn(
        "_own", F.pmod(F.xxhash64(*rows.columns), tiles).cast("int")
    )
    units = tiled.select("*", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("_other"))
    unit = F.xxhash64("_key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return units.select(
        *rows.columns,
        unit.alias("unit"),
        F.col("_key.table").alias("table"),
        F.col("_own").alias("own"),
        (F.col("_own") == F.col("_other")).alias("diagonal"),
    )


def links(values: DataFrame, radius: int, blocks: int, tile: int, skim: bool = False) -> DataFrame:
    """``(src, dst)`` between the distinct fingerprints ``(fp)``: a tree per unit and group.

    ``skim`` passes over small units without a close pair, seen for a whole batch
    at once; worth it where most units hold a chance meeting of two or three.
    """
    units = dealt(values.select("fp"), "fp", radius, blocks, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in _runs(batches, radius if skim else None):
            found = tree_links(fps.view(np.uint64), radius)
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], ["src", "dst"])

    return (
        units.repartition("unit")
        .sortWithinPartitions("unit", "fp")
        .select("unit", "fp")
        .mapInArrow(run, "src long, dst long")
    )


SKIMMED = 8  # rows of the largest unit that is skimmed


def _has_close_pair(units: np.ndarray, fps: np.ndarray, starts: np.ndarray, radius: int) -> np.ndarray:
    """For each unit of at most SKIMMED rows whether two rows are close."""
    near = np.zeros(len(units), bool)
    for by in range(1, SKIMMED):
        same = np.flatnonzero(units[by:] == units[:-by])
        if not len(same):
            break
        near[same[np.bitwise_count(fps[same + by] ^ fps[same]) <= radius]] = True
    return np.logical_or.reduceat(near, starts)


def _runs(batches: Iterator[pa.RecordBatch], skim: int | None) -> Iterator[np.ndarray]:
    """The distinct fingerprints of each unit with two or more; units may span batches.

    Units are named by a hash: two that clash only compare more than they need.
    """
    held_unit, held = None, []

    def whole():
        values = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
        return [values] if len(values) > 1 else []

    for batch in batches:
        units = batch.column(0).to_numpy()
        fps = batch.column(1).to_numpy()
        if not len(units):
            continue
        starts = np.concatenate([[0], np.flatnonzero(units[1:] != units[:-1]) + 1])
        ends = np.append(starts[1:], len(units))
        # Runs of one inside the batch have no partner.
        several = ends - starts > 1
        if skim is not None:
            several &= (ends - starts > SKIMMED) | _has_close_pair(units, fps.view(np.uint64), starts, skim)
        several |= (starts == 0) | (ends == len(units))
        for s, e in zip(starts[several], ends[several], strict=True):
            if units[s] != held_unit:
                yield from whole()
                held_unit, held = units[s], []
            held.append(fps[s:e])
    yield from whole()


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 4,
    radius: int = 4,
    blocks: int = 6,
    tile: int = 8192,
) -> DataFrame:
    """``(key, fingerprint, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest key reachable over links. Rows without
    words have fingerprint zero and are linked like any other; null keys stay
    null and are named by no component unless all keys of it are null. Rows that
    repeat each get a row. An empty table gives an empty result; other columns
    of ``docs`` are not looked at.
    """
    rows = cut(fingerprints(docs, key, text, width).select(F.col(key).alias("k"), "fp"))
    named = cut(rows.groupBy("fp").agg(F.min("k").alias("least")))
    roots = components(links(named, radius, blocks, tile))
    placed = named.join(roots, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("own"), F.coalesce("root", "fp").alias("root"), "least"
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    names = cut(placed.select("own", "root").join(least, "root").select("own", "component_id"))
    return rows.join(names, F.col("fp") == F.col("own")).select(
        F.col("k").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
