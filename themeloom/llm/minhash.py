"""Min-hash bands: sets of high Jaccard likeness meet under a common key.

The smallest value of a random order of all hashes agrees for two sets with a
chance of their Jaccard likeness J. A band key is made of ``rows`` such values, so
of ``bands`` keys two sets share one with a chance of 1 - (1 - J ** rows) ** bands.
Which of them are alike is decided afterwards by whoever asks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.plans.joins import lookup_join
from themeloom.plans.lineage import cut

_draw = np.random.Generator(np.random.PCG64(20))
MASKS = _draw.integers(0, 1 << 32, 256, np.uint32)
FACTORS = _draw.integers(0, 1 << 32, 256, np.uint32) | np.uint32(1)


def band_keys(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``bands`` keys a set; the sets are runs of well mixed 64-bit ``hashes`` that begin at ``starts``."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band + 1 << 8 | rows, np.uint64)
        for at in range(band * rows, band * rows + rows):
            least = np.minimum.reduceat((short ^ MASKS[at]) * FACTORS[at], starts)
            key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out.view(np.int64)


def dealt(rows: DataFrame, keys: str, own: Column, tile: int) -> DataFrame:
    """``rows`` once per unit of comparison, named in ``unit``, with ``band``, ``mine`` and ``diagonal``.

    A key with more than ``tile`` rows is dealt in tiles by ``own``, and every pair
    of tiles is a unit, as ``simhash.dealt`` does.
    """
    keyed = rows.select("*", F.explode(keys).alias("band")).drop(keys)
    large = cut(
        keyed.groupBy("band").count().where(F.col("count") > tile)
        .select("band", F.ceil(F.col("count") / tile).cast("int").alias("_tiles"))
    )
    tiled = lookup_join(keyed, large, ["band"], "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    tiled = tiled.withColumn("mine", F.pmod(F.xxhash64(own), F.col("_tiles")).cast("int"))
    units = tiled.select("*", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_other"))
    return units.select(
        *[c for c in rows.columns if c != keys],
        F.xxhash64("band", F.least("mine", "_other"), F.greatest("mine", "_other")).alias("unit"),
        "band",
        "mine",
        (F.col("mine") == F.col("_other")).alias("diagonal"),
    )
