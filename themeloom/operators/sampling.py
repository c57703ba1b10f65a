"""Repeatable samples.

Rows are ordered by a seeded hash of their key, so a sample depends on the data
and the seed only, never on how the data is partitioned. Keys must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.hashing import seeded_hash, unit_interval
from themeloom.operators.profiles import value_counts
from themeloom.operators.quotas import sample_cells
from themeloom.options import SampleOptions
from themeloom.plans.joins import lookup_join
from themeloom.plans.lineage import cut

# Hex digits of the hash that form a bucket: 65,536 slices of every stratum.
BUCKET_DIGITS = 4


def take_per_cell(
    rows: DataFrame,
    cells: DataFrame,
    cell_keys: list[str],
    key: str,
    seed: int,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """The first ``take`` rows of every cell in hash order, exactly.

    ``cells`` holds ``take`` and any columns to carry along, one row per cell.
    Cells, hashes and keys are read once into a narrow table. Counting it per
    cell and hash bucket tells in which bucket a cell's quota ends; only that
    bucket, 1/65,536 of the cell, is ranked, for the hash at which the cell ends.
    The rows themselves are read once and never move.
    """
    digest = seeded_hash(key, seed)
    narrow = cut(rows.select(*cell_keys, F.col(key).alias("_key"), digest.alias("_hash")))
    narrow = narrow.withColumn("_bucket", F.substring("_hash", 1, digits))
    by_cell = Window.partitionBy(*cell_keys).orderBy("_bucket")
    running = (
        narrow.groupBy(*cell_keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(by_cell))
    )
    reached = F.when(F.col("_upto") >= F.col("take"), F.struct("_bucket", "_upto", "_n"))
    ends = cut(
        lookup_join(running, cells.select(*cell_keys, "take"), cell_keys)
        .groupBy(*cell_keys)
        .agg(F.min(reached).alias("_end"), F.max("take").alias("take"))
        .select(
            *cell_keys,
            F.col("_end._bucket").alias("_last_bucket"),
            (F.col("take") - (F.col("_end._upto") - F.col("_end._n"))).alias("_rest"),
        )
    )
    in_cell = Window.partitionBy(*cell_keys).orderBy("_hash", "_key")
    last = (
        lookup_join(narrow, ends, cell_keys)
        .where(F.col("_bucket") == F.col("_last_bucket"))
        .withColumn("_rank", F.row_number().over(in_cell))
        .where(F.col("_rank") == F.col("_rest"))
        .select(*cell_keys, F.struct("_hash", "_key").alias("_last"))
    )
    # Cells smaller than their quota have no end and are taken whole.
    bounds = ends.select(*cell_keys, F.col("_last_bucket").isNull().alias("_whole"))
    bounds = cut(lookup_join(bounds, cut(last), cell_keys, "left"))
    bounds = _carry(bounds, cells, cell_keys)
    at = F.struct(digest.alias("_hash"), F.col(key).alias("_key"))
    return (
        lookup_join(rows, bounds, cell_keys)
        .where(F.col("_whole") | (at <= F.col("_last")))
        .drop("_whole", "_last")
    )


def _carry(bounds: DataFrame, cells: DataFrame, cell_keys: list[str]) -> DataFrame:
    extra = [c for c in cells.columns if c not in cell_keys and c not in ("quota", "pop", "take")]
    if not extra:
        return bounds
    return cut(lookup_join(bounds, cells.select(*cell_keys, *extra), cell_keys))


def capped_sample(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows in hash order, or all when there are fewer."""
    cell = rows.sparkSession.range(1).select(F.lit(0).alias("_cell"), F.lit(n).cast("bigint").alias("take"))
    return take_per_cell(rows.withColumn("_cell", F.lit(0)), cell, ["_cell"], key, seed).drop("_cell")


def is_sampled(key: Column | str, fraction: Column | float, seed: int) -> Column:
    """Bernoulli choice of a row from its key; also works on streams."""
    bound = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return unit_interval(seeded_hash(key, seed)) < bound


def bernoulli_sample(
    rows: DataFrame, fraction: float, key: str, seed: int, cap: int | None = None
) -> DataFrame:
    """Each row with probability ``fraction``; at most ``cap``, in hash order."""
    chosen = rows.where(is_sampled(key, fraction, seed))
    return chosen if cap is None else capped_sample(chosen, cap, key, seed)


def _with_cell(rows: DataFrame, cells: DataFrame, stratum: str, substratum: str) -> DataFrame:
    """Rows with the columns that name their sampling cell."""
    split = cells.where("by_substratum").select("stratum").limit(1).collect()
    is_split = F.col(stratum).eqNullSafe(F.lit(split[0][0])) if split else F.lit(False)
    return rows.select(
        "*",
        F.col(stratum).alias("_stratum"),
        is_split.alias("_by_substratum"),
        F.when(is_split, F.col(substratum)).alias("_substratum"),
    )


_CELL_KEYS = ["_stratum", "_by_substratum", "_substratum"]


def _cells_of(rows: DataFrame, stratum: str, substratum: str, options: SampleOptions) -> DataFrame:
    counts = cut(
        value_counts(
            rows.select(F.col(stratum).alias("stratum"), F.col(substratum).alias("substratum")),
            "stratum",
            "substratum",
        )
    )
    return cut(sample_cells(counts, options))


def _renamed(cells: DataFrame) -> DataFrame:
    return cells.select(
        F.col("stratum").alias("_stratum"),
        F.col("by_substratum").alias("_by_substratum"),
        F.col("substratum").alias("_substratum"),
        "pop",
        "quota",
        "take",
        "sampling_stage",
    )


def stratified_sample(
    rows: DataFrame, stratum: str, substratum: str, key: str, options: SampleOptions
) -> DataFrame:
    """Exactly ``take`` rows of every cell, tagged with ``sampling_stage``.

    The input is read three times, whatever the number of strata: for counts,
    for hashes, and for the rows themselves. Filters on the text make the first
    two read it too.
    """
    cells = _cells_of(rows, stratum, substratum, options)
    placed = _with_cell(rows, cells, stratum, substratum)
    return take_per_cell(placed, _renamed(cells), _CELL_KEYS, key, options.seed).drop(*_CELL_KEYS)


def stratified_sample_bernoulli(
    rows: DataFrame, stratum: str, substratum: str, key: str, options: SampleOptions
) -> DataFrame:
    """Each row with probability ``quota / pop`` of its cell: sizes hold on average."""
    cells = _cells_of(rows, stratum, substratum, options)
    placed = _with_cell(rows, cells, stratum, substratum)
    fraction = F.col("quota") / F.col("pop")
    return (
        lookup_join(placed, _renamed(cells), _CELL_KEYS)
        .where((F.col("quota") >= F.col("pop")) | is_sampled(key, fraction, options.seed))
        .drop(*_CELL_KEYS, "pop", "quota", "take")
    )


def surrogate_id(rows: DataFrame, key: str, seed: int = 0, name: str = "sample_id") -> DataFrame:
    """Consecutive ids 0, 1, 2, ... in hash order of a unique key.

    A rank over all rows without one task sorting them: rows are numbered
    inside 65,536 hash buckets, and each bucket starts where the rows of the
    earlier ones end. That table of starts has at most 65,536 rows.
    """
    hashed = rows.withColumn("_hash", seeded_hash(key, seed)).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    in_bucket = Window.partitionBy("_bucket").orderBy("_hash", key)
    return (
        hashed.join(F.broadcast(starts), "_bucket")
        .withColumn(name, F.col("_start") + F.row_number().over(in_bucket) - 1)
        .drop("_hash", "_bucket", "_start")
    )
