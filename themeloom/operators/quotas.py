"""How many rows each stratum contributes to a sample.

Works on count tables: one row per stratum. Budgets are one-row aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.options import SampleOptions

ISSUE_STAGE = "issue_stratified"
PRODUCT_STAGE = "product_stratified"

# Quotas are sums of fractions: differences below this are rounding.
ROUNDING = 1e-6


def allocate_strata(counts: DataFrame, options: SampleOptions) -> DataFrame:
    """Quota per stratum from a ``(stratum, pop)`` table.

    Strata of at most ``min_per_stratum`` rows are taken whole. Each larger one
    gets that minimum plus a share of the remaining budget in proportion to its
    size; the share alone is capped at ``max_share * total``, and the quota at
    the population. What the caps leave over is not handed out again.
    """
    pop = F.col("pop")
    is_small = pop <= options.min_per_stratum
    budget = counts.agg(
        F.coalesce(F.sum(F.when(is_small, pop)), F.lit(0)).alias("small"),
        F.coalesce(F.sum(F.when(~is_small, pop)), F.lit(0)).alias("large"),
        F.count_if(~is_small).alias("n_large"),
    ).first()
    reserved = budget["small"] + budget["n_large"] * options.min_per_stratum
    remaining = options.total - reserved
    if remaining < 0:
        raise ValueError(f"the sample size {options.total} is too small: need at least {reserved}")
    share = F.lit(float(remaining)) * (pop / F.lit(float(budget["large"] or 1)))
    capped = F.least(share, F.lit(options.total * options.max_share))
    quota = F.when(is_small, pop.cast("double")).otherwise(
        F.least(F.lit(float(options.min_per_stratum)) + capped, pop.cast("double"))
    )
    return scale_to_total(counts.withColumn("quota", quota), options)


def scale_to_total(allocation: DataFrame, options: SampleOptions) -> DataFrame:
    """Shrink large strata when quotas exceed the sample size.

    Quotas of :func:`allocate_strata` cannot exceed it; other tables may. Large
    quotas are scaled and floored; what is still too much comes off the largest
    stratum (of equals, the one whose name sorts last).
    """
    is_large = F.col("pop") > options.min_per_stratum
    allocated = allocation.agg(F.sum("quota")).first()[0] or 0.0
    if allocated <= options.total * (1 + 1e-9):
        return allocation
    scaled = allocation.withColumn(
        "quota",
        F.when(is_large, F.floor(F.col("quota") * F.lit(options.total / allocated)).cast("double"))
        .otherwise(F.col("quota")),
    )
    rest = scaled.agg(
        F.greatest(F.sum("quota") - options.total, F.lit(0.0)).alias("excess"),
        F.max(F.when(is_large, F.struct("pop", "stratum"))).alias("top"),
    ).first()
    if rest["top"] is None or not rest["excess"]:
        return scaled
    on_largest = F.col("stratum").eqNullSafe(F.lit(rest["top"]["stratum"]))
    return scaled.withColumn(
        "quota", F.col("quota") - F.when(on_largest, F.lit(rest["excess"])).otherwise(0.0)
    )


def allocate_substrata(
    counts: DataFrame, allocation: DataFrame, options: SampleOptions
) -> DataFrame:
    """Quotas for the values of a second field inside the largest stratum.

    ``counts`` is ``(stratum, substratum, pop)``. Every substratum gets
    ``min_per_substratum`` plus its proportional part, at most its population;
    when the quota cannot hold the minima, the floored proportional part, at
    least one. What is missing to the stratum's quota, or too much, goes to the
    largest substratum and on to the next ones as populations and zero allow.
    Empty when the quota is not above twice the minimum.
    """
    top = allocation.agg(F.max(F.struct("pop", "stratum", "quota")).alias("t")).first()["t"]
    minimum = options.min_per_substratum
    inside = F.lit(False)
    if top is not None and top["quota"] > 2 * minimum:
        inside = F.col("stratum").eqNullSafe(F.lit(top["stratum"]))
    target = float(top["quota"]) if top is not None else 0.0
    chosen = counts.where(inside)
    size = chosen.agg(F.count(F.lit(1)).alias("n"), F.sum("pop").alias("pop")).first()
    population = float(size["pop"] or 1)
    remaining = target - size["n"] * minimum
    pop = F.col("pop")
    if remaining < 0:
        quota = F.greatest(
            F.lit(1.0), F.floor(F.lit(target) * (pop / F.lit(population))).cast("double")
        )
    else:
        proportional = F.lit(remaining) * (pop / F.lit(population))
        quota = F.least(F.lit(float(minimum)) + proportional, pop.cast("double"))
    first = chosen.withColumn("quota", quota)
    gap = target - (first.agg(F.sum("quota")).first()[0] or 0.0)
    if abs(gap) < ROUNDING:
        return first
    return first.withColumn("quota", F.col("quota") + _spill(gap))


def _spill(gap: float) -> Column:
    """The part of ``gap`` each row takes, largest population first."""
    order = [F.desc("pop"), F.desc_nulls_last("substratum")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("pop") - F.col("quota") if gap > 0 else F.col("quota")
    taken_before = F.coalesce(F.sum(room).over(before), F.lit(0.0))
    part = F.greatest(F.least(F.lit(abs(gap)) - taken_before, room), F.lit(0.0))
    return part if gap > 0 else -part


def sample_cells(
    counts: DataFrame, options: SampleOptions
) -> DataFrame:
    """One row per sampling cell: ``(stratum, by_substratum, substratum, pop, quota, sampling_stage)``.

    The largest stratum is split by substratum, every other stratum is one cell.
    ``counts`` is ``(stratum, substratum, pop)`` and should be cut already.
    """
    strata = counts.groupBy("stratum").agg(F.sum("pop").alias("pop"))
    allocation = allocate_strata(strata, options)
    fine = allocate_substrata(counts, allocation, options)
    split = fine.select("stratum").limit(1).collect()
    is_split = F.col("stratum").eqNullSafe(F.lit(split[0][0])) if split else F.lit(False)
    return (
        fine.select(
            "stratum",
            F.lit(True).alias("by_substratum"),
            "substratum",
            "pop",
            "quota",
            F.lit(ISSUE_STAGE).alias("sampling_stage"),
        )
        .unionByName(
            allocation.where(~is_split).select(
                "stratum",
                F.lit(False).alias("by_substratum"),
                F.lit(None).cast(counts.schema["substratum"].dataType).alias("substratum"),
                "pop",
                "quota",
                F.lit(PRODUCT_STAGE).alias("sampling_stage"),
            )
        )
        .where(F.col("quota") > 0)
        .transform(with_whole_numbers)
    )


def with_whole_numbers(cells: DataFrame) -> DataFrame:
    """Adds ``take``: quotas as whole numbers that add up to the rounded sum.

    Every cell gets its quota rounded down; what is missing goes to the largest
    remainders, ties by name. One row per cell: a table of counts.
    """
    down = F.floor(F.col("quota") + ROUNDING)
    remainder = F.round(F.col("quota") - down, 6)
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(
        F.desc(remainder), F.asc_nulls_first("stratum"), "by_substratum", F.asc_nulls_first("substratum")
    )
    missing = F.round(F.sum("quota").over(everything)) - F.sum(down).over(everything)
    extra = (F.row_number().over(order) <= missing) & (down < F.col("pop"))
    return cells.withColumn("take", (down + F.when(extra, 1).otherwise(0)).cast("bigint"))
