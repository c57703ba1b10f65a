"""Exact duplicates through an extendible-hash index on shared files.

A directory of 2^G pointers maps the leading hash bits to buckets. Each bucket
owns a range of hashes; one that would hold more than ``capacity`` distinct
hashes is split by one bit more, doubling its part of the directory, until it
fits or the directory is at its full depth (then it chains on). Owner tasks each
take a range of buckets, keep the entries of equal hash as a chain, and compare
their bytes: that decides which texts are equal. All of it is DataFrame
functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from themeloom.llm.common import SPACE_RUN, text_or_empty
from themeloom.plans.lineage import cut

START_DEPTH = 4
FULL_DEPTH = 16  # 65,536 pointers at most: a fixed bound of about 1 MB, whatever the data


SALTS = 16  # entries of equal text that may come to its owner


@dataclass(frozen=True)
class ExactIndex:
    """``entries``: (bucket, h, chain, sha, keep_id, group_size); ``slots``: (at, k, h, sha), a row per document."""

    directory: DataFrame
    entries: DataFrame
    slots: DataFrame


def normalised(text: str | Column) -> Column:
    """White space runs as one space; null as the empty text."""
    return F.regexp_replace(text_or_empty(text), SPACE_RUN, " ")


def directory(hashes: DataFrame, capacity: int) -> DataFrame:
    """``(slot, depth, bucket)`` for every used pointer of the distinct hashes ``(h)``.

    ``bucket`` is the first slot of its range, so buckets are in key order. The
    table has one row per slot in use, never more than 2^FULL_DEPTH.
    """
    slots = hashes.groupBy(_slot("h").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    levels = slots.select(
        "slot", "n", F.explode(F.sequence(F.lit(START_DEPTH), F.lit(FULL_DEPTH))).alias("depth")
    ).withColumn("bucket", _first_slot("slot", "depth"))
    sizes = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("held"))
    # A bucket stays at the first depth at which it fits; the full depth takes what is left.
    fits = sizes.where((F.col("held") <= capacity) | (F.col("depth") == FULL_DEPTH))
    return (
        levels.join(fits, ["depth", "bucket"])
        .groupBy("slot")
        .agg(F.min("depth").alias("depth"))
        .withColumn("bucket", _first_slot("slot", "depth"))
    )


def _slot(h: str) -> Column:
    return F.shiftrightunsigned(h, 64 - FULL_DEPTH).cast("int")


def _first_slot(slot: str, depth: str) -> Column:
    width = F.expr(f"shiftleft(1, {FULL_DEPTH} - {depth})")
    return (F.col(slot) - F.pmod(F.col(slot), width)).cast("int")


def build_index(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 100_000
) -> ExactIndex:
    """The index of all rows of ``docs``, on files in the shared folder.

    Map tasks fold copies into at most SALTS entries per text and task, and
    these into SALTS per text, so a text with a third of all rows comes to its
    owner a few times only. The directory routes the entries, with their texts,
    to the owners of their bucket's key range. There the entries of one hash are
    a chain in order of their bytes; where the bytes differ from the entry
    before, another text begins, so texts whose hashes collide stay apart.
    """
    plain = docs.select(F.col(key).alias("k"), normalised(text).alias("norm"))
    slots = cut(
        plain.select(
            F.monotonically_increasing_id().alias("at"), "k", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("sha")
        )
    )
    pointers = cut(directory(slots.select("h").distinct(), capacity))
    folded = plain.groupBy("norm", F.pmod(F.xxhash64("k"), F.lit(SALTS)).alias("salt")).agg(
        F.min("k").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )
    hashed = folded.withColumn("h", F.xxhash64("norm")).withColumn("slot", _slot("h"))
    routed = hashed.join(F.broadcast(pointers.select("slot", "bucket")), "slot").repartitionByRange("bucket", "h")
    same_hash = W.partitionBy("bucket", "h").orderBy("norm", "salt")
    begins = F.when(F.lag("norm").over(same_hash) == F.col("norm"), 0).otherwise(1)
    chained = (
        routed.withColumn("begins", begins)
        .withColumn("chain", F.sum("begins").over(same_hash.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("sha", F.sha2("norm", 256))
    )
    entries = cut(
        chained.groupBy("bucket", "h", "chain", "sha").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    )
    return ExactIndex(pointers, entries, slots)


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 100_000
) -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Of equal texts exactly one row stays, that with the smallest key; of rows that
    repeat both key and text any one. Null text counts as empty. A null key never
    wins over another; of a group with null keys only one row stays, and its
    ``keep_id`` is null. Other columns are not looked at; an empty table gives an
    empty result.
    """
    index = build_index(docs, key, text, capacity)
    first = F.min(F.struct(F.col("k").isNull().alias("unknown"), "k", "at"))["at"]
    stays = index.slots.groupBy("h", "sha").agg(first.alias("stays"))
    entries = index.entries.select("h", "sha", "keep_id", "group_size").join(stays, ["h", "sha"])
    entries = cut(entries).select(F.col("h").alias("_h"), F.col("sha").alias("_sha"), "keep_id", "group_size", "stays")
    return index.slots.join(
        entries, (F.col("h") == F.col("_h")) & (F.col("sha") == F.col("_sha"))
    ).select(
        F.col("k").alias(key),
        "keep_id",
        "group_size",
        (F.col("at") == F.col("stays")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def first_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 100_000) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay: one of each group of equal texts."""
    found = exact_duplicates(docs, key, text, capacity)
    found = cut(found.select(F.col(key).alias("_k"), F.col("text_sha256").alias("_sha"), "keep_id", "kept"))
    kept = found.where("kept").select("_k", "_sha")
    rows = docs.select(F.struct("*").alias("row"), F.sha2(normalised(text), 256).alias("sha"), F.col(key).alias("k"))
    same = F.col("k").eqNullSafe(F.col("_k")) & (F.col("sha") == F.col("_sha"))
    chosen = rows.join(kept, same, "left_semi")
    least = found.where(F.col("_k").eqNullSafe(F.col("keep_id")))
    again = cut(least.groupBy("_k", "_sha").count().where("count > 1").select("_k", "_sha"))
    if not again.isEmpty():  # rows that repeat key and text: any one of them
        chosen = chosen.join(again, same, "left_anti").unionByName(
            chosen.join(again, same, "left_semi").dropDuplicates(["k", "sha"])
        )
    return chosen.select("row.*")
