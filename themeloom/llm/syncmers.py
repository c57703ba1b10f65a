"""Document fingerprints from closed syncmers, with DataFrame functions only.

A k-mer of code points is an anchor if the smallest of its s-mers (by XXH64)
stands at one of its edges. That depends on the k-mer alone, so equal passages
have equal anchors wherever they stand, and the anchors of a text put together
from parts are those of the parts and of the seams. The fingerprint is every
anchor with its place. Two texts are matched by position: what they share are
links, two neighbouring anchors at the same distance, so a shared passage is a
chain of links at one shift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from themeloom.llm.common import bound_to, text_or_empty
from themeloom.plans.lineage import cut

SMER = 4
SPAN = 16  # s-mers in a k-mer; the sliding minimum takes two steps of four
K = SMER + SPAN - 1
LOW = 0xFFFFFFFF
MOST_RANGES = 16_384


def anchors(text: Column, before: Column | int = 0) -> Column:
    """All closed syncmers of ``text`` in order; none if it is shorter than ``K``.

    An anchor is a long: its place (plus ``before``) over 32 bits of the hash of
    its k-mer. Of any ``SPAN - 1`` neighbouring k-mers one is an anchor.
    """
    inner = F.transform(
        F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{SMER}}}))"), F.lit(1)), lambda x: F.xxhash64(x)
    )

    def least_of_four(a: Column, by: int) -> Column:
        return F.transform(a, lambda x, i: F.least(x, *[F.get(a, i + n * by) for n in (1, 2, 3)]))

    def minimum(h: Column) -> Column:
        return bound_to(least_of_four(h, 1), lambda a: least_of_four(a, 4))

    def selected(h: Column, least: Column) -> Column:
        at = lambda i: F.get(h, i)
        places = F.filter(
            F.sequence(F.lit(0), F.size(h) - SPAN),
            lambda i: F.get(least, i) == F.least(at(i), at(i + SPAN - 1)),
        )
        # Every fourth s-mer together spell the k-mer.
        spelt = [*range(0, SPAN - 1, SMER), SPAN - 1]
        offset = F.lit(before).cast("long") if isinstance(before, int) else before.cast("long")
        return F.transform(
            places,
            lambda i: F.shiftleft(i + offset, 32).bitwiseOR(F.xxhash64(*[at(i + s) for s in spelt]).bitwiseAND(F.lit(LOW))),
        )

    def of(h: Column) -> Column:
        return F.when(F.size(h) >= SPAN, bound_to(minimum(h), lambda m: selected(h, m))).otherwise(no_anchors())

    return bound_to(inner, of)


def within(marks: Column, size: Column) -> Column:
    """The anchors ``marks`` that lie in the first ``size`` characters."""
    return bound_to(F.shiftleft((size - (K - 1)).cast("long"), 32), lambda end: F.filter(marks, lambda x: x < end))


def no_anchors() -> Column:
    return F.array().cast("array<bigint>")


def fingerprint(marks: Column, whole: Column) -> Column:
    """The anchors ``marks``; a text too short for any is its own anchor at place 0, the empty text has none."""
    own = F.when(whole == "", no_anchors()).otherwise(F.array(F.xxhash64(whole).bitwiseAND(F.lit(LOW))))
    return bound_to(marks, lambda m: F.when(F.size(m) > 0, m).otherwise(own))


def _from_last(marks: Column, i: Column) -> Column:
    """Anchor ``i`` with the distance from the anchor before in place of its place."""
    before = F.shiftright(F.get(marks, i - 1), 32)
    return F.get(marks, i) - F.when(i > 0, F.shiftleft(before, 32)).otherwise(F.lit(0))


def links(marks: Column) -> Column:
    """Hashes (even) of neighbouring anchors and their distance; of a lone anchor the anchor's."""

    def of(m: Column) -> Column:
        link = lambda i: F.xxhash64(F.get(m, i - 1).bitwiseAND(F.lit(LOW)), _from_last(m, i))
        several = F.transform(F.sequence(F.lit(1), F.size(m) - 1), lambda i: link(i).bitwiseAND(F.lit(-2)))
        lone = F.transform(m, lambda x: F.xxhash64(x.bitwiseAND(F.lit(LOW))).bitwiseAND(F.lit(-2)))
        return F.when(F.size(m) > 1, several).otherwise(lone)

    return bound_to(marks, of)


def likeness(a: Column, b: Column) -> Column:
    """Links that both have, each as often as in both, of those that either has; 1 for two empty texts.

    If one side repeats no link, those are the links in common. Else, sorted
    together, the copies of a link stand side by side, those of ``b`` (made odd)
    last: each of them takes one of ``a`` that is left over.
    """
    both = F.sort_array(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(F.lit(1)))))
    state = lambda link, left, met: F.struct(link.alias("link"), left.alias("left"), met.alias("met"))

    def step(s: Column, x: Column) -> Column:
        link = x.bitwiseAND(F.lit(-2))
        left = F.when(s["link"] == link, s["left"]).otherwise(F.lit(0))
        own = x == link
        return state(
            link,
            F.when(own, left + 1).otherwise(F.greatest(left - 1, F.lit(0))),
            s["met"] + F.when(own | (left == 0), F.lit(0)).otherwise(F.lit(1)),
        )

    counted = F.aggregate(both, state(F.lit(1).cast("long"), F.lit(0), F.lit(0)), step, lambda s: s["met"])
    single = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    met = F.when(single(a) | single(b), F.size(F.array_intersect(a, b))).otherwise(counted)
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(bound_to(met, lambda m: m / (total - m)))


def shown(marks: Column) -> Column:
    """The fingerprint as text: of each anchor a hex digit, the distance from the last, and eight of its hash."""

    def of(m: Column) -> Column:
        anchor = lambda x, i: F.lpad(F.hex(_from_last(m, i)), 9, "0")
        some = F.lower(F.array_join(F.transform(m, anchor), ""))
        return F.when(F.size(m) > 0, some).otherwise(F.lit(""))

    return bound_to(marks, of)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, anchors)`` per row; null text counts as empty."""
    whole = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("whole"))
    return whole.select(F.col("k").alias(key), fingerprint(anchors(F.col("whole")), F.col("whole")).alias("anchors"))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(k, whole, range, guest)``, dealt by ``range`` so that each row's next is in its range.

    Rows go by descending key, null last, equal keys by text. Keys are cut into
    as many ranges as four times the session's shuffle partitions, at quantiles
    of all keys. The first row of the range that comes next joins each range as
    a guest behind its own rows; the first row of all is the guest of the last.
    """
    spark = docs.sparkSession
    ranges = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    rows = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("whole"))
    points = [i / ranges for i in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx("k", points or [0.5], 10 * ranges).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    sorted_bounds = F.lit(bounds).cast("array<bigint>") if bounds else no_anchors()
    steps = F.array(*[F.lit(1 << i) for i in range(len(bounds).bit_length(), -1, -1)])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when(F.get(sorted_bounds, low + step - 1) < F.col("k"), low + step).otherwise(low),
    )
    placed = rows.select(
        "k", "whole", F.when(F.col("k").isNull(), F.lit(-1)).otherwise(found).alias("range"), F.xxhash64("whole").alias("tie")
    )
    # The first row of a range: the largest key, of these the smallest hash of the text.
    tops = placed.groupBy("range").agg(F.min(F.struct((-F.col("k")).alias("k"), "tie")).alias("top"))
    tops = cut(tops.select("range", (-F.col("top.k")).alias("k"), "top.tie"))  # a row per range
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("range"))
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    either = lambda c: F.coalesce(F.lead(F.struct("k", "tie")).over(order), F.first(F.struct("k", "tie")).over(whole))[c]
    wanted = tops.select("range", either("k").alias("_k"), either("tie").alias("_tie"))
    guests = (
        placed.drop("range")
        .join(F.broadcast(wanted), F.col("k").eqNullSafe(F.col("_k")) & (F.col("tie") == F.col("_tie")))
        .groupBy("range")
        .agg(F.first("k").alias("k"), F.first("whole").alias("whole"))
    )
    own = placed.select("k", "whole", "range", F.lit(False).alias("guest"))
    return own.unionByName(guests.select("k", "whole", "range", F.lit(True).alias("guest")))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, one row per row of ``docs``.

    ``(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)``. In the edited text the last third (rounded down) is replaced by
    the beginning of the next document's text, by descending key. Null texts
    count as empty; null keys come last; repeated rows follow one another; a
    single document is its own next; an empty table gives an empty result. Keys
    must be whole numbers; other columns are not looked at.

    Texts move once. An edited text's anchors are those of its unchanged part,
    of the seam and of the new end; only those of the seam are not made already.
    A fingerprint has all its anchors, about one of eight characters. A text must fit in a task with its
    s-mers (about 60 bytes a character).
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, key, text).repartition(parts, "range")
    size = F.length("whole")
    rows = rows.withColumn("n_chars", size.cast("long")).withColumn("keep", size - F.floor(size / 3).cast("int"))
    whole, keep = F.col("whole"), F.col("keep")
    rows = rows.withColumn("marks", anchors(whole))
    rows = rows.withColumn("links", links(fingerprint(F.col("marks"), whole)))
    order = W.partitionBy("range").orderBy("guest", F.desc_nulls_last("k"), F.xxhash64("whole"))
    following = F.lead(F.struct("whole", "marks", "links")).over(order)
    rows = rows.withColumn("following", following).where(~F.col("guest"))
    first = F.substring(whole, F.lit(1), keep)
    head = F.substring(F.col("following.whole"), F.lit(1), (F.col("n_chars") - keep).cast("int"))
    rows = rows.select("*", head.alias("head")).select("*", F.concat(first, F.col("head")).alias("edited"))
    # A k-mer over the seam has fewer than K characters of either side.
    seam_from = F.greatest(keep - (K - 2), F.lit(1))
    seam = F.concat(F.substring(whole, seam_from, keep - seam_from + 1), F.substring("head", 1, K - 1))
    of_head = within(F.col("following.marks"), F.length("head"))
    moved = bound_to(F.shiftleft(keep.cast("long"), 32), lambda by: F.transform(of_head, lambda x: x + by))
    made = F.concat(within(F.col("marks"), keep), anchors(seam, seam_from - 1), moved)
    rows = rows.withColumn("anchors", fingerprint(F.col("marks"), whole))
    rows = rows.withColumn("edited_anchors", fingerprint(made, F.col("edited")))
    return rows.select(
        F.col("k").alias(key),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("anchors")).alias("fingerprint"),
        shown(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("links"), links(F.col("edited_anchors"))).alias("near_edited"),
        likeness(F.col("links"), F.col("following.links")).alias("near_next"),
    )
