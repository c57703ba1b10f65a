"""Mixing sources to target weights over a domain, language and source tree.

Budgets run from the root down. At each node the budget is shared out by the
weights of the children; a child that cannot use its share (its tokens times the
allowed epochs) gets what it can use and its shortage goes to its siblings. Only
what a whole subtree cannot use is left to the siblings of its parent, and so on
up. A leaf then takes the first tokens of an endless row of seeded epochs: each
epoch is a new order of the leaf's documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from themeloom.functions.hashing import hex_number, seeded_hash
from themeloom.llm.common import SPACE_RUN, SPACES, word_count
from themeloom.plans.lineage import cut

NULL_NODE = "(null)"
SLICE_DIGITS = 3  # 4,096 slices per leaf; only one of them is ever put in order


@dataclass(frozen=True)
class MixOptions:
    """``weights[level][node]`` are whole numbers, 1 where not given, 0 to leave out.

    ``numerator / denominator`` of all available tokens is the total budget.
    """

    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    other_domain: str = "other"
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    numerator: int = 3
    denominator: int = 5
    max_epochs: int = 3
    seed: int = 17


def domain_of(source: Column, options: MixOptions) -> Column:
    found = F.lit(options.other_domain)
    for name, members in options.domains.items():
        found = F.when(source.isin(*members), F.lit(name)).otherwise(found)
    return found


def leaf_budgets(leaves: DataFrame, options: MixOptions) -> DataFrame:
    """``(domain, lang, source, tokens, budget)`` from ``(domain, lang, source, tokens)``.

    Whole tokens throughout: shares are rounded down and what is left goes to
    the largest remainders, ties to the first name. The table has one row per
    leaf, a property of the corpus layout, not of its rows.
    """
    tree = leaves.withColumn("cap", F.col("tokens") * options.max_epochs)
    weight = lambda level: _weight(level, options)
    domains = tree.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    total = F.sum("tokens").over(W.partitionBy(F.lit(0))) * options.numerator
    domains = domains.select("*", weight("domain").alias("weight"), total.alias("scaled"))
    domains = domains.withColumn("parent", F.expr(f"scaled div {options.denominator}"))
    domains = _shared_out(domains, [], "domain").select("domain", F.col("budget").alias("parent"))
    langs = tree.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    langs = langs.withColumn("weight", weight("lang")).join(domains, "domain")
    langs = _shared_out(langs, ["domain"], "lang").select("domain", "lang", F.col("budget").alias("parent"))
    sources = tree.withColumn("weight", weight("source")).join(langs, ["domain", "lang"])
    return _shared_out(sources, ["domain", "lang"], "source").select(
        "domain", "lang", "source", "tokens", "budget"
    )


def _weight(level: str, options: MixOptions) -> Column:
    found = F.lit(1)
    for name, weight in options.weights.get(level, {}).items():
        found = F.when(F.col(level) == name, F.lit(weight)).otherwise(found)
    return found.cast("long")


def _shared_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes`` (cap, weight, parent = the parent's budget) with their ``budget``.

    Children in order of cap by weight: as long as a child's cap is at most its
    share of what the ones before it have left, it is full.
    """
    group = [F.lit(0), *parent]
    full_order = W.partitionBy(*group).orderBy(F.col("cap") / F.col("weight"), name)
    before = full_order.rowsBetween(W.unboundedPreceding, -1)
    after = full_order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(*group)
    used = nodes.where(F.col("weight") > 0)
    ranked = used.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.sum("weight").over(after).alias("weight_after"),
        F.sum("cap").over(whole).alias("cap_all"),
    )
    wide = "cast({} as decimal(19,0))".format
    ranked = ranked.withColumn("pot", F.least("parent", "cap_all")).withColumn(
        "full",
        F.expr(f"{wide('cap')} * {wide('weight_after')} <= {wide('weight')} * {wide('pot - cap_before')}"),
    )
    summed = lambda c: F.sum(F.when(c[0], F.col(c[1])).otherwise(0)).over(whole)
    ranked = ranked.select(
        "*",
        (F.col("pot") - summed((F.col("full"), "cap"))).alias("free"),
        summed((~F.col("full"), "weight")).alias("free_weight"),
    )
    product, share = f"{wide('free')} * {wide('weight')}", wide("free_weight")
    ranked = ranked.select(
        "*",
        F.expr(f"if(full, cap, cast({product} div {share} as bigint))").alias("base"),
        F.expr(f"if(full, 0, cast({product} % {share} as bigint))").alias("remainder"),
    )
    ranked = ranked.select(
        "*",
        (F.col("pot") - F.sum("base").over(whole)).alias("extra"),
        F.row_number().over(W.partitionBy(*group).orderBy(F.desc("remainder"), name)).alias("rank"),
    )
    return ranked.withColumn(
        "budget",
        F.col("base") + F.when(~F.col("full") & (F.col("rank") <= F.col("extra")), 1).otherwise(0),
    )


def mix(
    docs: DataFrame,
    options: MixOptions,
    key: str = "doc_id",
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` taken, once per epoch, as ``(row, node columns, epoch, ...)``.

    ``row`` holds the columns of ``docs``, so their names cannot clash with the
    others: domain, lang, source, n_tokens, epoch and take_tokens. Tokens are
    words. The last document of a leaf may be taken in part (``take_tokens``
    less than ``n_tokens``); a leaf takes its budget exactly.

    Null languages and sources are nodes of their own, named ``(null)``. Texts
    without words count no tokens; they come along with the tokens around them.
    Rows that repeat are rows of their own. Null keys share one place in an
    epoch's order. A node with weight 0 or without tokens takes nothing.

    No leaf is put in order whole: words are counted per leaf and hash slice,
    slices wholly below the budget are taken as they are, and only the documents
    of the one slice in which the budget ends are ranked.
    """
    node = lambda c: F.coalesce(F.col(c), F.lit(NULL_NODE))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(key).alias("k"),
        domain_of(F.col(source), options).alias("domain"),
        node(lang).alias("lang"),
        node(source).alias("source"),
        word_count(text).alias("n_tokens"),
        F.xxhash64(text).alias("text_hash"),
    )
    leaf = ["domain", "lang", "source"]
    slim = cut(rows.select("k", *leaf, "n_tokens"))
    leaves = slim.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    plan = cut(
        leaf_budgets(leaves, options)
        .where((F.col("tokens") > 0) & (F.col("budget") > 0))
        .select(
            *leaf,
            F.expr("budget div tokens").alias("epochs"),
            F.expr("budget % tokens").alias("rest"),
        )
    )
    # One row per leaf: joined by a plain join, which broadcasts it only while it is small.
    digest = _digest(options)
    slices = (
        slim.join(plan, leaf)
        .groupBy(*leaf, "rest", hex_number(digest, 1, SLICE_DIGITS).alias("slice"))
        .agg(F.sum("n_tokens").alias("held"))
        .withColumn("start", F.sum("held").over(W.partitionBy(*leaf).orderBy("slice")) - F.col("held"))
    )
    ends = (
        slices.where((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("held")))
        .groupBy(*leaf).agg(F.min("slice").alias("end"), F.min_by("start", "slice").alias("start"))
    )
    # Cut, so that its true size decides how the rows are joined to it.
    goals = cut(plan.join(ends, leaf, "left"))
    placed = rows.join(goals, leaf).withColumn("slice", hex_number(digest, 1, SLICE_DIGITS))
    out = ["row", *leaf, "n_tokens"]
    whole = F.when(F.col("epochs") > 0, F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    last = F.when(F.col("slice") < F.col("end"), F.array("epochs")).otherwise(F.array().cast("array<bigint>"))
    taken = placed.select(*out, F.explode(F.concat(whole, last)).alias("epoch")).select(
        *out, "epoch", F.col("n_tokens").alias("take_tokens")
    )
    order = W.partitionBy(*leaf).orderBy("digest", "n_tokens", "text_hash")
    ending = (
        placed.where(F.col("slice") == F.col("end"))
        .withColumn("digest", digest)
        .withColumn("at", F.col("start") + F.sum("n_tokens").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("at", F.col("at") - F.col("n_tokens"))
        .where(F.col("at") < F.col("rest"))
        .select(
            *out,
            F.col("epochs").alias("epoch"),
            F.least(F.col("n_tokens"), F.col("rest") - F.col("at")).alias("take_tokens"),
        )
    )
    return taken.unionByName(ending)


def first_words(text: Column, number: Column) -> Column:
    """The text up to the end of its first ``number`` words, with the white space between them."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # words with what follows them
    lead = F.substring(text, 1, 1).isin(*SPACES).cast("int")
    return F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), (number + lead).cast("int")), ""), SPACE_RUN + r"\z", "")


def taken_rows(mixed: DataFrame, columns: list[str], text: str = "text", size: str = "n_chars") -> DataFrame:
    """The ``columns`` of the documents of ``mix``; a text taken in part ends with its last word taken."""
    part = F.col("take_tokens") < F.col("n_tokens")
    cut_text = F.when(part, first_words(F.col("row")[text], F.col("take_tokens"))).otherwise(F.col("row")[text])
    rows = mixed.select("row", part.alias("part"), cut_text.alias("cut_text"))
    made = {text: F.col("cut_text"), size: F.when(F.col("part"), F.length("cut_text").cast("long")).otherwise(F.col("row")[size])}
    return rows.select(*[(made[c] if c in made else F.col("row")[c]).alias(c) for c in columns])


def _digest(options: MixOptions) -> Column:
    """The document's place in its leaf's last epoch; each epoch has an order of its own."""
    return seeded_hash(
        F.concat_ws(":", F.col("epochs"), F.coalesce(F.col("k").cast("string"), F.lit(NULL_NODE))),
        options.seed,
    )
