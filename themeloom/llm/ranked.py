"""Ranked lexical search by the Best Position Algorithm over an index in segments.

Every task turns its documents into segments: for each term the documents that
hold it and how often. Segments stay where they were written; what is shuffled
are document frequencies, added up in the tasks first, and results.

A search reads the segments in tasks. In a segment each term of an item has an
impact list, its documents by falling contribution to the score. The lists are
read from the top (sorted access). Of each new document all other lists are
asked (direct access), which gives its whole score and its position in every
list. The best position of a list is the last one up to which every position has
been seen, in whichever way; since direct accesses fill positions too, it is
often far behind the last one read. No unseen document can score more than the
sum of the contributions at the best positions. When that sum is strictly below
the k-th best score found, reading stops: ties at the k-th place are still
found. A task carries its k best documents from segment to segment, so later
segments are left sooner, and hands on k rows per item.

Scores are sums of whole numbers, so they do not depend on any order.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from themeloom.llm.common import text_or_empty
from themeloom.plans.lineage import cut

# A term is a maximal run of letters, digits and all that is not ASCII; only A-Z is folded.
BETWEEN_TERMS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLDED = bytes(
    ord(chr(b).lower()) if b >= 128 or chr(b) in string.ascii_letters + string.digits else 32 for b in range(128)
) + bytes(range(128, 256))

SEGMENT_BYTES = 16_000_000  # of text; a longer text is a segment of its own
SEGMENT_DOCS = 65_536  # so that a document's number has two bytes
ITEM_BYTES = 8_000_000  # of item terms that are sent to the tasks at once; more make more rounds
FIRST_STEP = 8  # positions read of each list in the first step; steps double


@dataclass(frozen=True)
class Index:
    """``segments``, and the numbers of documents with terms and of all their terms."""

    segments: DataFrame
    documents: int
    occurrences: int


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of every row of ``docs``; rows without a term (null, empty) are not in it."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def start() -> None:
            nonlocal numbers, keys, lengths, widths, terms, tfs, size
            numbers = defaultdict(count().__next__)
            keys, lengths, widths, terms, tfs, size = [], [], [], [], [], 0

        def segment() -> pa.RecordBatch:
            of = np.array(terms, np.int64)
            order = np.argsort(of, kind="stable")  # by term, then document
            held = np.repeat(np.arange(len(keys), dtype="<u2"), widths)
            columns = [
                pa.array([len(keys)], pa.int64()),
                pa.array([sum(lengths)], pa.int64()),
                pa.array([keys], pa.list_(key_type)),
                pa.array([np.array(lengths, "<i8").tobytes()], pa.binary()),
                pa.array([list(numbers)], pa.list_(pa.binary())),
                pa.array([np.bincount(of, minlength=len(numbers))], pa.list_(pa.int64())),
                pa.array([held[order].tobytes()], pa.binary()),
                pa.array([np.array(tfs, "<u4")[order].tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, [n.split()[0] for n in SEGMENT.split(", ")])

        numbers = keys = lengths = widths = terms = tfs = size = None
        start()
        for batch in batches:
            key_type = batch.schema.field(0).type
            for i, value in enumerate(batch.column(1)):
                data = value.as_py()
                words = data.translate(FOLDED).split()
                if not words:
                    continue
                counts = Counter(words)
                keys.append(batch.column(0)[i].as_py())
                lengths.append(len(words))
                widths.append(len(counts))
                terms.extend(map(numbers.__getitem__, counts))
                tfs.extend(counts.values())
                size += len(data)
                if size >= SEGMENT_BYTES or len(keys) >= SEGMENT_DOCS:
                    yield segment()
                    start()
        if keys:
            yield segment()

    rows = docs.select(F.col(key), F.encode(text_or_empty(text), "UTF-8").alias("_bytes"))
    segments = cut(rows.mapInArrow(run, SEGMENT.format(key=kind)))
    total = segments.agg(F.sum("documents"), F.sum("occurrences")).first()
    return Index(segments, total[0] or 0, total[1] or 0)


def frequencies(index: Index, terms: DataFrame) -> DataFrame:
    """``(term, df)`` of the distinct ``terms`` (term) that documents hold; only theirs are shuffled."""
    each = index.segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t"))
    held = each.select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    return held.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


SEGMENT = (
    "documents long, occurrences long, keys array<{key}>, lengths binary, "
    "terms array<binary>, dfs array<long>, docs binary, tfs binary"
)


class ImpactList:
    """The contributions of one term to the documents of a segment."""

    __slots__ = ("docs", "impacts", "positions", "by_impact", "sorted_impacts", "dense")

    def __init__(self, docs: np.ndarray, impacts: np.ndarray, segment_docs: int) -> None:
        self.docs, self.impacts = docs, impacts  # by document, for direct access
        order = np.argsort(-impacts, kind="stable")
        self.by_impact, self.sorted_impacts = docs[order], impacts[order]
        self.positions = np.empty(len(order), np.int64)
        self.positions[order] = np.arange(len(order))
        self.dense = None
        if 8 * len(docs) > segment_docs:
            self.dense = np.full(segment_docs, -1, np.int32)
            self.dense[docs] = np.arange(len(docs))

    def ask(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``docs`` (ascending) are in the list, and where in its order by document."""
        if self.dense is not None:
            at = self.dense[docs]
            held = np.flatnonzero(at >= 0)
            return held, at[held]
        if len(docs) < len(self.docs):
            at = np.searchsorted(self.docs, docs)
            at[at == len(self.docs)] = 0
            held = np.flatnonzero(self.docs[at] == docs)
            return held, at[held]
        at = np.searchsorted(docs, self.docs)
        at[at == len(docs)] = 0
        own = np.flatnonzero(docs[at] == self.docs)
        return at[own], own


def best_positions(
    lists: list[tuple[int, ImpactList]], segment_docs: int, k: int, scores: list[int]
) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that may be among the ``k`` best, their scores, and how many positions were read.

    ``lists`` are pairs of repeats in the item and list. ``scores`` are the best
    scores known from elsewhere. Every document that is not returned scores
    strictly less than the k-th best of ``scores`` and the returned ones, or 0.
    """
    met = np.zeros(segment_docs, bool)
    seen = [np.zeros(len(x.docs) + 1, bool) for _, x in lists]  # the last stands for the end
    best = [0] * len(lists)  # how many positions from the top on are seen
    best_scores = np.array(sorted(scores, reverse=True)[:k], np.int64)
    found_docs, found_scores = [], []
    depth, step, read = 0, FIRST_STEP, 0
    while True:
        limit = sum(
            repeats * int(x.sorted_impacts[max(at - 1, 0)])
            for (repeats, x), at in zip(lists, best, strict=True)
            if at < len(x.docs)
        )
        if limit == 0 or (len(best_scores) == k and limit < best_scores[-1]):
            break
        top = [x.by_impact[depth : depth + step] for _, x in lists]
        read += sum(map(len, top))
        met_before = met.copy()
        for docs in top:
            met[docs] = True
        fresh = np.flatnonzero(met & ~met_before)
        total = np.zeros(len(fresh), np.int64)
        for (repeats, x), marks in zip(lists, seen, strict=True):
            held, at = x.ask(fresh)
            total[held] += repeats * x.impacts[at]
            marks[x.positions[at]] = True
        for i, marks in enumerate(seen):
            best[i] += int(np.argmin(marks[best[i] :]))
        good = total > 0
        if len(best_scores) == k:
            good &= total >= best_scores[-1]
        if good.any():
            found_docs.append(fresh[good])
            found_scores.append(total[good])
            best_scores = np.sort(np.concatenate([best_scores, total[good]]))[::-1][:k]
        depth += step
        step *= 2
    if not found_docs:
        return np.empty(0, np.int64), np.empty(0, np.int64), read
    docs, total = np.concatenate(found_docs), np.concatenate(found_scores)
    if len(best_scores) == k:
        good = total >= best_scores[-1]
        docs, total = docs[good], total[good]
    return docs, total, read


def _in_order(found: list[tuple], k: int) -> list[tuple]:
    """The ``k`` first of ``(score, key)``: highest score, then smallest key, null last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]


def item_terms(items: DataFrame, text: str) -> DataFrame:
    """``items`` with the terms of ``text``, repeats included, in ``terms``."""
    folded = F.translate(text_or_empty(text), string.ascii_uppercase, string.ascii_lowercase)
    return items.withColumn("terms", F.filter(F.split(folded, BETWEEN_TERMS), lambda t: t != ""))


def search(
    index: Index, items: DataFrame, k: int = 10, item_key: str = "item_id", item_text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``(item_key, rank, key, score)``: the ``k`` best documents of each row of ``items``, score above 0.

    ``rank`` counts from 1; equal scores go by ``key`` ascending, null last. A
    document's score for a term is its weight (rounded logarithm of how rare it
    is) times its saturated frequency, in whole numbers, once for each time the
    term is in the item.

    Every row of ``items`` is an item of its own, also with a null or repeated
    key. Items without terms (null or empty text) or matches have no rows; an
    empty index or table of items gives an empty result. Rows of documents that
    repeat rank one after the other. Long items are terms like others.
    """
    n, total = index.documents, max(index.occurrences, 1)
    kind = index.segments.schema["keys"].dataType.elementType.simpleString()
    numbered = cut(item_terms(items.select(F.col(item_key).alias("item"), F.col(item_text).alias("words")), "words")
                   .select(F.monotonically_increasing_id().alias("at"), "item", "terms"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)))
    asked = cut(
        numbered.select("at", F.explode("terms").alias("term"))
        .groupBy("at", F.encode("term", "UTF-8").alias("term"))
        .agg(F.count(F.lit(1)).alias("repeats"))
    )
    weights = cut(frequencies(index, cut(asked.select("term").distinct())).select("term", weight.alias("weight")))
    wanted = cut(asked.join(weights, "term"))
    size = wanted.agg(F.sum(F.octet_length("term") + 40)).first()[0] or 0
    rounds = -(-size // ITEM_BYTES)
    part = F.pmod(F.xxhash64("at"), F.lit(max(rounds, 1)))
    found = None
    for number in range(rounds):
        # ITEM_BYTES of terms on average, whatever the number of items.
        asked_now: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
        weight_of: dict[bytes, int] = {}
        chosen = wanted.where(part == number).select("at", "term", "repeats", "weight")
        for at, term, repeats, w in chosen.toLocalIterator():
            asked_now[at].append((bytes(term), repeats))
            weight_of[bytes(term)] = w
        best = _search_segments(index.segments, dict(asked_now), weight_of, k, n, total, kind)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = index.segments.sparkSession.createDataFrame([], f"at long, k {kind}, score long")
    order = W.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("k"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = numbered.select("at", "item")
    return ranked.join(named, "at").select(
        F.col("item").alias(item_key), "rank", F.col("k").alias(key), "score"
    )


def _search_segments(
    segments: DataFrame, asked: dict[int, list[tuple[bytes, int]]], weights: dict[bytes, int], k: int,
    documents: int, occurrences: int, kind: str,
) -> DataFrame:
    """``(at, k, score)``: of every task its ``k`` best documents for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type.value_type
            for i in range(batch.num_rows):
                keys = batch.column(0)[i].values
                lengths = np.frombuffer(batch.column(1)[i].as_py(), "<i8")
                dfs = batch.column(3)[i].values.to_numpy()
                docs = np.frombuffer(batch.column(4)[i].as_py(), "<u2")
                tfs = np.frombuffer(batch.column(5)[i].as_py(), "<u4")
                ends = np.cumsum(dfs)
                m = 25 + 75 * lengths * documents // occurrences
                lists: dict[bytes, ImpactList] = {}
                for number, term in enumerate(batch.column(2)[i].values.to_pylist()):
                    weight = weights.get(term)
                    if weight:  # a weight of 0 adds nothing to any score
                        span = slice(ends[number] - dfs[number], ends[number])
                        tf = tfs[span].astype(np.int64)
                        impacts = weight * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs[span]]))
                        lists[term] = ImpactList(docs[span], impacts, len(lengths))
                for at, terms in asked.items():
                    own = [(repeats, lists[t]) for t, repeats in terms if t in lists]
                    if not own:
                        continue
                    known = best.get(at, [])
                    found, scores, _ = best_positions(own, len(lengths), k, [s for s, _ in known])
                    if len(found):
                        new = zip(scores.tolist(), keys.take(pa.array(found)).to_pylist(), strict=True)
                        best[at] = _in_order([*known, *new], k)
        if best:
            rows = [(at, key, score) for at, found in best.items() for score, key in found]
            ats, keys, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ats, pa.int64()), pa.array(keys, key_type), pa.array(scores, pa.int64())], ["at", "k", "score"]
            )

    columns = ("keys", "lengths", "terms", "dfs", "docs", "tfs")
    return segments.select(*columns).mapInArrow(run, f"at long, k {kind}, score long")
