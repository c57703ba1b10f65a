"""Periodic runs of words, found by uniting suffix classes in order of decreasing common prefix.

A run is a stretch of words with smallest period q, at least twice as long as q,
that cannot be extended on either side with the same period.

The suffixes of a text that share their first words with another suffix are put
in order by prefix doubling; neighbours in that order share a common prefix
(LCP). Kruskal's way, the classes left and right of the largest LCP are united
first. A class is a union-find root with an ordered set of its text positions;
of two classes the smaller one is inserted into the larger. A position p then
gets a new neighbour p + d with exactly that LCP. Where d <= LCP, the words from
p on repeat after d words for LCP words more: the seed of a run of d + LCP words.
d is its smallest period, for a smaller one would have put a position between
the two into the class before. The seed that cannot be moved to the left is the
run itself, so every run is met exactly once, with its exact ends.

Only LCPs of at least half the least length can seed a run; other suffixes are
left alone, which in plain prose are nearly all.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import text_or_empty

TOGETHER = 200_000  # words of the texts that are ordered at once; a longer text is ordered alone
CHUNK = 512


class OrderedPositions:
    """A sorted set of positions in chunks, so that an insertion moves one chunk at most."""

    __slots__ = ("chunks", "heads", "size")

    def __init__(self, position: int) -> None:
        self.chunks = [[position]]
        self.heads = [position]
        self.size = 1

    def __iter__(self) -> Iterator[int]:
        for chunk in self.chunks:
            yield from chunk

    def add(self, position: int) -> tuple[int | None, int | None]:
        """Insert ``position``; what stands before and after it."""
        at = max(bisect_right(self.heads, position) - 1, 0) if len(self.heads) > 1 else 0
        chunk = self.chunks[at]
        place = bisect_right(chunk, position)
        before = chunk[place - 1] if place else None  # a first chunk has none before its head
        after = chunk[place] if place < len(chunk) else self.heads[at + 1] if at + 1 < len(self.heads) else None
        chunk.insert(place, position)
        self.size += 1
        if not place:
            self.heads[at] = position
        if len(chunk) > 2 * CHUNK:
            self.chunks[at : at + 1] = chunk[:CHUNK], chunk[CHUNK:]
            self.heads.insert(at + 1, chunk[CHUNK])
        return before, after

    def absorb(self, smaller: OrderedPositions) -> Iterator[tuple[int, int]]:
        """Insert all of ``smaller``; the pairs of positions that become neighbours by it."""
        added = None
        coming = iter(smaller)
        position = next(coming, None)
        while position is not None:
            following = next(coming, None)
            before, after = self.add(position)
            if before is not None and before != added:
                yield before, position
            if after is not None and (following is None or following > after):
                yield position, after
            added, position = position, following


def ordered_suffixes(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order, and the LCP of each with the next one.

    Left out are suffixes without a partner that shares ``least`` words. The ids
    of words must end with one that occurs once, as must every text within, and
    texts must not share ids.
    """
    order = np.argsort(ids, kind="stable")
    ranks, active, width = [_ranks(ids, ids[order], order, None)], order, 1
    kept = None
    while True:
        own = ranks[-1][active]
        alone = np.ones(len(active), bool)  # active is in order of rank
        same = own[1:] == own[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        active = active[~alone]
        if 2 * width > least and kept is None:
            kept = active
        if not len(active):
            break
        key = ranks[-1][active] * (len(ids) + 1) + ranks[-1][active + width]
        sort = np.argsort(key)
        active, key = active[sort], key[sort]
        ranks.append(_ranks(ranks[-1], key, active, ranks[-1][active]))
        width *= 2
    kept = active if kept is None else kept
    order = kept[np.argsort(ranks[-1][kept])]
    left, right = order[:-1], order[1:]
    shared = np.zeros(len(left), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        shared += (ranks[level][left + shared] == ranks[level][right + shared]).astype(np.int64) << level
    return order, shared


def _ranks(before: np.ndarray, key: np.ndarray, positions: np.ndarray, base: np.ndarray | None) -> np.ndarray:
    """Ranks in which ``positions``, sorted by ``key``, are told apart: the place of the first of their kind."""
    place = np.arange(len(key))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    first = np.maximum.accumulate(np.where(fresh, place, 0))
    if base is not None:  # places count from the start of the group that is refined
        opened = np.ones(len(key), bool)
        opened[1:] = base[1:] != base[:-1]
        first = base + first - np.maximum.accumulate(np.where(opened, place, 0))
    ranks = before.astype(np.int64, copy=True)
    ranks[positions] = first
    return ranks


def find_runs(ids: np.ndarray, min_length: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of at least ``min_length`` words.

    ``ids`` as for :func:`ordered_suffixes`, and starting with an id of its own.
    """
    least = max(1, (min_length + 1) // 2)
    order, shared = ordered_suffixes(ids, least)
    edges = np.flatnonzero(shared >= least)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    root = list(range(len(order)))
    classes: dict[int, OrderedPositions] = {}
    positions, found = order.tolist(), []

    def find(at: int) -> int:
        while root[at] != at:
            root[at] = at = root[root[at]]
        return at

    for edge, common in zip(edges.tolist(), shared[edges].tolist(), strict=True):
        a, b = find(edge), find(edge + 1)
        large = classes.pop(a, None) or OrderedPositions(positions[a])
        small = classes.pop(b, None) or OrderedPositions(positions[b])
        if large.size < small.size:
            large, small, a, b = small, large, b, a
        for p, q in large.absorb(small):
            period = q - p
            if period <= common and period + common >= min_length and ids[p - 1] != ids[q - 1]:
                found.append((p, period + common, period))
        root[b] = a
        classes[a] = large
    return found


def runs_of(texts: list[list[bytes]], min_length: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, by start, then period."""
    numbers = count()
    ids, starts = [next(numbers)], []
    for words in texts:
        named = defaultdict(numbers.__next__)  # anew for each text: texts share no ids
        starts.append(len(ids))
        ids.extend(map(named.__getitem__, words))
        ids.append(next(numbers))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in find_runs(np.array(ids, np.int64), min_length):
        text = bisect_right(starts, start) - 1
        runs[text].append((start - starts[text], length, period))
    for found in runs:
        found.sort(key=lambda run: (run[0], run[2]))
    return runs


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that a run repeats."""
    if not runs:
        return b" ".join(words)
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return b" ".join(compress(words, keep))


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 12) -> DataFrame:
    """``(key, n_words, runs, collapsed)``, one row per row of ``docs``, each from its own text alone.

    Words are separated by ASCII white space. ``runs`` holds ``(start, length,
    period)`` in words, by start, then period, at least ``min_length`` words long;
    ``collapsed`` the words outside of the repetitions of any run, joined by one
    space. Nothing is shuffled; a text of any length is one row's work.

    A null text counts as empty: no runs, an empty ``collapsed``. Null keys and
    rows that repeat each get a row. An empty table gives an empty result; other
    columns of ``docs`` are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        for batch in batches:
            texts, size, done = [], 0, 0
            for at, value in enumerate(batch.column(1), 1):
                words = value.as_py().split()
                texts.append(words)
                size += len(words)
                if size >= TOGETHER or at == batch.num_rows:
                    runs = runs_of(texts, min_length)
                    rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
                    kept = [collapsed(words, found) for words, found in zip(texts, runs, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(done, at - done), pa.array([len(w) for w in texts], pa.int64()),
                         pa.array(rows, kind), pa.array(kept, pa.string())],
                        ["k", "n_words", "runs", "collapsed"],
                    )
                    texts, size, done = [], 0, at

    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.encode(text_or_empty(text), "UTF-8").alias("_bytes"))
    found = rows.mapInArrow(run, f"k {key_type}, n_words long, runs {RUNS}, collapsed string")
    return found.select(F.col("k").alias(key), "n_words", "runs", "collapsed")
