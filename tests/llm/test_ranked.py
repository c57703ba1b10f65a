"""Ranked search against scores of all documents, and the stopping rule against full lists."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from themeloom.llm import ranked

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def terms_of(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain(docs, items, k):
    counts = [(key, Counter(terms_of(text))) for key, text in docs]
    counts = [(key, c) for key, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in counts:
            m = 100 - 75 + 75 * c.total() * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms_of(text)
                if t in c
            )
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark_rows):
    return sorted(map(tuple, spark_rows), key=str)


@pytest.mark.parametrize("segment_docs", [1, 3, 65_536])
def test_odd_rows(table, monkeypatch, segment_docs):
    monkeypatch.setattr(ranked, "SEGMENT_DOCS", segment_docs)
    long = "alpha beta " * 20_000
    docs = [(1, None), (2, ""), (3, " ,;-\x00 "), (4, "Alpha BETA gamma"), (4, "Alpha BETA gamma"), (None, "alpha"), (5, long),
            (6, "ÄRGER ärger Straße 😀"), (7, "alpha-beta_gamma 007"), (8, "alpha\x00beta"), (9, "delta")]
    items = [(1, "alpha"), (2, "ALPHA alpha beta"), (3, None), (4, ""), (5, "Ärger 😀"), (None, "gamma"), (1, "alpha"),
             (6, "nowhere"), (7, "beta " * 3000 + "delta 007")]
    index = ranked.build_index(table(docs, DOCS))
    for k in (1, 3, 10):
        assert found(ranked.search(index, table(items, ITEMS), k).collect()) == plain(docs, items, k)
    assert ranked.search(index, table([], ITEMS)).count() == 0
    empty = ranked.build_index(table([], DOCS))
    assert ranked.search(empty, table(items, ITEMS)).count() == 0


def test_rounds_and_ties(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([3, 3, 3, 12])))) for i in range(600)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 6)))) for i in range(30)]
    monkeypatch.setattr(ranked, "ITEM_BYTES", 1500)  # several rounds
    monkeypatch.setattr(ranked, "SEGMENT_DOCS", 50)
    index = ranked.build_index(spark.createDataFrame(docs, DOCS).repartition(3))
    assert found(ranked.search(index, spark.createDataFrame(items, ITEMS), 7).collect()) == plain(docs, items, 7)


def test_reading_stops_and_loses_nothing():
    """Lists in which few documents stand out: most positions are never read, all ties are returned."""
    rng = np.random.default_rng(2)
    saved = 0
    for _ in range(150):
        n, k = 400, int(rng.integers(1, 8))
        lists, scores = [], np.zeros(n, np.int64)
        for _ in range(int(rng.integers(1, 6))):
            docs = np.sort(rng.choice(n, int(rng.integers(1, n)), replace=False))
            impacts = rng.integers(1, 6, len(docs)) * 10
            impacts[rng.random(len(docs)) < 0.03] += 200
            repeats = int(rng.integers(1, 3))
            lists.append((repeats, ranked.ImpactList(docs, impacts.astype(np.int64), n)))
            scores[docs] += repeats * impacts
        known = rng.integers(1, 300, int(rng.integers(0, 4))).tolist()
        docs, total, read = ranked.best_positions(lists, n, k, known)
        assert (scores[docs] == total).all() and len(set(docs.tolist())) == len(docs)
        everything = sorted([*known, *scores[scores > 0].tolist()], reverse=True)
        kth = everything[k - 1] if len(everything) >= k else 0
        assert set(np.flatnonzero((scores >= kth) & (scores > 0)).tolist()) <= set(docs.tolist())
        saved += read < sum(len(x.docs) for _, x in lists)
    assert saved > 75


def test_best_position_passes_the_last_one_read():
    """Direct accesses fill the top of the second list before it is read."""
    first = ranked.ImpactList(np.arange(40), np.full(40, 50), 100)
    second = ranked.ImpactList(np.arange(40), np.arange(1000, 960, -1), 100)
    _, _, read = ranked.best_positions([(1, first), (1, second)], 100, 3, [])
    assert read < 20
