"""Syncmer fingerprints against a plain implementation."""

import hashlib
import random
import re
import struct
from collections import Counter
from itertools import pairwise

import pytest
import xxhash

from themeloom.llm import syncmers

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def plain_anchors(text):
    """``(distance from the last, 32 bits of hash)`` of every anchor."""
    s, span = syncmers.SMER, syncmers.SPAN
    text_hash = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    inner = [text_hash(text[i : i + s]) for i in range(len(text) - s + 1)]
    found, last = [], 0
    for i in range(len(inner) - span + 1):
        window = inner[i : i + span]
        if min(window) in (window[0], window[-1]):
            found.append((i - last, chained(*window[:-1:s], window[-1]) & syncmers.LOW))
            last = i
    return found or ([(0, text_hash(text) & syncmers.LOW)] if text else [])


def plain_links(found):
    return Counter((a[1], b) for a, b in pairwise(found)) if len(found) > 1 else Counter(h for _, h in found)


def plain_likeness(a, b):
    a, b = plain_links(a), plain_links(b)
    return (a & b).total() / (a | b).total() if a or b else 1.0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    out = []
    for i, (key, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        a, b, c = plain_anchors(text), plain_anchors(edited), plain_anchors(following)
        shown = lambda x: "".join(f"{gap:x}{h:08x}" for gap, h in x)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(out, key=str)


def test_odd_rows(table):
    rows = [(3, "a" * 40), (2, None), (1, ""), (9, "short"), (8, "exactly elev"), (7, "Ein längerer Text, der etwas mehr sagt. " * 40),
            (7, "Ein längerer Text, der etwas mehr sagt. " * 40), (7, "other"), (None, "no key at all, but text"), (5, "line\nfeeds\n\n and tabs\t" * 9),
            (-4, "x" * 11), (4, "word " * 5000)]
    found = syncmers.edited_fingerprints(table(rows, DOCS)).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows)
    assert syncmers.edited_fingerprints(table([], DOCS)).count() == 0
    one = syncmers.edited_fingerprints(table([(1, "just this one")], DOCS)).collect()
    assert one[0].near_next == 1.0


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = syncmers.edited_fingerprints(docs).collect()
    assert sorted(map(tuple, found), key=str) == expected([tuple(r) for r in docs.collect()])
    near = [r for r in found if r.n_chars > 200]
    assert sum(r.near_edited > r.near_next for r in near) > 0.95 * len(near)


def test_letters_beyond_the_first_plane(table):
    text = "emoji 😀 and 𝒻ancy letters 😀😀 in a text of some length " * 3
    found = syncmers.edited_fingerprints(table([(1, text), (2, text)], DOCS)).collect()
    assert found[0].fingerprint == found[1].fingerprint and found[0].near_next == 1.0


def letters(rng, n):
    return "".join(rng.choices("abcdefghij klmnop", k=n))


def near_next(table, a, b):
    rows = syncmers.edited_fingerprints(table([(2, a), (1, b)], DOCS)).collect()
    return {r.doc_id: r.near_next for r in rows}[2]


def test_a_passage_anywhere_in_long_texts_is_seen(table):
    rng = random.Random(5)
    passage = letters(rng, 300)
    a, b = letters(rng, 9000) + passage + letters(rng, 700), letters(rng, 40) + passage + letters(rng, 12000)
    true = 300 / (len(a) + len(b) - 300)
    assert 0.5 * true < near_next(table, a, b) < 1.5 * true
    assert near_next(table, a.replace(passage, ""), b) == 0


@pytest.mark.parametrize("n, most", [(300, 0.12), (1000, 0.07), (4000, 0.04), (40000, 0.015)])
def test_likeness_is_the_shared_share_of_the_text(table, n, most):
    rng = random.Random(n)
    for share in (0.2, 0.5, 0.9):
        common = letters(rng, int(share * n))
        a, b = common + letters(rng, n - len(common)), letters(rng, n - len(common)) + common
        assert abs(near_next(table, a, b) - share / (2 - share)) < most


def test_order_and_repeats_count(table):
    rng = random.Random(3)
    words = [letters(rng, 12) for _ in range(300)]
    other = rng.sample(words, len(words))
    assert near_next(table, "".join(words), "".join(other)) < 0.05
    piece = letters(rng, 400)
    assert near_next(table, piece * 9, piece * 3) == pytest.approx(1 / 3, abs=0.03)


@pytest.mark.parametrize("name", ["edited_fingerprints"])
def test_native_plan(spark, name):
    plan = getattr(syncmers, name)(spark.createDataFrame([(1, "a")], DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_an_edited_text_reuses_the_anchors_of_both_texts(table):
    rng = random.Random(8)
    rows = [(n, letters(rng, n)) for n in range(1, 120)]
    found = syncmers.edited_fingerprints(table(rows, DOCS))
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows)
    # Pieces of four characters are cut from whole texts and from seams of at most 2 * (K - 1) only.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2
