"""Periodic runs against a search over all starts and periods."""

import random

from themeloom.llm import periodic
from themeloom.llm.catalog import with_periods

DOCS = "doc_id long, text string"


def plain_runs(words, least):
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            piece = words[i : i + length]
            smaller = any(all(piece[x] == piece[x + r] for x in range(length - r)) for r in range(1, q))
            if j > i and length >= max(least, 2 * q) and not smaller:
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_random_words():
    rng = random.Random(7)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(0, 4)):
            n, letters = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
            words = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = rng.randint(1, n - a)
                words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            texts.append(words)
        least = rng.choice([2, 3, 4, 12, 13])
        assert periodic.runs_of(texts, least) == [plain_runs(words, least) for words in texts]


def test_positions_stay_in_order():
    rng = random.Random(3)
    values = rng.sample(range(100_000), 6000)
    kept = periodic.OrderedPositions(values[0])
    seen = [values[0]]
    for value in values[1:]:
        seen_before = max((x for x in seen if x < value), default=None) if len(seen) < 300 else None
        before, after = kept.add(value)
        if len(seen) < 300:
            assert before == seen_before and after == min((x for x in seen if x > value), default=None)
        seen.append(value)
    assert list(kept) == sorted(values) and kept.size == len(values) and len(kept.chunks) > 1
    evens, odds = periodic.OrderedPositions(0), periodic.OrderedPositions(5)
    for x in (2, 10):
        list(evens.absorb(periodic.OrderedPositions(x)))
    list(odds.absorb(periodic.OrderedPositions(6)))
    assert list(evens.absorb(odds)) == [(2, 5), (6, 10)]  # 5 and 6 were neighbours before


def test_odd_rows(table):
    many = "one two three " * 9000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 12), (5, "a " * 11), (6, "ü ü" * 3), (None, "x y " * 6), (7, many), (7, many),
            (8, "a b c d e f g h i j k l"), (9, "p q r s t u v " + "p q r s t u v w " * 2)]
    found = [tuple(r) for r in periodic.periodic_runs(table(rows, DOCS)).collect()]
    assert len(found) == len(rows)
    for (key, text), row in zip(rows, found, strict=True):
        words = (text or "").split()
        runs = [tuple(r) for r in row[2]]
        assert row[0] == key and row[1] == len(words)
        if text is not many:
            assert runs == plain_runs(words, 12)
        repeated = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert row[3] == " ".join(w for i, w in enumerate(words) if i not in repeated)
    assert [tuple(r) for r in found[7][2]] == [(0, 27000, 3)] and found[7] == found[8]
    assert periodic.periodic_runs(table([], DOCS)).count() == 0


def test_planted_periods(spark):
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "") for r in docs.collect()}
    planted = 0
    for r in with_periods(docs).collect():
        h, words = zlib.crc32(str(r.doc_id).encode()), texts[r.doc_id].split()
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        assert (r.text or "").split() == words
    assert planted > 10
