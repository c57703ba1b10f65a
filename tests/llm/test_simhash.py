"""SimHash groups against all pairs compared by brute force."""

import random
import re

import numpy as np
import xxhash

from themeloom.llm import simhash

DOCS = "doc_id long, text string"


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    value = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s.encode(), 42) >> bit & 1 for s in shingles)
        value |= (2 * ones > len(shingles)) << bit
    return value


def groups(values, radius=4):
    """Smallest id reachable, for (id, fingerprint) with ids that may be null."""
    label = list(range(len(values)))
    for _ in values:
        for i, (_, a) in enumerate(values):
            for j, (_, b) in enumerate(values):
                if (a ^ b).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for (key, _), g in zip(values, label, strict=True):
        least[g] = min((x for x in (key, least.get(g)) if x is not None), default=None)
    return [least[g] for g in label]


def test_groups_as_brute_force(table):
    draw = random.Random(4)
    words = [f"Word{i}" for i in range(300)]
    base = [" ".join(draw.choices(words, k=400)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(6, 40):
        text = base[i % 6].split(" ")
        for _ in range(i % 4):
            text[draw.randrange(400)] = draw.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(50, None), (51, ""), (52, " \t "), (53, "one"), (53, "one"), (None, base[0]), (None, "alone here"), (54, "w " * 9000)]
    found = simhash.near_duplicates(table(rows, DOCS), tile=3).collect()
    values = [(k, plain_fingerprint(t)) for k, t in rows]
    expected = [(k, f"{v:016x}", c) for (k, v), c in zip(values, groups(values), strict=True)]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert len({c for _, _, c in expected}) < 20


def test_bit_planes():
    draw = random.Random(5)
    for radius in (0, 1, 3, 4, 7):
        values = np.array([draw.getrandbits(64) & 0xFF0F for _ in range(90)], np.uint64)
        planes = simhash.BitPlanes(values)
        for lane in range(90):
            near = sum(1 << i for i, v in enumerate(values) if int(v ^ values[lane]).bit_count() <= radius)
            assert planes.within(lane, radius, planes.full) == near


def test_blocks_find_every_pair(spark):
    draw = random.Random(6)
    centre = draw.getrandbits(63)
    values = {centre}
    while len(values) < 60:
        flipped = centre
        for bit in draw.sample(range(63), 4):
            flipped ^= 1 << bit
        values.add(flipped)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for tile in (7, 1000):
        edges = {frozenset(r) for r in simhash.links(df, 4, 6, tile).collect()}
        reached, todo = {centre}, [centre]
        while todo:
            x = todo.pop()
            for e in edges:
                if x in e:
                    new = set(e) - reached
                    reached |= new
                    todo += new
        assert reached == values


def test_empty(table):
    assert simhash.near_duplicates(table([], DOCS)).count() == 0
