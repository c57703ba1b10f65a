"""Fuzzy line groups against all pairs."""

import random

import numpy as np

from themeloom.llm import lines as L
from themeloom.llm import runs

DOCS = "doc_id long, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain(rows):
    first = {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for n, line in enumerate((text or "").split("\n")):
            if L.normalised(line):
                first.setdefault(L.normalised(line), (key, n))
    every = list(first)
    sims = [int(L.word_simhashes([x.encode()])[0]) for x in every]
    label = list(range(len(every)))
    for i, a in enumerate(every):
        for j in range(i):
            if (sims[j] ^ sims[i]).bit_count() > L.RADIUS and max(len(a), len(every[j])) > L.EXACT:
                continue
            if 5 * distance(a, every[j]) <= max(len(a), len(every[j])) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    kept = {first[every[g]] for g in set(label)}  # the earliest of a group has its label
    return sorted(
        (key, "\n".join(x for n, x in enumerate((text or "").split("\n")) if not L.normalised(x) or (key, n) in kept)) for key, text in rows
    )


def test_groups_as_brute_force(table, monkeypatch):
    monkeypatch.setattr(runs, "RUN_BYTES", 4000)
    monkeypatch.setattr(L, "TILE", 4)
    draw = random.Random(10)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(200)]
    base = [draw.choices(words, k=40) for _ in range(8)]
    rows = []
    for i in range(60):
        text = []
        for line in draw.sample(base, 3):
            line = list(line)
            for _ in range(draw.choice((0, 0, 1, 2, 9))):
                line[draw.randrange(40)] = draw.choice(words)
            if draw.random() < 0.2:
                draw.shuffle(line)  # the same SimHash, another line
            text.append((" " if i % 2 else "  ").join(line).upper() if i % 3 else " ".join(line))
        rows.append((i, "\n".join(text) + "\n\n" * (i % 2)))
    rows += [(100, None), (101, ""), (102, "one\none\nOne \n two"), (103, "w " * 20000)]
    found = L.deduplicate_lines(table(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.text) for r in found) == plain(rows)
    assert sum(r.n_removed for r in found) > 60
    assert L.deduplicate_lines(table([], DOCS)).count() == 0


def test_null_keys_and_repeated_rows(table):
    rows = [(None, "same line here"), (2, "same line here"), (2, "same line here"), (None, "alone")]
    found = L.deduplicate_lines(table(rows, DOCS)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in found), key=str) == sorted(
        [(None, 1, 1, ""), (2, 1, 0, "same line here"), (2, 1, 1, ""), (None, 1, 0, "alone")], key=str
    )


def test_edit_distance():
    draw = random.Random(11)
    for _ in range(1500):
        a, b = ("".join(draw.choices("abc", k=draw.randint(0, 14))) for _ in range(2))
        assert L.edit_distance(a, b) == distance(a, b)
        assert L.similar(a, b) == (5 * distance(a, b) <= max(len(a), len(b)))


def test_simhash_of_many_lines_is_that_of_each():
    lines = [b"a", b"b c d", b"x" * 200, b"b c d e f g h i j k", "été et".encode()]
    assert L.word_simhashes(lines).tolist() == [int(L.word_simhashes([x])[0]) for x in lines]


def test_recall_of_edit_similar_pairs():
    # Against all pairs, without band keys and SimHashes; lines from 20 characters on.
    draw = random.Random(12)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9))) for _ in range(300)]
    lines = []
    for size in (4, 8, 12, 20, 40):
        for _ in range(60):
            line = draw.choices(words, k=size)
            lines.append(" ".join(line))
            for at in draw.sample(range(size), max(size // 10, 1)):
                line[at] = draw.choice(words)
            lines.append(" ".join(line))
    lines = sorted(set(lines), key=len)
    data = [x.encode() for x in lines]
    sims, keys = L.word_simhashes(data), [set() for _ in data]
    for key, line in zip(*map(np.ndarray.tolist, L.line_keys(data)), strict=True):
        keys[line].add(key)
    pairs = [(i, j) for j in range(len(lines)) for i in range(j) if 5 * len(lines[i]) >= 4 * len(lines[j]) and L.similar(lines[i], lines[j])]
    found = [keys[i] & keys[j] and (int(sims[i]) ^ int(sims[j])).bit_count() <= L.RADIUS for i, j in pairs]
    assert len(pairs) > 180
    assert sum(map(bool, found)) >= 0.95 * len(pairs)


def test_changed_words_are_linked(table):
    rows = [(1, "the quick brown fox jumps over the lazy dog today"), (2, "the quick brown cat jumps over the lazy dog today"), (3, "nothing of this is like the others")]
    found = L.deduplicate_lines(table(rows, DOCS)).collect()
    assert {r.doc_id: r.n_removed for r in found} == {1: 0, 2: 1, 3: 0}


def test_short_lines_are_linked_whole(table):
    # Every pair of up to EXACT characters, found by brute force, shares a key.
    draw = random.Random(13)
    lines = set()
    for size in range(1, L.EXACT + 1):
        for _ in range(60):
            line = "".join(draw.choices("abcd é", k=size))
            lines.add(L.normalised(line))
            for _ in range(2):
                edited = list(line)
                for _ in range(draw.randint(1, max(size // 5, 1))):
                    at = draw.randrange(len(edited) + 1)
                    edited[at : at + draw.randint(0, 1)] = draw.choices("abcd é", k=draw.randint(0, 1))
                lines.add(L.normalised("".join(edited)))
    lines = sorted(x for x in lines if 0 < len(x) <= L.EXACT)
    keys = [L.pieces(x) for x in lines]
    pairs = [(i, j) for j in range(len(lines)) for i in range(j) if L.similar(lines[i], lines[j])]
    assert len(pairs) > 1000
    assert all(keys[i] & keys[j] for i, j in pairs)


def test_keys_of_one_line_only_make_no_rows(spark, table):
    rows = [(1, "a line that stands alone in here\nand some line that comes again"), (2, "and some line that comes agaim")]
    packed = runs.pack(table(rows, DOCS).select("doc_id", "text").repartition(2, "doc_id"), "doc_id", "text").cache()
    shared = L.shared_keys(L.sent_keys(packed, 2))
    found = packed.groupBy("run").cogroup(shared.groupBy("run")).applyInArrow(lambda t, s: L._shared_lines(t, s, 2), L.LINE)
    assert sorted((r.id, r.line) for r in found.collect()) == [(1, 1), (2, 0)]
