"""Edit distances of many pairs at once, and which pairs of lines are verified."""

import random

import numpy as np
import pyarrow as pa

from themeloom.llm import edits
from themeloom.llm import lines as L


def drawn(count, letters, longest):
    draw = random.Random(21)
    pairs = [("", ""), ("", "abc"), ("a", "")]
    for _ in range(count):
        a = "".join(draw.choices(letters, k=draw.randint(0, draw.choice((3, 63, 64, 65, longest)))))
        b = list(a) if draw.random() < 0.6 else draw.choices(letters, k=draw.randint(0, longest))
        for _ in range(draw.randint(0, len(b) // 4)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randint(0, 2)] = draw.choices(letters, k=draw.randint(0, 2))
        pairs.append((a, "".join(b)))
    return pairs


def test_distances_as_one_by_one(monkeypatch):
    monkeypatch.setattr(edits, "LANES", 64)
    for letters in ("abc", "abcdefgh é𝄞", [chr(x) for x in range(200, 900)]):
        pairs = drawn(400, letters, 300)
        each = np.array([L.edit_distance(a, b) for a, b in pairs])
        most = np.array([max(len(a), len(b)) // 5 for a, b in pairs])
        assert edits.distances(pairs).tolist() == each.tolist()
        assert edits.within(pairs, most).tolist() == (each <= most).tolist()
        assert [L.similar(a, b) for a, b in pairs] == (each <= most).tolist()
    assert len(edits.distances([])) == 0


def unit_table(rows, texts):
    """Rows (unit, line, band, keys) of one class a line."""
    unit, line, band, keys = zip(*rows, strict=True)
    n = len(rows)
    columns = [pa.array(unit), pa.array(line), pa.array(line), pa.array([0] * n), pa.array([texts[x] for x in line]),
               pa.array([0] * n, pa.int32()), pa.array([True] * n), pa.array([False] * n), pa.array(line), pa.array(band),
               pa.array(keys, pa.list_(pa.int64()))]
    names = ["unit", "la", "lb", "sim", "text", "mine", "diagonal", "exact", "class", "band", "keys"]
    return pa.RecordBatch.from_arrays(columns, names)


def test_long_pairs_are_verified_under_one_key_only(monkeypatch):
    draw = random.Random(22)
    texts = ["".join(draw.choices("abcdef ", k=600)).replace("  ", "xy") for _ in range(3)]
    texts[2] = texts[1][:300] + "zzz" + texts[1][303:]
    seen = []
    monkeypatch.setattr(L, "similar", lambda a, b, old=L.similar: seen.append((a, b)) or old(a, b))
    keys = [[2, 4, 6, 8], [4, 6, 8], [4, 8, 10]]
    rows = sorted((key // 2, line, key, keys[line]) for line in range(3) for key in keys[line])
    links = list(zip(*L.similar_links(unit_table(rows, texts)), strict=True))
    assert [{rows[x][1], rows[y][1]} for x, y in links] == [{1, 2}]
    assert len(seen) == 3  # each pair under key 4; one by one they would be 2 + 3 + 1 times
    seen.clear()
    parts = [unit_table([r for r in rows if r[0] == unit], texts) for unit in (1, 2, 3, 4)]
    assert sum(len(L.similar_links(part)[0]) for part in parts) == 1
    assert len(seen) == 3


def test_links_of_many_units_connect_what_is_similar():
    draw = random.Random(23)
    base = ["".join(draw.choices("abcdefghijkl ", k=70)).strip() for _ in range(30)]
    texts = []
    for text in base:
        for _ in range(6):
            line = list(text)
            for _ in range(draw.randint(0, 8)):
                line[draw.randrange(len(line))] = draw.choice("abcdefghijkl")
            texts.append("".join(line))
    rows = sorted((draw.randrange(8), line, 2, None) for line in range(len(texts)) for _ in range(3))
    rows = sorted(set(rows), key=lambda r: r[:2])
    batches = [unit_table(rows[i : i + 50], texts) for i in range(0, len(rows), 50)]
    wanted, found = (np.arange(len(texts)) for _ in range(2))

    def unite(label, a, b):
        label[label == max(label[a], label[b])] = min(label[a], label[b])

    for u, a, *_ in rows:
        for v, b, *_ in rows:
            if u == v and a < b and wanted[a] != wanted[b] and L.similar(texts[a], texts[b]):
                unite(wanted, a, b)
    for batch in L._unit_links(iter(batches)):
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            unite(found, x["la"], y["la"])
    assert found.tolist() == wanted.tolist()
