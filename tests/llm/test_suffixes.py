"""Repeated passages against all 50-byte strings in a dictionary."""

import hashlib
import random

from themeloom.llm import runs, suffixes

DOCS = "doc_id long, text string"


def plain(rows):
    first = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            if key is not None:
                w = data[i : i + 50]
                first[w] = min(first.get(w, key), key)
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            least = first.get(data[i : i + 50])
            if least is not None and (key is None or least < key):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for x in bytes(gone).split(b"\0") if x)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cut(df):
    return sorted((tuple(r) for r in suffixes.repeated_passages(df).drop("spans").collect()), key=str)


def test_odd_rows(table, monkeypatch):
    monkeypatch.setattr(runs, "RUN_BYTES", 3000)
    draw = random.Random(7)
    noise = lambda n: "".join(draw.choices("abcdefgh é\n\0", k=n))
    passage, fifty = noise(300), "x" + noise(40).encode()[:48].decode("utf-8", "ignore")
    fifty = (fifty + "y" * 50)[: 50 - (len(fifty.encode()) - len(fifty))]
    rows = [(i, noise(80) + passage[i : i + 150] + noise(30) + (passage if i % 5 == 0 else "")) for i in range(40)]
    rows += [(50, None), (51, ""), (52, fifty), (53, "q" + fifty + "r"), (54, fifty[:-1]), (55, "z" * 400), (56, "z" * 700), (57, "ab" * 300 + "z" * 49)]
    rows += [(58, rows[3][1]), (58, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (None, noise(200)), (-1, rows[5][1]), (59, "ab" * 30_000)]
    assert cut(table(rows, DOCS)) == plain(rows)
    assert suffixes.repeated_passages(table([], DOCS)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert cut(docs) == plain([tuple(r) for r in docs.collect()])


def test_spans_are_maximal(table):
    passage = "".join(random.Random(8).choices("abcdefgh", k=120))
    (_, second) = suffixes.repeated_passages(table([(1, passage), (2, "12" + passage + "3")], DOCS)).orderBy("doc_id").collect()
    assert [tuple(s) for s in second.spans] == [(2, 122)]


def test_loser_tree():
    draw = random.Random(9)
    for count in (0, 1, 2, 3, 7, 16):
        lists = [sorted(bytes(draw.choices(b"ab", k=draw.randint(0, 9))) for _ in range(draw.randint(0, 30))) for _ in range(count)]

        def coded(strings):
            before = b""
            for s in strings:
                shared = next((i for i, (x, y) in enumerate(zip(before, s)) if x != y), min(len(before), len(s)))  # noqa: B905
                yield shared, s
                before = s

        order, prefix = suffixes.merged([coded(x) for x in lists])
        heads = [iter(x) for x in lists]
        out = [next(heads[i]) for i in order]
        assert out == sorted(s for x in lists for s in x)
        for a, b, p in zip(out, out[1:], prefix[1:], strict=False):
            assert a[:p] == b[:p] and (len(a) == p or len(b) == p or a[p] != b[p])


def test_runs_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], DOCS)
    table = runs.bucketed(runs.pack(docs, "doc_id", "text"), 3)
    side = spark.createDataFrame([(1, 2)], "run long, x int")
    plan = table.groupBy("run").cogroup(side.groupBy("run")).applyInArrow(lambda a, b: a.select(["run"]), "run long")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
