"""Held-out accuracy and the filter's own answers."""

import numpy as np

from themeloom.llm import language

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.identify(docs).select("doc_id", "text", "lang", "_language.held_out", "_language.p.*").toPandas()
    assert len(found) == docs.count()
    assert found.score.between(0, 1).all()
    unseen = found[found.held_out & (found.text.str.len() >= 40)]
    assert len(unseen) > 100
    assert (unseen.lang == unseen.lang_pred).mean() > 0.97


def test_labels_outside_the_learnt_fold_change_nothing(spark, table):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()[["doc_id", "text", "lang"]]
    other = docs.copy()
    import zlib

    fold = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id])
    other.loc[fold, "lang"] = "xx"
    read = lambda d: language.identify(spark.createDataFrame(d, DOCS)).select("doc_id", "_language").toPandas()
    a, b = read(docs), read(other)
    assert a.sort_values("doc_id").reset_index(drop=True).equals(b.sort_values("doc_id").reset_index(drop=True))
    assert dict(zip(a.doc_id, [r.held_out for r in a._language], strict=True)) == dict(zip(docs.doc_id, fold, strict=True))


def test_odd_rows(table):
    texts = {"en": "the cat and the dog went to the house", "de": "der hund und die katze gehen nach haus"}
    rows = [(i, texts["en" if i % 2 else "de"] * 3, "en" if i % 2 else "de") for i in range(60)]
    rows += [(None, texts["en"], "en"), (100, None, "en"), (101, "", None), (102, "12 !?", "de"), (103, "the dog " * 20000, None),
             (104, "ж", None), (105, texts["de"], None), (105, texts["de"], None)]
    found = language.identify(table(rows, DOCS)).select("doc_id", "_language.p.lang_pred", "_language.p.score").collect()
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in found}
    assert len(found) == len(rows)
    assert by_id[100] == by_id[101] == by_id[102] == ("und", 0.0)
    assert by_id[None][0] == by_id[103][0] == "en" and by_id[105][0] == "de"
    assert by_id[104][0] in ("de", "en")
    assert language.identify(table([], DOCS)).count() == 0
    nothing = language.identify(table([(1, "hello", None)], DOCS)).select("_language.p.lang_pred").collect()
    assert nothing[0].lang_pred == "und"


def plain_model(model, texts):
    """The model's answers from sets of grams that pass the filter, looked up one by one."""
    size = model.masks.shape[1]

    def holds(number, code):
        row, bit = model.masks[number // language.BITS], 1 << number % language.BITS
        code ^= code >> 15
        return all(int(row[(code * int(m) & 0xFFFFFFFF) >> (33 - size.bit_length())]) & bit for m in language.MULTIPLIERS)

    out = []
    for text in texts:
        data = b"  " + text.lower().encode() + b"  "
        grams = [int.from_bytes(data[i : i + 4], "big") for i in range(len(data) - 3)]
        share = []
        for number in range(len(model.languages)):
            noise = model.noise[number]
            share.append(max(sum(holds(number, g) for g in grams) / len(grams) - noise, 0) / (1 - noise))
        if not any(share):
            out.append((model.languages[model.fallback], 0.0, 0.0))
            continue
        best = share.index(max(share))
        out.append((model.languages[best], share[best] / sum(share), share[best]))
    return out


def test_same_as_plain_dictionaries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.where(~language.held_out("doc_id")), "doc_id", "text", "lang", language.LanguageOptions())
    texts = [r.text for r in docs.where("length(text) between 1 and 600").limit(120).collect()] + ["ж ж", "日本", "x"]
    for text, expected in zip(texts, plain_model(model, texts), strict=True):
        found = model.predict(text)
        assert found[0] == expected[0] and np.allclose(found[1:], expected[1:])


def test_filter_returns_every_language_of_a_gram():
    """More languages than a row of slots has bits."""
    names = [f"l{i:02}" for i in range(80)]
    masks = np.zeros((-(-80 // language.BITS), 1 << 14), np.int8)
    texts = [f"shared {chr(97 + i % 26) * 3}{i:02}" for i in range(80)]
    for number, text in enumerate(texts):
        for slot in language.slots(language.gram_codes(text), masks.shape[1]):
            masks[number // language.BITS][slot] |= np.int8(1 << number % language.BITS)
    model = language.LanguageModel(names, masks, np.zeros(80), 0)
    assert model.hits(language.gram_codes("shared")[2:4]).all()
    for number, text in enumerate(texts):
        assert model.hits(language.gram_codes(text))[number].all()
        assert model.predict(text)[0] == names[number]


def test_many_languages(spark):
    rows = [(i, f"{chr(0x4E00 + 40 * (i % 70))}{chr(0x4E01 + 40 * (i % 70))} " * 5, f"l{i % 70:02}") for i in range(700)]
    found = language.identify(spark.createDataFrame(rows, DOCS)).select("lang", "_language.p.*").collect()
    assert all(r.lang == r.lang_pred and r.trusted for r in found)


def test_trusted(spark):
    """Clean texts of every learnt language stay; foreign scripts, noise and code go."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = ["Съешь же ещё этих мягких французских булок, да выпей чаю", "いろはにほへと ちりぬるを", "xqzkv bgrtp wqxzj kkjvv " * 5,
           "for (i = 0; i < n; ++i) { x[i] += y[j] * 2; }\n" * 8, "12 34", "", None]
    extra = spark.createDataFrame([(10_000_000 + i, t, None) for i, t in enumerate(odd)], DOCS)
    found = language.identify(docs.unionByName(extra)).select("doc_id", "text", "_language.p.trusted").collect()
    assert not any(r.trusted for r in found if r.doc_id >= 10_000_000)
    assert all(r.trusted for r in found if r.doc_id < 10_000_000)


def test_every_labelled_row_is_learnt_from(spark):
    """One row of thousands in its language has words of its own; the row counts, whatever its key."""
    rows = [(i, "the cat sat on the mat", "en") for i in range(6000)] + [(i, "der hund und die katze", "de") for i in range(6000, 6500)]
    for key in (7001, 7002, 7003, 7004):
        docs = spark.createDataFrame([*rows, (key, "zyxwvut", "en")], DOCS)
        model = language.fit(docs, "doc_id", "text", "lang", language.LanguageOptions())
        codes = language.gram_codes("zyxwvut")
        assert model.hits(codes)[model.languages.index("en")].all()
