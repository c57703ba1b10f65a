"""Budgets and prefixes of the mixture against a plain implementation."""

import hashlib
from collections import defaultdict

from themeloom.llm import mixing

DOCS = "doc_id long, text string, lang string, source string"
OPTIONS = mixing.MixOptions(
    domains={"a": ("s1", "s2"), "b": ("s3",)},
    weights={"domain": {"a": 3, "b": 2, "other": 0}, "lang": {"en": 2}, "source": {"s2": 5}},
    numerator=4,
    denominator=5,
    max_epochs=2,
    seed=3,
)


def share_out(pot, children):
    """children: {name: (cap, weight)}; whole tokens, full children first, then largest remainders."""
    children = {n: c for n, c in children.items() if c[1] > 0}
    pot, given, open_ = min(pot, sum(c for c, _ in children.values())), {}, dict(children)
    while True:
        weight = sum(w for _, w in open_.values())
        full = [n for n, (c, w) in open_.items() if c * weight <= w * (pot - sum(given.values()))]
        if not full:
            break
        first = min(full, key=lambda n: (open_[n][0] / open_[n][1], n))
        given[first] = open_.pop(first)[0]
    free = pot - sum(given.values())
    for n, (_, w) in open_.items():
        given[n] = free * w // weight
    rest = pot - sum(given.values())
    for n in sorted(open_, key=lambda n: (-(free * open_[n][1] % weight), n))[:rest]:
        given[n] += 1
    return given


def plain_mix(rows, o):
    name = lambda x: "(null)" if x is None else x
    leaves = defaultdict(list)
    for key, text, lang, source in rows:
        domain = next((d for d, m in o.domains.items() if source in m), o.other_domain)
        leaves[domain, name(lang), name(source)].append((key, len((text or "").split())))
    tokens = {p: sum(n for _, n in v) for p, v in leaves.items()}
    weight = lambda level, n: o.weights.get(level, {}).get(n, 1)
    cap = lambda *p: sum(t * o.max_epochs for q, t in tokens.items() if q[: len(p)] == p)
    level = lambda *p: {q[len(p)] for q in tokens if q[: len(p)] == p}
    out = []
    top = share_out(sum(tokens.values()) * o.numerator // o.denominator, {d: (cap(d), weight("domain", d)) for d in level()})
    for d, pot in top.items():
        for g, sub in share_out(pot, {g: (cap(d, g), weight("lang", g)) for g in level(d)}).items():
            for s, budget in share_out(sub, {s: (cap(d, g, s), weight("source", s)) for s in level(d, g)}).items():
                epoch, docs = 0, leaves[d, g, s]
                while budget > 0 and tokens[d, g, s]:
                    if budget >= tokens[d, g, s]:
                        out += [(k, d, g, s, epoch, n, n) for k, n in docs]
                        budget -= tokens[d, g, s]
                    else:
                        digest = lambda x: hashlib.md5(f"{o.seed}:{epoch}:{name(x[0])}".encode()).hexdigest()  # noqa: B023, E731
                        for k, n in sorted(docs, key=lambda x: (digest(x), x[1])):
                            if budget <= 0:
                                break
                            out.append((k, d, g, s, epoch, n, min(n, budget)))
                            budget -= n
                    epoch += 1
    return out


def taken(df):
    return df.select("row.doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens").collect()


def test_as_plain(table):
    rows = [(i, "w " * (1 + i * 7 % 40), "en" if i % 3 else "fr", f"s{1 + i % 4}") for i in range(200)]
    rows += [(300 + i, "word " * 900, "en", "s1") for i in range(30)]  # a hot source
    rows += [(None, "a b c", None, "s1"), (401, None, "en", None), (402, "", "de", "s3"), (403, "x y", "de", "s3"), (403, "x y", "de", "s3")]
    found = taken(mixing.mix(table(rows, DOCS), OPTIONS))
    assert sorted(map(tuple, found), key=str) == sorted(plain_mix(rows, OPTIONS), key=str)
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    assert sum(r.take_tokens for r in found) == total * 4 // 5
    assert max(r.epoch for r in found) == 1


def test_shortage_goes_to_siblings_first(table):
    # s1 cannot use its half: s2 gets it before the other domain does.
    rows = [(1, "w " * 10, "en", "s1"), (2, "w " * 500, "en", "s2"), (3, "w " * 500, "en", "s3")]
    options = mixing.MixOptions(domains={"a": ("s1", "s2"), "b": ("s3",)}, numerator=400, denominator=1010, max_epochs=1)
    used = {r.source: r.take_tokens for r in taken(mixing.mix(table(rows, DOCS), options))}
    assert used == {"s1": 10, "s2": 190, "s3": 200}


def test_empty(table):
    assert mixing.mix(table([], DOCS), OPTIONS).count() == 0
    assert mixing.mix(table([(1, None, None, None)], DOCS), OPTIONS).count() == 0


def test_stage_cuts_the_last_document(spark):
    import corpus_pipeline

    rows = [(i, f" \tone{i}  two\nthree " + "w " * (i % 37), "en", f"src{i % 3}", 0) for i in range(60)]
    docs = spark.createDataFrame([(*r[:4], len(r[1])) for r in rows], DOCS + ", n_chars long")
    expected = {}
    for *_, source, _, _, take in plain_mix([r[:4] for r in rows], corpus_pipeline.MIX):
        expected[source] = expected.get(source, 0) + take
    found, whole = {}, {r[0]: r[1] for r in rows}
    left = corpus_pipeline.mixing_stage(spark, docs, "").collect()
    for r in left:
        found[r.source] = found.get(r.source, 0) + len(r.text.split())
        assert whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert found == expected
    assert any(r.text != whole[r.doc_id] for r in left)
