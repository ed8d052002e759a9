"""Language identification: accuracy on held-out documents, undetermined texts, the machines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import language, queries
from quarryline.llm.language import Grams, Identifier, fit, identify


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.op6_language(spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_margins_are_those_of_the_vectors():
    g = Grams(10)
    texts = ["Hello wörld", "a", "12 ab 34 cd", "x" * 50]
    w = np.random.default_rng(1).normal(size=(3, 1 << 10)).astype(np.float32)
    together, alone = g.margins(g.of(texts), w), np.array([g.margins(g.of([t]), w)[:, 0] for t in texts]).T
    assert np.allclose(together, alone, atol=1e-4)  # neighbours in a batch do not matter
    assert np.allclose(alone, w @ g.shares(texts).T, atol=1e-3)


def test_machine_separates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] - x[:, 1] > 0, 1.0, -1.0)
    w, b = fit(x, np.arange(200), y)
    assert (np.sign(x @ w + b) == y).mean() > 0.97


def test_families_first():
    german, french = "der die und das nicht ", "le la et les des "
    i = Identifier([(german * 5, "de"), ("the and of that ", "en"), (french * 5, "fr"), ("el los y que una ", "es")])
    assert i.families == ["germanic", "romance"] and {f: [(m.yes, m.no) for m in own] for f, own in i.machines.items()} == {"germanic": [("de", "en")], "romance": [("es", "fr")]}
    assert i.predict([german, french])[0][0] == "de" and i.predict([french])[0][0] == "fr"
    assert language.family_of("xx") == "xx"
    assert Identifier([("abc", "xx")]).predict(["abc", "1"]) == [("xx", 1.0), ("und", 0.0)]


def test_odd_rows(make, odd):
    docs = make([(i, t, "en" if (i or 0) % 2 else "de") for i, t in odd], extra=True)
    rows = identify(docs, language.sample(docs, F.lit(True))).collect()
    assert len(rows) == len(odd)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {1, 2, 3} <= und and not {4, 5, 8} & und
    assert {r.lang_pred for r in identify(docs, []).collect()} == {"und"}
    assert language.sample(make([]), F.lit(True)) == []
    assert len(language.sample(docs, F.lit(True), per_language=2)) <= 4


def test_examples_are_whole_texts(spark):
    long = {"xx": "aba " * 6_000 + "zuz " * 6_000, "yy": "ebe " * 4_000}
    docs = spark.createDataFrame([(i, t, n) for i, (n, t) in enumerate(long.items())], "doc_id long, text string, lang string")
    assert dict((n, t) for t, n in language.sample(docs, F.lit(True))) == long


def test_a_bound_of_characters_leaves_out_rows_and_cuts_none(spark):
    docs = spark.createDataFrame([(i, "abc " * 25, "xx") for i in range(9)] + [(9, "e" * 5_000, "yy")], "doc_id long, text string, lang string")
    got = language.sample(docs, F.lit(True), max_chars=1_000)
    assert sorted((n, len(t)) for t, n in got) == [("xx", 100)] * 5 + [("yy", 5_000)]


def by_definition(model, text):
    """A prediction from the definition: n-grams one by one, their shares, the largest family, all duels within it."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    bits, mask = model.grams.bits, (1 << 32) - 1
    kept = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in (c if c.isalpha() or ord(c) > 65_535 else " " for c in text)] + [32]
    share = np.zeros(1 << bits)
    for n in (1, 2, 3):
        for k in range(len(kept)):
            h = 0
            for j in range(n):
                x = kept[k + j] if k + j < len(kept) else 32
                h = ((x * 0x9E3779B1) if j == 0 else h * 0x01000193 + x) & mask
            h = ((h ^ h >> 15) * 0x85EBCA6B + n) & mask
            share[h >> 32 - bits] += 1
    share *= language.SCALE / share.sum()
    sure = lambda m: 1 / (1 + np.exp(-2 * max(0.0, min(m, 30.0))))
    family, first = model.families[0], 1.0
    if len(model.families) > 1:
        m = sorted(((float(w @ share) + b, -k) for k, (w, b) in enumerate(zip(*model.first))), reverse=True)
        family, first = model.families[-m[0][1]], sure(m[0][0] - m[1][0])
    duels = {}
    for x in model.machines[family]:
        d = float(x.w @ share) + x.b
        duels[x.yes, x.no], duels[x.no, x.yes] = d, -d
    names = [v for v in model.langs if language.family_of(v) == family]
    won = lambda v: sum(duels[v, o] > 0 or (duels[v, o] == 0 and v > o) for o in names if o != v)
    best = min(names, key=lambda v: (-won(v), -sum(duels[v, o] for o in names if o != v), v))
    return best, first * (sure(min(duels[best, o] for o in names if o != best)) if len(names) > 1 else 1.0)


def test_predictions_equal_brute_force(spark, make, odd):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held", language_held())
    model = Identifier(language.sample(docs, ~F.col("held")))
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op6_language(spark, sf).collect()}
    for r in docs.select("doc_id", F.substring("text", 1, 10_000_000).alias("text")).collect():
        want = by_definition(model, r.text)
        assert got[r.doc_id][0] == want[0] and abs(got[r.doc_id][1] - want[1]) < 1e-4
    for _, t in odd:
        (lang, score), want = model.predict([t])[0], by_definition(model, t)
        assert lang == want[0] and abs(score - want[1]) < 1e-4


def language_held():
    from quarryline.llm.common import held_out

    return held_out("doc_id", 4, 2)


def test_three_hundred_languages(spark):
    """Every language is learned and can be predicted, however many there are."""
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in range(0x1200, 0x1330) if chr(c).isalpha()]
    own = {f"q{i:03}": [letters[k] for k in rng.choice(len(letters), 12, replace=False)] for i in range(300)}
    text = lambda v: " ".join("".join(rng.choice(own[v], 4)) for _ in range(80))
    docs = spark.createDataFrame([(i * 300 + k, text(v), v) for k, v in enumerate(own) for i in range(4)], "doc_id long, text string, lang string")
    examples = language.sample(docs.filter("doc_id < 900"), F.lit(True))
    assert len({v for _, v in examples}) == 300
    rows = identify(docs.filter("doc_id >= 900").repartition(4), examples, keep=("lang",)).collect()
    assert len(rows) == 300 and sum(r.lang == r.lang_pred for r in rows) >= 285
    with pytest.raises(ValueError):
        language.sample(docs, F.lit(True), max_languages=299)
    with pytest.raises(ValueError):
        identify(docs, examples, max_bytes=1 << 20)


def test_ties(spark):
    """Of equal margins the first family and the second language; both are as sure as a coin."""
    model = Identifier([("abc", "xx"), ("abc", "yy")])
    for part in model.first:
        part[:] = 0
    assert model.predict(["abc"])[0] == ("xx", 0.5)
    model = Identifier([("abc", "de"), ("abc", "en")])
    model.machines["germanic"][0].w[:] = 0
    model.machines["germanic"][0].b = 0.0
    assert model.predict(["abc"])[0] == ("en", 0.5)
