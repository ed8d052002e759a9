"""Decontamination against brute force and against SQL."""

import hashlib
import random
import re

from oracle import compare
from pyspark.sql import functions as F

from quarryline.llm import queries, sql
from quarryline.llm.decontaminate import contamination, window_hashes, without_documents, without_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                own = grams.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        names = ",".join(sorted(map(str, found)))
        spans = [k for k in sorted(hit) if k - 1 not in hit]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit), spans))
    return sorted(out, key=repr)


def case(odd):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(30)] + ["É", "Ümlaut", "THE", "the"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(("", ",", ".\n", " -")) for _ in range(n))
    items = [(i, text(rng.randint(10, 30))) for i in range(12)] + [(12, "w1 w2 w3"), (13, "  --  "), (14, None), (15, "W1, w2: w3"), (2, "w4 the W5"), (16, "É Ümlaut"), (17, "nowhere"), (18, "w7 w8 w9 w1 w2 w3 w4")]
    docs = list(odd)
    for i in range(100, 160):
        t = text(rng.randint(0, 60))
        if i % 3 == 0:
            t += " " + rng.choice(items[:12])[1].upper() + " " + text(4)
        docs.append((i, t))
    return docs, items


def test_equals_brute_force(spark, make, odd):
    docs, items = case(odd)
    bench = spark.createDataFrame([(*r, "x", "y") for r in items], "item_id long, text string, words string, n string")
    for block in (32 << 20, 12_000, 2_000):  # all windows broadcast; their hashes in one block; in several
        rows = contamination(make(docs, extra=True), bench, block_bytes=block).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, [s.first for s in r.spans]) for r in rows), key=repr)
        assert got == brute(docs, items)


def test_no_benchmark_and_no_documents(spark, make, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = contamination(make(odd), none).collect()
    assert len(rows) == len(odd) and not any(r.contaminated for r in rows)
    assert contamination(make([]), none).count() == 0
    assert without_documents(make(odd), none).count() == len(odd)


def test_documents_go_and_clean_ones_stay(spark, make, odd):
    docs, items = case(odd)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = make(docs)
    for c in ("own key", "own text_h", "hit id", "name0", "times"):
        df = df.withColumn(c, F.lit("clash"))
    clean = {i: not c for i, _, _, _, _, c, _ in brute(docs, items)}
    for block in (32 << 20, 2_000):
        out = without_documents(df, bench, block_bytes=block)
        assert out.columns == df.columns
        assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None) == sorted((i, t) for i, t in docs if i is not None and clean[i])


def test_spans_can_be_cut_out(spark):
    d = spark.createDataFrame([("A, b! c d.", [(1, 3)]), ("-x y", [(0, 1)]), ("x y", [])], "t string, s array<struct<first:int,past:int>>")
    assert [r[0] for r in d.select(without_spans(F.col("t"), F.col("s"))).collect()] == ["A,  d.", "- y", "x y"]


def test_window_hashes_tell_windows_apart(spark):
    rng = random.Random(2)
    w = [rng.choice("abc") for _ in range(300)]
    for n in (1, 2, 3, 5, 7, 10):
        h = spark.createDataFrame([(w,)], "w array<string>").select(window_hashes(F.col("w"), n)).first()[0]
        grams = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        assert len(h) == len(grams) and len(set(zip(h, grams))) == len(set(h)) == len(set(grams))
    both = spark.createDataFrame([(w[:9],)], "w array<string>").select(*[window_hashes(F.col("w"), *n) for n in ((10, 7, 3), (7,), (3,))]).first()
    assert both[0] == both[1] + both[2]


def test_equals_sql(spark):
    compare(spark, queries.op8_decontaminate, sql.DECONTAMINATE, "/root/testdata/sf0.001")
