"""Text statistics against brute force, and the learned list."""

import random
import re

from quarryline.llm import quality
from quarryline.llm.quality import judge, learn, statistics, verdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    x = text or ""
    w = WORD.findall(x)
    seen = {}
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {p + j for v in seen.values() if len(v) > 1 for p in v for j in range(5)}
    lines = [s for s in x.split("\n") if WORD.search(s)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(make, odd):
    rng = random.Random(1)
    docs = odd + [(100 + i, "".join(rng.choice("ab# \n") for _ in range(rng.randint(0, 300)))) for i in range(60)]
    got = sorted(tuple(r)[1:7] for r in statistics(make(docs, extra=True)).collect())
    want = sorted(brute(t) for _, t in docs)
    assert sorted((g[0], g[1], g[2], g[4], g[5]) for g in got) == want


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        docs.append((i, " ".join(word() + ("###" if bad else "") for _ in range(30))))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_learned_rules_drop_junk_and_keep_the_rest(spark, make):
    docs, labels = corpus()
    rows = judge(make(docs), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r.kept == bool(r.doc_id % 4) for r in rows)


def test_rules_equal_their_expression(spark):
    rng = random.Random(3)
    rows = [(i, *[float(rng.randint(0, 9)) for _ in quality.FEATURES], rng.random()) for i in range(600)]
    names = list(quality.FEATURES)
    data = [(*r[:-1], int(not (r[1] > 6 and r[2] <= 4))) for r in rows]
    df = spark.createDataFrame(data, ["id", *names, "label"])
    rules = learn(df)
    assert rules and all(1 <= len(r) <= 4 for r in rules)

    def first(row):
        for k, rule in enumerate(rules, 1):
            if all((row[t.feature] > t.threshold) == t.above for t in rule):
                return k
        return None

    out = df.withColumn("rule", verdict(rules)).collect()
    assert all(r.rule == first(r) for r in out)
    assert sum(r.rule is not None and r.label == 1 for r in out) <= 0.1 * sum(r.rule is not None for r in out)


def test_odd_rows_and_no_labels(spark, make, odd):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 0), (999, 0), (6, None), (6, 7)], "doc_id long, quality int")
    rows = judge(make(odd, extra=True), labels.limit(0)).collect()
    assert len(rows) == len(odd)
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert {r.doc_id for r in rows if r.base_failed} >= {1, 2, 3, 4, 7}
    assert judge(make(odd), labels).count() == len(odd)
    assert judge(make([]), labels).count() == 0
