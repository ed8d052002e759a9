"""Deleted interpolation against a plain-Python model, at any cut of the batches."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarryline.llm import interpolated as M
from quarryline.llm.common import held_out

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    """Counts, deleted counts, expectation-maximisation over single tokens, and scores."""
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    seqs = [(i, [*WORD.findall((t or "").translate(LOWER)), "\n"]) for i, t in docs]
    uni, bi = Counter(), Counter()
    for i, s in seqs:
        if not held[i]:
            uni.update(s)
            bi.update(zip(["\0", *s], s))
    n, v = sum(uni.values()), len(uni)
    ends = uni["\n"]
    ctx = lambda u: ends if u == "\0" else uni[u]
    rows = []
    for i, s in seqs:
        if not held[i]:
            for u, w in zip(["\0", *s], s):
                cu, cw, cuw = ctx(u) - 1, uni[w] - 1, bi[u, w] - 1
                rows.append((min(cu.bit_length(), M.BUCKETS - 1), cuw / cu if cu > 0 else 0.0, cw / max(1, n - 1)))

    def fit(some):
        lam = np.array([0.4, 0.4, 0.2])
        p = np.array([(a, b, 1 / (v + 1)) for _, a, b in some])
        for _ in range(60):
            share = p * lam
            lam = (share / share.sum(1, keepdims=True)).mean(0)
        return lam

    pooled = fit(rows) if rows else np.array([0.0, 0.0, 1.0])
    lam = {}
    for b in range(M.BUCKETS):
        own = [r for r in rows if r[0] == b]
        x = fit(own) if len(own) >= 50 else pooled.copy()
        if b == 0:
            x[0] = 0
        x[2] = max(x[2], 1e-9)
        lam[b] = x / x.sum()
    out = []
    for i, s in seqs:
        score = 0.0
        for u, w in zip(["\0", *s], s):
            cu = ctx(u)
            a = lam[min(cu.bit_length(), M.BUCKETS - 1)]
            score += math.log10(a[0] * bi[u, w] / max(cu, 1) + a[1] * uni[w] / max(1, n) + a[2] / (v + 1))
        out.append((held[i], len(s), sum(uni[w] > 0 for w in s), n, sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s), score))
    return out


def corpus(n=150):
    words = "the of and to in cat dog sat mat log Sun moon sky red blue run ran".split()
    x, docs = 7, []
    for i in range(n):
        s = []
        for _ in range(20 + i % 30):
            x = (x * 1103515245 + 12345) % (1 << 31)
            s.append(words[min((x >> 16) % 17, (x >> 8) % 17)])
        docs.append((i, " ".join(s) + (f"\nonly{i}" if i % 3 == 0 else "")))
    return docs


@pytest.mark.parametrize(("parts", "batch"), [(1, 12 << 20), (8, 900)])
def test_equals_brute_force(make, odd, parts, batch):
    docs = corpus() + [(None if i is None else i + 1000, t) for i, t in odd]
    rows = M.score(make(docs, extra=True).repartition(3), held_out("doc_id", 5, 1), parts=parts, batch_bytes=batch, run_batches=3).collect()
    key = lambda r: (r[0], r[1], r[2], r[3], round(r[4], 6))
    got = sorted(((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows), key=key)
    for g, w in zip(got, sorted(brute(docs), key=key), strict=True):
        assert g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-5)


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    from quarryline.llm.queries import op3_interpolated

    rows = op3_interpolated(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_sum_to_one():
    lam = M.learn_weights([((3 << 16) + 7, 100, 40.0, 10.0), ((0 << 16), 80, 0.0, 8.0)], 10)
    assert np.allclose(lam.sum(1), 1) and lam[0, 0] == 0


def test_packing():
    rng = np.random.default_rng(1)
    for base in (0, 5 << 60):
        for sizes in ([0], [1], [0, 3, 0], [2, 1000, 0, 7]):
            segments = [np.unique(rng.integers(base, base + (1 << 60), n, dtype=np.uint64)) for n in sizes]
            data = M.pack_keys(segments, base)
            assert (M.unpack_keys(data) == np.concatenate(segments)).all()
            assert len(data) <= 12 + 8 * sum(sizes) + 2 * len(sizes)
    for n in (0, 1, 2, 1000):
        counts = rng.integers(0, 1 << 40, n)
        assert (M.unpack_counts(M.pack_counts(counts)) == counts).all()


def test_totals_of_repeated_keys():
    rng = np.random.default_rng(2)
    keys, counts = rng.integers(0, 300, 5_000, dtype=np.uint64) << np.uint64(50), rng.integers(0, 3, 5_000, dtype=np.uint32)
    total, distinct = M._totals(keys, counts)
    want = Counter()
    for k, c in zip(keys.tolist(), counts.tolist()):
        want[k] += c
    assert total.tolist() == [want[k] for k in keys.tolist()] and distinct == sum(v > 0 for v in want.values())


def test_parts_follow_the_text(spark, make):
    assert [M.parts_for(n) for n in (0, 1, 16 << 20, (16 << 20) + 1, 10**14)] == [1, 1, 1, 2, 1 << 23]
    packs = M.packed(make([(1, "a b"), (2, None)]).selectExpr("doc_id AS id", "text", "false AS held"))
    assert packs.agg({"bytes": "sum"}).first()[0] < 200  # measured, as a table in memory has no size


def test_runs_and_batches(make):
    docs = make([(i, f"word{i} " * 40) for i in range(50)]).coalesce(1).selectExpr("doc_id AS id", "text", "false AS held")
    rows = M.packed(docs, 900, 3).orderBy("run", "nth").collect()
    assert len(rows) > 6 and [(r.run, r.nth) for r in rows] == [(k // 3, k % 3) for k in range(len(rows))]


def test_texts_are_not_exchanged(spark):
    from quarryline.llm.queries import op3_interpolated

    plan = op3_interpolated(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # the answers


def test_nothing_to_learn_from(make):
    i = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    r = M.score(make([(i, "a b")]), held_out("doc_id", 5, 1), parts=2).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert M.score(make([]), held_out("doc_id", 5, 1), parts=2).count() == 0
