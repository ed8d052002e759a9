"""Searches in tiles: bounded memory, exact ties, the same rows."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarryline.functions import vectors
from quarryline.operators import metrics, search
from quarryline.plans import catalog


def batch(pos, v):
    return pa.RecordBatch.from_arrays([pa.array(pos), pa.array(list(v), pa.list_(pa.float64()))], names=["vec_pos", "vector"])


def in_order(a, b) -> float:
    out = 0.0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        out += x * y
    return out


def test_memory_of_a_worker_does_not_grow_with_queries():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(4000, 8))
    rows, peak = batch(np.arange(4000), v), {}
    for n in (512, 2048):
        block = SimpleNamespace(value=[np.arange(n), v[:n]])
        tracemalloc.start()
        got = list(search._hits(block, 10, True)([rows]))
        peak[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(map(len, got)) == 10 * n
    assert peak[2048] < 1.3 * peak[512] and peak[2048] < 64e6, peak


def test_equal_vectors_tie_wherever_they_are():
    rng = np.random.default_rng(3)
    few = rng.normal(size=(150, 64)) / 8
    v = few[rng.integers(0, 150, 5000)]
    v[4000:] = few[rng.integers(0, 3, 1000)]  # large groups of copies
    pos = rng.permutation(5000)
    block = SimpleNamespace(value=[pos[:300].copy(), v[:300]])
    got = {}
    for b in search._hits(block, 40, True)([batch(pos[n : n + 700], v[n : n + 700]) for n in range(0, 5000, 700)]):
        for q, p, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got.setdefault(q, []).append((-s, p))
    for n in range(0, 300, 7):
        exact = np.zeros(5000)
        for d in range(64):
            exact += v[n, d] * v[:, d]
        want = sorted((-s, p) for s, p in zip(exact.tolist(), pos.tolist(), strict=True) if p != pos[n])[:40]
        assert sorted(got[pos[n]]) == want
        assert -want[0][0] == in_order(v[n], v[pos.tolist().index(want[0][1])])


def test_odd_vectors_are_no_hits():
    v = np.array([[1.0, 0.0], [np.nan, 1.0], [np.inf, 1.0], [0.5, 0.5], [0.0, 0.0]])
    block = SimpleNamespace(value=[np.array([0, 9]), np.array([[1.0, 0.0], [np.nan, 0.0]])])
    (b,) = search._hits(block, 3, True)([batch(np.arange(5), v)])
    assert list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) == [(0, 3), (0, 4)]
    assert sum(map(len, search._hits(block, 3, True)([]))) == 0


def test_shortlists_of_all_pairs_without_sorting_them(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(50)]  # many ties
    v = spark.createDataFrame(rows, "vec_pos long, vector array<double>").repartition(3)
    q = spark.createDataFrame([*rows[:9], (99, [1.0, 1.0, 1.0])], "sample_id long, vector array<double>")
    pairs = [(i, j, in_order(np.array(x), np.array(y)), (j % 11) / 20.0) for i, x in [*rows[:9], (99, [1.0, 1.0, 1.0])] for j, y in rows if i != j]
    want = search.rerank_shortlist(spark.createDataFrame(pairs, "sample_id long, item long, first double, second double"), 7, "first", "second")
    got = search.shortlists_of_all(q, v, 7, (F.col("item") % 11) / 20.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("sample_id", "item", "final").collect()))
    one = search.shortlists_of_all(q.limit(1), v.filter("vec_pos = 0"), 7, F.lit(0.0))
    assert one.count() == 0  # a query meets no vector but its own
    plan = catalog.QUERIES["shortlist_rerank"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("BroadcastNestedLoopJoin")]
    assert "Window" not in above and "Exchange" not in above and "aggregate(" not in above


def test_late_scores_equal_the_expressions(spark):
    rng = np.random.default_rng(5)
    sections = []
    for i in range(40):
        n = int(rng.integers(1, 6))
        sections.append((i, rng.normal(size=(n, 4)).tolist(), [bool(x) for x in rng.random(n) < (0.0 if i % 9 == 4 else 0.7)]))
    s = spark.createDataFrame(sections, "sec long, tokens array<array<double>>, mask array<boolean>").repartition(2)
    q = s.filter("sec % 6 = 0").selectExpr("sec AS qry", "slice(tokens, 1, 3) AS q")
    pairs = search.against_all(q, s, "qry", F.col("qry") != F.col("sec"))
    want = pairs.select("qry", "sec", vectors.cls_max("q", F.get("tokens", F.lit(0))), vectors.maxsim("q", "tokens", "mask"), vectors.logsumexp("q", "tokens", "mask"))
    for block in (2, 1024):
        got = search.late_scores(q, s, block)
        a, b = (sorted(map(tuple, d.collect())) for d in (got, want))
        assert [r[:2] for r in a] == [r[:2] for r in b] and len(a) == 7 * 39
        np.testing.assert_allclose([r[2:] for r in a], [r[2:] for r in b], rtol=1e-12, atol=1e-12)
    assert search.late_scores(q.limit(0), s).count() == 0
    assert "MapInArrow" in catalog.QUERIES["late_interaction"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_grams_of_captions_are_not_exchanged_before_they_are_counted(spark):
    rows = [(i, f"a cat {i} sat", ["a cat sat", f"cat {i}"]) for i in range(30)]
    d = spark.createDataFrame(rows, "id long, candidate string, references array<string>")
    plan = metrics.cider(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode(transform(sequence" not in plan
    assert plan.count("Join LeftOuter") == 2  # counts over the rows and the row's own sum; no n-gram meets an n-gram
