"""Karmarkar-Karp shards: balance, whole groups, gapless slots."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm.shards import assign, difference


def by_the_book(sizes, shards):
    """Differencing with plain lists: combine the two partitions of largest spread until one is left."""
    parts = [(sorted([0] * (shards - 1) + [s]), i) for i, s in enumerate(sizes)]
    n = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][-1] - p[0][0]), p[1]))
        (a, _), (b, _), *rest = parts
        parts = [*rest, (sorted(x + y for x, y in zip(a, reversed(b))), n)]
        n += 1
    return parts[0][0] if parts else [0] * shards


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=30), st.integers(1, 5))
def test_difference_is_the_method(sizes, shards):
    places, sums = difference(sizes, shards)
    assert sorted(sums.tolist()) == by_the_book(sizes, shards)
    own = Counter()
    for s, p in zip(sizes, places[:, -1].tolist(), strict=True):
        own[p] += s
    assert [own[k] for k in range(shards)] == sums.tolist()


def test_partial_partitions_combine():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 1000, 4) for _ in range(20)]
    places, sums = difference(parts, 4)
    again = np.zeros(4, np.int64)
    for p, at in zip(parts, places):
        assert sorted(at.tolist()) == [0, 1, 2, 3]
        again[at] += p
    assert again.tolist() == sums.tolist() and sums.max() - sums.min() < 200


def check(rows, docs, shards):
    assert len(rows) == len(docs)
    slots, text_of = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for r in rows:
        text_of[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in text_of.values())


def test_odd_rows(make, odd):
    rows = assign(make(odd, extra=True), 5).collect()
    check(rows, odd, 5)
    want = Counter((i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t in odd)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_balance_over_cells_and_runs(make):
    rng = random.Random(4)
    docs = [(i, "w" * rng.randint(1, 400) + str(i)) for i in range(3000)] + [(i, "hot") for i in range(3000, 4500)]
    for large in (5, 40, 5000):
        rows = assign(make(docs), 7, large_groups=large, groups_per_cell=200, rows_per_run=100).collect()
        check(rows, docs, 7)
        total = Counter()
        for r in rows:
            total[r.shard] += r.size
        assert max(total.values()) - min(total.values()) <= 20, large


def test_empty(make):
    assert assign(make([]), 3).count() == 0


def test_cells_against_one_differencing(make):
    """The spread that cells leave is within the bound that the module states, and near that of one differencing of all groups."""
    rng = random.Random(8)
    docs = [(i, "v" * rng.choice((1, 5, 300, 2000)) + str(i)) for i in range(4000)]
    sizes = sorted((len(t) + 16 for _, t in docs), reverse=True)
    _, sums = difference(sizes, 6)
    for large in (10, 500):
        total = Counter()
        for r in assign(make(docs), 6, large_groups=large, groups_per_cell=300).collect():
            total[r.shard] += r.size
        spread, cells = max(total.values()) - min(total.values()), (4000 - large) // 300 + 1
        assert max(sums) - min(sums) <= 20 and spread <= 10 * cells, (large, spread)  # of 390,000 bytes in a shard


def test_repeated_rows_are_numbered_in_several_tasks(make):
    docs = [(7, "same")] * 900 + [(i, f"t{i}") for i in range(100)]
    check(assign(make(docs).repartition(4), 3, rows_per_run=50).collect(), docs, 3)
