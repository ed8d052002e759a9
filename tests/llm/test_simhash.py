"""SimHash: fingerprints by the definition, links and components by brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from quarryline.llm.simhash import components, fingerprint, links, near_duplicates, one_of_each

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_definition(text, n=3):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_is_the_definition(spark, odd):
    from pyspark.sql import functions as F

    for _, t in odd:
        assert fingerprint(t) == by_definition(t)
    # Spark's own hash of a string is the same XXH64.
    h = spark.createDataFrame([("a b É",)], "s string").select(F.xxhash64("s")).first()[0]
    assert h & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b É".encode(), 42)


def groups(fps, bits=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def cloud(rng, n):
    """Fingerprints around a few centres, some far from all."""
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.choice((rng.randrange(64), rng.randrange(12)))
        out.add(signed(x))
    return sorted(out)


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_give_the_components(spark, bits):
    rng = random.Random(4)
    fps = sorted({*cloud(rng, 400), 8, 17, 24, 25})
    want = {}
    for x, g in zip(fps, groups(fps, bits)):
        want.setdefault(g, set()).add(x)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    for long_list in (2, 48, 10_000):  # sections by their meeting values, mixed, by counting
        found = {}
        edges = links(nodes, bits, long_list)
        assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= bits for r in edges.collect())
        for r in components(edges).collect():
            found.setdefault(r.root, set()).add(r.node)
        assert sorted(map(sorted, found.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)
        assert all(root == min(s) for root, s in found.items())


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    rows = components(edges).collect()
    assert len(rows) == 201 and {r.root for r in rows} == {0}
    assert components(edges.limit(0)).count() == 0


def brute(docs):
    fps = [fingerprint(t) for _, t in docs]
    own = groups(fps)
    least = {}
    for (i, _), g in zip(docs, own):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, signed(f), least.get(g)) for (i, _), f, g in zip(docs, fps, own)), key=repr)


def corpus(odd):
    rng = random.Random(6)
    docs = list(odd)
    for i in range(20, 40):
        base = [f"w{rng.randrange(50)}" for _ in range(120)]
        docs.append((i, " ".join(base)))
        for k in range(4):
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            docs.append((i * 100 + k, " ".join(near)))
    return docs


def test_near_duplicates_equal_brute_force(make, odd):
    docs = corpus(odd)
    rows = near_duplicates(make(docs, extra=True)).collect()
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in rows), key=repr) == brute(docs)
    assert near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("most", [3, 1 << 19])  # names in an exchange, and all broadcast
def test_one_of_each_keeps_one_row_of_each_component(make, odd, most):
    docs = corpus(odd)
    df = make(docs, extra=True)
    for c in ("own key", "own text_h", "copy no", "stays"):
        df = df.withColumn(c, F.lit("clash"))
    kept = one_of_each(df, most=most)
    assert kept.columns == df.columns
    kept = kept.collect()
    want = {c for _, _, c in brute(docs)}
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == sorted(c for c in want if c is not None)
    assert len(kept) == len(want)
    assert {(r.doc_id, r.text) for r in kept} <= {(i, t) for i, t in docs}


def test_a_star_of_many_nodes(spark):
    """More nodes under one root than are joined by exchange."""
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(9)], "a long, b long")
    rows = {r.node: r.root for r in components(edges).collect()}
    assert rows == {**dict.fromkeys(range(300), 0), **dict.fromkeys(range(1000, 1010), 1000)}
