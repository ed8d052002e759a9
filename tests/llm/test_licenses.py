"""License scans: spans, coverage, the banded alignment and the winnowing guarantee."""

import random

import numpy as np
import pytest

from quarryline.llm.licenses import TEMPLATES, Scanner, align, scan, words_of

MIT = next(t for n, t in TEMPLATES if n == "MIT" and t.startswith("Permission"))


def full_local(a, b):
    """Local alignment without a band: the best score."""
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (1 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def test_wide_band_is_the_full_alignment():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(2))
        n, first, past = align(a, b, -20, 20)
        assert n >= full_local(a, b)  # matches less penalties is the score
        assert 0 <= past - first <= len(b)


def test_every_template_is_found_whole():
    s = Scanner()
    for k, (name, text) in enumerate(TEMPLATES):
        found = s.scan(f"Some words é first.\n{text}\nAnd more after.")
        assert (found[0]["license"], found[0]["coverage"]) == (name, 1.0) or found[0]["template_words"] > len(words_of(text)), k
        m = found[0]
        assert f"Some words é first.\n{text}\n"[m["start"] : m["end"]].split()[0] == text.split()[0]


def test_changed_copies_and_strangers():
    s = Scanner()
    words = MIT.split()
    words[10:10] = ["really"]
    del words[40]
    words[60] = "other"
    m = s.scan(" ".join(words))
    assert [x["license"] for x in m] == ["MIT"] and 0.9 < m[0]["coverage"] < 1
    assert s.scan("the license of the library is free for you and me") == []
    assert s.scan(" ".join(MIT.split()[:40])) == []  # under four fifths of the template
    twice = s.scan("Released under the MIT License. x y z. Released under the MIT License.")
    assert [(x["license"], x["coverage"]) for x in twice] == [("MIT", 1.0)] * 2
    assert twice[0]["end"] <= twice[1]["start"]


def test_shared_runs_have_a_fingerprint():
    s = Scanner(n=3, window=2)
    for t in s.words:
        for i in range(len(t) - 3):
            grams = s.grams(__import__("numpy").array(t[i : i + 4]))
            assert any(g in s.keys for g in grams)
    with pytest.raises(ValueError):
        Scanner((("x", "too short"),))


def test_odd_rows(make, odd):
    docs = [*odd, (50, "A\nLicensed under the Apache License, Version 2.0.\n" * 2)]
    rows = scan(make(docs, extra=True)).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: r.n_licenses for r in rows if r.n_licenses} == {50: 2}
    m = rows[-1].licenses[0]
    assert docs[-1][1][m.start : m.end] == "Licensed under the Apache License, Version 2.0"
    assert scan(make([])).count() == 0


def test_short_templates_are_found_with_a_word_missing_or_changed():
    s = Scanner()
    for text in ("Released under MIT License.", "Released under an MIT License.", "Published under the MIT License."):
        assert [(m["license"], m["matched_words"], m["coverage"]) for m in s.scan(f"Some words é first. {text} And more after.")] == [("MIT", 4, 0.8)], text
    assert s.scan("Released to the public by MIT.") == []


def test_all_that_coverage_allows_may_be_missing():
    s = Scanner()
    rng = random.Random(6)
    for k, (_, template) in enumerate(TEMPLATES):
        words = template.split()
        n = len(words_of(template))
        one = [i for i, w in enumerate(words) if len(words_of(w)) == 1]
        for _ in range(20):
            drop = rng.sample(one, min(len(one), int(n * 0.2 + 1e-9)))
            text = " ".join(w for i, w in enumerate(words) if i not in drop)
            at = np.array([s.ids.get(w, -1) for w in words_of(text)], np.int64)
            held = [t for size, keys, posts in s.indexes for g in s.grams(at, size).tolist() if g in keys for t, _ in posts[keys.tolist().index(g)]]
            assert k in held, (template, text)


def aligned(template, words):
    """For each start of words, the most template words that a local alignment from there on has, by all pairs: (score, matches, first, past) of the best."""
    best = (0, 0, 0, 0)
    row = [(0, 0, j) for j in range(len(words) + 1)]  # score, matches, first
    for x in template:
        new = [(0, 0, 0)]
        for j, y in enumerate(words):
            up = (row[j][0] + (1 if x == y else -1), row[j][1] + (x == y), row[j][2])
            options = [up, (row[j + 1][0] - 1, *row[j + 1][1:]), (new[j][0] - 1, *new[j][1:])]
            top = max(options, key=lambda o: o[:2])
            new.append(top if top[0] > 0 else (0, 0, j + 1))
            if new[-1][:2] > best[:2]:
                best = (*new[-1][:2], new[-1][2], j + 1)
        row = new
    return best


def brute(scanner, text):
    """Templates found by aligning every one with the whole text, over and over beside what was found; the scan's rule of overlaps."""
    words, found = words_of(text), []
    for t, (name, template) in enumerate(TEMPLATES):
        own, todo = words_of(template), [(0, len(words))]
        while todo:
            a, b = todo.pop()
            _, n, first, past = aligned(own, words[a:b])
            if n >= scanner.coverage * len(own):
                found.append((t, n, a + first, a + past))
                todo += [(a, a + first), (a + past, b)]
    found.sort(key=lambda m: (-m[1], -m[1] / len(words_of(TEMPLATES[m[0]][1])), m[0], m[2]))
    kept = []
    for m in found:
        if all(m[3] <= k[2] or m[2] >= k[3] for k in kept):
            kept.append(m)
    return sorted((TEMPLATES[t][0], n, a, b) for t, n, a, b in kept)


def test_a_scan_equals_brute_force(make):
    """Texts with templates whole, changed by a seventh at most, cut off and doubled, between other words."""
    rng = random.Random(9)
    other = "the a of to code file and with this under terms license library you may use copy work free software".split()
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 3)):
            words += rng.choices(other, k=rng.randint(0, 25))
            own = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.randint(0, len(own) // 14)):
                own[rng.randrange(len(own))] = "changed"
            words += own[: rng.choice((len(own), len(own), len(own) // 2))]
        docs.append((i, " ".join([*words, *rng.choices(other, k=5)])))
    scanner = Scanner()
    seen = 0
    for r in scan(make(docs)).collect():
        text = docs[r.doc_id][1]
        at = {}
        place = [m.span() for m in __import__("re").finditer("[A-Za-z0-9]+", text)]
        for k, (a, b) in enumerate(place):
            at[a], at[-b] = k, k + 1
        got = sorted((m.license, m.matched_words, at[m.start], at[-m.end]) for m in r.licenses)
        assert got == brute(scanner, text), text
        seen += len(got)
    assert seen > 40


def test_equal_coverage_of_matches_that_overlap():
    """The longer match stays; of the same words, that of the template that comes first."""
    mine = (("one", "alpha beta gamma delta epsilon"), ("two", "alpha beta gamma delta epsilon"), ("three", "delta epsilon zeta eta theta iota kappa"))
    s = Scanner(mine)
    assert [m["license"] for m in s.scan("alpha beta gamma delta epsilon")] == ["one"]
    assert [m["license"] for m in s.scan("alpha beta gamma delta epsilon zeta eta theta iota kappa")] == ["three"]
