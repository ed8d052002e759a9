"""Quality rules: a learned decision list over text statistics.

Text statistics are computed once for each document with DataFrame functions. The
list is learned by sequential covering from counts of the labelled documents over
binned statistics: a rule grows on two thirds of them, condition by condition, by
information gain, is pruned on the other third, and what it covers is taken out
before the next one grows. The list is emitted as one ordered CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, durable, let

#: Percentiles of the documents to keep and of those to drop; thresholds lie half-way
#: between neighbours among them, so that a rule leaves a margin to both sides.
KEEP_AT, DROP_AT = (0.0, 0.01, 0.5, 0.99, 1.0), (0.01, 0.1, 0.25, 0.5)


#: What the rules test: one statistic per another, times a scale. With these five and
#: eight thresholds each, the counts that reach the driver have at most 9 ** 5 cells
#: for each label and side.
FEATURES = {
    "symbols_per_100_words": ("n_symbols", "n_words", 100.0),
    "repeated_words_pct": ("n_repeat_words", "n_words", 100.0),
    "repeated_lines_pct": ("n_dup_lines", "n_lines", 100.0),
    "chars_per_word": ("word_chars", "n_words", 1.0),
    "capitals_pct": ("n_capitals", "word_chars", 100.0),
}


def feature(name: str) -> Column:
    a, b, scale = FEATURES[name]
    return F.when(F.col(b) > 0, scale * F.col(a) / F.col(b)).otherwise(0.0).alias(name)


def repeated_words(words: Column, n: int) -> Column:
    """Words inside windows of n words that occur twice or more, the first occurrence included."""

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - x, F.lit(n)))), F.lit(0).cast("long"), lambda s, x: s + x)

    def twins(pairs: Column) -> Column:
        same = F.filter(pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, twins)).otherwise(F.lit(0).cast("long"))

    hashes = F.when(F.size(words) > n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))
    return let(hashes, count)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 5) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals), whole texts; null: none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = let(F.array_remove(F.split(text, SPACE + "+"), ""), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w, window).alias("repeated")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("repeated")))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return docs.select(
        F.col(id_col).alias("id"), words.alias("w"), lines.alias("x"), (F.char_length(text) - count(SPACE)).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"), count("[A-Z]").alias("n_capitals"),
    ).select("id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("x.n").alias("n_lines"), F.col("x.repeated").alias("n_dup_lines"), F.col("w.repeated").alias("n_repeat_words"), "n_capitals")


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def thresholds(labelled: DataFrame, label: str) -> dict[str, list[float]]:
    ask = [F.percentile_approx(F.when(F.col(label) == side, F.col(f)), list(at), 10_000).alias(f"{f}_{side}") for f in FEATURES for side, at in ((1, KEEP_AT), (0, DROP_AT))]
    found = labelled.agg(*ask).first()
    values = {f: sorted({float(x) for side in (0, 1) for x in found[f"{f}_{side}"] or ()}) for f in FEATURES}
    return {f: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for f, v in values.items()}


def learn(labelled: DataFrame, label: str = "label", min_precision: float = 0.9, min_covered: int = 5, max_rules: int = 12, max_tests: int = 4) -> list[tuple[Test, ...]]:
    """Rules, in order, each a conjunction of tests on FEATURES that says: drop.

    labelled has id, the columns of FEATURES and a label of 1 (keep) or 0 (drop). All
    of its rows count. A rule stays if, on the third of the documents that it was
    pruned on, it is right min_precision of the time and covers min_covered of them.
    """
    cuts = thresholds(labelled, label)
    side = (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("prune")
    bins = [sum(((F.col(f) > t).cast("int") for t in cuts[f]), F.lit(0)).alias(f) for f in FEATURES]  # bin k: above k thresholds
    cells = [(r["prune"], tuple(r[f] for f in FEATURES), r[label], r["n"]) for r in labelled.select(side, *bins, F.col(label)).groupBy("prune", *FEATURES, label).agg(F.count("*").alias("n")).collect()]
    order = {f: k for k, f in enumerate(FEATURES)}
    place = {f: {t: k for k, t in enumerate(cuts[f])} for f in FEATURES}
    tests = [Test(f, above, t) for f in FEATURES for t in cuts[f] for above in (True, False)]

    def holds(test: Test, cell) -> bool:
        return (cell[1][order[test.feature]] > place[test.feature][test.threshold]) == test.above

    def tally(rule, cells) -> tuple[int, int]:
        right = wrong = 0
        for c in cells:
            if all(holds(t, c) for t in rule):
                right, wrong = right + c[3] * (c[2] == 0), wrong + c[3] * (c[2] != 0)
        return right, wrong

    def grow(cells) -> tuple[Test, ...]:
        rule: tuple[Test, ...] = ()
        inside = cells
        while len(rule) < max_tests:
            p, n = tally((), inside)
            if not p or not n:
                break
            gains = []
            for k, t in enumerate(tests):
                a, b = tally((t,), inside)
                if a:
                    gains.append((a * (log2(a / (a + b)) - log2(p / (p + n))), -k))
            best, k = max(gains, default=(0, 0))
            if best <= 1e-9:
                break
            rule += (tests[-k],)
            inside = [c for c in inside if holds(tests[-k], c)]
        return rule

    def worth(rule, cells) -> float:
        p, n = tally(rule, cells)
        return (p - n) / (p + n) if p + n else -1.0

    rules = []
    while len(rules) < max_rules:
        growing, pruning = [c for c in cells if not c[0]], [c for c in cells if c[0]]
        rule = grow(growing)
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: worth(r, pruning))
        p, n = tally(rule, pruning)
        if p + n < min_covered or p < min_precision * (p + n):
            break
        rules.append(rule)
        cells = [c for c in cells if not all(holds(t, c) for t in rule)]
    return rules


def verdict(rules: list[tuple[Test, ...]]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds, from 1, or null."""
    out = F
    for k, rule in enumerate(rules, 1):
        condition = rule[0].column()
        for t in rule[1:]:
            condition = condition & t.column()
        out = out.when(condition, F.lit(k))
    return F.lit(None).cast("int") if out is F else out.otherwise(F.lit(None).cast("int"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", min_words: int = 10, max_repeat_pct: int = 20) -> DataFrame:
    """A row for each row of docs: id_col, the base statistics, base_failed, rule (the first that drops it) and kept.

    A null text is empty and fails the base. Labels other than 0 and 1, null ids and
    labels of unknown documents teach nothing; a document labelled twice counts twice.
    Without labels the list is empty, and the base decides alone. Other columns are ignored.
    """
    stats = durable(statistics(docs, id_col, text_col)).select("*", *map(feature, FEATURES))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("label").isin(0, 1))
    rules = learn(stats.join(known, "id"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return stats.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), verdict(rules).alias("rule"),
    ).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
