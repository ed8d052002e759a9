"""Score normalisation and fusion. NaN counts as missing: Spark would rank it first."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .text import col, let


def present(score) -> Column:
    return F.when(~F.isnan(col(score).cast("double")), col(score).cast("double"))


def softmax(score, group, temperature: float = 1.0) -> Column:
    """exp(x / T) over its sum in the group; T of zero or less counts as 1; if the sum is no use, 1 / n."""
    t = temperature if temperature > 0 else 1.0
    w = Window.partitionBy(*([group] if isinstance(group, str) else group))
    x = present(score) / t
    e = F.exp(x - F.max(x).over(w))
    s = F.sum(e).over(w)
    return F.when((s > 0) & ~F.isnan(s), e / s).otherwise(1.0 / F.count(F.lit(1)).over(w))


def sigmoid(score, temperature: float = 1.0) -> Column:
    """A missing score counts as 0."""
    t = temperature if temperature > 0 else 1.0
    return 1.0 / (1.0 + F.exp(-F.coalesce(present(score), F.lit(0.0)) / t))


def weighted(first, second, first_weight: float, second_weight: float) -> Column:
    """Weights are scaled to sum to 1; if they sum to zero or less, both count one half. A missing second score is 0."""
    s = first_weight + second_weight
    a, b = (first_weight / s, second_weight / s) if s > 0 else (0.5, 0.5)
    return F.lit(a) * col(first) + F.lit(b) * F.coalesce(present(second), F.lit(0.0))


def minmax(score, group) -> Column:
    """0 to 1 in the group; 0 for all where all are equal."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group))
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (col(score) - low) / (high - low)).otherwise(0.0)


def strength(*scores) -> Column:
    """The first score there is, else 0."""
    return F.coalesce(*[present(s) for s in scores], F.lit(0.0))


def positive_logit(logits) -> Column:
    """The logit that speaks for a match: the only one, the second of two, the third of more."""
    n = F.size(col(logits))
    return F.get(col(logits), F.when(n == 1, F.lit(0)).when(n == 2, F.lit(1)).otherwise(F.lit(2)))


def rounded(score, places: int = 6) -> Column:
    """score at that many decimal places as SQL rounds: scaled, to the nearest whole number, ties away from zero, scaled back.

    Rounding the printed decimals instead, as Spark does, takes another side where the
    scaled value lies half-way, and loses the sign of a negative number that becomes zero.
    """
    scale = 10.0**places

    def one(x: Column) -> Column:
        r = F.round(F.abs(x) * scale, 0) / scale
        return F.when((x == 0) | ~(r < float("inf")), x).when(x < 0, -r).otherwise(r)

    return one(F.col(score)) if isinstance(score, str) else let(score, one)


def rounded_each(values, places: int = 6) -> Column:
    """An array of numbers, each rounded."""
    return F.transform(col(values), lambda x: rounded(x, places))
