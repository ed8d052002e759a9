"""Vector arithmetic as column expressions over arrays of double."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let


def doubles(v) -> Column:
    """float32 sums differ from engine to engine; doubles are exact enough to rank by."""
    return col(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def norm(v) -> Column:
    return F.sqrt(total(F.transform(col(v), lambda x: x * x)))


def cosine(a, b) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def l2_normalize(v) -> Column:
    """A vector of length one; a zero vector stays as it is."""

    def scaled(x: Column) -> Column:
        return let(norm(x), lambda n: F.transform(x, lambda y: F.when(n > 0, y / n).otherwise(y)))

    return let(col(v), scaled)


def fuse(query, description, description_text, alpha: float) -> Column:
    """alpha * query + (1 - alpha) * description where the description's text is not blank, else the query."""
    rest = float(1 - Decimal(repr(float(alpha))))  # 0.3 for 0.7 and not 0.30000000000000004
    mixed = F.zip_with(col(query), col(description), lambda q, d: F.lit(alpha) * q + F.lit(rest) * d)
    return F.when(F.coalesce(col(description_text), F.lit("")).rlike(r"(?U)\S"), mixed).otherwise(col(query))


def mean_pool(tokens, mask) -> Column:
    """The mean of the tokens that the mask keeps, normalised; tokens: array of vectors, mask: array of boolean."""
    kept = F.zip_with(col(tokens), col(mask), lambda t, m: F.transform(t, lambda x: F.when(m, x).otherwise(0.0)))
    zero = F.transform(F.get(col(tokens), F.lit(0)), lambda x: F.lit(0.0))
    sums = F.aggregate(kept, zero, lambda s, t: F.zip_with(s, t, lambda a, b: a + b))
    n = F.greatest(F.size(F.filter(col(mask), lambda m: m)).cast("double"), F.lit(1e-9))
    return l2_normalize(F.transform(sums, lambda x: x / n))


def _floor(score: Column) -> Column:
    """Scores of sections that are masked throughout."""
    return F.when(score.isNull() | F.isnan(score) | (score == F.lit(float("-inf"))), F.lit(-1e4)).otherwise(score)


def cls_max(query_tokens, cls) -> Column:
    """The largest product of the section's vector with a query token."""
    return _floor(F.array_max(F.transform(col(query_tokens), lambda q: dot(q, col(cls)))))


def _kept(section_tokens, mask) -> Column:
    pairs = F.arrays_zip(col(section_tokens).alias("t"), col(mask).alias("m"))
    return F.transform(F.filter(pairs, lambda p: p["m"]), lambda p: p["t"])


def maxsim(query_tokens, section_tokens, mask) -> Column:
    """For each query token the best section token, on average."""

    def over(kept: Column) -> Column:
        best = F.transform(col(query_tokens), lambda q: F.array_max(F.transform(kept, lambda t: dot(q, t))))
        return F.when(F.size(kept) > 0, total(best) / F.size(col(query_tokens)))

    return _floor(let(_kept(section_tokens, mask), over))


def logsumexp(query_tokens, section_tokens, mask) -> Column:
    """For each query token the logarithm of the mean of exponentials over section tokens, on average."""

    def one(products: Column) -> Column:
        return let(F.array_max(products), lambda m: m + F.log(total(F.transform(products, lambda x: F.exp(x - m)))) - F.log(F.size(products).cast("double")))

    def over(kept: Column) -> Column:
        each = F.transform(col(query_tokens), lambda q: let(F.transform(kept, lambda t: dot(q, t)), one))
        return F.when(F.size(kept) > 0, total(each) / F.size(col(query_tokens)))

    return _floor(let(_kept(section_tokens, mask), over))


def token_max(query_tokens, vector) -> Column:
    """The largest product of a vector with any of several query tokens: an image's score for a text."""
    return F.array_max(F.transform(col(query_tokens), lambda q: dot(q, col(vector))))


def first_tokens(tokens, mask, n: int = 32) -> tuple[Column, Column]:
    """The first n token vectors and their mask; fewer are filled up with zero vectors that the mask leaves out."""
    kept, seen = F.slice(col(tokens), 1, n), F.slice(col(mask), 1, n)
    none = F.transform(F.coalesce(F.get(col(tokens), F.lit(0)), F.array().cast("array<double>")), lambda x: F.lit(0.0))
    missing = F.greatest(n - F.size(kept), F.lit(0))
    return F.concat(kept, F.array_repeat(none, missing)), F.concat(seen, F.array_repeat(F.lit(False), missing))
