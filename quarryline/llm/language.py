"""Language identification by hierarchical discrimination.

A language family is predicted first, by one linear machine for each family, fitted by
least squares to all families at once; then one-versus-one linear support vector
machines separate the languages within it. Every machine sees hashed letter n-grams of
the whole text, as shares of all of the text's n-grams.

The machines are trained on a bounded sample of labelled texts: of each language the
per_language rows of least hash, max_examples in all but one of each language at
least. All languages are learned. Machines grow with the number of languages, 64 KB
for each family and each pair within one, so more than max_languages are an error.
Prediction reads the text only.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

#: Families of languages, by ISO 639-1 code. A language in none is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
UNDETERMINED = "und"
BITS, ORDERS = 14, (1, 2, 3)
#: Share vectors are short; this brings their margins to the order of one.
SCALE = 30.0
BLOCK_CHARS = 1 << 20


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def _letters() -> np.ndarray:
    """For each code point of the basic plane: its lower case if it is a letter, else a space."""
    out = np.full(65_536, 32, np.uint32)
    for c in range(65_536):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@dataclass
class Machine:
    """w . x + b > 0 speaks for `yes`, else for `no`."""

    yes: str
    no: str
    w: np.ndarray
    b: float


class Grams:
    """Hashed n-grams of letters; all that is no letter is one space between words."""

    def __init__(self, bits: int = BITS, orders: tuple[int, ...] = ORDERS):
        self.bits, self.orders, self.table = bits, orders, _letters()

    def of(self, texts: list[str]):
        """For each order, hashes by position; where each text starts, and how many n-grams it has.

        A text counts with one space at its end; more spaces before the next text keep
        its n-grams from reaching into it, and are left out.
        """
        gap = max(self.orders)
        pad = "\n" * gap
        code = np.frombuffer(pad.join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(length + gap) - length - gap
        x = np.where(code < 65_536, self.table[np.minimum(code, 65_535)], code)
        out, h = [], np.zeros(len(x), np.uint32)
        for n in range(1, max(self.orders) + 1):
            h = h * np.uint32(0x01000193) + np.roll(x, 1 - n) if n > 1 else x * np.uint32(0x9E3779B1)
            if n in self.orders:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
                out.append((mixed >> np.uint32(32 - self.bits)).astype(np.int32))
        return out, starts, length + 1

    def shares(self, texts: list[str]) -> np.ndarray:
        """Vectors of one row for each text."""
        out = np.zeros((len(texts), 1 << self.bits), np.float32)
        for i, t in enumerate(texts):
            for h in self.of([t])[0]:
                out[i] += np.bincount(h[: len(t) + 1], minlength=1 << self.bits)
            out[i] *= SCALE / out[i].sum()
        return out

    def margins(self, hashed, weights: np.ndarray) -> np.ndarray:
        """weights (machines x hashes) applied to the shares of each text that `of` hashed, without making the vectors."""
        hashes, starts, length = hashed
        bounds = np.column_stack([starts, starts + length]).ravel()
        out = np.zeros((len(weights), len(starts)))
        for h in hashes:
            for k, w in enumerate(weights):
                out[k] += np.add.reduceat(w[h], bounds)[::2]
        return out * (SCALE / (len(hashes) * length))


def fit(x: np.ndarray, rows: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """A linear support vector machine on x[rows], by dual coordinate descent; y is 1 or -1."""
    rng, n = np.random.default_rng(seed), len(y)
    w, b, a = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(n)
    norm = np.array([float(x[i] @ x[i]) for i in rows]) + 1.0
    for _ in range(rounds):
        for i in rng.permutation(n):
            g = y[i] * (float(x[rows[i]] @ w) + b) - 1
            new = min(max(a[i] - g / norm[i], 0.0), c)
            if new != a[i]:
                step = np.float32((new - a[i]) * y[i])
                w += step * x[rows[i]]
                b += float(step)
                a[i] = new
    return w, b


def fit_families(x: np.ndarray, of: np.ndarray, names: list[str], ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """A linear machine for each name, one against the rest, by least squares in the space of examples; weights and offsets."""
    gram = (x @ x.T).astype(np.float64) + 1.0
    gram[np.diag_indices_from(gram)] += ridge * np.trace(gram) / len(gram)
    a = np.linalg.solve(gram, np.where(of[:, None] == np.array(names, object)[None, :], 1.0, -1.0))
    return (x.T @ a.astype(np.float32)).T.copy(), a.sum(0)


class Identifier:
    def __init__(self, examples: list[tuple[str, str]]):
        """examples: texts and their languages."""
        self.grams = Grams()
        self.langs = sorted({lang for _, lang in examples})
        self.families = sorted({family_of(x) for x in self.langs})
        self.within = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        self.first = (np.zeros((0, 1 << self.grams.bits), np.float32), np.zeros(0))
        self.machines: dict[str, list[Machine]] = {f: [] for f in self.families}
        if examples:
            x = self.grams.shares([t for t, _ in examples])
            lang = np.array([v for _, v in examples], object)
            if len(self.families) > 1:
                self.first = fit_families(x, np.array([family_of(v) for _, v in examples], object), self.families)
            for f, own in self.within.items():
                for a, b in combinations(own, 2):
                    rows = np.nonzero((lang == a) | (lang == b))[0]
                    self.machines[f].append(Machine(a, b, *fit(x, rows, np.where(lang[rows] == a, 1.0, -1.0))))

    @property
    def n_bytes(self) -> int:
        return self.first[0].nbytes + sum(m.w.nbytes for own in self.machines.values() for m in own)

    def _vote(self, names: list[str], margin: dict) -> tuple[str, float]:
        """Most votes, then largest sum of margins, then name; and how sure the closest duel was, 0.5 to 1."""
        if len(names) == 1:
            return names[0], 1.0
        votes, total, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for a, b in combinations(names, 2):
            m = margin[a, b]
            votes[a if m > 0 else b] += 1
            total[a], total[b] = total[a] + m, total[b] - m
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = min(names, key=lambda v: (-votes[v], -total[v], v))
        return best, _sure(least[best])

    def _families(self, hashed) -> list[tuple[str, float]]:
        """For each text the family of the largest margin, the first of equals, and how sure the distance to the next is."""
        n = len(hashed[1])
        if len(self.families) == 1:
            return [(self.families[0], 1.0)] * n
        m = self.grams.margins(hashed, self.first[0]) + self.first[1][:, None]
        best = m.argmax(0)
        top = np.sort(m, axis=0)
        return [(self.families[k], _sure(d)) for k, d in zip(best.tolist(), (top[-1] - top[-2]).tolist(), strict=True)]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """A language and a score from 0 to 1 for each text; `und` and 0 for null, and for texts without a letter."""
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not self.langs:
            return out
        a = size = 0
        for k, i in enumerate(rows):
            size += len(texts[i])
            if size >= BLOCK_CHARS or k == len(rows) - 1:
                own = rows[a : k + 1]
                hashed = self.grams.of([texts[j] for j in own])
                families = self._families(hashed)
                for f in sorted({f for f, _ in families}):
                    machines = self.machines[f]
                    m = self.grams.margins(hashed, [x.w for x in machines])
                    for n, j in enumerate(own):
                        if families[n][0] == f:
                            lang, more = self._vote(self.within[f], {(x.yes, x.no): float(m[q, n]) + x.b for q, x in enumerate(machines)})
                            out[j] = (lang, families[n][1] * more)
                a, size = k + 1, 0
        return out


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-2 * max(0.0, min(margin, 30.0)))))


def sample(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, max_examples: int = 3_000, max_languages: int = 1_000, max_chars: int = 48_000_000) -> list[tuple[str, str]]:
    """Whole texts and languages to learn from, within the bounds named; of each language
    the first row, and more as long as its share of max_chars holds them.

    The rows are chosen by a hash of their ids, which reads no texts; those without a
    letter teach nothing. A language's rows are first cut to the share of hashes that
    holds four times as many as are asked for, so that no task ranks a whole language.
    More than max_languages different languages are an error, and none is left out.
    """
    known = docs.filter(may_learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(id_col), F.lit(1 << 31)).alias("h"), F.col(text_col).alias("text"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()
    if not counts:
        return []
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages, or is {lang_col} no language?")
    k = max(1, min(per_language, max_examples // len(counts)))
    cuts = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, min(1 << 31, 1 + ((4 * k << 31) // r.n))) for r in counts], "lang string, cut long"))
    first = lambda rows, *by: rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("k") <= k)
    picked = first(known.select("lang", "h").join(cuts, "lang").filter(F.col("h") < F.col("cut")), "h").select("lang", "h").distinct()
    texts = first(known.join(F.broadcast(picked), ["lang", "h"]).select("lang", "h", "text"), "h", "text")
    upto = F.sum(F.char_length("text")).over(Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    texts = texts.withColumn("chars", upto).filter((F.col("k") == 1) | (F.coalesce("chars", F.lit(0)) <= max_chars // len(counts)))
    return [(r.text, r.lang) for r in texts.orderBy("lang", "k").select("text", "lang").collect() if r.text and any(map(str.isalpha, r.text))]


def identify(docs: DataFrame, examples: list[tuple[str, str]], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), max_bytes: int = 128 << 20) -> DataFrame:
    """The columns `keep` of docs, lang_pred and score, a row for each row of docs.

    Null texts and texts without a letter are `und` with score 0. Of families with
    equal margins the first in order counts; a text that lies on the boundary of two
    languages goes to the second in order. Without examples all is `und`. Other columns
    are ignored. The machines are broadcast if they take no more than max_bytes; more
    are an error.
    """
    model = Identifier(examples)
    if model.n_bytes > max_bytes:
        raise ValueError(f"the machines of {len(model.langs)} languages take {model.n_bytes} bytes, more than {max_bytes}")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for b in slices(batches, 0):
            found = sent.value.predict(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    return docs.select(F.col(text_col).alias("text "), *[F.col(k) for k in keep]).mapInArrow(scan, ", ".join([*kinds, "lang_pred string, score double"]))
