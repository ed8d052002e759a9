"""Personal data by a semi-Markov conditional random field.

Base spans come from four fixed patterns. The field adds spans that they miss: it
scores whole candidate segments by features of the span (its shape, digits, checks,
neighbours), with a weight for each pair of neighbouring labels, and a dynamic program
over segments of at most MAX_TOKENS tokens, of any length each, chooses boundaries and types together.

A segment that is an entity has a digit or an @ in it, all other tokens are single
segments of label O whose score and transitions are zero. So tokens further than an
entity's tokens from any such sign can only be O, and the program runs over the
regions around signs alone: the result is that of the whole text.

The field is trained here, by its likelihood, on sentences drawn from a seeded
generator; no document is read for it.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
MAX_TOKENS = 12

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_DIGITS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_CHUNK = re.compile(r"\S+")
_TOKEN = re.compile(r"[^\W_]+|_|[^\w\s]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Each @ ends the run of local characters before it; a run is read once, so no text takes quadratic time."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        past = m.end() if m else at + 1
        at = text.find("@", past)


def addresses(text: str):
    """Four dotted numbers at a time along each chain of them; a match with a part over 255 is dropped."""
    for m in _DOTTED.finditer(text):
        if "." not in m[0]:
            continue
        chain, at = [], m.start()
        for part in [*m[0].split("."), ""]:
            if part:
                chain.append((part, at))
                if len(chain) == 4:
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p, _ in chain):
                        yield chain[0][1], at + len(part)
                    chain = []
            else:
                chain = []
            at += len(part) + 1


def cards(text: str):
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield m.span()


_BASE = dict(zip(BASE_KINDS, (emails, addresses, cards, phones), strict=True))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start, in code points."""
    return [(k, a, b) for k, f in _BASE.items() for a, b in f(text)]


#: Openings of access tokens that their issuers publish; fixed values.
ISSUED = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "AKIA", "ASIA", "AIza", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "sk-", "sk_live_", "rk_live_", "hf_", "npm_", "pypi-")

#: Words before a value that tell what it is; fixed values.
CUES = {
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "apikey", "auth", "bearer"),
    "pass": ("password", "passwd", "pwd", "passwort", "passphrase"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefax", "mobil", "handy", "rufnummer", "telephone"),
    "digest": ("commit", "md5", "sha", "sha1", "sha256", "hash", "checksum", "id", "uuid", "revision"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "ip": ("ip", "host", "server", "address"),
    "email": ("mail", "email", "e-mail", "contact"),
}
_SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\Z"),
    "quad": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}\Z"),
    "digits": re.compile(r"[0-9]+\Z"),
    "grouped": re.compile(r"[0-9]{4}(?:[ -][0-9]{4}){2,3}[ -]?[0-9]{0,4}\Z"),
    "national": re.compile(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}\Z"),
    "international": re.compile(r"\+[0-9][ ().0-9-]+[0-9]\Z"),
    "trunk": re.compile(r"\(?0[1-9][0-9]{1,4}\)?[ /-]{1,3}[0-9]{3,8}(?:[ -][0-9]{1,4}){0,2}\Z"),
    "pairs": re.compile(r"0[1-9](?:[ .-][0-9]{2}){4}\Z"),
    "hex": re.compile(r"[0-9a-fA-F]{24,}\Z"),
    "prefixed": re.compile(r"[A-Za-z]{2,6}[-_][A-Za-z0-9_-]{16,}\Z"),
    "mixed": re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]{16,}\Z"),
    "short mixed": re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]{8,15}\Z"),
    "base64": re.compile(r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])(?=.*[+/])[A-Za-z0-9+/]{24,}\Z"),
    "issued": re.compile(f"(?:{'|'.join(ISSUED)})(?=.*[0-9])[A-Za-z0-9_-]{{16,}}\\Z"),
    "signed": re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\Z"),
    "groups": re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z"),
    "date": re.compile(r"(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})\Z"),
    "decimal": re.compile(r"[0-9]{1,3}(?:[.,][0-9]+)+\Z"),
    "time": re.compile(r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\Z"),
}
FEATURES = (
    "bias", *(f"shape:{k}" for k in _SHAPES), "no shape", *(f"cue:{k}" for k in CUES), "after =", "quoted", "glued before", "glued after", "part of number", "cut short",
    "octets", "luhn", "digits:1-6", "digits:7-9", "digits:10-11", "digits:12-15", "digits:16-19", "digits:20+", "chars:20+", "spaces", "one token", "has @", "opens odd",
)
_F = {f: i for i, f in enumerate(FEATURES)}


def features(text: str, start: int, end: int, tokens: int, before: str) -> list[int]:
    """Features of a whole span; before: the last words before it, lower case."""
    s = text[start:end]
    out = ["bias"]
    shapes = [k for k, p in _SHAPES.items() if p.match(s)]
    out += [f"shape:{k}" for k in shapes] or ["no shape"]
    words = re.findall(r"[^\W_]+", before)[-2:]
    out += [f"cue:{k}" for k, cues in CUES.items() if any(w in cues for w in words)]
    left, right = text[start - 1 : start], text[end : end + 1]
    if before.rstrip(" \"'")[-1:] in ("=", ":"):
        out.append("after =")
    if left and left in "\"'" and right == left:
        out.append("quoted")
    if left.isalnum() or left in ("@", "_"):
        out.append("glued before")
    if right.isalnum() or right in ("@", "_"):
        out.append("glued after")
    two = text[max(0, start - 2) : start]
    if (two[-1:] in tuple(".,:/-") and two[:1].isdigit()) or (right and right in ".,:/-" and text[end + 1 : end + 2].isdigit()):
        out.append("part of number")
    if right and right in ".-@_" and text[end + 1 : end + 2].isalnum():
        out.append("cut short")
    d = _digits(s)
    if "shape:quad" in out and all(int(x) <= 255 for x in s.split(".")):
        out.append("octets")
    if 16 <= len(d) <= 19 and len(d) + s.count(" ") + s.count("-") == len(s) and luhn(d):
        out.append("luhn")
    n = len(d)
    out.append("digits:1-6" if n <= 6 else "digits:7-9" if n <= 9 else "digits:10-11" if n <= 11 else "digits:12-15" if n <= 15 else "digits:16-19" if n <= 19 else "digits:20+")
    if end - start >= 20:
        out.append("chars:20+")
    if " " in s:
        out.append("spaces")
    if tokens == 1:
        out.append("one token")
    if "@" in s:
        out.append("has @")
    if ("(" in s) != (")" in s):
        out.append("opens odd")
    return [_F[f] for f in out]


def segments(text: str, start: int, end: int):
    """Tokens of a region and its candidate entities: (first, past, features) by token."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    sign = [bool(_SIGN.search(text, a, b)) for a, b in tokens]
    cands = []
    for i, (a, _) in enumerate(tokens):
        c = text[a]
        if not (c.isalnum() or c in "+(") or not any(sign[i : i + MAX_TOKENS]):
            continue
        before, seen = text[max(0, a - 24) : a].lower(), False
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            p, b = tokens[j]
            if (j > i and "\n" in text[tokens[j - 1][1] : p]) or p - tokens[max(j - 1, i)][1] > 1:
                break
            seen |= sign[j]
            if seen and (text[b - 1].isalnum() or text[b - 1] == ")"):
                cands.append((i, j + 1, features(text, a, b, j + 1 - i, before)))
    return tokens, cands


class Field:
    """Labels: 0 is O, k is KINDS[k - 1]."""

    def __init__(self):
        self.n = len(KINDS) + 1
        self.weights = np.zeros((len(FEATURES), self.n - 1))
        self.moves = np.zeros((self.n, self.n))  # moves[0, 0] stays zero

    def _scores(self, cands) -> list[tuple[int, int, np.ndarray]]:
        return [(i, j, self.weights[f].sum(0)) for i, j, f in cands]

    def decode(self, text: str, start: int, end: int) -> list[tuple[str, int, int]]:
        tokens, cands = segments(text, start, end)
        if not cands:
            return []
        by_end: dict[int, list] = {}
        for i, j, s in self._scores(cands):
            by_end.setdefault(j, []).append((i, s))
        n = len(tokens)
        best, back = np.full((n + 1, self.n), -np.inf), {}
        best[0, 0] = 0
        for j in range(1, n + 1):
            into = best[j - 1] + self.moves[:, 0]
            k = int(into.argmax())
            best[j, 0], back[j, 0] = into[k], (j - 1, k)
            for i, s in by_end.get(j, ()):
                into = best[i][:, None] + self.moves[:, 1:]
                k = into.argmax(0)
                value = into[k, np.arange(self.n - 1)] + s
                for y in np.nonzero(value > best[j, 1:])[0]:
                    best[j, y + 1], back[j, int(y) + 1] = value[y], (i, int(k[y]))
        out, j, y = [], n, int(best[n].argmax())
        while j:
            i, before = back[j, y]
            if y:
                out.append((KINDS[y - 1], tokens[i][0], tokens[j - 1][1]))
            j, y = i, before
        return out[::-1]

    def step(self, text: str, gold: list[tuple[str, int, int]], rate: float, memory) -> float:
        """One ascent of the log likelihood of gold spans, by AdaGrad; returns the log likelihood."""
        tokens, cands = segments(text, 0, len(text))
        n, scored = len(tokens), self._scores(cands)
        at, to = {a: k for k, (a, _) in enumerate(tokens)}, {b: k + 1 for k, (_, b) in enumerate(tokens)}
        truth = {(at[a], to[b]): KINDS.index(k) + 1 for k, a, b in gold}
        ends: dict[int, list] = {}
        for q, (i, j, s) in enumerate(scored):
            ends.setdefault(j, []).append((i, s, q))
        alpha = np.full((n + 1, self.n), -np.inf)
        alpha[0, 0] = 0
        for j in range(1, n + 1):
            alpha[j, 0] = np.logaddexp.reduce(alpha[j - 1] + self.moves[:, 0])
            for i, s, _ in ends.get(j, ()):
                alpha[j, 1:] = np.logaddexp(alpha[j, 1:], np.logaddexp.reduce(alpha[i][:, None] + self.moves[:, 1:], axis=0) + s)
        total = np.logaddexp.reduce(alpha[n])
        beta = np.full((n + 1, self.n), -np.inf)
        beta[n] = 0
        starts: dict[int, list] = {}
        for q, (i, j, s) in enumerate(scored):
            starts.setdefault(i, []).append((j, s, q))
        grad_w, grad_m = np.zeros_like(self.weights), np.zeros_like(self.moves)
        for i in range(n - 1, -1, -1):
            one = self.moves[:, 0] + beta[i + 1, 0]
            beta[i] = one
            grad_m[:, 0] -= np.exp(alpha[i] + one - total)
            for j, s, q in starts.get(i, ()):
                own = self.moves[:, 1:] + s + beta[j, 1:]
                beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(own, axis=1))
                p = np.exp(alpha[i][:, None] + own - total)
                grad_m[:, 1:] -= p
                grad_w[cands[q][2]] -= p.sum(0)
        score, i, y = 0.0, 0, 0
        lookup = {(a, b): k for k, (a, b, _) in enumerate(cands)}
        stop = {a: (b, k) for (a, b), k in truth.items()}
        while i < n:
            j, k = stop.get(i, (i + 1, 0))
            score += self.moves[y, k]
            grad_m[y, k] += 1
            if k:
                q = lookup[i, j]
                score += scored[q][2][k - 1]
                grad_w[cands[q][2], k - 1] += 1
            i, y = j, k
        grad_m[0, 0] = 0
        for value, grad, seen, shrink in ((self.weights, grad_w, memory[0], 1e-3), (self.moves, grad_m, memory[1], 1e-3)):
            grad = grad - shrink * value
            seen += grad * grad
            value += rate * grad / np.sqrt(seen + 1e-8)
        self.moves[0, 0] = 0
        return score - total


def example(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence of invented words with values of all kinds and look-alikes that are none."""
    vowels, rest = "aeiouéüó", "bcdfghklmnprstvwzñß"
    word = lambda: "".join(rng.choice(rest) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(valid: bool) -> str:
        n = rng.choice((16, 16, 16, 19))
        while True:
            d = number(n)
            if luhn(d) == valid:
                break
        return rng.choice((d, d, " ".join(d[i : i + 4] for i in range(0, n, 4)), "-".join(d[i : i + 4] for i in range(0, n, 4))))

    def letters(n: int) -> str:
        """A run of n letters and digits with a digit in it."""
        at = rng.randrange(n)
        return "".join(rng.choice("0123456789") if i == at else rng.choice(string.ascii_letters + string.digits) for i in range(n))

    def hexadecimal(n: int) -> str:
        return "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "7a"

    def groups() -> str:
        return "-".join(hexadecimal(n) for n in (8, 4, 4, 4, 12))

    def value() -> tuple[str, str, str]:
        pick = rng.randrange(28)
        if pick < 2:
            return "email", rng.choice(("", "", "email ", "contact: ")), f"{word().encode('ascii', 'ignore').decode() or 'a'}{rng.choice(('.', '_', ''))}{number(2)}@{rng.choice(('mail', 'post', 'box'))}{rng.choice('0123456789')}.example.{rng.choice(('com', 'org', 'net'))}"
        if pick < 4:
            return "ip", rng.choice(("", "", "ip ", "host ")), ".".join(str(rng.randrange(256)) for _ in range(4))
        if pick < 6:
            return "card", rng.choice(("", "", "card ", "visa: ")), card(True)
        if pick < 8:
            a, b, c = number(3), number(3), number(4)
            return "phone", rng.choice(("", "phone ", "call ", "tel: ")), rng.choice((f"+1 ({a}) {b}-{c}", f"+{number(2)} {number(3)} {number(7)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"))
        if pick < 10:
            pairs = rng.choice(" .-").join([f"0{rng.randint(1, 9)}", *(number(2) for _ in range(4))])
            own = f"0{rng.randint(1, 9)}{number(rng.randint(1, 3))}"
            return "phone", rng.choice(("Telefon: ", "Tel. ", "tel: ", "Mobil ", "Fax ", "phone ")), rng.choice((pairs, f"{own} {number(rng.randint(5, 8))}", f"{own}/{number(rng.randint(5, 8))}", f"({own}) {number(4)} {number(3)}", f"{own}-{number(6)}"))
        if pick < 13:
            long = hexadecimal(rng.choice((32, 40, 40, 64)))
            long = rng.choice((long, long, long.upper(), letters(rng.randint(20, 44)), letters(rng.randint(20, 44)), f"sk-{long[:28]}9f", groups()))
            return "secret", rng.choice(('token = "', 'TOKEN = "', "api_key: ", "secret=", "password = '", 'key = "', "Bearer ", "Authorization: Bearer ", "client_secret=")), long
        if pick < 15:
            return "secret", rng.choice(("", "", "token: ", "key = ")), rng.choice(ISSUED) + letters(rng.randint(16, 40))
        if pick < 16:
            return "secret", rng.choice(("password: ", "password = '", "passwd=", "pwd: ", "Passwort: ")), letters(rng.randint(8, 15))
        if pick < 17:
            return "secret", rng.choice(("secret_access_key = ", 'key = "', "token: ")), rng.choice("+/").join(letters(rng.randint(7, 15)) for _ in range(rng.randint(2, 4)))
        if pick < 18:
            return "secret", rng.choice(("", "Bearer ", "token=")), f"eyJ{letters(rng.randint(12, 24))}.{letters(rng.randint(20, 40))}.{letters(rng.randint(20, 43))}"
        look = (number(4), f"{number(1)}.{number(1)}", f"19{number(2)}-0{rng.randint(1, 9)}-1{number(1)}", f"{rng.randint(10, 23)}:{number(2)}", card(False), f"{number(1)},{number(3)}.{number(2)}", number(rng.randint(1, 12)), f"{number(1)}.{number(1)}.{number(1)}", f"src{number(2)}", ".".join(str(rng.randint(256, 999)) for _ in range(4)), f"@{word()}", word() + number(3))
        plain = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 10)))
        joined = rng.choice("_-").join(rng.choice((plain(), plain(), f"{plain()}{number(rng.randint(1, 2))}", f"v{number(1)}")) for _ in range(rng.randint(2, 5)))
        row = " ".join((f"0{number(1)}", *(number(2) for _ in range(rng.randint(2, 6)))))
        image = f"data:image/png;base64,{letters(rng.randint(10, 20))}/{letters(rng.randint(10, 20))}+{letters(rng.randint(4, 9))}"
        bare = rng.choice((hexadecimal(32), hexadecimal(40), hexadecimal(64), groups(), letters(rng.randint(8, 24)), f"0{number(2)} {number(5)}", row, row, joined, joined, joined, image, f"docs/{number(4)}/{word()}{number(1)}/{letters(12)}"))
        return "", *rng.choice(((rng.choice(("", "", "version ", "page ", "no. ")), rng.choice(look)), (rng.choice(("", "", "", "commit ", "id: ", "md5: ", "sha256 ", "file ", "name = ")), bare), (rng.choice(("", "key ", "token ", "password ", "call ", "phone ")), rng.choice(look[:4]))))

    text, gold = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(1, 5))) + rng.choice((" ", " ", ", ", ". ", ".\n"))
        kind, cue, v = value()
        text += cue
        if kind:
            gold.append((kind, len(text), len(text) + len(v)))
        text += v
        if cue[-1:] in "\"'" and cue:
            text += cue[-1]
        text += rng.choice((" ", ". ", ", ", "\n", "*** ", "!! "))
    return text + word(), gold


def train(sentences: int = 600, rounds: int = 4, rate: float = 0.5, seed: int = 11) -> Field:
    rng, field = random.Random(seed), Field()
    data = [example(rng) for _ in range(sentences)]
    memory = (np.zeros_like(field.weights), np.zeros_like(field.moves))
    for _ in range(rounds):
        for text, gold in data:
            field.step(text, gold, rate, memory)
    return field


def regions(text: str, reach: int = MAX_TOKENS):
    """Stretches of text within reach of a digit or @: so many words to both sides, each of one token or more, whole."""
    if not _SIGN.search(text):
        return
    chunks = [m.span() for m in _CHUNK.finditer(text)]
    k, first, past = 0, -1, -1
    for m in _SIGN.finditer(text):
        if first >= 0 and m.start() < chunks[k][1]:  # in the word of the sign before it
            continue
        k = bisect_right(chunks, (m.start(), len(text)), k) - 1
        if first < 0 or k - reach > past:
            if first >= 0:
                yield chunks[first][0], chunks[past][1]
            first = max(0, k - reach)
        past = min(len(chunks) - 1, k + reach)
    yield chunks[first][0], chunks[past][1]


def find(text: str | None, field: Field | None) -> tuple[list, list]:
    """Base spans, and all spans: those and what the field adds beside them, by kind and start."""
    if not text:
        return [], []
    base = base_spans(text)
    added = [s for a, b in regions(text) for s in field.decode(text, a, b)] if field else []
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts
    free = []
    for s in added:
        k = int(np.searchsorted(starts, s[2]))  # spans that start before its end
        if not k or reach[k - 1] <= s[1]:
            free.append(s)
    return base, sorted(base + free, key=lambda s: (KINDS.index(s[0]), s[1]))


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None, spans) -> str | None:
    """Each span replaced by its kind in brackets; where spans overlap, their union by the kind of the first."""
    if not text:
        return text
    out, past = [], 0
    runs: list[list] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if runs and a < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], b)
        else:
            runs.append([k, a, b])
    for k, a, b in runs:
        out += [text[past:a], f"[{k.upper()}]"]
        past = b
    return "".join([*out, text[past:]])


def detect(docs: DataFrame, field: Field, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """The columns `keep` of docs, n_email, n_ip, n_card, n_phone (base spans), base_sha256,
    spans (all, as kind:start:end by kind and start) and, on wish, redacted (the text without them).

    A null text is empty and has no spans; its redacted text is null. Offsets are code
    points. Rows, repeated ones too, come back one each; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def scan(batches):
        for b in slices(batches, 0):
            texts = b.column(0).to_pylist()
            found = [find(t, sent.value) for t in texts]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE_KINDS]
            digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found])
            more = [pa.array([redacted(t, every) for t, (_, every) in zip(texts, found, strict=True)], pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *counts, digest, pa.array([written(every) for _, every in found]), *more], names=names)

    names = [*keep, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", *["redacted"] * with_text]
    kinds = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + [f"n_{k} long" for k in BASE_KINDS] + ["base_sha256 string", "spans string"] + ["redacted string"] * with_text
    return docs.select(F.col(text_col).alias("text "), *[F.col(k) for k in keep]).mapInArrow(scan, ", ".join(kinds))
