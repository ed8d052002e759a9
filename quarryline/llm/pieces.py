"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The vocabulary file is only read, never trained. Pieces of a Unigram model keep their
log scores. A BPE model has merge ranks in their place; they become log scores by
Zipf's law, -ln(rank) - ln(sum of 1/rank), so that earlier merges are likelier.

Usually no piece has a space marker after another character, nor a line end, so a best
path always breaks before a run of spaces and around a line end. Texts are cut there,
equal chunks of a batch are encoded once, and all of them in one pass of array
operations. With a model that has other pieces, or pieces of over 63 bytes, each text
is one chunk and is encoded by itself, which is slower.

Of a model's normaliser, the removal of extra spaces and the space before a text are
followed; a table that maps characters is not, and is an error.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks of more bytes are encoded one by one: array operations gain nothing there.
LONG_CHUNK = 256
_SPACES = re.compile(" +")
BATCH_BYTES = 3 << 18


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        i, out, shift = i + 1, out | (c & 127) << shift, shift + 7
        if c < 128:
            return out, i


def _fields(b: bytes):
    """(number, value) of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            if key & 7 == 2:
                n, i = _varint(b, i)
            else:
                n = 8 if key & 7 == 1 else 4
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], int, bool]:
    """Pieces (text, score, kind) in order of id, the model's type, and whether a space is put before a text."""
    pieces, kind, prefix = [], UNIGRAM, True
    for number, value in _fields(data):
        if number == 1:
            d = dict(_fields(value))
            pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            prefix = bool(dict(_fields(value)).get(3, 1))
    return pieces, kind, prefix


def extra_spaces_go(data: bytes) -> bool:
    """Whether the model's normaliser takes out spaces at the ends and repeated ones; one that maps characters is an error."""
    d = next((dict(_fields(value)) for number, value in _fields(data) if number == 3), {})
    if d.get(2):
        raise ValueError("the model maps characters before it encodes; that is not followed here")
    return bool(d.get(4, 1))


def log_scores(pieces: list[tuple[str, float, int]], kind: int) -> np.ndarray:
    """Log scores of all pieces. A piece that the user defined has 0 and so goes before others."""
    scores = np.array([s for _, s, _ in pieces], np.float64)
    if kind != UNIGRAM:
        normal = [i for i, p in enumerate(pieces) if p[2] == NORMAL]
        normal.sort(key=lambda i: (-scores[i], i))
        rank = np.arange(1, len(normal) + 1)
        scores[normal] = -np.log(rank) - np.log((1.0 / rank).sum())
    scores[[i for i, p in enumerate(pieces) if p[2] == USER]] = 0.0
    return scores.astype(np.float32)


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value: from state s, byte c leads to t = base[s] + c if check[t] == s; value[t] is a key's id or -1. The root is 0."""
    root: dict = {}
    for key, i in keys.items():
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = i
    base, check, value = [0] * 1024, [-1] * 1024, [-1] * 1024
    check[0], low, high, queue = 0, 1, 1, [(0, root)]

    def grow(n: int) -> None:
        if n > len(base):
            more = max(n, 2 * len(base)) - len(base)
            base.extend([0] * more), check.extend([-1] * more), value.extend([-1] * more)

    for state, node in queue:
        value[state] = node.get(-1, -1)
        children = sorted(c for c in node if c >= 0)
        if not children:
            continue
        while low < len(check) and check[low] != -1:
            low += 1
        at, tries = max(low, children[0] + 1), 0
        while True:
            grow(at + 257)
            b = at - children[0]
            if check[at] == -1 and all(check[b + c] == -1 for c in children):
                break
            at, tries = at + 1, tries + 1
            if tries == 256:  # dense here: go on where all is free
                at = max(at, high)
        base[state] = b
        for c in children:
            check[b + c] = state
            high = max(high, b + c + 1)
            queue.append((b + c, node[c]))
    grow(high + 257)
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


class Codec:
    """Encodes and decodes; made of arrays and so small enough to broadcast."""

    def __init__(self, data: bytes):
        pieces, kind, self.prefix = read_model(data)
        self.extra = extra_spaces_go(data)
        self.scores = log_scores(pieces, kind)
        keys, self.bytes_at = {}, np.full(256, -1, np.int32)
        self.narrow = self.cuts = True
        spelled = []
        for i, (text, _, what) in enumerate(pieces):
            spelled.append(b"")
            if what in (NORMAL, USER):
                spelled[-1] = text.replace(MARKER, " ").encode()
                self.narrow &= len(spelled[-1]) <= 63
                self.cuts &= b"\n" not in spelled[-1] and b" " not in spelled[-1].lstrip(b" ")
                keys.setdefault(spelled[-1], i)
            elif what == BYTE:
                spelled[-1] = bytes([int(text[3:5], 16)])
                self.bytes_at[spelled[-1][0]] = i
            elif what == UNKNOWN:
                self.unknown, spelled[-1] = i, " ⁇ ".encode()
        self.base, self.check, self.value = double_array(keys)
        self.floor = np.float32(min(self.scores[list(keys.values())]) - np.float32(UNKNOWN_PENALTY))
        self.spelled = b"".join(spelled)
        self.ends = np.cumsum([len(x) for x in spelled])
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[self.bytes_at[self.bytes_at >= 0]] = True

    def _chunk(self, chunk: bytes) -> list[int]:
        """Ids of one chunk, by the same path rule as _chunks."""
        n = len(chunk)
        best, back = [np.float32(-np.inf)] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = np.float32(0)
        base, check, value, scores = self.base, self.check, self.value, self.scores
        for i in range(n):
            if best[i] == -np.inf:
                continue
            c = chunk[i]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            s, single = 0, False
            for j in range(i, n):
                t = base[s] + chunk[j]
                if check[t] != s:
                    break
                s = t
                if value[s] >= 0:
                    single |= j + 1 - i == width
                    score = best[i] + scores[value[s]]
                    if score > best[j + 1]:
                        best[j + 1], back[j + 1] = score, (i, int(value[s]))
            if not single and best[i] + self.floor > best[i + width]:
                best[i + width], back[i + width] = best[i] + self.floor, (i, -1)
        out, i = [], n
        while i:
            start, piece = back[i]
            out.extend([piece] if piece >= 0 else self._unknown(chunk[start:i])[::-1])
            i = start
        return out[::-1]

    def _unknown(self, char: bytes) -> list[int]:
        return [int(self.bytes_at[c]) for c in char] if (self.bytes_at >= 0).all() else [self.unknown]

    def _chunks(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many chunks, one after the other, and how many each has. data: their bytes, one after the other."""
        total, n = len(data), len(starts)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ends = starts + sizes
        lead = (data & 0xC0) != 0x80
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))).astype(np.int8)
        rel = np.arange(total, dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
        stop = np.repeat(ends, sizes).astype(np.int32)
        pos = np.nonzero(lead)[0].astype(np.int32)
        state = np.zeros(len(pos), np.int32)
        single = np.zeros(total, bool)
        edges, depth = [], 0
        while len(pos):
            at = pos + depth
            t = self.base[state] + data[at]
            ok = self.check[t] == state
            pos, state = pos[ok], t[ok]
            depth += 1
            piece = self.value[state]
            hit = piece >= 0
            if hit.any():
                edges.append((depth, pos[hit], piece[hit]))
                single[pos[hit][width[pos[hit]] == depth]] = True
            more = pos + depth < stop[pos]
            pos, state = pos[more], state[more]
        lost = np.nonzero(lead & ~single)[0].astype(np.int32)
        for w in (1, 2, 3, 4):
            if len(at := lost[width[lost] == w]):
                edges.append((w, at, np.full(len(at), -1, np.int32)))
        depths = np.concatenate([np.full(len(p), d, np.int8) for d, p, _ in edges])
        froms, what = np.concatenate([p for _, p, _ in edges]), np.concatenate([i for _, _, i in edges])
        # Node k + chunk is the place before byte k: a chunk has a place more than bytes.
        shift = np.repeat(np.arange(n, dtype=np.int32), sizes)
        key = rel[froms].astype(np.int16) * np.int16(64) + depths  # below 256 * 64, as chunks and pieces are short
        by = np.argsort(key, kind="stable")
        key, froms, what, depths = key[by], froms[by], what[by], depths[by]
        node = froms + shift[froms]
        score = np.where(what >= 0, self.scores[what], self.floor).astype(np.float32)
        cuts = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]])
        best = np.full(total + n, -np.inf, np.float32)
        best[starts + np.arange(n)] = 0
        back, piece_of = np.zeros(total + n, np.int8), np.full(total + n, -1, np.int32)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # by start, then length; no place twice in a group
            d = depths[a]
            to = node[a:b] + d
            value = best[node[a:b]] + score[a:b]
            up = value > best[to]
            to = to[up]
            best[to], back[to], piece_of[to] = value[up], d, what[a:b][up]
        chunk = np.arange(n)
        at, first = ends + chunk, starts + chunk
        trail = []
        while len(chunk):
            trail.append((chunk, piece_of[at], at - back[at] - chunk, back[at]))
            at = at - back[at]
            more = at > first[chunk]
            chunk, at = chunk[more], at[more]
        steps = np.concatenate([np.full(len(x[0]), k, np.int32) for k, x in enumerate(trail)])
        of, piece, begin, length = (np.concatenate([x[k] for x in trail]) for k in range(4))
        by = np.lexsort((-steps, of))
        of, piece, begin, length = of[by], piece[by], begin[by], length[by].astype(np.int64)
        if (self.bytes_at >= 0).all():
            times = np.where(piece >= 0, 1, length)
            ids, k = np.repeat(piece, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            raw = ids < 0
            ids[raw] = self.bytes_at[data[(np.repeat(begin, times) + k)[raw]]]
            of = np.repeat(of, times)
        else:
            ids = np.where(piece >= 0, piece, self.unknown).astype(np.int32)
        return ids.astype(np.int32), np.bincount(of, minlength=n)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; null and empty texts have none."""
        lead = b" " if self.prefix else b""
        if self.extra:
            texts = [_SPACES.sub(" ", t).strip(" ") if t else t for t in texts]
        raw = [lead + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        size = np.array([len(x) for x in raw], np.int64)
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        space, line = data == 0x20, data == 0x0A
        cut = np.zeros(len(data), bool)
        cut[0] = True
        cut[1:] = ((space[1:] & ~space[:-1]) | line[1:] | line[:-1]) & self.cuts
        cut[(np.cumsum(size) - size)[size > 0]] = True
        starts = np.nonzero(cut)[0]
        offsets = np.append(starts, len(data))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined)]).dictionary_encode()
        kind = chunks.dictionary
        bounds = np.frombuffer(kind.buffers()[1], np.int64)[kind.offset : kind.offset + len(kind) + 1]
        body = np.frombuffer(kind.buffers()[2], np.uint8) if kind.buffers()[2] else np.zeros(0, np.uint8)
        sizes = np.diff(bounds)
        short = (sizes <= LONG_CHUNK) & self.narrow
        ids_of, n_of = [], np.zeros(len(kind), np.int64)
        keep = np.repeat(short, sizes)
        ids, n_of[short] = self._chunks(body[bounds[0] : bounds[-1]][keep], np.cumsum(sizes[short]) - sizes[short], sizes[short])
        ids_of.append(ids)
        place = np.zeros(len(kind), np.int64)
        place[short] = np.cumsum(n_of[short]) - n_of[short]
        used = len(ids)
        for k in np.nonzero(~short)[0]:
            own = np.array(self._chunk(body[bounds[k] : bounds[k + 1]].tobytes()), np.int32)
            ids_of.append(own)
            place[k], n_of[k] = used, len(own)
            used += len(own)
        ids, which = np.concatenate(ids_of), chunks.indices.to_numpy()
        times = n_of[which]
        stops = np.cumsum(times)
        index = np.arange(stops[-1]) + np.repeat(place[which] - (stops - times), times)
        doc = np.searchsorted(np.cumsum(size), starts, side="right")
        return ids[index], np.bincount(doc, weights=times, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids, counts of them each. Bytes that are no UTF-8 become U+FFFD; an id that the model does not have is an error."""
        if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < len(self.ends)):
            raise ValueError(f"ids from {ids.min()} to {ids.max()} of a model with {len(self.ends)} pieces")
        size = np.diff(self.ends, prepend=0)
        times = size[ids]
        stops = np.cumsum(times)
        index = np.arange(stops[-1] if len(stops) else 0) + np.repeat((self.ends - size)[ids] - (stops - times), times)
        joined = np.frombuffer(self.spelled, np.uint8)[index].tobytes()
        out, a = [], 0
        for b in np.append(0, stops)[np.cumsum(counts)].tolist():
            own = joined[a:b]
            out.append((own[1:] if self.prefix and own[:1] == b" " else own).decode("utf-8", "replace"))
            a = b
        return out


def default_model() -> str:
    """The public 32,000-piece model that comes with the tokenizer files, where they are installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def codec(path: str) -> Codec:
    with open(path, "rb") as f:  # on the driver; executors get the arrays
        return Codec(f.read())


def encode(docs: DataFrame, model: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs and ids, n_tokens, n_byte_tokens, round_trip (decoding gives the text back).

    A null text has null ids, no tokens and round_trip true; an empty text has no
    ids. U+2581 in a text is spelled in bytes, as the piece would mean a space. A
    model without byte pieces gives its unknown id instead, and then round_trip is
    false, as it is where the model takes extra spaces out. Other columns are ignored; rows, repeated ones too, come back one each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(codec(model))

    def scan(batches):
        c = sent.value
        for b in slices(batches, 0, BATCH_BYTES):
            texts = b.column(0).to_pylist()
            ids, counts = c.encode(texts)
            ends = np.cumsum(counts)
            bytes_before = np.append(0, np.cumsum(c.is_byte[ids]))
            back = c.decode(ids, counts)
            null = np.array([t is None for t in texts])
            offsets = pa.array(np.append(0, ends).astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(np.append(0, ends).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(counts), pa.array(bytes_before[ends] - bytes_before[ends - counts]), pa.array([(t or "") == x for t, x in zip(texts, back, strict=True)])],
                names=[*keep, "ids", "n_tokens", "n_byte_tokens", "round_trip"],
            )

    kinds = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    return docs.select(F.col(text_col).alias("text "), *keep).mapInArrow(scan, ", ".join([*kinds, "ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean"]))


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of encoded and text; null ids give a null text. Ids that the model does not have, null or negative ones too, are an error."""
    sent = encoded.sparkSession.sparkContext.broadcast(codec(model))

    def scan(batches):
        c = sent.value
        for b in batches:
            lists = b.column(0)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = c.decode(pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist(), strict=True)], pa.string())], names=[*keep, "text"])

    kinds = [f"`{k}` {encoded.schema[k].dataType.simpleString()}" for k in keep]
    return encoded.select(F.col(ids_col).alias("ids "), *keep).mapInArrow(scan, ", ".join([*kinds, "text string"]))
