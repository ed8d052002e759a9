"""Unigram encoding against enumeration, against the library, and round trips."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import pieces as P

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def data():
    with open(P.default_model(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def codec(data):
    return P.Codec(data)


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, wire, value):
    return varint(number << 3 | wire) + (varint(value) if wire == 0 else varint(len(value)) + value if wire == 2 else value)


def model(pieces, kind=P.UNIGRAM, byte_fallback=True, prefix=True, extra=False):
    """A model file of the given pieces (text, score, kind)."""
    out = b""
    for text, score, what in pieces:
        out += field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, what))
    out += field(2, 2, field(3, 0, kind) + field(35, 0, int(byte_fallback)))
    return out + field(3, 2, field(1, 2, b"identity") + field(3, 0, int(prefix)) + field(4, 0, int(extra)))


def small(byte_fallback=True):
    base = [("<unk>", 0.0, P.UNKNOWN), ("<s>", 0.0, P.CONTROL), ("</s>", 0.0, P.CONTROL)]
    if byte_fallback:
        base += [(f"<0x{i:02X}>", 0.0, P.BYTE) for i in range(256)]
    rng = random.Random(1)
    own = ["▁", "a", "b", "c", "ab", "abc", "bc", "▁a", "▁ab", "é", "aé", "cc", "▁▁", "bcc"]
    return base + [(p, -1.0 - rng.random() * 6 * (1 + (len(p) > 2)), P.NORMAL) for p in own]


def best_by_enumeration(c, pieces, text):
    """The score of the best segmentation of a short text, by trying all."""
    table = {t.replace("▁", " "): float(s) for (t, _, k), s in zip(pieces, c.scores) if k == P.NORMAL}
    x = " " + text

    def go(i):
        if i == len(x):
            return 0.0
        own = [table[x[i:j]] + go(j) for j in range(i + 1, min(len(x), i + 6) + 1) if x[i:j] in table]
        if x[i] not in table:
            own.append(float(c.floor) + go(i + 1))
        return max(own)

    return go(0)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcé x\n", min_size=1, max_size=9))
def test_viterbi_finds_the_best_path(text):
    pieces = small()
    c = P.Codec(model(pieces))
    ids, counts = c.encode([text])
    score, unknown = 0.0, 0
    i = 0
    while i < len(ids):  # a run of bytes of one character is one unknown piece
        if c.is_byte[ids[i]]:
            lead = bytes([int(pieces[ids[i]][0][3:5], 16)])[0]
            i += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3
            score += float(c.floor)
            unknown += 1
        else:
            score += float(c.scores[ids[i]])
            i += 1
    assert score == pytest.approx(best_by_enumeration(c, pieces, text), abs=1e-4)
    assert c.decode(ids, counts) == [text]
    assert c._chunk(b"ab abc"[:2]) == c._chunks(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2]))[0].tolist()


def test_equals_the_library(codec, data, spark):
    """The library with the same pieces and log scores as a Unigram model; paths may differ only where their scores tie."""
    pieces, _, _ = P.read_model(data)
    lib = sentencepiece.SentencePieceProcessor(model_proto=model([(t, float(s), k) for (t, _, k), s in zip(pieces, codec.scores)]))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["", " ", "  a  b ", "日本語 😀 \x00", "x" * 700 + "é" * 300, "\n\n a\n"]
    ids, counts = codec.encode(texts)
    ends, same = np.cumsum(counts), 0
    for t, e, n in zip(texts, ends, counts):
        got, want = ids[e - n : e].tolist(), lib.encode(t)
        same += got == want
        total = lambda x: sum(float(codec.scores[i]) for i in x if not codec.is_byte[i])
        assert total(got) == pytest.approx(total(want), abs=0.05) and sum(codec.is_byte[got]) == sum(codec.is_byte[want])
    assert same > 0.9 * len(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_round_trip(texts):
    c = test_round_trip.codec
    texts = [t for t in texts if not any("\ud800" <= x <= "\udfff" for x in t)]
    assert c.decode(*c.encode(texts)) == texts


test_round_trip.codec = P.Codec(open(P.default_model(), "rb").read())


def test_marker_in_a_text_survives(codec):
    ids, counts = codec.encode(["a▁b c"])
    assert codec.is_byte[ids].sum() == 3 and codec.decode(ids, counts) == ["a▁b c"]


def test_long_and_short_chunks_agree(codec, monkeypatch):
    texts = ["abcdefgh ijk" * 5, "日本" * 20, "a" * 100]
    want = [x.tolist() for x in codec.encode(texts)]
    monkeypatch.setattr(P, "LONG_CHUNK", 3)
    assert [x.tolist() for x in codec.encode(texts)] == want


def test_double_array_holds_its_keys():
    rng = random.Random(3)
    keys = {bytes(rng.randint(0, 255) for _ in range(rng.randint(1, 6))): i for i in range(3000)}
    base, check, value = P.double_array(keys)

    def find(key):
        s = 0
        for b in key:
            t = base[s] + b
            if check[t] != s:
                return -1
            s = t
        return value[s]

    assert all(find(k) == i for k, i in keys.items())
    other = [bytes(rng.randint(0, 255) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    assert all(find(k) == -1 for k in other if k not in keys)


def test_without_byte_pieces_unknown_ids_stand():
    c = P.Codec(model(small(False)))
    ids, counts = c.encode(["abx"])
    assert ids[-1] == c.unknown == 0 and c.decode(ids, counts) != ["abx"]


def test_odd_rows(make, odd):
    docs = make(odd, extra=True)
    path = P.default_model()
    rows = P.encode(docs, path, keep=("doc_id", "words")).collect()
    assert len(rows) == len(odd) and all(r.round_trip and r.words == "clash" for r in rows)
    assert sum(r.ids is None for r in rows) == 2 and all(r.n_tokens == len(r.ids or []) for r in rows)
    encoded = P.encode(docs, path)
    back = P.decode(encoded, path).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(odd, key=repr)
    assert P.encode(make([]), path).count() == 0


def library(data, text):
    return sentencepiece.SentencePieceProcessor(model_proto=data).encode(text)


def test_extra_spaces_go_where_the_model_says_so():
    data = model(small(), extra=True)
    c = P.Codec(data)
    for t in ("a  b", "  ab c ", "abc", "   ", ""):
        ids, counts = c.encode([t])
        assert ids.tolist() == library(data, t) and counts.tolist() == [len(ids)]


def test_defined_pieces_go_first_and_pieces_may_have_any_form():
    own = [("cab", -9.0, P.USER), ("x\ny", -1.5, P.NORMAL), ("a▁b", -0.9, P.NORMAL), ("q" * 70, -2.0, P.NORMAL), ("q", -3.0, P.NORMAL)]
    data = model(small() + own)
    c = P.Codec(data)
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice(["a", "b", "c", " ", "cab", "x", "\n", "x\ny", "q" * 35, "q", "é", "日"]) for _ in range(rng.randint(1, 12)))
        ids, counts = c.encode([t])
        assert ids.tolist() == library(data, t), t
        assert c.decode(ids, counts) == [t]


def test_a_table_of_characters_is_refused():
    with pytest.raises(ValueError):
        P.Codec(field(3, 2, field(2, 2, b"xxxx")) + model(small()))


def test_ids_that_the_model_does_not_have(spark, codec):
    for bad in ([-1, 5], [5, 10**6]):
        with pytest.raises(ValueError):
            codec.decode(np.array(bad), np.array([2]))
    with pytest.raises(Exception, match="pieces"):
        P.decode(spark.createDataFrame([(1, [5, None])], "doc_id long, ids array<int>"), P.default_model()).collect()
