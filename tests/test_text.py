"""The traps of text normalisation: Python's white space, escapes, marks and stops."""

import re

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text
from quarryline.functions.answer_tables import CONSENSUS_PUNCTUATION


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [
    ("A B　C", "a b c"), ("The  (film) Title!", "the title"), (None, ""), ("", ""), ("Café (x) 2", "caf 2"), ("a\tb\nc d", "a b c d"),
])
def test_normalize_title(spark, raw, want):
    assert one(spark, raw, text.normalize_title) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("http://x/wiki/New_York_City#a", "new york city"), ("http://x/wiki/a+b?c", "ab"), ("http://x/wiki/%zz_c", "zz c"), ("http://x/wiki/A%20B", "a b"), ("http://x/", ""), (None, ""),
])
def test_url_to_title(spark, raw, want):
    assert one(spark, raw, text.url_to_title) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("The answer is  TWO\nand\ta", "2 and"), ("<extra_id_0> It's an  apple.", "its apple"), ("DONT", "don't"), ("entailment", "yes"), ("", ""), (None, ""), ("a an the", ""),
])
def test_normalize_answer(spark, raw, want):
    assert one(spark, raw, text.normalize_answer) == want


def marks(s: str) -> str:
    """The rule as stated, in plain Python."""
    comma = re.search(r"\d,\d", s)
    out = s
    for p in CONSENSUS_PUNCTUATION:
        out = out.replace(p, "" if f"{p} " in s or f" {p}" in s or comma else " ")
    return re.sub(r"\.(?!\d)", "", out, count=32)


@pytest.mark.parametrize("raw", ["a-b", "a - b", "1,000 dogs", "x. y. 3.5", "." * 40, "." * 33, "." * 32, "a.b" * 40 + ".", "", "he said \"yes\"!", "[a]{b}(c)"])
def test_consensus_punctuation(spark, raw):
    assert one(spark, raw, text.consensus_punctuation) == marks(raw)


def test_consensus_words(spark):
    assert one(spark, "The Two  dogs dont bark", text.consensus_words) == "2 dogs don't bark"


@pytest.mark.parametrize(("raw", "want"), [("A|B||C", ["A", "B", "C"]), ("nan", []), ("", []), (None, []), ("7", ["7"])])
def test_parse_ids(spark, raw, want):
    assert one(spark, raw, text.parse_ids) == want


def test_captions_and_questions(spark):
    assert one(spark, "  A (big)\n\n dog: runs.  ", text.pre_caption) == "a big dog runs"
    assert one(spark, "What *is* it?!  ", text.pre_question) == "what is it?"
    assert one(spark, " ".join("w" for _ in range(60)), text.pre_caption).count("w") == 50


def test_sections_that_do_not_count(spark):
    d = spark.createDataFrame([(" See Also ", ), ("History",), (None,)], "t string")
    assert [r[0] for r in d.select(text.is_excluded_section("t")).collect()] == [True, False, None]
    assert one(spark, "  \t", text.is_blank) and not one(spark, " x", text.is_blank)
    assert one(spark, "The list of lakes", text.is_list_page)
    assert spark.range(1).select(F.lit(1)).count() == 1
