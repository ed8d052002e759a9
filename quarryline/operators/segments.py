"""Documents to sections, sentences and paragraphs of bounded length."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_excluded_section, let, strip

#: Where a sentence ends: a mark, then white space.
SENTENCE_END = r"(?U)(?<=[.!?])\s+"


def zipped(titles: Column, texts: Column) -> Column:
    """Pairs up to the shorter list (arrays_zip would fill up with nulls)."""
    n = F.least(F.size(titles), F.size(texts))
    return F.arrays_zip(F.slice(titles, 1, n).alias("title"), F.slice(texts, 1, n).alias("text"))


def sections(docs: DataFrame) -> DataFrame:
    """(doc_idx, source_title, section_idx, section_title, section_text) of docs with doc_idx, title, section_titles, section_texts.

    section_idx counts all sections; those that are blank or only hold references are left out.
    """
    each = docs.select("doc_idx", F.coalesce("title", F.lit("N/A")).alias("source_title"), F.posexplode(zipped(F.col("section_titles"), F.col("section_texts"))).alias("section_idx", "s"))
    out = each.select("doc_idx", "source_title", "section_idx", F.col("s.title").alias("section_title"), F.col("s.text").alias("section_text"))
    return out.filter(~is_excluded_section("section_title") & ~is_blank("section_text"))


def sentences_of(text: Column, abbreviations: tuple[str, ...] = ()) -> Column:
    """An approximation: a sentence ends with . ! or ? and white space, but not after one of the abbreviations, named without their full stop."""
    not_after = "".join(rf"(?<!\b{re.escape(a)}\.)" for a in abbreviations)
    return F.filter(F.split(strip(text), SENTENCE_END.replace(r"\s+", not_after + r"\s+")), lambda s: s != "")


def sentences(sections_: DataFrame, abbreviations: tuple[str, ...] = ()) -> DataFrame:
    """A row for each sentence: section columns, sentence_idx, and the title with ` [sent i]`."""
    each = sections_.select("*", F.posexplode(sentences_of(F.col("section_text"), abbreviations)).alias("sentence_idx", "s"))
    return each.withColumn("section_title", F.concat("section_title", F.lit(" [sent "), F.col("sentence_idx").cast("string"), F.lit("]"))).withColumn("section_text", F.col("s")).drop("s")


def balanced_chunks(parts: Column, max_length: int) -> Column:
    """Sentences joined to chunks of about equal length, max_length at most (a longer sentence is a chunk alone).

    A chunk closes before a sentence that would overfill it, or once it has reached
    the average that the rest of the text leaves for each chunk still expected.
    """
    length = lambda s: F.char_length(s) + 1
    total = F.aggregate(parts, F.lit(0), lambda n, s: n + length(s))

    def fold(size: Column) -> Column:
        expected = F.greatest(F.lit(1), F.ceil(size / max_length).cast("int"))
        start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("cur_len"), size.alias("rest"))

        def step(acc: Column, s: Column) -> Column:
            average = acc["rest"] / F.greatest(F.lit(1), expected - F.size(acc["done"]))
            closes = (F.size(acc["cur"]) > 0) & ((acc["cur_len"] + length(s) > max_length) | (acc["cur_len"] >= average))
            closed = F.struct(
                F.concat(acc["done"], F.array(strip(F.array_join(acc["cur"], " ")))).alias("done"), F.array(s).alias("cur"), length(s).alias("cur_len"), (acc["rest"] - acc["cur_len"]).alias("rest"),
            )
            goes_on = F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.array(s)).alias("cur"), (acc["cur_len"] + length(s)).alias("cur_len"), acc["rest"].alias("rest"))
            return F.when(closes, closed).otherwise(goes_on)

        last = lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(strip(F.array_join(acc["cur"], " "))))).otherwise(acc["done"])
        return F.aggregate(parts, start, step, last)

    return let(total, fold)


def paragraphs(sections_: DataFrame, max_length: int = 1024) -> DataFrame:
    """A row for each chunk of sentences: section columns, paragraph_idx, and the title with ` [para i]`."""
    parts = let(sentences_of(F.col("section_text")), lambda p: balanced_chunks(p, max_length))
    each = sections_.select("*", F.posexplode(parts).alias("paragraph_idx", "p"))
    return each.withColumn("section_title", F.concat("section_title", F.lit(" [para "), F.col("paragraph_idx").cast("string"), F.lit("]"))).withColumn("section_text", F.col("p")).drop("p")
