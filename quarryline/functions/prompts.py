"""Inputs of generators: prompts, grouped captions, token sequences, frame features."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col, let, strip


def evidence_prompt(sections, n: int = 3) -> Column:
    """The first n sections, one to a line."""
    return F.array_join(F.slice(col(sections), 1, n), "\n")


def answer_prompt(question, sections, n: int = 3) -> Column:
    """The question, the first n sections as its context, and how to answer."""
    return F.concat(F.lit("Question: "), col(question), F.lit("\nContext: "), evidence_prompt(sections, n), F.lit("\nAnswer with a short entity only."))


def fid_inputs(question, captions, n_captions: int, group: int) -> Column:
    """The question before each group of captions; the last group ends at n_captions.

    A group that runs out of captions before its end is left out.
    """
    q = strip(F.lower(col(question)))

    def joined(caps: Column) -> Column:
        text = F.array_join(F.transform(caps, lambda c: F.concat(strip(c), F.lit(". "))), "")
        return F.concat(q, F.lit(" \\n "), strip(F.lower(text)))

    cuts = [(a, min(a + group, n_captions)) for a in range(0, n_captions, group)]
    every = F.array(*[F.when(F.size(col(captions)) >= b, joined(F.slice(col(captions), a + 1, b - a))) for a, b in cuts])
    return F.filter(every, lambda x: x.isNotNull())


def task_prompt(questions) -> Column:
    """One example answered yes, the last synthetic question, and one answered no."""
    return F.concat(F.lit("Question:"), F.element_at(col(questions), -1), F.lit("\nAnswer:yes\nQuestion:Is this a toilet?\nAnswer:no\n"))


def context_prompt(answers, captions, index, n: int = 30) -> Column:
    """A caption for each answer, from the last answer backwards, round and round, n times.

    index: map from an answer, lower case and without its last character, to caption
    numbers from 0; an answer that is not in it stands for caption 0. Each answer adds
    its first caption that is not in the prompt yet.
    """

    def over(found: Column) -> Column:
        size = F.size(col(answers))
        start = F.struct(F.lit("").alias("text"), F.array().cast("array<int>").alias("used"))

        def step(acc: Column, k: Column) -> Column:
            answer = F.get(col(answers), F.pmod(size - 1 - k, size))
            key = F.lower(F.substring(answer, F.lit(1), F.greatest(F.char_length(answer) - 1, F.lit(0))))
            ids = F.coalesce(F.try_element_at(found, key), F.array(F.lit(0)))
            new = F.get(F.filter(ids, lambda i: ~F.array_contains(acc["used"], i)), F.lit(0))
            return F.when(new.isNull(), acc).otherwise(F.struct(F.concat(acc["text"], F.get(col(captions), new)).alias("text"), F.concat(acc["used"], F.array(new)).alias("used")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step, lambda acc: acc["text"])

    return let(col(index), over)


def dialogue_sequence(caption, history, answer, end: int, speakers: tuple[int, int], caption_type: int) -> Column:
    """input_ids, token_type_ids and labels of a caption, utterances and an answer, each closed by `end`.

    Utterances alternate between two speakers, the answer goes on; only the answer is
    a label, all else is -1. caption and answer are arrays of token ids, history one of such arrays.
    """
    closed = lambda x: F.concat(x, F.array(F.lit(end)))
    said = F.transform(F.concat(col(history), F.array(col(answer))), closed)
    kinds = F.flatten(F.transform(said, lambda s, i: F.transform(s, lambda _: F.when(i % 2 == 1, speakers[1]).otherwise(speakers[0]))))
    head = closed(col(caption))
    before = F.concat(head, F.flatten(F.transform(col(history), closed)))
    return F.struct(
        F.concat(head, F.flatten(said)).alias("input_ids"), F.concat(F.transform(head, lambda _: F.lit(caption_type)), kinds).alias("token_type_ids"),
        F.concat(F.transform(before, lambda _: F.lit(-1)), closed(col(answer))).alias("labels"),
    )


def concat_features(modalities: list) -> Column:
    """Frame by frame concatenation of several feature series, cut to the shortest."""
    columns = [col(m) for m in modalities]
    n = F.least(*[F.size(m) for m in columns]) if len(columns) > 1 else F.size(columns[0])
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(*[F.get(m, i) for m in columns]))
    return F.when(n > 0, frames).otherwise(F.slice(columns[0], 1, 0))


def whitespace_clean(c) -> Column:
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def word_pieces(vocabulary: str, context: int = 77):
    """A column function: token ids of a tokenizers file, cut or filled with zeros to `context`, start and end marks included.

    The file is read in the worker, once for each task.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        start, end = t.token_to_id("<|startoftext|>"), t.token_to_id("<|endoftext|>")
        for texts in batches:
            out = []
            for e in t.encode_batch(texts.fillna("").tolist(), add_special_tokens=False):
                ids = [start, *e.ids, end][:context]
                ids[-1] = end
                out.append(ids + [0] * (context - len(ids)))
            yield pd.Series(out)

    return encode
