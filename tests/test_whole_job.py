"""Queries that once answered for a part of their rows, held against the whole job."""

import re

import numpy as np
import pytest

from quarryline.functions.answer_tables import ARTICLES, CONSENSUS_PUNCTUATION, CONTRACTIONS, NUMBER_WORDS
from quarryline.operators import metrics
from quarryline.plans import catalog, relations as rel

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_retrieval_ranks_of_ties_blocks_and_missing_partners(spark, block_rows):
    rng = np.random.default_rng(5)
    v = rng.integers(-1, 2, (60, 3)).astype(float)  # many ties
    label = [int(x) for x in rng.integers(0, 12, 60)]
    label[0] = 99  # no other has it
    items = spark.createDataFrame([(i, label[i], v[i].tolist()) for i in range(60)], "vec_pos long, label int, vector array<double>").repartition(4)
    queries = items.filter("vec_pos % 7 = 0").selectExpr("vec_pos AS sample_id", "label AS truth", "vector")

    def rank(own, others):
        order = sorted((o for o in others if o != own), key=lambda o: (-(v[own] @ v[o]), -o))
        return next((k for k, o in enumerate(order) if label[o] == label[own]), None)

    asked = range(0, 60, 7)
    by_query, by_item = metrics.retrieval_ranks(queries, items, block_rows)
    assert {r.sample_id: r["rank"] for r in by_query.collect()} == {q: rank(q, range(60)) for q in asked}
    assert {r.vec_pos: r["rank"] for r in by_item.collect()} == {i: rank(i, asked) for i in range(60)}
    assert by_query.filter("rank IS NULL").count() > 0 and by_item.filter("rank IS NULL").count() > 0


def normal(s: str) -> str:
    """The consensus normaliser in plain Python."""
    comma, out = re.search(r"\d,\d", s), s
    for p in CONSENSUS_PUNCTUATION:
        out = out.replace(p, "" if f"{p} " in s or f" {p}" in s or comma else " ")
    words = [NUMBER_WORDS.get(w, w) for w in re.sub(r"\.(?!\d)", "", out, count=32).lower().split()]
    return " ".join(CONTRACTIONS.get(w, w) for w in words if w not in ARTICLES)


def chats(spark, folder, pairs) -> str:
    """conversations of a user's turn and the assistant's, in a folder of tables."""
    rows = [(i, t, ("user", "assistant")[t], x) for i, pair in enumerate(pairs) for t, x in enumerate(pair)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


PAIRS = [("two dogs", "The 2 dogs."), ("An apple", "apple"), ("Été", "été"), ("dont", "don't"), ("7", "7"), ("Same start, other end", "Same start, no end"), ("!?", ""), ("x", "y"), ("Yes", "yes"), ("1,000 cats", "1000 cats")]


def test_gqa_compares_whole_texts_of_all_rows(spark, tmp_path):
    got = catalog.QUERIES["gqa_accuracy"](spark, chats(spark, tmp_path, PAIRS)).first()
    same = [normal(q) == normal(a) for q, a in PAIRS]
    assert 0 < sum(same) < len(same)
    assert (got.n, got.accuracy) == (len(PAIRS), round(sum(same) / len(same), 6))


def test_gqa_over_the_table(spark):
    rows = rel.answers(spark, SF).collect()
    got = catalog.QUERIES["gqa_accuracy"](spark, SF).first()
    assert (got.n, got.accuracy) == (len(rows), round(sum(normal(r.question) == normal(r.answer) for r in rows) / len(rows), 6))
