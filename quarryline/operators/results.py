"""Merging, caching and comparing result sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import rank_by


def merge_shards(shards: list[DataFrame], key: str, order: str) -> DataFrame:
    """All shards one after the other, in order; of each key the first row stays."""
    parts = [s.withColumn("shard_no", F.lit(k)) for k, s in enumerate(shards)]
    all_rows = reduce(DataFrame.unionByName, parts)
    return all_rows.withColumn("n", rank_by(key, F.asc("shard_no"), F.asc(order))).filter("n = 1").drop("n", "shard_no")


def missing_samples(samples: DataFrame, cache: DataFrame) -> DataFrame:
    """Samples that a result cache does not hold yet."""
    return samples.join(cache.select("sample_id").distinct(), "sample_id", "left_anti")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_a, only_b): how many distinct ids either side has alone; both 0 for equal sets."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(1)), b.select(key).distinct().withColumn("in_b", F.lit(1))
    both = x.join(y, key, "full")
    return both.agg(F.count(F.when(F.col("in_b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("in_a").isNull(), 1)).alias("only_b"))


def attach_annotations(results: DataFrame, annotations: DataFrame, key: str = "question_id") -> DataFrame:
    """results with the annotations' columns; ids on one side only are an error."""
    both = results.withColumn("has_result", F.lit(True)).join(annotations.withColumn("has_annotation", F.lit(True)), key, "full")
    bad = F.col("has_result").isNull() | F.col("has_annotation").isNull()
    checked = F.when(bad, F.raise_error(F.lit("results and annotations differ in their ids"))).otherwise(F.col(key))
    return both.withColumn(key, checked).drop("has_result", "has_annotation")


def filter_any(rows: DataFrame, **wanted: list) -> DataFrame:
    """Rows whose columns are among the values wanted; an empty list asks for nothing."""
    for name, values in wanted.items():
        if values:
            rows = rows.filter(F.col(name).isin(list(values)))
    return rows


def inverted_index(rows: DataFrame, item: str, terms: Column) -> DataFrame:
    """(term, items): for each term the distinct items that have it, ascending."""
    return rows.select(F.col(item).alias("item"), F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.sort_array(F.collect_set("item")).alias("items"))


def dialogue(turns: DataFrame, last: int = 3) -> DataFrame:
    """(conv_id, turns, n_turns): the last turns of each conversation, two messages a turn.

    Only those messages are gathered, whatever the length of a conversation.
    """
    newest = turns.withColumn("n", rank_by("conv_id", F.desc("turn"))).filter(F.col("n") <= 2 * last)
    return newest.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"), F.count("*").alias("n_turns"))
