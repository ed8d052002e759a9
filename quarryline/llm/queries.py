"""Registered queries of the operators in this folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, interpolated, language, licenses, personal, perspectives, pieces, quality, shards, simhash, sql
from .common import held_out, table


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.default_model())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"), shards=40)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated.score(table(spark, sf_dir, "documents"), held_out("doc_id", 5, 1))


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 4, 2))
    examples = language.sample(docs, ~F.col("held_out"))
    return language.identify(docs, examples, keep=("doc_id", "held_out"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.detect(table(spark, sf_dir, "documents"), personal.train())


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


QUERIES = {f.__name__: f for f in (op1_shards, op2_quality_rules, op3_interpolated, op4_perspectives, op5_licenses, op6_language, op7_personal_data, op8_decontaminate, op9_pieces, op10_simhash)}
ORACLE_SQL: dict[str, str] = {"op4_perspectives": sql.PERSPECTIVES, "op8_decontaminate": sql.DECONTAMINATE}
