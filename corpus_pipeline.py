"""A training corpus from `documents`: five stages, each one operator of quarryline.llm.

Every stage reads what the one before it kept. Documents go where the language cannot
be told, where another document of the same near-duplicate group stays, and where a
benchmark passage occurs; personal data is masked in the others, and their texts are
encoded. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, language, personal, pieces, simhash
from quarryline.llm.common import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told stay as they are; null texts and texts without a letter go.
    Where no row has a language to learn from, all that have a letter stay."""
    examples = language.sample(docs, F.lit(True))
    known = language.identify(docs, examples or [("a", "unknown")], keep=COLUMNS)
    return known.filter(F.col("lang_pred") != language.UNDETERMINED).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least id, ids before null.
    Null, empty and blank texts have one fingerprint and so are one group with all that
    are within two bits of it; of rows that are equal in id and text one stays."""
    return simhash.one_of_each(docs).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage, as they are; null and empty texts have none and stay."""
    return decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; each span of personal data becomes its kind in brackets, and n_chars follows. Null texts stay null with their n_chars."""
    found = personal.detect(docs, personal.train(), keep=("doc_id", "lang", "source", "n_chars"), with_text=True)
    length = F.when(F.col("redacted").isNull(), F.col("n_chars")).otherwise(F.char_length("redacted").cast("long"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", length.alias("n_chars"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows: doc_id, lang, source, n_chars, ids, n_tokens, n_byte_tokens, round_trip. Null texts have null ids and no tokens, empty ones no ids."""
    return pieces.encode(docs, pieces.default_model(), keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("encoding", encoding)]

#: Learned models and connected components are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result is written as Parquet to the shared folder and read again, the last is returned.

    documents needs doc_id, text, lang, source and n_chars, any of them null; other
    columns are left out by the first stage. An empty table gives no rows.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
