"""Writing metrics, candidates, summaries and cached results."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_rows(rows: DataFrame) -> DataFrame:
    """sample_id, stage, latency_s (6 decimals), peak_vram_gb (6), energy_J (3), is_warmup (0 or 1), as text."""
    return rows.select(
        F.col("sample_id").cast("string").alias("sample_id"), "stage", F.format_string("%.6f", F.col("latency_s").cast("double")).alias("latency_s"), F.format_string("%.6f", F.col("peak_vram_gb").cast("double")).alias("peak_vram_gb"),
        F.format_string("%.3f", F.col("energy_j").cast("double")).alias("energy_J"), F.col("is_warmup").cast("int").cast("string").alias("is_warmup"),
    )


def flat(rows: DataFrame) -> DataFrame:
    """rows for a CSV: arrays joined by `|`, their nulls as nothing."""
    kinds = dict(rows.dtypes)
    return rows.select(*[F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), "|").alias(c) if kinds[c].startswith("array") else F.col(c) for c in rows.columns])


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat(rows).write.mode(mode).csv(path, header=True)


def write_summary(row: DataFrame, path: str, mode: str = "append") -> None:
    """Rows as JSON, one object to a line, keys in order."""
    row.select(*sorted(row.columns)).write.mode(mode).json(path)


def fingerprint(meta: dict) -> str:
    return hashlib.sha256(json.dumps(meta, sort_keys=True).encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, meta: dict, samples: DataFrame, compute) -> DataFrame:
    """Results of all samples; those that a run with equal meta has left are read, the others computed and added.

    compute takes the samples that are missing and returns rows with their sample_id.
    """
    path = f"{root}/{fingerprint(meta)}"
    try:
        have = spark.read.parquet(path)
        missing = samples.join(have.select("sample_id").distinct(), "sample_id", "left_anti")
    except AnalysisException:
        missing = samples
    new = compute(missing)
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).join(samples.select("sample_id"), "sample_id", "left_semi")
