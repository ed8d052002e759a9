"""Stage timings, power and energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def warm_up(samples: DataFrame, order: str, valid: Column, n: int) -> DataFrame:
    """samples with is_warmup: fewer than n valid ones come before.

    Valid samples are counted over the whole order, without a window of all rows: the
    n-th valid one ends the warm-up, and finding it takes the n least only.
    """
    last = samples.filter(valid).select(order).orderBy(order).limit(n).agg(F.max(order).alias("last"), F.count("*").alias("n")).first()
    if n <= 0:
        return samples.withColumn("is_warmup", F.lit(False))
    if last.n < n:
        return samples.withColumn("is_warmup", F.lit(True))
    return samples.withColumn("is_warmup", F.col(order) <= F.lit(last["last"]))


def stage_summary(rows: DataFrame) -> DataFrame:
    """For each stage, warm-ups left out: count, mean, population deviation and percentiles of latency, memory, energy; 0 where there is nothing.

    rows: stage, latency_s, peak_vram_gb, energy_j, is_warmup. A stage of warm-ups only still has its row.
    """
    own = lambda c: F.when(~F.col("is_warmup"), F.col(c))
    latency = own("latency_s")
    out = rows.groupBy("stage").agg(
        F.count(latency).alias("count"), F.avg(latency).alias("latency_mean"), F.stddev_pop(latency).alias("latency_std"),
        *[F.percentile(latency, q).alias(f"latency_p{int(100 * q)}") for q in (0.5, 0.9, 0.95, 0.99)],
        F.avg(own("peak_vram_gb")).alias("vram_mean"), F.max(own("peak_vram_gb")).alias("vram_max"), F.avg(own("energy_j")).alias("energy_mean"), F.sum(own("energy_j")).alias("energy_total"),
    )
    return out.select("stage", "count", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in out.columns[2:]])


def energy(samples: DataFrame, series: str = "series_id", t: str = "t", watts: str = "watts", since: Column | None = None) -> DataFrame:
    """(series, energy_j): watts integrated over time by trapezoids, per series.

    since: where the series' clock starts; if its first sample is later, the first
    power counts from there. Steps back in time count nothing.
    """
    w = Window.partitionBy(series).orderBy(t)
    first = F.row_number().over(w) == 1
    lead = F.greatest(F.col(t) - since, F.lit(0.0)) * F.col(watts) if since is not None else F.lit(0.0)
    step = (F.lag(watts).over(w) + F.col(watts)) / 2 * F.greatest(F.col(t) - F.lag(t).over(w), F.lit(0.0))
    return samples.select(series, F.when(first, lead).otherwise(step).alias("joules")).groupBy(series).agg(F.sum("joules").alias("energy_j"))


def smoothed(rows: DataFrame, series: str, order: list[str], value: str, size: int = 20) -> DataFrame:
    """rows with the median (of an even number the lower), mean, maximum and last of the newest `size` values, and the mean of all so far."""
    w = Window.partitionBy(series).orderBy(*order)
    last = w.rowsBetween(1 - size, 0)
    ordered = F.sort_array(F.collect_list(value).over(last))
    return rows.select(
        "*", F.get(ordered, F.floor((F.size(ordered) - 1) / 2).cast("int")).alias("median"), F.avg(value).over(last).alias("avg"), F.max(value).over(last).alias("max"),
        F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("global_avg"),
    )


def learning_rates(steps: DataFrame, epoch: str, kind: str, start: float, least: float, max_epoch: int, decay: float = 0.9, warm_steps: int = 1, warm_start: float = 0.0) -> DataFrame:
    """steps with lr: `cosine` from start to least over max_epoch, `step` by decay each epoch, or `warmup` from warm_start up to start."""
    e = F.col(epoch).cast("double")
    if kind == "cosine":
        lr = (start - least) * 0.5 * (1 + F.cos(F.pi() * e / max_epoch)) + least
    elif kind == "step":
        lr = F.greatest(F.lit(least), start * F.pow(F.lit(decay), e))
    elif kind == "warmup":
        lr = F.least(F.lit(start), warm_start + (start - warm_start) * e / max(warm_steps, 1))
    else:
        raise ValueError(f"no schedule {kind}")
    return steps.withColumn("lr", lr)
