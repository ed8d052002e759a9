"""Sharding by Karmarkar-Karp differencing.

A partial partition is a list of sums, one for each shard. Differencing repeatedly
takes the two partial partitions of largest spread and adds them in opposite orders,
largest sums to smallest, until one is left. The groups that must stay whole (equal
texts) start as partial partitions of one non-zero sum.

Groups are first summed over the cluster, so a text that many documents share is one
group. The largest, a bounded number, are differenced on the driver. The others are
dealt by hash to cells, each differenced in a task of its own; to even out what the
largest groups leave uneven, a cell also takes its share of their sums as one partial
partition more, which keeps the numbers of the shards. A cell's sums then end nearly
equal, and so do the totals. Where there are few groups the driver does it all.
"""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, join_hot


def difference(parts: list, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions; a part is a size or an array of `shards` sums.

    Returns places (a row for each part: the shard of each of its bins, for a plain
    size in the last column) and the final sums by shard.
    """
    n = len(parts)
    if not n:
        return np.zeros((0, shards), np.int32), np.zeros(shards, np.int64)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.zeros((n, shards), np.int32)  # of inner node k: n + k
    first = {}  # of parts with several sums: their bins by sum
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, p in enumerate(parts):
        if np.ndim(p):
            first[i] = np.argsort(p, kind="stable")
            sums[i] = p[first[i]]
            heap.append((-int(sums[i][-1] - sums[i][0]), i))
        else:
            heap.append((-int(p), i))
    heapq.heapify(heap)

    def take(i: int) -> np.ndarray:
        if i in sums:
            return sums.pop(i)
        out = np.zeros(shards, np.int64)
        out[-1] = parts[i]
        return out

    made = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = take(a) + take(b)[::-1]
        by = np.argsort(total, kind="stable")
        total = total[by]
        left[made], right[made], order[made] = a, b, by
        sums[n + made] = total
        heapq.heappush(heap, (-int(total[-1] - total[0]), n + made))
        made += 1
    root = heap[0][1]
    places = np.zeros((n, shards), np.int32)
    at = {root: np.arange(shards, dtype=np.int32)}
    for k in range(made - 1, -1, -1):
        lab = np.empty(shards, np.int32)
        lab[order[k]] = at.pop(n + k)
        at[int(left[k])], at[int(right[k])] = lab, lab[::-1]
    for i, lab in at.items():
        if i in first:
            places[i][first[i]] = lab
        else:
            places[i] = lab
    return places, take(root)


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 16, large_groups: int = 5_000, groups_per_cell: int = 20_000, rows_per_run: int = 50_000) -> DataFrame:
    """A row for each row of docs: id_col, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Rows of equal text share a shard; null texts are one such group, of no bytes and a
    null checksum. size is the text's UTF-8 bytes plus row_bytes. Slots number the rows
    of a shard from 0 without gaps. A group larger than a shard's fair share fills its shard alone. An empty
    table gives no rows. Other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = durable(docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + row_bytes).cast("long").alias("size"),
        F.crc32(F.encode(text_col, "utf-8")).alias("crc"), F.xxhash64(text_col).alias("text_h"),
    ))
    groups = durable(rows.groupBy("text_h").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    large = groups.orderBy(F.desc("bytes"), "text_h").limit(large_groups).collect()
    places, left = difference([r.bytes for r in large], shards)
    known = [(r.text_h, r.rows, int(p)) for r, p in zip(large, places[:, -1], strict=True)]
    shard_of = docs.sparkSession.createDataFrame(known, "text_h long, rows long, shard int")
    if len(large) == large_groups:
        cells = max(1, ceil((groups.count() - large_groups) / groups_per_cell))

        def cell(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["bytes", "text_h"], ascending=False, ignore_index=True)
            c = int(pdf["cell"].iloc[0])
            share = left * (c + 1) // cells - left * c // cells  # of all cells together: left
            places, _ = difference([*pdf["bytes"].tolist(), share], shards)
            shard_at = np.empty(shards, np.int32)
            shard_at[places[-1]] = np.arange(shards)
            return pd.DataFrame({"text_h": pdf["text_h"], "rows": pdf["rows"], "shard": shard_at[places[:-1, -1]]})

        rest = groups.join(F.broadcast(shard_of.select("text_h")), "text_h", "left_anti")
        dealt = rest.withColumn("cell", F.pmod(F.xxhash64(F.col("text_h"), F.lit("cell")), F.lit(cells)).cast("int"))
        shard_of = shard_of.union(dealt.groupBy("cell").applyInPandas(cell, "text_h long, rows long, shard int"))
    placed = join_hot(rows, durable(shard_of), "text_h", "rows")

    runs = max(1, ceil(rows.count() / (shards * rows_per_run)))
    # The place that a row is read from deals out rows that are repeated in id and text too; it is kept with the row.
    placed = durable(placed.withColumn("run", F.pmod(F.xxhash64("id", "text_h", F.spark_partition_id()), F.lit(runs)).cast("int")))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "run").agg(F.count("*").alias("n")).select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "run").orderBy("id", "text_h"))
    return placed.withColumn("k", within).join(starts, ["shard", "run"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
