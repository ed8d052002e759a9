"""What several operators share."""

from __future__ import annotations

import ctypes
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII space characters that separate words: space and \t to \r.
SPACE = r"[ \t-\r]"
NOT_SPACE = r"[^ \t-\r]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share.

    It is the session's own (spark.checkpoint.dir). Where none is set, a local session
    gets a temporary one; on a cluster that is an error, as the local folder of one
    machine is not seen by the others.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def trim() -> None:
    """Gives memory that this worker has freed back to the system; without glibc only Arrow's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(batches, of: int, size: int = 1 << 20):
    """Record batches cut to runs of rows with about `size` bytes in string column `of`
    (a row at least), so that a worker holds few texts at a time."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(of)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(b):
            before = ends[a - 1] if a else 0
            past = max(a + 1, int(np.searchsorted(ends, before + size)))
            yield b.slice(a, past - a)
            trim()
            a = past


def let(value: Column, body) -> Column:
    """body(value), with value computed once: the optimizer would else copy its
    expression into every lambda that names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Only A to Z become lower case; lower() would change other letters too."""
    return F.translate(text, UPPER, UPPER.lower())


def held_out(id_col: str, of: int, part: int) -> Column:
    """Whether the CRC-32 of the id as text leaves `part` when divided by `of`; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of)) == part, F.lit(False))


def join_hot(rows: DataFrame, dim: DataFrame, key: str, weight: str, hot_rows: int = 2_000, hot_keys: int = 1_000) -> DataFrame:
    """rows inner join dim on key, dim having one row for each key and the number
    of rows with that key in `weight`.

    Keys of at least hot_rows rows, the hot_keys largest of them, are broadcast (a
    bounded table), so that no task gets all rows of a key that many rows share;
    the others are shuffled. rows is read twice and should be durable.
    """
    hot = dim.filter(F.col(weight) >= hot_rows).orderBy(F.desc(weight), key).limit(hot_keys)
    hot = durable(hot)
    out = [c for c in dim.columns if c not in (key, weight)]
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return (
        rows.join(F.broadcast(hot.select(key, *out)), key)
        .unionByName(cold_rows.join(dim.select(key, *out), key))
    )


#: Names that are broadcast at most: two longs each, about 50 MB as a hash table.
BROADCAST_NAMES = 1 << 19


def fresh(name: str, *frames: DataFrame) -> str:
    """name, made longer until no frame has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """docs with two columns more, which name a row by its id and text in 128 bits and are never null; and their names."""
    key, text_h = fresh("own key", docs), fresh("own text_h", docs)
    return docs.withColumn(text_h, F.xxhash64(text_col)).withColumn(key, F.xxhash64(id_col, text_h)), [key, text_h]


def without(rows: DataFrame, gone: DataFrame, names: list[str], weight: str | None = None, most: int = BROADCAST_NAMES) -> DataFrame:
    """rows less those whose names are in gone, which has one row for each and should be durable.

    Up to `most` names, counted first, are broadcast, so that texts stay where they
    are. Of more, those of the largest weight are broadcast, as many rows may share
    one; the rest meet the rows in an exchange.
    """
    n = gone.count()
    if n <= most:
        return rows.join(F.broadcast(gone.select(*names)), names, "left_anti")
    hot = durable(gone.orderBy(*([F.desc(weight)] if weight else []), *names).limit(most).select(*names))
    rest = gone.join(hot, names, "left_anti").select(*names)
    return rows.join(F.broadcast(hot), names, "left_anti").join(rest.hint("merge"), names, "left_anti")
