"""Rounding as SQL rounds, bit for bit: the sign of zero and what lies half-way count."""

import glob
import os
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import scores, vectors
from quarryline.plans import catalog

ODD = [-1e-8, -4.9e-7, -5e-7, 5e-7, -0.0, 0.0, 0.12345649999999999, -0.12345649999999999, 0.0078125, -0.0078125, 1.0000005, 2.5e300, 1.7e308, -1.7e308, float("inf"), float("-inf"), float("nan")]


def bits(v):
    if isinstance(v, float):
        return "nan" if v != v else struct.pack(">d", v)
    return tuple(bits(x) for x in v) if isinstance(v, (list, tuple)) else v


def held(spark, name: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}/*.parquet'")
    want = con.sql(f"SELECT * FROM ({catalog.ORACLE_SQL[name]}) ORDER BY 1")
    got = catalog.QUERIES[name](spark, sf_dir).select(*want.columns).orderBy(want.columns[0]).collect()
    assert [bits(tuple(r)) for r in got] == [bits(r) for r in want.fetchall()]


@pytest.mark.parametrize("places", [2, 6])
def test_rounded_equals_sql(spark, places):
    rng = np.random.default_rng(3)
    values = [*ODD, *rng.normal(0, 1e-6, 300), *((rng.integers(-(10**7), 10**7, 300) + 0.5) / 10**places * (1 + rng.integers(-2, 3, 300) * 2e-16))]
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, ?)", [float(x), places]).fetchone()[0] for x in values]
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "i long, x double").orderBy("i")
    assert [bits(r[0]) for r in d.select(scores.rounded("x", places)).collect()] == [bits(x) for x in want]
    assert [bits(r[0]) for r in d.select(scores.rounded(F.col("x") + 0.0, places)).collect()][:4] == [bits(x) for x in want[:4]]
    assert sorted(map(str, map(bits, d.agg(scores.rounded_each(F.collect_list("x"), places)).first()[0]))) == sorted(map(str, map(bits, want)))
    assert d.select(scores.rounded(F.lit(None).cast("double"))).first()[0] is None


def test_fused_weights_sum_as_written(spark):
    d = spark.createDataFrame([([1.0], [1.0])], "a array<double>, b array<double>")
    x, y = d.select(vectors.fuse("a", "b", F.lit("a view"), 0.7), vectors.fuse("a", F.array(F.lit(3.0)), F.lit("a view"), 0.7)).first()
    assert (x, y) == ([0.7 * 1.0 + 0.3 * 1.0], [0.7 * 1.0 + 0.3 * 3.0])


@pytest.mark.parametrize("name", ["description_fusion", "feature_concat", "l2_normalize", "mean_pool"])
def test_vectors_near_zero_and_half_way(spark, tmp_path, name):
    rng = np.random.default_rng(7)
    x = np.where(rng.random((80, 64)) < 0.3, rng.normal(0, 4e-7, (80, 64)), np.where(rng.random((80, 64)) < 0.5, rng.integers(-63, 64, (80, 64)) / 128, rng.normal(0, 0.125, (80, 64)))).astype(np.float32)
    rows = [(i, x[i].tolist(), i % 5) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    held(spark, name, str(tmp_path))
