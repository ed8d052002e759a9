"""Shared helpers, the guard of the entry, and names of the queries."""

import re
import subprocess
import sys

from pyspark.sql import functions as F

from quarryline.llm import queries
from quarryline.llm.common import ascii_lower, durable, held_out, join_hot, let, shared_folder


def test_join_hot_is_the_join(spark):
    rows = durable(spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 50).cast("long").alias("key"), "id"))
    dim = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    want = sorted(map(tuple, rows.join(dim.select("key", "most"), "key").select("key", "id", "most").collect()))
    for hot, keys in ((2000, 1000), (1, 3), (10**9, 5)):
        got = join_hot(rows, dim, "key", "n", hot_rows=hot, hot_keys=keys)
        assert sorted(map(tuple, got.select("key", "id", "most").collect())) == want


def test_held_out_is_the_checksum(spark):
    import zlib

    d = spark.range(200).select("id", held_out("id", 5, 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 1) for r in d)
    assert spark.createDataFrame([(None,)], "id long").select(held_out("id", 5, 1)).first()[0] is False


def test_small_expressions(spark):
    d = spark.createDataFrame([("AbÉZ",)], "s string")
    assert d.select(ascii_lower(F.col("s"))).first()[0] == "abÉz"
    assert d.select(let(F.length("s"), lambda x: x + x)).first()[0] == 8
    assert shared_folder(spark)


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_\w+$", n)[1]) for n in queries.QUERIES]
    assert numbers == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_entry_needs_no_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()) > 50)"], capture_output=True, text=True, timeout=120)
    assert said.stdout.split()[1:] == ["True", "True"], said.stderr


def test_native_operators_run_no_python(spark):
    for name in ("op2_quality_rules", "op4_perspectives", "op8_decontaminate"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
