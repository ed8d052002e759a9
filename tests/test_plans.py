"""Flows, settings, scorers and the stream."""

import warnings

from pyspark.sql import functions as F

from quarryline.operators import graph, scorers
from quarryline.plans import config, flows
from quarryline.streaming.telemetry import stage_windows


def test_settings():
    assert config.settings().search_width == 400 and config.settings("shipped").search_width == 20
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        assert config.settings(k=5, nonsense=1).k == 5
    assert "nonsense" in str(told[0].message)


def test_flow_from_search_to_clusters(spark):
    cfg = config.settings(k=3, m=4, tau=0.1)
    vec = [(i, i // 2, [1.0, i / 10]) for i in range(10)]
    vectors = spark.createDataFrame(vec, "vec_pos long, doc_idx long, vector array<double>")
    docs = spark.createDataFrame([(i, "List of x" if i == 4 else f"T{i}", ["s", "t"], ["one", "two"]) for i in range(5)], "doc_idx long, title string, section_titles array<string>, section_texts array<string>")
    samples = spark.createDataFrame([(100, [1.0, 1.0])], "sample_id long, vector array<double>")
    found = flows.retrieve(samples, vectors, docs, cfg)
    assert [r.doc_idx for r in found.orderBy("doc_rank").collect()] == [3, 2, 1]  # 4 is a list page
    assert abs(found.agg(F.sum("img_norm")).first()[0] - 1) < 1e-12
    cands = flows.candidates(found, docs).withColumn("rerank_score", F.col("section_idx").cast("double"))
    top = flows.fuse(cands, cfg)
    assert top.count() == 4
    pairs = graph.section_pairs(top.select("sample_id", "idx"))
    rel = pairs.select("sample_id", "i", "j", *[F.lit(v).alias(n) for n, v in (("ent_ij", 0.8), ("neu_ij", 0.1), ("con_ij", 0.1), ("ent_ji", 0.8), ("neu_ji", 0.1), ("con_ji", 0.1))])
    assert flows.cluster(top, rel, cfg).first().type == "kept"
    assert len(flows.cluster(top, rel, cfg, "clique").first().members) == 3
    truth = spark.createDataFrame([(100, ["t3"], [("t3", 1)])], "sample_id long, titles array<string>, pairs array<struct<title: string, section_id: int>>")
    named = top.withColumn("norm_title", F.lower("source_title"))
    recall = {(r.level, r.k): r.hits for r in flows.evaluate(named, truth, 4).collect()}
    assert recall["document", 4] == 1 and recall["section", 4] == 1


def test_scorers(spark):
    name = "length-test"
    scorers._SCORERS.pop(name, None)

    @scorers.register(name)
    def factory():
        return lambda q, s: [float(len(a) + len(b)) for a, b in zip(q, s)]

    d = spark.createDataFrame([("a", "bc")], "q string, s string")
    assert scorers.with_scores(d, "q", "s", [name]).first().rerank_score == 3.0
    rows = []
    with scorers.stage_meter("x", rows):
        d.count()
    assert rows[0]["stage"] == "x" and rows[0]["latency_s"] > 0


def test_encoders_and_lemmatisers(spark):
    for registry, name in ((scorers._ENCODERS, "len"), (scorers._LEMMATISERS, "s")):
        registry.pop(name, None)

    @scorers.register_encoder("len")
    def encoder():
        return lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts]

    @scorers.register_lemmatiser("s")
    def lemmatiser():
        return lambda texts: [[(w, w.rstrip("s"), "NOUN" if w.endswith("s") else "OTHER") for w in t.split()] for t in texts]

    d = spark.createDataFrame([("two dogs",), (None,)], "t string")
    rows = d.select(scorers.text_encoder("len")("t").alias("v"), scorers.text_encoder("len", unit=True)("t").alias("u"), scorers.lemmatised("s")("t").alias("l")).collect()
    assert rows[0].v == [24.0, 32.0] and [round(x, 9) for x in rows[0].u] == [0.6, 0.8] and rows[0].l == "two dog"
    assert rows[1].v == [0.0, 0.0] and rows[1].l == ""


def test_meter_of_energy_and_memory():
    import time

    rows, calls = [], []

    def watts():
        calls.append(1)
        if len(calls) == 2:
            raise OSError("no reading")
        return 10.0

    with scorers.stage_meter("x", rows, watts=watts, peak_gb=lambda: 1.5, poll_s=0.02):
        time.sleep(0.3)
    assert rows[0]["peak_vram_gb"] == 1.5 and 0.8 * 10 * 0.25 < rows[0]["energy_j"] < 1.2 * 10 * rows[0]["latency_s"]


def test_recall_by_title_and_section_counts_every_sample(spark):
    top = spark.createDataFrame([(1, "a", 0, 1, 1), (1, "b", 1, 2, None), (2, "x", 0, 1, 1)], "sample_id long, norm_title string, section_idx int, section_rank int, doc_place int")
    truth = spark.createDataFrame([(1, ["b"], [("b", 1)]), (2, ["x"], []), (3, ["y"], [("y", 0)]), (4, None, None)], "sample_id long, titles array<string>, pairs array<struct<title: string, section_id: int>>")
    got = {(r.level, r.k): (r.hits, r.total) for r in flows.evaluate(top, truth, 3).collect()}
    assert got == {("document", 1): (1, 3), ("document", 3): (2, 3), ("section", 1): (0, 3), ("section", 3): (1, 3)}
    placed = {(r.level, r.k): r.hits for r in flows.evaluate(top, truth, 3, doc_rank="doc_place").collect()}
    assert placed["document", 3] == 1  # a null place does not count
    assert {r.hits for r in flows.evaluate(top.limit(0), truth, 3).collect()} == {0}


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.col("value").alias("latency_s"))
    e.write.parquet(str(tmp_path / "in"))
    stream = stage_windows(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("stages").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("stages").collect())) == sorted(map(tuple, stage_windows(e).collect()))
