"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from quarryline.sources import readers, writers


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_knowledge_base_list_and_object(spark, tmp_path):
    doc = {"title": " ", "section_titles": ["a"], "section_texts": ["b"]}
    p = put(tmp_path / "list.json", json.dumps([doc | {"wikipedia_url": "u1", "wikipedia_title": "W"}, doc | {"url": "u2"}, doc | {"url": "u1", "title": "T"}]))
    kb = readers.knowledge_base(spark, p).orderBy("doc_idx").collect()
    assert [(r.doc_idx, r.url, r.title) for r in kb] == [(0, "u1", "W"), (1, "u2", "unknown"), (2, "u1", "T")]
    assert {(r.url, r.doc_idx) for r in readers.url_index(readers.knowledge_base(spark, p)).collect()} == {("u1", 0), ("u2", 1)}
    q = put(tmp_path / "dict.json", json.dumps({"http://x/wiki/New_York": doc, "http://y": doc | {"title": "Y"}}))
    assert [(r.url, r.title) for r in readers.knowledge_base(spark, q).collect()] == [("http://x/wiki/New_York", "new york"), ("http://y", "Y")]
    with pytest.raises(ValueError):
        readers.knowledge_base(spark, put(tmp_path / "bad.json", "3"))


def test_vectors_need_documents(spark):
    v = spark.createDataFrame([(0, "a"), (1, "b")], "vec_pos long, url string")
    u = spark.createDataFrame([("a", 0)], "url string, doc_idx long")
    both = readers.vector_documents(v, u)
    assert {(r.vec_pos, r.doc_idx) for r in both.collect()} == {(0, 0), (1, -1)}
    with pytest.raises(Exception, match="knowledge base"):
        readers.require_documents(both, 1).collect()


def test_questions(spark, tmp_path):
    rows = ["question,answer,dataset_image_ids", "q0,a,1|2", 'q1,"a ""b"", c",', "q2,,nan", "q3,x,007", "q4,y,9"]
    p = put(tmp_path / "q.csv", "\n".join(rows))
    got = readers.questions(spark, p, 0, 4).orderBy("row_idx").collect()
    assert [(r.row_idx, r.question, r.image_ids) for r in got] == [(0, "q0", ["1", "2"]), (3, "q3", ["007"])]
    assert readers.questions(spark, p, 4).first().answer == "y"


def test_id_names_later_file_counts(spark, tmp_path):
    a, b = put(tmp_path / "a.json", '{"1": "x", "2": "y"}'), put(tmp_path / "b.json", '{"1": "z"}')
    assert {(r.id, r.name) for r in readers.id_names(spark, [a, b]).collect()} == {("1", "z"), ("2", "y")}


def test_images(spark, tmp_path):
    for n in ("a/12.jpg", "b/12.png", "a/x.jpg", "a/7.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"i")
    found = readers.image_files(spark, str(tmp_path)).collect()
    assert [(r.id, r.path.endswith("b/12.png")) for r in found] == [("12", True)]
    w = spark.createDataFrame([(1, "12"), (2, "13")], "sample_id long, id string")
    one = spark.createDataFrame([("13", "p")], "id string, path string")
    got = {(r.sample_id, r.path) for r in readers.resolve_images(w, one, spark.createDataFrame([("12", "q"), ("13", "r")], "id string, path string")).collect()}
    assert got == {(1, "q"), (2, "p")}
    paths = spark.createDataFrame([("abcd",), ("ab",)], "i string").select(readers.landmark_path("r", F.col("i"))).collect()
    assert [r[0] for r in paths] == ["r/a/b/c/abcd.jpg", None]


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([(1, "s", 0.1234567, 2.0, 3.00049, True)], "sample_id long, stage string, latency_s double, peak_vram_gb double, energy_j double, is_warmup boolean")
    assert tuple(writers.stage_rows(d).first()) == ("1", "s", "0.123457", "2.000000", "3.000", "1")
    a = spark.createDataFrame([(1, ["x", None, "y"])], "i long, a array<string>")
    writers.write_csv(a, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().a == "x||y"
    writers.write_summary(a.select(F.col("i").alias("b"), F.lit(1).alias("a")), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1,"b":1}'


def test_cache_computes_what_is_missing(spark, tmp_path):
    calls = []

    def compute(s):
        calls.append(sorted(r.sample_id for r in s.collect()))
        return s.withColumn("x", F.col("sample_id") * 2)

    ids = lambda n: spark.range(n).select(F.col("id").alias("sample_id"))
    assert writers.cached(spark, str(tmp_path), {"k": 1}, ids(2), compute).count() == 2
    assert writers.cached(spark, str(tmp_path), {"k": 1}, ids(4), compute).count() == 4
    assert writers.cached(spark, str(tmp_path), {"k": 2}, ids(1), compute).count() == 1
    assert calls == [[0, 1], [2, 3], [0]]


def test_records(spark, tmp_path):
    p = put(tmp_path / "x.json", '[{"a": 1}, {"a": 2}]')
    assert readers.records(spark, p).count() == 2
    with pytest.raises(ValueError):
        readers.records(spark, "x.pkl")
    a = spark.range(3)
    assert readers.mixed([a, a]).count() == 6
    ann = put(tmp_path / "ann.json", json.dumps({"annotations": [{"question_id": 1, "image_id": 2, "question_type": "q", "answer_type": "t", "answers": [{"answer_id": 1, "answer": "x"}]}]}))
    assert readers.annotations(spark, ann).first().answers[0].answer == "x"


def test_knowledge_base_by_lines(spark, tmp_path):
    for k in range(3):
        put(tmp_path / f"{k}.jsonl", "\n".join(json.dumps({"url": f"u{k}{i}", "title": "t"}) for i in range(4)))
    got = readers.knowledge_base(spark, str(tmp_path), lines=True).orderBy("doc_idx").collect()
    assert [r.doc_idx for r in got] == list(range(12)) and len({r.url for r in got}) == 12


def test_unreadable_images_are_blank(spark, tmp_path):
    (tmp_path / "1.jpg").write_bytes(b"img")
    w = spark.createDataFrame([(1, str(tmp_path / "1.jpg")), (2, "/none.jpg")], "sample_id long, path string")
    got = {r.sample_id: bytes(r.content) for r in readers.image_bytes(spark, w, str(tmp_path), b"blank").collect()}
    assert got == {1: b"img", 2: b"blank"}


def test_image_bytes_by_name_and_by_folder(spark, tmp_path):
    for n in ("a", "b", "c"):
        (tmp_path / f"{n}.jpg").write_bytes(n.encode())
    w = spark.createDataFrame([(1, f"{tmp_path}/a.jpg"), (2, f"{tmp_path}/b.jpg"), (3, f"{tmp_path}/gone.jpg")], "sample_id long, path string")
    for listed in (10, 1):
        got = {r.sample_id: bytes(r.content) for r in readers.image_bytes(spark, w, str(tmp_path), b"blank", listed).collect()}
        assert got == {1: b"a", 2: b"b", 3: b"blank"}


def test_arrays(spark, tmp_path):
    import numpy as np
    import pytest

    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    np.save(tmp_path / "v.npy", np.array([7, 8]))
    rows = {(r.path.rsplit("/", 1)[1], r.row): list(r["values"]) for r in readers.arrays(spark, f"{tmp_path}/*.npy").collect()}
    assert rows == {("m.npy", 0): [0.0, 1.0], ("m.npy", 1): [2.0, 3.0], ("m.npy", 2): [4.0, 5.0], ("v.npy", 0): [7.0, 8.0]}
    np.save(tmp_path / "o.npy", np.array([{}], object))
    with pytest.raises(Exception, match="allow_pickle"):
        readers.arrays(spark, f"{tmp_path}/o.npy").collect()
