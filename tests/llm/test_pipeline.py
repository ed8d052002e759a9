"""The pipeline: each stage on its own input, against plain versions of its decision."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__ as entry
from quarryline.llm.personal import find, train
from quarryline.llm.simhash import fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark, tmp_path):
    from test_decontaminate import brute as contaminated
    from test_simhash import groups

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        kept[name] = ({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in spark.read.parquet(str(tmp_path / name)).collect()})
        docs = spark.read.parquet(str(tmp_path / name))
    before, after = kept["language_id"]
    assert set(after) == {i for i, t in before.items() if t and any(map(str.isalpha, t))}
    before, after = kept["near_duplicates"]
    ids = sorted(before)
    own = groups([fingerprint(before[i]) for i in ids])
    assert sorted(after) == sorted(min(i for i, g in zip(ids, own) if g == x) for x in set(own))
    before, after = kept["benchmark"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(after) == sorted(i for i, _, _, _, _, bad, _ in contaminated(sorted(before.items()), items) if not bad)
    before, after = kept["personal_data"]
    assert set(before) == set(after)
    field = train()
    for i, r in after.items():
        if not find(before[i], field)[1]:
            assert r.text == before[i]
        else:
            assert r.text != before[i] and r.n_chars == len(r.text)
    before, after = kept["encoding"]
    assert set(before) == set(after) and all(r.round_trip for r in after.values())
    assert sorted(r.doc_id for r in entry.queries()["pipeline"](spark, sf).collect()) == sorted(after)


def test_odd_rows(spark, make, odd):
    for rows in (odd, []):
        docs = make(rows, extra=True)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() <= len(rows)
