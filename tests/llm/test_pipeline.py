import os

import corpus_pipeline
import pytest
from helpers import odd_docs, prose

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd_docs(spark))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
            continue
        assert out.columns == columns, name
        rows = out.collect()
        sizes.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    kept = {r.doc_id for r in docs.collect()}
    assert all(labels.get(i, 1) for i in kept)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered(spark):
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{n}" for n in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
    assert entry.queries()["pipeline"](spark, SF).columns[:3] == ["doc_id", "start", "length"]


def test_boilerplate_of_a_large_source_goes(spark):
    rows = [(i, ("Home | About\n" if i < 25 else "") + prose(60, i), "en", "big", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert len(kept) == 300 and [r.doc_id for r in kept if "Home" in r.text] == [0]
