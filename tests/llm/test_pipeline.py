"""The pipeline's stages: columns, decisions, odd rows."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from trendloom.llm import golay_simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        left.append(docs.count())
    assert left == sorted(left, reverse=True) and 0 < left[-1] < left[0] < 200
    groups = golay_simhash.simhash_groups(docs)
    assert groups.filter("doc_id = component_id").count() > 0
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_stages_stand_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "some words", None, "s", 10)]
    docs = spark.createDataFrame(rows, schema)
    near = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in near.collect()) == ["1", "2", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).isEmpty()
        stage(spark, docs, SF).collect()


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
