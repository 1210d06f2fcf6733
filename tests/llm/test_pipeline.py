"""The pipeline's stages on small tables: each keeps the columns and does what it decides."""

from __future__ import annotations

import corpus_pipeline as C

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [docs.count()]
    for name, stage in C.STAGES[:-1]:
        out = C.written(stage(spark, docs, SF), "test_stage")
        assert out.columns == docs.columns, name
        n.append(out.count())
        docs = out
    assert n[0] > n[1] > n[2] == n[3] > n[4] > 0.8 * n[3]
    assert docs.select("doc_id").distinct().count() == docs.count()
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert docs.where("text like '%[secret]%'").count() > 0


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
