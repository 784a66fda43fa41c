"""The pipeline's stages: columns, decisions, and the whole run against its stages one by one (each operator is held against brute force in its own tests)."""

import os

import corpus_pipeline
from rasterloom.llm import queries, storage

from .helpers import documents


def test_stages(spark, tmp_path):
    rows, docs = documents(spark)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "substring_dedup", "best_fit_packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        assert name == names[-1] or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"{k}"))
        before, at = at, spark.read.parquet(str(tmp_path / f"{k}"))
        if name in ("line_dedup", "substring_dedup"):
            assert at.count() == before.count()
        if name in ("language_id", "near_dedup"):
            assert at.exceptAll(before).count() == 0 and at.count() < before.count()
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted(map(str, at.drop("sequence_id", "offset").collect()))


def test_scope_drops_folders(spark):
    with storage.scope():
        inner = storage.Workspace(spark, "inner")
        inner.save(spark.range(3), "t")
        at = inner.path.removeprefix("file://")
        assert os.path.isdir(f"{at}/t")
    outer = storage.Workspace(spark, "outer")
    assert not os.path.exists(at) and outer.save(spark.range(3), "t").count() == 3


def test_empty(spark, tmp_path):
    _, docs = documents(spark)
    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_query_an_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
