"""The corpus pipeline stage by stage."""

from __future__ import annotations

import corpus_pipeline
from conftest import SMALL
from llm.odd import documents


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SMALL))
        seen.append((name, docs.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert [n for n, _ in seen] == [n for n, _ in corpus_pipeline.STAGES]
    assert all(n > 0 for _, n in seen)
    assert seen[1][1] == seen[0][1] >= seen[2][1]
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_odd_and_empty_tables(spark):
    for empty in (False, True):
        docs = documents(spark, empty)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            assert docs.columns == columns, name
            docs = corpus_pipeline.cut(stage(spark, docs, SMALL))
        assert (docs.count() == 0) == empty
