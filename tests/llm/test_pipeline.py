from __future__ import annotations

import re

import __spark_entry__
import corpus_pipeline
from roadflow.llm import queries


def test_stages_on_a_small_table(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = str(tmp_path / str(k))
        stage(spark, docs, sf).write.parquet(path)
        new = spark.read.parquet(path)
        assert new.columns == docs.columns and new.count() <= counts[-1]
        assert new.join(docs, "doc_id", "left_anti").count() == 0
        counts.append(new.count())
        docs = new
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == counts[4]


def test_stages_take_odd_tables(spark):
    rows = [(None, None, "en", "s", None, 1), (1, "", None, "s", 0, 2), (1, "", None, "s", 0, 2), (2, "good words " * 30, "en", None, 330, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, "/root/testdata/sf0.001")
            assert frame.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, frame, "/root/testdata/sf0.001").collect()


def test_all_registered():
    names = set(__spark_entry__.queries())
    assert {n for n in range(1, 11) if any(re.match(rf"op{n}_", x) for x in names)} == set(range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= names
