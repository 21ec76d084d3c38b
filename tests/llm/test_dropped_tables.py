"""What near-dedup writes for one step alone is deleted when that step is done."""

from __future__ import annotations

import glob

import corpus_pipeline
from roadflow.llm import set_join
from roadflow.session import shared_folder


def test_tables_of_one_step_are_deleted(spark):
    words = [f"w{i}" for i in range(200)]
    docs = [(k, " ".join(words[: 199 + k % 2]), "en") for k in range(2)]
    folder = f"{shared_folder(spark)}/roadflow/{spark.sparkContext.applicationId}".removeprefix("file://")
    before = {n: set(glob.glob(f"{folder}/{n}-*")) for n in ("sets", "nodes", "held", "shared")}
    assert corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string"), "").count() == 1
    left = {n: len(set(glob.glob(f"{folder}/{n}-*")) - was) for n, was in before.items()}
    assert left == {"sets": 1, "nodes": 0, "held": 0, "shared": 0}


def test_the_sets_that_stay_hold_no_members(spark):
    """What grows with the length of texts is stored for each distinct set alone, and of that the first members; copies add nothing."""
    text = " ".join(f"w{i}" for i in range(500))
    full = set_join.shingle_sets(spark.createDataFrame([(k, text) for k in range(9)], "doc_id long, text string"), shingle=5)
    assert {len(r["prefix"]) for r in full.collect()} == {496 - 397 + 1}
    sets, one = set_join.split(full)
    assert sets.columns == ["id", "th", "uid", "n", "fp"] and sets.count() == 9
    assert [len(r["prefix"]) for r in one.collect()] == [100]
