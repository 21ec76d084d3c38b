"""The corpus pipeline: five operators in a row, each on all its predecessor kept, with Parquet in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.llm import decontaminate, line_dedup, packing, quality, simhash
from roadflow.llm.common import own_names, table
from roadflow.llm.queries import quality_weights, tokenizer_path
from roadflow.session import written

#: Words of a shingle of the near-duplicate stage.
SHINGLE = 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    score, predicted = own_names(docs, "__score", "__predicted")
    scored = quality.predict(docs, quality_weights(docs, sf_dir), keep=docs.columns, names=(score, predicted))
    return scored.filter(F.col(predicted) == 1).drop(score, predicted)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that also stand earlier; one or two lines of 50 words or more are a run as well."""
    return line_dedup.dedup(docs, long_words=line_dedup.LONG_WORDS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts linked by a Jaccard similarity of 0.8 or more of their shingle sets."""
    return simhash.keep_one(docs, shingle=SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold little of the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack(packing.pieces(docs.select("doc_id", "text"), tokenizer_path()))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
