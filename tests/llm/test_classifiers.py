from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from roadflow.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"


def test_language_accuracy_and_edge_cases(spark):
    got = queries.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[0] > 0.98 and held[1] == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1000))
    texts = [("aa bb", "x"), ("cc dd", "y"), (None, None), ("", "x"), ("123 !!", "y"), ("aa " * 50_000, "x")]
    df = spark.createDataFrame([(i, t, lang, 1.0) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string, score double")
    langs, matrix = langid.train(df)
    out = {r["doc_id"]: r for r in langid.predict(df, langs, matrix, keep=["doc_id"]).collect()}
    assert [out[i]["lang_pred"] for i in range(6)] == ["x", "y", "und", "und", "und", "x"] and all(0 <= r["score"] <= 1 for r in out.values())
    none, empty = langid.train(df.limit(0))
    assert none == [] and {r["lang_pred"] for r in langid.predict(df, none, empty, keep=["doc_id"]).collect()} == {"und"}


def test_language_scores_match_plain_sums():
    rng = np.random.default_rng(0)
    langs, matrix = ["a", "b", "c"], rng.normal(size=(langid.ORDERS * langid.BUCKETS, 3)).astype(np.float32)
    texts = ["hello world", "x", "ÀÉ 12 straße", "", None, "one, two; three"]
    rows, at, has = langid.ngram_buckets(texts)
    names, share = langid.score(texts, langs, matrix)
    for i, t in enumerate(texts):
        total = [sum(float(matrix[b, k]) for order in rows for b in order[at[i] : at[i + 1]]) for k in range(3)]
        best = max(range(3), key=lambda k: total[k])
        assert names[i] == (langs[best] if has[i] else "und")
        assert math.isclose(share[i], 1 / sum(math.exp(x - total[best]) for x in total) if has[i] else 0.0, rel_tol=1e-9)
    one = langid.ngram_buckets(["hello world"])[0]
    again = langid.ngram_buckets(["other text", "hello world", "z"])
    assert (again[0][:, again[1][1] : again[1][2]] == one).all()  # a text's n-grams don't depend on its neighbours


def test_quality_held_out_and_edge_cases(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op7_quality(spark, SF).join(labels, "doc_id").filter("held_out").select("quality", "predicted").collect()
    assert len(got) > 50 and np.mean([r["quality"] == r["predicted"] for r in got]) > 0.95
    w = np.zeros(quality.BUCKETS + 1, np.float32)
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "plain words here", 5), (3, "plain words here", 5), (None, "x " * 100_000, 5)], "doc_id long, text string, predicted int")
    out = quality.predict(df, w, keep=["doc_id"]).collect()
    assert len(out) == 5 and {r["score"] for r in out} == {0.5} and {r["predicted"] for r in out} == {1}
    assert quality.predict(df.limit(0), w, keep=["doc_id"]).count() == 0
    assert (quality.train(df, spark.createDataFrame([], "doc_id long, quality int")) == 0).all()


def test_quality_features_are_words_and_pairs():
    text = "Aa bb BIG!! 12 bb bb".encode()
    data = np.frombuffer(b"zz" + text, np.uint8)
    bucket, where = quality.features(data, np.array([0, 2, len(data)]))
    own = bucket[where[1] : where[2]]
    # aa bb big !! 12 bb bb: seven words, six pairs, one word of capitals
    assert len(own) == 14 and Counter(own.tolist()).most_common(1)[0][1] == 3
    alone, _ = quality.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert sorted(alone.tolist()) == sorted(own.tolist())


def test_ftrl_learns_a_line():
    rng = np.random.default_rng(1)
    lessons = []
    for k in range(400):
        label = k % 2
        i = np.unique(np.append(rng.integers(0, 1000, 5), 2000 + label))
        lessons.append((np.append(i, quality.BUCKETS), np.append(np.full(len(i), 1.0), 0.1), label))
    w = quality.ftrl(lessons)
    assert w[2001] > 0.5 > -0.5 > w[2000]
