"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal, scored as sparse dot products.

Words are runs of letters, runs of digits and runs of other signs; a word of three or more capitals also yields the word
CAPS, and a word equal to the one before yields the pair SAME. A text is the sparse vector of the shares that each hashed
word and pair of words has in it. Training reads a bounded sample of labelled rows; the weights have a fixed size.

Defined results: NULL and empty texts have no words and get the score of the bias alone. Very long texts are scored whole.
Documents whose label is NULL teach nothing; several labels of one id count as their mean, and of several documents of one id one teaches. Without any label every score is
0.5. Equal texts get equal scores. Only ``text`` is read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.common import blocks, bytes_of, cols, map_arrow, mix, ship_package, span_hashes

BUCKETS = 1 << 18
#: Most labelled documents that training reads: the first by a hash of their id. A fixed bound, whatever the input.
TRAIN_ROWS = 6_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-3
THRESHOLD = 0.3

_CLASS = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 other
_CLASS[[*b" \t\n\r\x0b\x0c"]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CAPS, _SAME = np.uint64(0x1234567), np.uint64(0x7654321)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of a block's texts, sorted by text, and where each text's begin (one more at the end)."""
    kind = _CLASS[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[at[at <= len(data)]] = True
    edge = np.flatnonzero(new)
    first, last = edge[:-1], edge[1:]
    word = kind[first] != 0
    first, last = first[word], last[word]
    doc = np.searchsorted(at, first, "right") - 1
    h = span_hashes(_LOWER[data], first, last)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    caps = (upper[last] - upper[first] == last - first) & (last - first >= 3)
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, int)
    left, right = h[pair], h[pair + 1]
    both = np.where(left == right, _SAME, mix(left * np.uint64(3) + right))
    bucket = np.concatenate([h, both, np.full(caps.sum(), mix(_CAPS[None])[0])]) % np.uint64(BUCKETS)
    owner = np.concatenate([doc, doc[pair], doc[caps]])
    order = np.argsort(owner, kind="stable")
    return bucket[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(at)))


def _lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        bucket, at = features(*bytes_of(block.column(2)))
        index, share = [], []
        for a, b in zip(at, at[1:]):
            own, n = np.unique(bucket[a:b], return_counts=True)
            index.append(own.astype(np.int32))
            share.append((n / max(b - a, 1)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [block.column(0), block.column(1), pa.array(index, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["ord", "label", "idx", "val"]
        )


def ftrl(lessons: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias) after ``epochs`` passes of follow-the-regularised-leader."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for i, x, label in lessons:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    return weights(np.arange(BUCKETS + 1))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = []
    for batch in batches:
        at, idx = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
        val = batch.column(3).values.to_numpy()
        for k, (o, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            i, x = idx[at[k] : at[k + 1]], val[at[k] : at[k + 1]]
            got.append((o, len(i), i, x, label))
    got.sort(key=lambda g: (g[0], g[1], g[2].tobytes()))
    lessons = [(np.append(i, BUCKETS).astype(np.int64), np.append(x * 10.0, 0.1), label) for _, _, i, x, label in got]
    yield pa.RecordBatch.from_arrays([pa.array([ftrl(lessons).astype(np.float32).tobytes()], pa.binary())], ["w"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from the documents that ``labels`` (already without held-out rows) names."""
    ship_package(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna().groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    chosen = known.withColumn("ord", F.xxhash64("id")).orderBy("ord", "id").limit(rows)  # a fixed bound, so it may be broadcast
    sample = docs.select(F.col(id_col).alias("id"), "text").join(F.broadcast(chosen), "id")
    lessons = sample.select("ord", "label", "text").mapInArrow(_lessons, "ord long, label int, idx array<int>, val array<float>")
    # one document an id, so that repeated ids bring no more than `rows` of them
    lessons = lessons.groupBy("ord").agg(F.min_by(F.struct("label", "idx", "val"), F.struct(F.size("idx"), F.xxhash64("idx", "val"))).alias("x")).select("ord", "x.*")
    fitted = lessons.repartition(1).mapInArrow(_fit, "w binary").collect()  # at most `rows` sparse vectors in; one row out
    return np.frombuffer(fitted[0]["w"], np.float32) if fitted else np.zeros(BUCKETS + 1, np.float32)


def scores(data: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
    bucket, where = features(data, at)
    n = np.diff(where)
    mean = np.zeros(len(n))
    # a sum of its own for each text, so that a text's score doesn't depend on its neighbours
    some = n > 0
    if some.any():
        mean[some] = np.add.reduceat(w[bucket].astype(np.float64), where[:-1][some]) / n[some]
    return 1 / (1 + np.exp(-np.clip(mean * 10.0 + w[-1] * 0.1, -30, 30)))


def predict(docs: DataFrame, w: np.ndarray, *, keep: list[str], threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns of docs with score and predicted."""
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(w)  # BUCKETS + 1 floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, len(keep)):
            got = scores(*bytes_of(block.column(block.num_columns - 1)), model.value)
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32), pa.int32())], [*keep, *names])

    schema = docs.select(*cols(docs, keep)).schema.add(names[0], "double").add(names[1], "integer")
    return map_arrow(docs.select(*cols(docs, keep), F.col("text").alias("__text")), run, schema)
