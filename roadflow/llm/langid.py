"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams (1 to 3 characters) per language over a bounded sample of labelled rows;
the resulting log-probability matrix has a fixed number of rows (ORDERS x BUCKETS) and is broadcast.
Scoring is a sparse product in numpy: the matrix rows of a text's n-grams are gathered and summed.

Defined results: a NULL text or one without any letter gets ``und`` with score 0.0; so does every text where no labelled
row exists. Very long texts are scored whole. Equal rows give equal rows. Ties between languages go to the smallest value.
Only ``text`` is read for a prediction; further columns of the input are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.common import blocks, cols, map_arrow, ship_package

ORDERS = 3
BUCKETS = 1 << 15
#: Most labelled rows that training reads: the first by a hash of their id. A fixed bound, whatever the input.
TRAIN_ROWS = 12_000
SMOOTHING = 0.5
#: n-grams of one long text whose matrix rows are gathered at once.
SLICE = 1 << 19
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x10000)], bool)


_table: list[np.ndarray] = []


def ngram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix rows of all n-grams of all texts (shape: ORDERS x characters), text boundaries, and which texts have a letter.

    Texts are lower-cased and every non-letter counts as one blank; an n-gram never crosses a text's end.
    """
    if not _table:
        _table.append(_letters())
    low = [" " + (t or "").lower() + " " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t) for t in low])])
    letter = _table[0][np.minimum(code, 0xFFFF)]
    for i in np.flatnonzero(code > 0xFFFF).tolist():
        letter[i] = chr(code[i]).isalpha()
    code = np.where(letter, code, np.uint32(32)).astype(np.uint32)
    some = np.concatenate([[0], np.cumsum(letter)])
    has = some[at[1:]] > some[at[:-1]]
    # runs of blanks count once
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    keep[at[:-1][at[:-1] < len(code)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    code, at = code[keep], kept[at]
    out = np.empty((ORDERS, len(code)), np.int32)
    h = np.zeros(len(code), np.uint32)
    for n in range(ORDERS):
        moved = np.full(len(code), 32, np.uint32)
        moved[: len(code) - n] = code[n:]
        h = (h ^ moved) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out[n] = n * BUCKETS + ((h * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int32)
        for back in range(n):  # n-grams that would cross a text's end share one bucket
            out[n][np.maximum(at[1:] - 1 - back, 0)] = n * BUCKETS
    return out, at, has


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for block in blocks(batches):
        lang = block.column(1).to_pylist()
        rows, at, _ = ngram_buckets(block.column(0).to_pylist())
        for name in set(lang):
            mine = np.repeat(np.array([x == name for x in lang]), np.diff(at))
            add = np.bincount(rows[:, mine].ravel(), minlength=ORDERS * BUCKETS)
            counts[name] = counts[name] + add if name in counts else add
    for name in sorted(counts):
        bucket = np.flatnonzero(counts[name])
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(counts[name][bucket], pa.int64())], ["lang", "bucket", "n"]
        )


def train(labelled: DataFrame, *, id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (buckets x languages). labelled: id, text, lang, all rows allowed as lessons."""
    spark = labelled.sparkSession
    ship_package(spark)
    labelled = labelled.select(F.col(id_col).alias("id"), "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    chosen = labelled.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(rows)
    sample = labelled.join(F.broadcast(chosen), "id", "left_semi").select("text", "lang")  # at most `rows` ids: a fixed bound
    counts = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # at most ORDERS x BUCKETS rows a language, whatever the input
    langs = sorted(set(got.column("lang").to_pylist()))
    matrix = np.full((ORDERS * BUCKETS, len(langs)), SMOOTHING)
    place = {x: i for i, x in enumerate(langs)}
    np.add.at(matrix, (got.column("bucket").to_numpy(), np.array([place[x] for x in got.column("lang").to_pylist()], int)), got.column("n").to_numpy())
    for n in range(ORDERS):
        part = matrix[n * BUCKETS : (n + 1) * BUCKETS]
        part /= part.sum(axis=0, keepdims=True) if len(langs) else 1
    return langs, np.log(matrix).astype(np.float32)


def score(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its share of the posterior (of equal priors)."""
    rows, at, has = ngram_buckets(texts)
    out, share = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not langs or not len(texts):
        return out, share
    total = np.zeros((len(texts), len(langs)))
    for order in rows:
        if len(texts) > 1 or len(order) <= SLICE:
            total += np.add.reduceat(matrix[order].astype(np.float64), at[:-1], axis=0)  # every text has its padding, so no empty slice
        else:  # a long text is alone in its block: a slice at a time
            for k in range(0, len(order), SLICE):
                total[0] += np.add.reduceat(matrix[order[k : k + SLICE]].astype(np.float64), [0], axis=0)[0]
    best = total.argmax(axis=1)
    share = np.where(has, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
    return [langs[b] if h else UNKNOWN for b, h in zip(best, has)], share


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, *, keep: list[str]) -> DataFrame:
    """``keep`` columns of docs with lang_pred and score."""
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast((langs, matrix))  # ORDERS x BUCKETS x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for block in blocks(batches, len(keep)):
            lang, share = score(block.column(block.num_columns - 1).to_pylist(), names, table)
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(lang, pa.string()), pa.array(share, pa.float64())], [*keep, "lang_pred", "score"])

    schema = docs.select(*cols(docs, keep)).schema.add("lang_pred", "string").add("score", "double")
    return map_arrow(docs.select(*cols(docs, keep), F.col("text").alias("__text")), run, schema)
