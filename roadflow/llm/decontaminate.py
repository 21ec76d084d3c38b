"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows (``WINDOW`` consecutive words; a shorter item is one window) are sets of word shingles. To contain a window a document
must contain every one of its shingles, so the rarest one, by a count over all documents, is the only prefix needed. Documents
emit the places of prefix shingles, which a filter of fixed size picks out, with the words around them; these join the windows by
shingle. A place and the shingle's position in the window say where the window would start (positional bound) and end (length
bound); then the words themselves are compared.

Defined results: NULL texts have no words, no hits, and are not contaminated; items without words have no windows. An item with a NULL id
can hit but is neither counted nor listed. Repeated items each count. Repeated documents each get their row. An empty benchmark hits
nothing. Columns other than id and text are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.common import blocks, bytes_of, own_names, parted, ship_package, span_hashes, window_hashes, word_spans
from roadflow.session import written

WINDOW = 13
SHINGLE = 5
#: Bits of the filter of wanted shingles: a fixed size; a larger benchmark fills it and more places are sent, none is missed.
FILTER_BITS = 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASES = {k: 0x9E3779B97F4A7C15 + 0x10000000000 * k + 0x2000 * k for k in range(1, SHINGLE + 1)}


class _Words:
    def __init__(self, column: pa.Array) -> None:
        data, at = bytes_of(column)
        self.data = _LOWER[data]
        self.raw = self.data.tobytes()
        self.first, self.last, self.doc = word_spans(self.data, at, _IN_WORD)
        self.hash = span_hashes(self.data, self.first, self.last)
        self.begin = np.searchsorted(self.doc, np.arange(len(at)))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k words in a row of one text, and the places of their first words."""
        h = window_hashes(self.hash, k, _BASES[k])
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[k - 1 :]) if len(h) else np.zeros(0, np.int64)
        return h[at], at

    def text(self, a: int, b: int) -> bytes:
        return b" ".join([self.raw[x:y] for x, y in zip(self.first[a:b].tolist(), self.last[a:b].tolist())])


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            w, out = _Words(block.column(1)), []
            for row, (a, b) in enumerate(zip(w.begin.tolist(), w.begin[1:].tolist())):
                size = min(window, b - a)
                k = min(SHINGLE, size)
                if not size:
                    continue
                h = window_hashes(w.hash[a:b], k, _BASES[k])
                for s in range(b - a - size + 1):
                    own = h[s : s + size - k + 1].view(np.int64).tolist()
                    out.append((row, size, k, w.text(a + s, a + s + size), [{"h": x, "o": o} for o, x in enumerate(own)]))
            kind = pa.list_(pa.struct([("h", pa.int64()), ("o", pa.int32())]))
            yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array([x[0] for x in out], pa.int64())), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), kind), 1))], ["item", "size", "k", "words", "shingles"])

    return run


def _filter(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash in column h."""
    got = hashes.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).cast("int").alias("b")).distinct().toArrow().column("b")  # at most 2**FILTER_BITS
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[got.to_numpy()] = True
    return np.packbits(bits)


def _wanted(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    b = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1


def _count(bits, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            w = _Words(block.column(0))
            for k in sizes:
                h, _ = w.shingles(k)
                h, n = np.unique(h[_wanted(h, bits.value)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return run


def _places(bits, sizes: list[int], window: int, schema_names: list[str]):
    kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("from", pa.int64()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            w = _Words(block.column(2))
            begin, found = w.begin.tolist(), [[] for _ in range(block.num_rows)]
            for k in sizes:
                h, at = w.shingles(k)
                keep = _wanted(h, bits.value)
                reach = window - k if k == SHINGLE else 0  # a shorter shingle is its whole window
                for x, p in zip(h[keep].view(np.int64).tolist(), at[keep].tolist()):
                    row = int(w.doc[p])
                    a, b = max(begin[row], p - reach), min(begin[row + 1], p + k + reach)
                    found[row].append({"h": x, "at": p - begin[row], "from": a - begin[row], "words": w.text(a, b)})
            yield pa.RecordBatch.from_arrays([*block.columns[:2], pa.array(np.diff(w.begin)), pa.array(found, kind)], schema_names)

    return run


def find(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """id, th (xxhash64 of the text), n_words, n_hit, items (sorted strings) and contaminated of each row of docs."""
    spark = docs.sparkSession
    ship_package(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col("text"))
    windows = written(items.mapInArrow(_item_windows(window), "item string, size int, k int, words string, shingles array<struct<h:long,o:int>>"), "windows")
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("th"), "text")
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect())  # 1 to SHINGLE
    each = windows.select("words", "size", F.explode("shingles").alias("x")).select("words", "size", "x.h", "x.o").distinct()
    bits = spark.sparkContext.broadcast(_filter(each))
    counts = written(docs.select("text").mapInArrow(_count(bits, sizes), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    rarest = each.join(counts, "h").groupBy("words", "size").agg(F.min(F.struct("n", "h", "o")).alias("x"), F.count_distinct("h").alias("seen"))
    # a window with a shingle that no document has can't occur
    need = windows.select("words", F.size(F.array_distinct("shingles.h")).alias("need")).distinct()
    prefix = written(rarest.join(need, "words").filter("seen = need").select("words", "size", "x.h", "x.o"), "prefix")
    shared = spark.sparkContext.broadcast(_filter(prefix))
    names = ["id", "th", "n_words", "places"]
    schema = f"id {docs.schema['id'].dataType.simpleString()}, th long, n_words long, places array<struct<h:long,at:long,from:long,words:string>>"
    scan = written(docs.mapInArrow(_places(shared, sizes, window, names), schema).withColumn("uid", F.monotonically_increasing_id()), "places")
    at = scan.filter(F.size("places") > 0).select("uid", "n_words", F.explode("places").alias("p")).select("uid", "n_words", "p.*")
    p = prefix.select("h", "o", "size", F.col("words").alias("wanted"))
    start = F.col("at") - F.col("o")
    met = at.join(p, "h").filter((start >= F.col("from")) & (start + F.col("size") <= F.col("n_words")))
    met = met.filter(F.array_join(F.slice(F.split("words", " "), (start - F.col("from") + 1).cast("int"), F.col("size")), " ") == F.col("wanted"))
    owners = written(windows.select("item", F.col("words").alias("wanted")).distinct(), "owners")
    hits = met.select("uid", start.alias("s"), (start + F.col("size")).alias("e"), "wanted").join(owners, "wanted")
    end = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(F.sort_array(F.collect_set(F.struct("s", "e"))), end, lambda a, x: F.struct(F.greatest(a["at"], x["e"]).alias("at"), (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["at"], x["s"]))).alias("n")), lambda a: a["n"])
    by_doc = hits.groupBy("uid").agg(covered.alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))
    out = scan.select("uid", "id", "th", "n_words").join(by_doc, "uid", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), "th", "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """docs without the contaminated ones. Rows of equal id and text share their fate."""
    bad = written(find(docs, benchmark, id_col=id_col).filter("contaminated").select(F.col(id_col).alias("id"), "th").distinct(), "contaminated")
    stay, maybe = parted(docs, id_col, bad)
    bid, bth = own_names(docs, "__id", "__th")
    bad = bad.select(F.col("id").alias(bid), F.col("th").alias(bth)).hint("merge")
    return stay.unionByName(maybe.join(bad, F.col(id_col).eqNullSafe(F.col(bid)) & (F.xxhash64("text") == F.col(bth)), "left_anti"))
