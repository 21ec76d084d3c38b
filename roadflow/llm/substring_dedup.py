"""Substring dedup: remove words covered by runs of ``window`` words that also start earlier.

The corpus is its own reference, so automata of all its shards would have to meet all its documents; their number grows with the
input, and the work with its square (see README). This operator therefore finds the same maximal repeated spans with fingerprints:

1. A window's anchor is its smallest hashed group of ``GRAM`` words; equal windows have equal anchors. About one word in six is
   an anchor. An anchor stands for a span: all windows of its document that it is the anchor of.
2. Anchors meet by hash, packed into one binary value for each bucket of hashes and block of text. If an anchor has one and the
   same span everywhere, all but the earliest are removed whole. Within a block this is decided before anything is sent.
3. An anchor with different spans (an end of a repeat) yields a 128-bit hash for each window of its spans. The earliest place of each
   is a partial aggregate; every other place is removed.
4. The removed spans are joined with their documents' texts; all other documents were finished in the first pass.

No group of equal anchors is ever gathered beyond one entry for each block of text; a bucket that is too large all the same is thinned out
in parts, to one entry for each anchor of a part. A window's places meet only in aggregates and joins.

Defined results: NULL texts have no words. Places are ordered by id (NULL last), then start; rows that share an id do not remove
each other's windows at the same start. Windows are judged on the input. Texts shorter than a window keep all words. An empty
table gives no rows. Columns other than id and text are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from roadflow.llm.common import blocks, bytes_of, mix, parted, powers, ship_package, span_hashes, window_hashes, word_spans
from roadflow.operators.trajectories import numbered
from roadflow.session import written

WINDOW = 20
GRAM = 8
#: Anchors that a bucket is meant to hold; the number of buckets follows the input's size.
BUCKET_ROWS = 200_000
#: Bytes of a bucket's entries that a task gathers; a larger bucket goes in parts.
MOST_IN_BUCKET = 1 << 26
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_GRAM_BASE, _W1, _W2, _SPAN = 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x8EBC6AF09C88C6E3
_LAST = np.int64(2**63 - 1)
_ENTRY = np.dtype([("h", "<u8"), ("c", "<u8"), ("id", "<i8"), ("th", "<i8"), ("s", "<i4"), ("m", "u1"), ("many", "u1")])


def anchors(words: np.ndarray, doc: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For each anchor of a block's texts: its hash, its span's hash, first window and number of windows (places in the block)."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    g = window_hashes(words, gram, _GRAM_BASE)
    low, at, size, most = g, np.arange(len(g)), 1, window - gram + 1
    while size < most:  # the smallest of twice as many groups, then of all; the first one on ties
        step = min(size, most - size)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        size += step
    s = np.flatnonzero(doc[: n] == doc[window - 1 :])
    if not len(s):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    p = at[s]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]))
    first, times = s[new], np.diff(np.append(new, len(s)))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words ^ np.uint64(_SPAN)) * powers(_SPAN, len(words)), out=total[1:])
    c = (total[first + times + window - 1] - total[first]) * powers(pow(_SPAN, -1, 1 << 64), len(words))[first]
    c = mix(c ^ (times * 64 + (p[new] - first)).astype(np.uint64))
    return g[p[new]], c, first, times


def settle(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted entries, and for each: later in the list than an equal span of its anchor; its anchor has several spans (or is marked).

    An equal place (repeated rows of one id) is not later.
    """
    e = e[np.lexsort((e["s"], e["id"], e["c"], e["h"]))]
    n = len(e)
    new_h = np.concatenate([[True], e["h"][1:] != e["h"][:-1]])
    new_c = new_h | np.concatenate([[True], e["c"][1:] != e["c"][:-1]])
    head = np.maximum.accumulate(np.where(new_c, np.arange(n), 0))
    later = (e["id"] != e["id"][head]) | (e["s"] != e["s"][head])
    group = np.cumsum(new_h) - 1
    several = np.bincount(group, new_c) > 1
    several |= np.bincount(group, e["many"]) > 0
    return e, later, several[group]


class _Block:
    def __init__(self, block: pa.RecordBatch, text: int) -> None:
        self.data, self.at = bytes_of(block.column(text))
        self.first, self.last, self.doc = word_spans(self.data, self.at, _IN_WORD)
        self.words = span_hashes(self.data, self.first, self.last)
        self.begin = np.searchsorted(self.doc, np.arange(len(self.at)))  # words before each text


_PASS = "kind byte, bucket int, blob binary, id long, th long, s int, m int, w1 long, w2 long, sha string"
_NAMES = ("kind", "bucket", "blob", "id", "th", "s", "m", "w1", "w2", "sha")
_TYPES = (pa.int8(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
_DOC, _BLOB, _REMOVED, _WINDOW_HASH = range(4)


def _rows(kind: int, n: int, **given) -> pa.RecordBatch:
    columns = [pa.array(np.full(n, kind, np.int8)) if k == "kind" else given[k] if k in given and isinstance(given[k], pa.Array) else pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in zip(_NAMES, _TYPES)]
    return pa.RecordBatch.from_arrays(columns, list(_NAMES))


def _ids(ids: np.ndarray) -> pa.Array:
    """Ids of entries; the last long stands for NULL."""
    return pa.array(ids, pa.int64(), mask=ids == _LAST)


def _scan(buckets: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            b = _Block(block, 2)
            raw, begin = b.data.tobytes(), b.begin.tolist()
            spans = list(zip(b.first.tolist(), b.last.tolist()))
            sha = [hashlib.sha256(b" ".join([raw[x:y] for x, y in spans[i:j]])).hexdigest() for i, j in zip(begin, begin[1:])]
            yield _rows(_DOC, block.num_rows, id=block.column(0), th=block.column(1), s=np.diff(b.begin).astype(np.int32), sha=sha)
            h, c, s, m = anchors(b.words, b.doc, window)
            e = np.zeros(len(h), _ENTRY)
            of = b.doc[s] if len(s) else s
            ids, th = np.asarray(block.column(0).fill_null(int(_LAST)), np.int64), np.asarray(block.column(1), np.int64)
            e["h"], e["c"], e["id"], e["th"], e["s"], e["m"] = h, c, ids[of], th[of], s - b.begin[of], m
            place = np.zeros(len(h), np.int64)
            order = np.lexsort((e["s"], e["id"], e["c"], e["h"]))
            place = s[order]
            e, later, several = settle(e)
            yield _rows(_REMOVED, int(later.sum()), id=_ids(e["id"][later]), th=e["th"][later], s=e["s"][later], m=e["m"][later].astype(np.int32))
            yield from _window_rows(b, place[several & ~later], e[several & ~later], window)
            # one entry for each anchor: its earliest place, or a mark that it has several spans here
            e["many"] = several
            ahead = np.flatnonzero(np.concatenate([[True], e["h"][1:] != e["h"][:-1]])) if len(e) else np.zeros(0, int)
            same = ~later & ~several
            same[ahead] = True
            e = e[same]
            bucket = (e["h"] >> np.uint64(32)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(e) else np.zeros(1, int)
            planes = [np.ascontiguousarray(e[i:j].view(np.uint8).reshape(j - i, -1).T).tobytes() for i, j in zip(edge, edge[1:])]  # bytes of one rank side by side compress well
            yield _rows(_BLOB, len(planes), bucket=bucket[edge[:-1]].astype(np.int32), blob=planes)

    return run


def _window_rows(b: _Block, place: np.ndarray, e: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    if not len(e):
        return
    w1, w2 = window_hashes(b.words, window, _W1), window_hashes(b.words, window, _W2)
    m = e["m"].astype(np.int64)
    step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    at = np.repeat(place, m) + step
    yield _rows(_WINDOW_HASH, len(at), id=_ids(np.repeat(e["id"], m)), th=np.repeat(e["th"], m), s=(np.repeat(e["s"], m) + step).astype(np.int32), w1=w1[at].view(np.int64), w2=w2[at].view(np.int64))


_REPLY = "id long, th long, s int, m int, several boolean"
_REPLY_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())


def _entries(found: pa.Table) -> np.ndarray:
    raw = [np.frombuffer(x, np.uint8).reshape(_ENTRY.itemsize, -1).T for x in found.column("blob").to_pylist()]
    return np.ascontiguousarray(np.concatenate(raw)).reshape(-1).view(_ENTRY) if raw else np.zeros(0, _ENTRY)


def _told(e: np.ndarray, several: np.ndarray) -> list[pa.Array]:
    return [_ids(e["id"]), pa.array(e["th"]), pa.array(e["s"]), pa.array(e["m"].astype(np.int32)), pa.array(several)]


def _meet(found: pa.Table) -> pa.Table:
    """One bucket's entries: spans to remove, and those whose windows are to be looked at one by one."""
    e, later, several = settle(_entries(found))
    told = (later | several) & (e["many"] == 0)
    several &= ~later  # an equal span stands earlier, so its windows do
    return pa.table(_told(e[told], several[told]), ["id", "th", "s", "m", "several"])


def _thin(found: pa.Table) -> pa.Table:
    """A part of a bucket that is too large: what is settled within the part, and a blob with one entry for each anchor of it."""
    bucket = found.column("bucket")[0].as_py()
    e, later, several = settle(_entries(found))
    told = (later | several) & (e["many"] == 0)
    rows = [*_told(e[told], (several & ~later)[told]), pa.nulls(int(told.sum()), pa.int32()), pa.nulls(int(told.sum()), pa.binary())]
    e["many"] |= several
    one = e[np.flatnonzero(np.concatenate([[True], e["h"][1:] != e["h"][:-1]]))] if len(e) else e
    blob = np.ascontiguousarray(one.view(np.uint8).reshape(len(one), -1).T).tobytes()
    left = [*(pa.nulls(1, t) for t in _REPLY_TYPES), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())]
    names = ["id", "th", "s", "m", "several", "bucket", "blob"]
    return pa.concat_tables([pa.table(rows, names), pa.table(left, names)])


def _met(blobs: DataFrame, most: int) -> DataFrame:
    """What all buckets settle. A bucket of over ``most`` bytes, whose anchors many blocks share, is dealt out in parts first, which leave one entry for each anchor."""
    sizes = written(blobs.groupBy("bucket").agg(F.sum(F.octet_length("blob")).alias("n")).filter(F.col("n") > most), "large")
    if sizes.isEmpty():
        return written(blobs.groupBy("bucket").applyInArrow(_meet, _REPLY), "told")
    marked = blobs.join(sizes, "bucket", "left")
    part = F.pmod(F.xxhash64("blob"), F.ceil(F.col("n") / most)).cast("int")
    thin = marked.filter("n IS NOT NULL").withColumn("part", part).groupBy("bucket", "part").applyInArrow(_thin, _REPLY + ", bucket int, blob binary")
    thin = written(thin, "thin")
    rest = marked.filter("n IS NULL").select("bucket", "blob").unionByName(thin.filter("blob IS NOT NULL").select("bucket", "blob"))
    told = rest.groupBy("bucket").applyInArrow(_meet, _REPLY)
    return written(told.unionByName(thin.filter("blob IS NULL").drop("bucket", "blob")), "told")


def _by_document(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("s", "m"))).alias("spans"))


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the documents in ``wanted`` (a stored table by id and th) with its columns. docs: id, text."""
    w = wanted.withColumnsRenamed({"id": "wid"}).hint("merge")
    some = parted(docs, "id", wanted)[1].withColumn("own", F.xxhash64("text"))
    return some.join(w, F.col("id").eqNullSafe(F.col("wid")) & (F.col("own") == F.col("th"))).select("id", "th", "text", "spans")


def _windows_of(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            b = _Block(block, 2)
            spans = block.column(3)
            flat = pa.RecordBatch.from_struct_array(spans.flatten())
            n = np.asarray(spans.value_lengths(), np.int64)
            of = np.repeat(np.arange(block.num_rows), n)
            e = np.zeros(len(of), _ENTRY)
            e["id"], e["th"] = np.asarray(block.column(0).fill_null(int(_LAST)), np.int64)[of], np.asarray(block.column(1), np.int64)[of]
            e["s"], e["m"] = flat.column(0), flat.column(1)
            yield from _window_rows(b, b.begin[of] + e["s"], e, window)

    return run


def _apply(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            b = _Block(block, 2)
            raw = b.data.tobytes()
            out = ([], [], [])
            for i, spans in enumerate(block.column(3).to_pylist()):
                lo, hi = int(b.begin[i]), int(b.begin[i + 1])
                edge = np.zeros(hi - lo + 1, np.int64)
                for x in spans:
                    edge[x["s"]] += 1
                    edge[x["s"] + x["m"] + window - 1] -= 1
                keep = np.flatnonzero(np.cumsum(edge)[:-1] == 0) + lo
                out[0].append(hi - lo)
                out[1].append(hi - lo - len(keep))
                out[2].append(b" ".join([raw[x:y] for x, y in zip(b.first[keep].tolist(), b.last[keep].tolist())]).decode())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["id", "n_words", "n_removed", "kept"])

    return run


def _input_bytes(docs: DataFrame) -> int:
    """From the files' sizes, without a scan; a source that can't tell is added up."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", window: int = WINDOW, buckets: int | None = None, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 (of the kept words, joined by blanks) of each row. Ids of other types than whole numbers are numbered in their order."""
    spark = docs.sparkSession
    ship_package(spark)
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        place, own = "__place", docs.select(F.col(id_col).alias("__own"), "text")
        places = numbered(own.select("__own").filter("__own IS NOT NULL").distinct(), ("__own",), place)
        out = dedup(own.join(places, "__own", "left").select(place, "text"), id_col=place, window=window, buckets=buckets, most_in_bucket=most_in_bucket)
        return out.join(places, place, "left").select(F.col("__own").alias(id_col), "n_words", "n_removed", "kept_sha256")
    number = F.col(id_col).cast("long")
    number = F.when(number == int(_LAST), F.raise_error(F.lit("the largest long is no id"))).otherwise(number)
    docs = docs.select(number.alias("id"), F.xxhash64("text").alias("th"), "text")
    if buckets is None:
        buckets = min(1 << 30, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), _input_bytes(docs) // 4 // BUCKET_ROWS))
    scan = written(docs.mapInArrow(_scan(buckets, window), _PASS), "anchors")
    blobs = scan.filter(F.col("kind") == _BLOB).select("bucket", "blob")
    told = _met(blobs, most_in_bucket)
    split = written(_by_document(told.filter("several")), "several")
    hashed = _with_texts(docs.drop("th"), split).mapInArrow(_windows_of(window), _PASS).select("id", "th", "s", "w1", "w2")
    every = written(hashed.unionByName(scan.filter(F.col("kind") == _WINDOW_HASH).select("id", "th", "s", "w1", "w2")), "windows")
    place = F.struct(F.coalesce("id", F.lit(int(_LAST))).alias("id"), "s")
    first = written(every.groupBy("w1", "w2").agg(F.min(place).alias("place"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    late = every.join(first, ["w1", "w2"]).filter(place > F.col("place")).select("id", "th", "s", F.lit(1).alias("m"))
    removed = late.unionByName(told.filter("NOT several").select("id", "th", "s", "m")).unionByName(scan.filter(F.col("kind") == _REMOVED).select("id", "th", "s", "m"))
    removed = written(_by_document(removed), "removed")
    changed = _with_texts(docs.drop("th"), removed).mapInArrow(_apply(window), "id long, n_words long, n_removed long, kept string")
    whole = scan.filter(F.col("kind") == _DOC).alias("a").join(removed.select(F.col("id").alias("rid"), F.col("th").alias("rth")), F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left_anti")
    whole = whole.select("id", F.col("s").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    out = whole.unionByName(changed.select("id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))
    return out.withColumnRenamed("id", id_col)
