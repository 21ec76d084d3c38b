"""Shared pieces of the operators on documents: reading, Arrow blocks, hashed words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from roadflow.session import ship_package as _ship_package

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """``session.ship_package``, and batches of 1,000 whole texts where the session has no choice of its own: Spark's 10,000 are too many for a small executor."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, "1000")
    _ship_package(spark)


#: Bytes of text that a kernel holds at once; a longer single text forms a block of its own.
BLOCK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: Column) -> Column:
    """crc32 of an id as text; NULL for a NULL id."""
    return F.crc32(column.cast("string").cast("binary"))


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, made from these."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cols(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """df's columns by name, whatever signs the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in (df.columns if names is None else names)]


_frugal: list[bool] = []


def _return_memory() -> None:
    """From now on this worker gives what it frees back to the machine: several workers share an executor's memory with its JVM.

    Freed arrays of 256 kB and more go back at once (glibc would raise that limit by itself, and keep them), and Arrow takes its memory from there too.
    """
    if _frugal:
        return
    _frugal.append(True)
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):  # another C library
        return
    for what, value in ((-3, 1 << 18), (-1, 1 << 20), (-8, 1)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
        mallopt(what, value)
    pa.set_memory_pool(pa.system_memory_pool())


def blocks(batches: Iterator[pa.RecordBatch], text: str | int = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each, so that memory doesn't follow the batch size."""
    _return_memory()
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text))
        size = np.diff(offsets_of(column))
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets of the strings of a (possibly sliced) string or binary array."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    return np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * width).astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All strings of a block back to back as bytes, and their offsets (from 0); NULL counts as empty."""
    at = offsets_of(column)
    if not len(column) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    if column.null_count and np.diff(at)[~np.asarray(column.is_valid())].any():  # NULLs may own bytes
        return bytes_of(column.fill_null(""))
    return data, at - at[0]


def strings_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string; NULL counts as empty."""
    data, at = bytes_of(column)
    whole, at = data.tobytes(), at.tolist()
    return [whole[a:b] for a, b in zip(at, at[1:])]


def map_arrow(df: DataFrame, run, schema: StructType) -> DataFrame:
    """``mapInArrow`` for any column names, those with dots too; the kernel goes by position."""
    inside = [f"c{i}" for i in range(len(schema))]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, inside)

    out = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(named, StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(inside, schema)]))
    return out.toDF(*schema.names)


#: Bits of the filter of wanted rows: a fixed size; when it is full, more rows go through a join than need be.
FILTER_BITS = 22


def bits_of(wanted: DataFrame, key: str) -> tuple[Broadcast, Callable[[Column], Column]]:
    """A filter of fixed size with a bit for each key, a long, of ``wanted`` (a stored table), and what gives a key's place in it; for ``may_be``."""
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("__bit")
    found = wanted.select(place(F.col(key)).cast("int").alias("b")).distinct().toArrow().column("b")  # at most 2**FILTER_BITS
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[found.to_numpy()] = True
    return wanted.sparkSession.sparkContext.broadcast(np.packbits(bits)), place


def may_be(bits: Broadcast, places: pa.Array) -> pa.Array:
    b = np.asarray(places, np.int64)
    return pa.array((bits.value[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1)


def may_be_in(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose key, a long, may be in ``wanted`` (a stored table), by a filter of fixed size: all that are, and few others."""
    ship_package(df.sparkSession)
    bits, place = bits_of(wanted, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _return_memory()
        for batch in batches:
            mine = may_be(bits, batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([c.filter(mine) for c in batch.columns[:-1]], batch.schema.names[:-1])

    return df.select("*", place(F.col(key))).mapInArrow(run, df.schema)


def parted(docs: DataFrame, id_col: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs that are surely not in ``wanted``, and those that may be. wanted: a stored table of id and th (xxhash64 of text).

    A filter of fixed size with a bit for each wanted row keeps most texts out of the join that settles the others. docs may have any columns.
    """
    ship_package(docs.sparkSession)
    bit = lambda i, t: F.xxhash64(i, t).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    found = wanted.select(bit(F.col("id"), F.col("th")).cast("int").alias("b")).distinct().toArrow().column("b")  # at most 2**FILTER_BITS
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[found.to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    marked = docs.select("*", bit(F.col(id_col), F.xxhash64("text")).alias(own_names(docs, "__bit")[0]))
    at = docs.columns.index("text")

    def side(wanted_bit: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches, at):
                b = np.asarray(batch.column(batch.num_columns - 1), np.int64)
                mine = (shared.value[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == wanted_bit
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(mine)) for c in batch.columns[:-1]], batch.schema.names[:-1])

        return map_arrow(marked, run, docs.schema)

    return side(0), side(1)


# ------------------------------------------------------------------ hashed words

_ODD = np.uint64(0x9E3779B97F4A7C15)
_P = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, from a table that doubles as it grows."""
    have = _powers.get(base)
    if have is None:
        have = np.array([1, base], np.uint64)
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, at: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of its text. in_word: 256 booleans, by byte."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = in_word[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = at[:-1][np.diff(at) > 0]  # words of neighbouring texts are apart
    before[starts] = False
    after[starts[1:] - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return first, last, np.searchsorted(at, first, "right") - 1


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span [first, last), equal for equal bytes wherever they stand."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = last - first
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)  # of each byte in its span
    raw = np.add.reduceat((data[np.repeat(first, size) + place].astype(np.uint64) + np.uint64(1)) * powers(_P, int(size.max()))[place], begin)
    return mix(raw ^ size.astype(np.uint64) * _ODD)


def window_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` consecutive word hashes; one entry for each start that has a whole window."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + np.uint64(base & 0xFFFF)) * powers(base, len(words)), out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), n)
    return mix((total[size:] - total[:-size]) * inverse)
