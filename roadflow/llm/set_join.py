"""Similar texts by a prefix-filtered set join: all pairs whose sets of word shingles have a Jaccard similarity of ``LEAST`` or more.

Each text is the set of its shingles' 64-bit hashes, in one order for all texts: shingles that are common in a sample of the texts come last,
the others by hash. Two sets that are similar enough share a shingle among the first floor(n / 5) + 1 of each (n: the set's size), so
sets meet by the shingles of these prefixes and no pair is lost. Pairs that meet are dropped by bounds that hold for certain: on
the sizes, on the places of the shingle in both sets, and on the number of differing bits of 512 parities of the sets. What stays is
decided by intersecting the sets themselves.

Components need not look at all pairs: links that are known come first; then only pairs that join two parts are followed and decided; then
all pairs between different parts that are left. A shingle with very many sets is dealt out by pairs of blocks of them.

Defined results: NULL and empty texts have the empty set and are alike. Fewer words than a shingle are one shingle. Texts with the same
set are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadflow.llm.common import bits_of, blocks, may_be, may_be_in, mix, ship_package, strings_of
from roadflow.llm.components import components
from roadflow.session import drop, release, written

#: The least similarity as a fraction, 0.8.
LEAST = (4, 5)
#: Bits of the filter of common shingles: a fixed size; when it is full the order is by hash alone and more pairs meet.
FILTER_BITS = 22
#: One text in so many is looked at for common shingles, those that so many of them hold.
SAMPLE, COMMON = 8, 8
#: 64-bit words of a set's parities.
PARITY_WORDS = 8
#: Bytes of text that a kernel holds at once.
BLOCK_BYTES = 1 << 18
#: Sets of one shingle in one task; more are dealt out by pairs of blocks.
MOST_IN_GROUP = 2048
#: Up to this size all pairs of a group are compared side by side with other groups'.
SMALL_GROUP = 16
#: Rows that a task holds at once (whole groups).
ROWS_AT_ONCE = 20_000


def _flat(block: pa.RecordBatch, column: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of a block, the row of each, and each row's number of them."""
    from roadflow.llm.simhash import shingle_hashes

    h, each = shingle_hashes(strings_of(block.column(column)), shingle)
    return h, np.repeat(np.arange(block.num_rows), each), each


def _members(p: np.ndarray, row: np.ndarray, rows: int, *before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's members once, by ``before`` and then by hash; the rows' sizes, the members scrambled again, and the sets' hashes."""
    order = np.lexsort((p, *before, row))
    p, row = p[order], row[order]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (row[1:] != row[:-1])]) if len(p) else np.zeros(0, bool)
    p, row = p[new], row[new]
    n = np.bincount(row, minlength=rows)
    q = mix(p ^ np.uint64(0x2545F4914F6CDD1D))
    uid = np.zeros(rows, np.uint64)
    if len(p):
        uid[n > 0] = mix(np.add.reduceat(q, (np.cumsum(n) - n)[n > 0]) ^ n[n > 0].astype(np.uint64))
    return p, n, q, uid


def _lists(p: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(p.view(np.int64)))


def _bit(p: np.ndarray) -> np.ndarray:
    return (p >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """A bit for each shingle that is common in a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most=BLOCK_BYTES):
            h, row, _ = _flat(block, 0, shingle)
            p = _members(mix(h), row, block.num_rows)[0]
            yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64))], ["p"])

    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(run, "p long")
    often = sample.groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    found = often.select(F.shiftrightunsigned("p", 64 - FILTER_BITS).cast("int").alias("b")).distinct().toArrow().column("b")  # at most 2**FILTER_BITS
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[found.to_numpy()] = True
    return np.packbits(bits)


def shingle_sets(docs: DataFrame, *, shingle: int, id_col: str = "doc_id") -> DataFrame:
    """(id, th, uid, n, prefix, parity, fp): of each row the set's hash, size, first members and parities, and the text's SimHash, beside its xxhash64; stored.

    The other members are four fifths of the table; ``verified`` takes them from the few texts it asks for.
    """
    from roadflow.llm.simhash import simhashes

    spark = docs.sparkSession
    ship_package(spark)
    common = spark.sparkContext.broadcast(_common(docs, shingle))
    names = ["id", "th", "uid", "n", "prefix", "parity", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text", BLOCK_BYTES):
            h, row, each = _flat(block, 2, shingle)
            p, fp = mix(h), simhashes(h, each)
            b = _bit(p)
            last = (common.value[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1
            p, n, q, uid = _members(p, row, block.num_rows, last)
            some, begin = n > 0, (np.cumsum(n) - n)[n > 0]
            parity = np.zeros((block.num_rows, PARITY_WORDS), np.uint64)
            if len(p):
                word, one = (q >> np.uint64(6)) % np.uint64(PARITY_WORDS), np.uint64(1) << (q & np.uint64(63))
                for k in range(PARITY_WORDS):
                    parity[some, k] = np.bitwise_xor.reduceat(np.where(word == k, one, np.uint64(0)), begin)
            nth = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
            ahead = np.where(some, n - -(-LEAST[0] * n // LEAST[1]) + 1, 0)
            prefix = _lists(p[nth < np.repeat(ahead, n)], ahead)
            raw = parity.tobytes()
            size = 8 * PARITY_WORDS
            bits = pa.array([raw[k : k + size] for k in range(0, len(raw), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([*block.columns[:2], pa.array(uid.view(np.int64)), pa.array(n, pa.int32()), prefix, bits, pa.array(fp.view(np.int64))], names)

    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("th"), F.col("text").alias("__text"))
    kind = docs.schema["id"].dataType.simpleString()
    release()  # what the stages before have shuffled
    return written(docs.mapInArrow(run, f"id {kind}, th long, uid long, n int, prefix array<long>, parity binary, fp long"), "sets")


def whole_sets(texts: DataFrame, docs: DataFrame, *, shingle: int, id_col: str = "doc_id") -> DataFrame:
    """(uid, h): all members of the sets of those texts, and of some others; seldom one twice. texts: a stored table of ``row``, the hash of id and xxhash64 of the text."""
    bits, place = bits_of(texts, "row")
    docs = docs.select(place(F.xxhash64(F.col(id_col), F.xxhash64("text"))), F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for block in blocks(batches, 1, BLOCK_BYTES):
            block = block.filter(may_be(bits, block.column(0)))
            if not block.num_rows:
                continue
            h, row, _ = _flat(block, 1, shingle)
            p, n, _, uid = _members(mix(h), row, block.num_rows)
            new = []
            for x in uid.tolist():  # a table may hold a row many times
                new.append(x not in seen)
                seen.add(x)
            yield pa.RecordBatch.from_arrays([pa.array(uid.view(np.int64)), _lists(p, n)], ["uid", "h"]).filter(pa.array(new))

    return docs.mapInArrow(run, "uid long, h array<long>")


def _may_match(n: np.ndarray, at: np.ndarray, parity: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    """Whether the bounds leave a chance for the sets i and j that meet at one shingle. A similar pair passes at the first one it shares."""
    p, q = LEAST
    both = n[i] + n[j]
    need = -(-p * both // (p + q))
    ok = (q * np.minimum(n[i], n[j]) >= p * np.maximum(n[i], n[j])) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= need)
    ok[ok] = np.bitwise_count(parity[i if np.ndim(i) == 0 else i[ok]] ^ parity[j[ok]]).sum(axis=1, dtype=np.int64) <= (both - 2 * need)[ok]
    return ok


def group_pairs(group: np.ndarray, uid: np.ndarray, root: np.ndarray, block: np.ndarray, cross: np.ndarray, n: np.ndarray, at: np.ndarray, parity: np.ndarray, spanning: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs of one group and different roots that may match. Rows are sorted by group, then n.

    spanning: of large groups only pairs that connect all that may match. cross: only pairs of different blocks.
    """
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    low, size = edge[:-1], np.diff(edge)
    left, right = [], []
    for d in range(1, SMALL_GROUP):
        of = (size > d) & (size <= SMALL_GROUP)
        if not of.any():
            continue
        times = size[of] - d
        i = np.repeat(low[of], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        i = i[(root[i] != root[i + d]) & (~cross[i] | (block[i] != block[i + d]))]
        i = i[_may_match(n, at, parity, i, i + d)]
        left.append(i)
        right.append(i + d)
    p, q = LEAST
    for a, m in zip(low[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist()):
        reach = a + np.searchsorted(p * n[a : a + m], q * n[a : a + m], "right")
        own = root[a : a + m].copy()
        for i in range(a, a + m - 1):
            j = np.arange(i + 1, reach[i - a])
            j = j[(own[j - a] != own[i - a]) & (~cross[j] | (block[j] != block[i]))]
            if not len(j):
                continue
            j = j[_may_match(n, at, parity, i, j)]
            if spanning and len(j):
                parts, first = np.unique(own[j - a], return_index=True)
                j = j[first]
                own[np.isin(own, parts)] = own[i - a]
            left.append(np.full(len(j), i))
            right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _pairs(spanning: bool):
    def out(c: list[np.ndarray], parity: np.ndarray) -> pa.RecordBatch:
        key, lo, hi, block, uid, root, n, at = c
        new = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        i, j = group_pairs(np.concatenate([[0], np.cumsum(new)]), uid, root, block, lo != hi, n, at, parity, spanning)
        u, v = np.minimum(uid[i], uid[j]), np.maximum(uid[i], uid[j])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        rows = 0

        def joined() -> tuple[list[np.ndarray], np.ndarray]:
            return [np.concatenate([h[0][k] for h in held]) for k in range(8)], np.concatenate([h[1] for h in held])

        for batch in batches:
            if not batch.num_rows:
                continue
            parity = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint64).reshape(-1, PARITY_WORDS)
            held.append(([np.asarray(batch.column(k), np.int64) for k in range(8)], parity))
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:
                c, parity = joined()
                edge = np.flatnonzero((c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1]))
                cut = int(edge[-1]) + 1 if len(edge) else 0  # all but the last group, which may go on
                if cut:
                    yield out([x[:cut] for x in c], parity[:cut])
                held, rows = [([x[cut:] for x in c], parity[cut:])], len(parity) - cut
        if rows:
            yield out(*joined())

    return run


def _met(rows: DataFrame) -> DataFrame:
    """Of rows (key, uid, n, at, root), each (key, uid) once, those of keys with different roots."""
    shared = written(rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key"), "shared")
    release()
    met = written(may_be_in(rows, "key", shared).join(shared, "key"), "met")
    drop(shared)
    return met


def _candidates(met: DataFrame, parities: DataFrame, spanning: bool) -> DataFrame:
    """(u, v), u < v: pairs of sets of different roots that may match."""
    hot = written(met.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > MOST_IN_GROUP), "hot")
    if hot.isEmpty():
        dealt = met.withColumns({n: F.lit(0) for n in ("lo", "hi", "block")})
    else:
        parts = F.ceil(F.coalesce("m", F.lit(1)) / MOST_IN_GROUP).cast("int")
        dealt = met.join(hot, "key", "left").withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("uid"), "parts").cast("int"))
        dealt = dealt.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.withColumns({"lo": F.least("block", "__j"), "hi": F.greatest("block", "__j")})
    dealt = dealt.join(parities, "uid").select("key", "lo", "hi", "block", "uid", "root", "n", "at", "parity")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n", "uid")
    return dealt.mapInArrow(_pairs(spanning), "u long, v long").distinct()


def _similar(n: Column, m: Column, shared: Column) -> Column:
    p, q = LEAST
    return (p + q) * shared >= p * (n + m)


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, *, shingle: int, id_col: str = "doc_id") -> DataFrame:
    """Those pairs (u, v) whose sets are similar; stored. pairs: a stored table. sets: of ``shingle_sets`` of docs.

    A set goes once to its pairs, and once for each pair to the other set: nothing else of its size is sent or stored.
    """
    ends = pairs.select("u", "v", F.explode(F.array("u", "v")).alias("uid"))
    nodes = written(ends.select("uid").distinct(), "nodes")
    # of texts with the same set one is read
    texts = may_be_in(sets.select("uid", F.xxhash64("id", "th").alias("row")), "uid", nodes).groupBy("uid").agg(F.min("row").alias("row"))
    texts = written(texts.join(nodes, "uid").select("row"), "texts")
    met = ends.join(whole_sets(texts, docs, shingle=shingle, id_col=id_col), "uid")
    of = lambda end: F.first(F.when(F.col("uid") == F.col(end), F.col("h")), ignorenulls=True).alias(f"h{end}")
    found = written(met.groupBy("u", "v").agg(of("u"), of("v")).filter(_similar(F.size("hu"), F.size("hv"), F.size(F.array_intersect("hu", "hv")))).select("u", "v"), "verified")
    drop(nodes, texts)
    return found


def split(full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table of ``shingle_sets`` without first members and parities, and these of each set that isn't empty, once; both stored. The table itself is deleted."""
    # copies of a set become one before they are sent
    columns = ("n", "prefix", "parity")
    one = written(full.filter("n > 0").select("uid", *columns).groupBy("uid").agg(*(F.first(c).alias(c) for c in columns)), "unique")
    sets = written(full.select("id", "th", "uid", "n", "fp"), "sets")
    drop(full)
    return sets, one


def parts(sets: DataFrame, one: DataFrame, known: DataFrame, docs: DataFrame, *, shingle: int, id_col: str = "doc_id") -> DataFrame:
    """(u, v) as ``components`` gives them, of the sets' hashes linked by similarity. sets, one: of ``split``. known: links that are verified already; a stored table."""
    parities = one.select("uid", "parity")
    rows, links, tried, roots = one.select("uid", "n", F.posexplode("prefix").alias("at", "key")), known, known, components(known)
    for spanning in (True, False):
        of = roots.select(F.col("u").alias("uid"), F.col("v").alias("__root"))
        rows = _met(rows.join(of, "uid", "left").select("key", "uid", "n", "at", F.coalesce("__root", "uid").alias("root")))
        pairs = written(_candidates(rows, parities, spanning).join(tried, ["u", "v"], "left_anti"), "tried")
        rows = rows.drop("root")
        if pairs.isEmpty():
            continue
        release()
        links = written(links.unionByName(verified(pairs, sets, docs, shingle=shingle, id_col=id_col)), "links")
        tried, roots = tried.unionByName(pairs), components(links)
    return roots
