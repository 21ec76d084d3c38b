"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join.

Fingerprints within ``BUDGET`` differing bits agree on at least one of BUDGET + 1 blocks of bits. Distinct fingerprints are dealt out
once for each block, by the block's value; a group that is still too large is dealt out again by a block of the other bits, so
that one value with most of the fingerprints fills many tasks. Within a task the sorted fingerprints of each group form a binary trie.
Pairs of its nodes are followed down together, the differing bits so far are added up, and a pair beyond the budget is pruned, as
is a pair whose fingerprints are all known to be connected already. Only links that join two parts are kept, and components are
found by stars on the distinct fingerprints.

Defined results: NULL and empty texts have no words and fingerprint zero, linked like any other. Fewer words than a shingle count as one
shingle. Repeated rows share a fingerprint and are never paired up. NULL ids take part but are never the smallest, unless a component
has no other. An empty table gives no rows. Columns other than id and text are passed on unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm import set_join
from roadflow.llm.common import blocks, cols, mix, own_names, parted, ship_package, strings_of
from roadflow.llm.components import components
from roadflow.session import written

BUDGET = 3
SEED = 42
#: Fingerprints of one group in one task; larger groups are dealt out again.
MOST_IN_GROUP = 1024
#: After so many blocks 49 bits are fixed, so a group of distinct fingerprints has at most 2**15 members.
MOST_LEVELS = 5
#: Rows that a task holds at once (whole groups).
ROWS_AT_ONCE = 100_000
#: Pairs of nodes that are followed together.
PAIRS_AT_ONCE = 1 << 14

# ------------------------------------------------------------------ fingerprints

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def xxh64(data: bytes, first: np.ndarray, last: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each span [first, last) of data, computed side by side; spans of 32 bytes and more by the library."""
    size = last - first
    buffer = data + bytes(8)
    wide = np.ndarray((len(data) + 1,), "<u8", buffer, strides=(1,))
    half = np.ndarray((len(data) + 1,), "<u4", buffer, strides=(1,))
    byte = np.frombuffer(buffer, np.uint8)
    h = np.uint64(seed) + _P5 + size.astype(np.uint64)
    short = size < 32
    for k in range(3):
        i = np.flatnonzero(short & (size >= 8 * (k + 1)))
        lane = _rotl(wide[first[i] + 8 * k] * _P2, 31) * _P1
        h[i] = _rotl(h[i] ^ lane, 27) * _P1 + _P4
    at = first + (size & ~7)
    i = np.flatnonzero(short & (size & 4 > 0))
    h[i] = _rotl(h[i] ^ half[at[i]].astype(np.uint64) * _P1, 23) * _P2 + _P3
    at = first + (size & ~3)
    for k in range(3):
        i = np.flatnonzero(short & (size & 3 > k))
        h[i] = _rotl(h[i] ^ byte[at[i] + k].astype(np.uint64) * _P5, 11) * _P1
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(~short).tolist():
        h[i] = xxhash.xxh64_intdigest(data[first[i] : last[i]], seed)
    return h


def shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text by text, and each text's number of them. bytes.lower and bytes.split treat ASCII letters and white space alone."""
    words = [t.lower().split() for t in texts]
    data = b"\n".join(b" ".join(w) for w in words) + b"\n"
    n = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(data, np.uint8)
    end = np.flatnonzero((raw == 32) | (raw == 10))
    own = np.repeat(n, np.maximum(n, 1))  # an empty text still has its line end
    start = np.concatenate([[0], end[:-1] + 1])
    some = own > 0
    start, end, total = start[some], end[some], own[some]
    nth = np.arange(len(total)) - np.repeat(np.cumsum(n) - n, n)
    head = np.flatnonzero((nth + shingle <= total) | (nth == 0))
    tail = head + np.minimum(shingle, total[head]) - 1
    each = np.maximum(n - shingle + 1, np.minimum(n, 1))
    return xxh64(data, start[head], end[tail]) if len(head) else np.zeros(0, np.uint64), each


def simhashes(h: np.ndarray, each: np.ndarray) -> np.ndarray:
    """The SimHash of each text, as unsigned 64-bit numbers, from all shingles' hashes and each text's number of them."""
    out = np.zeros(len(each), np.uint64)
    if not len(h):
        return out
    some = each > 0
    begin = (np.cumsum(each) - each)[some]
    for k in range(8):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8)[:, k : k + 1], axis=1, bitorder="little")
        over = 2 * np.add.reduceat(bits, begin, axis=0, dtype=np.int64) > each[some][:, None]
        out[some] |= np.packbits(over, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    return simhashes(*shingle_hashes(texts, shingle))


def fingerprint_texts(docs: DataFrame, *, shingle: int, id_col: str = "doc_id") -> DataFrame:
    """(id, fp): the fingerprint of each row's text as a long."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            fp = pa.array(fingerprints(strings_of(block.column(1)), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([block.column(0), fp], ["id", "fp"])

    docs = docs.select(F.col(id_col).alias("id"), F.col("text").alias("__text"))
    return docs.mapInArrow(run, docs.select("id").schema.add("fp", "long"))


# ------------------------------------------------------------------ links


def sub_masks(mask: int) -> list[int]:
    """``mask`` with each of BUDGET + 1 blocks of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    size, out = len(free), []
    for k in range(BUDGET + 1):
        out.append(mask | sum(1 << b for b in free[size * k // (BUDGET + 1) : size * (k + 1) // (BUDGET + 1)]))
    return out


class _Parts:
    """Connected parts of the rows 0 .. n-1."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            new = x != y
            if not new.any():
                return
            a, b, x, y = a[new], b[new], x[new], y[new]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def trie_links(group: np.ndarray, fp: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each row the first row of its connected part. Rows are sorted by group, then by fingerprint, and distinct."""
    n = len(fp)
    parts = _Parts(n)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    many = np.diff(edge) > 1
    low, high = edge[:-1][many], edge[1:][many]
    zero = np.zeros(len(low), np.int64)
    ones: dict[int, np.ndarray] = {}
    stack = [(0, low[k : k + PAIRS_AT_ONCE], high[k : k + PAIRS_AT_ONCE], low[k : k + PAIRS_AT_ONCE], high[k : k + PAIRS_AT_ONCE], zero[k : k + PAIRS_AT_ONCE]) for k in range(0, len(low), PAIRS_AT_ONCE)]
    while stack:
        depth, a, b, c, d, diff = stack.pop()
        # pairs of single fingerprints are compared at once
        single = (b - a == 1) & (d - c == 1)
        if single.any():
            x, y = a[single], c[single]
            near = np.bitwise_count(fp[x] ^ fp[y]) <= budget
            parts.join(x[near], y[near])
            rest = ~single
            a, b, c, d, diff = a[rest], b[rest], c[rest], d[rest], diff[rest]
        if not len(a):
            continue
        # pairs whose rows are one part already need no look
        change = np.concatenate([[0, 0], np.cumsum(parts.root[1:] != parts.root[:-1])])
        one = (change[b] == change[a + 1]) & (change[d] == change[c + 1]) & (parts.root[a] == parts.root[c])
        if one.any():
            rest = ~one
            a, b, c, d, diff = a[rest], b[rest], c[rest], d[rest], diff[rest]
        if not len(a):
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((fp >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)])
        up = ones[depth]
        m1, m2 = b - (up[b] - up[a]), d - (up[d] - up[c])
        same = (a == c) & (b == d)
        a2 = np.concatenate([a, m1, a, np.where(same, b, m1)])
        b2 = np.concatenate([m1, b, m1, b])
        c2 = np.concatenate([c, m2, m2, c])
        d2 = np.concatenate([m2, d, d, m2])
        diff2 = np.concatenate([diff, diff, diff + 1, diff + 1])
        keep = (b2 > a2) & (d2 > c2) & (diff2 <= budget)
        keep &= ~((a2 == c2) & (b2 - a2 == 1))
        a2, b2, c2, d2, diff2 = (v[keep] for v in (a2, b2, c2, d2, diff2))
        for k in range(0, len(a2), PAIRS_AT_ONCE):
            s = slice(k, k + PAIRS_AT_ONCE)
            stack.append((depth + 1, a2[s], b2[s], c2[s], d2[s], diff2[s]))
    return parts.root


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within groups of rows (mask, fp) of equal masked bits."""

    def out(mask: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        value = fp.view(np.uint64)
        key = value & mask.view(np.uint64)
        order = np.lexsort((value, key, mask))
        value, key, mask = value[order], key[order], mask[order]
        group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (mask[1:] != mask[:-1]))])
        root = trie_links(group, value)
        new = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(value[new].view(np.int64)), pa.array(value[root[new]].view(np.int64))], ["u", "v"])

    masks, fps, n = [], [], 0
    for batch in batches:
        m, f = (np.asarray(batch.column(k), np.int64) for k in range(2))
        masks.append(m)
        fps.append(f)
        n += len(m)
        if n >= ROWS_AT_ONCE:
            m, f = np.concatenate(masks), np.concatenate(fps)
            key = f & m
            edge = np.flatnonzero((key[1:] != key[:-1]) | (m[1:] != m[:-1]))
            if len(edge):  # all but the last group, which may go on
                cut = int(edge[-1]) + 1
                yield out(m[:cut], f[:cut])
                masks, fps, n = [m[cut:]], [f[cut:]], len(m) - cut
            else:
                masks, fps = [m], [f]
    if n:
        yield out(np.concatenate(masks), np.concatenate(fps))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that connect all that are within the budget, by whatever path."""
    ship_package(distinct.sparkSession)
    parts, rows, masks = [], distinct.select("fp", F.lit(0).cast("long").alias("mask")), [0]
    for level in range(1, MOST_LEVELS + 1):
        step = F.create_map(*(F.lit(x) if i % 2 == 0 else F.array(*map(F.lit, x)) for m in masks for i, x in enumerate((_signed(m), [_signed(s) for s in sub_masks(m)]))))
        rows = rows.select("fp", F.explode(step[F.col("mask")]).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        masks = sorted({s for m in masks for s in sub_masks(m)})
        if level > 1:  # blocks chosen in another order may give the same mask
            rows = rows.distinct()
        if level == MOST_LEVELS:
            parts.append(rows)
            break
        hot = written(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_IN_GROUP).select("mask", "key", F.lit(True).alias("hot")), "hot")
        if hot.isEmpty():
            parts.append(rows)
            break
        marked = rows.join(hot, ["mask", "key"], "left")
        parts.append(marked.filter("hot IS NULL").select("fp", "mask", "key"))
        rows = written(marked.filter("hot").select("fp", "mask"), "again")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    dealt = every.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.select("mask", "fp").mapInArrow(_link, "u long, v long")


def classes(fps: DataFrame) -> DataFrame:
    """(fp, root, component_id): for each distinct fingerprint its component and the smallest id in it. fps: a stored table with id and fp."""
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    roots = components(links(distinct))
    of = written(distinct.join(roots.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "id", F.coalesce("v", "fp").alias("root")), "roots")
    smallest = written(of.groupBy("root").agg(F.min("id").alias("component_id")), "smallest")
    return written(of.join(smallest, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, *, shingle: int, id_col: str = "doc_id") -> DataFrame:
    """id, fp (long) and component_id of each row."""
    fps = written(fingerprint_texts(docs, shingle=shingle, id_col=id_col), "fingerprints")
    return fps.join(classes(fps), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def trie_pairs(sets: DataFrame) -> DataFrame:
    """(u, v): pairs of sets to look at, such that all sets whose fingerprints the trie links hang together; stored. sets: of ``set_join.shingle_sets``."""
    of = written(sets.filter("n > 0").groupBy("uid").agg(F.min("fp").alias("fp")), "fingerprints")
    ahead = written(of.groupBy("fp").agg(F.min("uid").alias("first")), "ahead")
    near = links(ahead.select("fp"))
    for end in "uv":
        near = near.join(ahead.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_")), end)
    same = of.join(ahead, "fp").filter("uid <> first").select(F.col("uid").alias("u_"), F.col("first").alias("v_"))
    both = near.select("u_", "v_").unionByName(same)
    return written(both.select(F.least("u_", "v_").alias("u"), F.greatest("u_", "v_").alias("v")).distinct(), "near")


def keep_one(docs: DataFrame, *, shingle: int, id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each group of texts linked by a Jaccard similarity of 0.8 or more of their shingle sets: the one with the smallest id (NULL last).

    The trie self-join of fingerprints finds most links, and each is verified on the sets themselves. Texts that are 0.8 alike may differ in over
    BUDGET bits, so ``set_join`` then looks for all links between different groups that are left: none is lost, and none below 0.8 counts.
    """
    key = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    fps, one = set_join.split(set_join.shingle_sets(docs, shingle=shingle, id_col=id_col))
    found = set_join.verified(trie_pairs(fps), fps, docs, shingle=shingle, id_col=id_col)
    roots = set_join.parts(fps, one, found, docs, shingle=shingle, id_col=id_col).select(F.col("u").alias("uid"), "v")
    of = written(fps.select("id", "th", "uid").join(roots, "uid", "left").select("id", "th", F.coalesce("v", "uid").alias("root")), "members")
    first = written(of.groupBy("root").agg(F.min(key).alias("k")), "first")
    go = written(of.join(first, "root").filter(~key.eqNullSafe(F.col("k"))).select("id", "th").distinct(), "go")
    stay, maybe = parted(docs, id_col, go)
    gid, gth, none, row = own_names(docs, "__id", "__th", "__none", "__row")
    go = go.select(F.col("id").alias(gid), F.col("th").alias(gth)).hint("merge")
    kept = stay.unionByName(maybe.join(go, F.col(id_col).eqNullSafe(F.col(gid)) & (F.xxhash64("text") == F.col(gth)), "left_anti"))
    again = written(fps.groupBy("id", "th").agg(F.count("*").alias("n")).filter("n > 1").select("id", "th"), "again")
    if again.isEmpty():
        return kept
    # rows of equal id and text: one of them
    once, many = parted(written(kept, "kept"), id_col, again)
    own = {none: F.col(id_col).isNull(), gid: F.coalesce(F.col(id_col), F.lit(0)), gth: F.xxhash64("text")}
    one = many.withColumns(own).groupBy(*own).agg(F.first(F.struct(*cols(docs))).alias(row)).select(f"{row}.*")
    return once.unionByName(one)
