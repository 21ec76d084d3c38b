"""Best-fit packing by minimum bin slack.

Documents become token ids (a public tokenizer, then id 1) and are cut into pieces of at most ``capacity`` tokens. Which pieces
share a sequence depends on their lengths alone, so only the count of each length (at most ``capacity`` numbers) is planned
centrally: a bin starts with the longest length left, and a subset-sum dynamic programme over the other lengths, one bit for each
sum, finds the fullest feasible rest; that combination is taken as many times as the counts allow, and removed. Each round leaves
some length with fewer pieces than the combination uses, so the number of rounds does not follow the number of documents.
Executors then number the pieces of each length (in salted groups, so that no length fills one task) and look up their places.

Defined results: NULL and empty texts are one piece with id 1 alone. A document of n tokens has ceil(n / capacity) pieces, whatever its length.
Repeated rows (and NULL ids) are packed as documents of their own. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadflow.llm.common import blocks, bytes_of, ship_package, span_hashes
from roadflow.session import written

CAPACITY = 4096
END_ID = 1
#: Groups that the pieces of one length are numbered in.
SALTS = 64

# ------------------------------------------------------------------ tokens

#: Distinct words whose ids a worker keeps (about 30 bytes each); beyond that it starts anew.
MOST_KEPT = 1_500_000

_KIND = np.full(256, 4, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 other sign, 4 left to the tokenizer
_KIND[33:127] = 3
_KIND[[*b" \t\n\r\x0b\x0c"]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[0xC3] = 1
_KIND[0x80:0xC0] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordTokenizer:
    """Ids of whole texts by way of their words, each of which is encoded once.

    The vocabulary drops white space, lower-cases, and forms words of letters, single digits, runs of other signs and a few endings after an
    apostrophe. Texts of ASCII and Latin-1 letters are parted here, a block at a time; words are told apart by a 64-bit hash, and their
    ids are looked up in sorted arrays. Any other text, and one with a special token's opening sign, goes to the tokenizer as it is.
    """

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self._clear()

    def _clear(self) -> None:
        self.key, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = [np.zeros(0, "<u4")]
        self.total = 0

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, key: np.ndarray, words: list[str]) -> None:
        if len(self.key) + len(key) > MOST_KEPT:
            self._clear()
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, of = np.array(e.ids, "<u4"), np.array(e.word_ids)
        size = np.bincount(of, minlength=len(words)) if len(of) and of[-1] == len(words) - 1 else None
        if size is None:
            each = [self._encode(w) for w in words]
            ids, size = np.concatenate(each), np.array([len(x) for x in each])
        at = self.total + np.cumsum(size) - size
        self.ids.append(ids)
        self.total += len(ids)
        key = np.concatenate([self.key, key])
        order = np.argsort(key)
        self.key, self.at, self.size = key[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def _places(self, key: np.ndarray, word_of) -> np.ndarray:
        """Places of sorted distinct keys; unknown ones are learned first. word_of: the words at places of ``key``."""
        for _ in range(2):
            i = np.searchsorted(self.key, key)
            new = np.flatnonzero(self.key[np.minimum(i, len(self.key) - 1)] != key) if len(self.key) else np.arange(len(key))
            if not len(new):
                return i
            if len(self.key) + len(new) > MOST_KEPT:  # all of this block's words, once the rest is dropped
                self._clear()
                new = np.arange(len(key))
            self._learn(key[new], word_of(new))
        return np.searchsorted(self.key, key)

    def __call__(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Little-endian 32-bit ids of each text. data, at: UTF-8 bytes of all texts and where each begins (one more at the end)."""
        n = len(at) - 1
        kind = _KIND[data]
        second = np.zeros(len(data), bool)
        second[1:] = data[:-1] == 0xC3
        odd = (kind == 4) | ((data >= 0x80) & (data < 0xC0) & ~second) | (second & ((data == 0x97) | (data == 0xB7)))
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # "<|"
        strange = np.concatenate([[0], np.cumsum(odd)])
        strange = strange[at[1:]] > strange[at[:-1]]
        low = _LOWER[data]
        low[second & (data >= 0x80) & (data <= 0x9E)] += 32
        new = np.ones(len(data) + 1, bool)
        new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        head = np.zeros(len(data) + 1, bool)
        head[at] = True
        new |= head
        for i in np.flatnonzero((low[:-1] == 39) & new[: len(low) - 1]).tolist() if len(low) > 1 else []:
            ending = low[i + 1 : i + 3].tobytes()
            m = 2 if ending in (b"re", b"ve", b"ll") and not head[i + 2] else 1 if ending[:1] in (b"s", b"t", b"m", b"d") else 0
            if m and not head[i + 1]:
                new[i + 1], new[i + 1 + m] = False, True
        edge = np.flatnonzero(new)
        first, last = edge[:-1], edge[1:]
        word = kind[first] != 0
        first, last = first[word], last[word]
        of = np.searchsorted(at, first, "right") - 1
        if strange.any():
            keep = ~strange[of]
            first, last, of = first[keep], last[keep], of[keep]
        h = span_hashes(low, first, last)
        key, some, which = np.unique(h, return_index=True, return_inverse=True)
        raw = low.tobytes()
        word_of = lambda k: [raw[a:b].decode() for a, b in zip(first[some[k]].tolist(), last[some[k]].tolist())]
        place = self._places(key, word_of)[which]
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        size = self.size[place]
        ends = np.cumsum(size)
        ids = self.ids[0][np.repeat(self.at[place] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        edges = np.concatenate([[0], ends])[np.searchsorted(of, np.arange(n + 1))] * 4
        out = [ids[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist())]
        for i in np.flatnonzero(strange).tolist():
            out[i] = self._encode(data[at[i] : at[i + 1]].tobytes().decode()).tobytes()
        return out


_tokenizers: dict[int, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """id, piece, start, length and ids_crc32 of each piece of each document."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as f:  # a file of fixed size, sent to the executors, which may not have it
        vocabulary = spark.sparkContext.broadcast(f.read())
    schema = docs.select(id_col).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(vocabulary.value[-4096:].encode()) + len(vocabulary.value)
        if key not in _tokenizers:
            _tokenizers.clear()
            _tokenizers[key] = WordTokenizer(vocabulary.value)
        for block in blocks(batches, "__text"):
            owner, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(_tokenizers[key](*bytes_of(block.column(1)))):
                ids += END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    owner.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], schema.names)

    return docs.select(id_col, F.col("text").alias("__text")).mapInArrow(run, schema)


# ------------------------------------------------------------------ plan


def fullest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, times) whose sum is as near to ``room`` as can be, longer lengths first. lengths: descending."""
    mask, full = (1 << (room + 1)) - 1, 1 << room
    sums, steps = 1, []
    for length, count in zip(lengths, counts):
        if length > room:
            continue
        left, part = min(count, room // length), 1
        while left:
            part = min(part, left)
            steps.append((sums, length, part))
            sums |= (sums << (length * part)) & mask
            left -= part
            part *= 2
        if sums & full:
            break
    at, used = sums.bit_length() - 1, {}
    for before, length, part in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + part
            at -= length * part
    return sorted(used.items(), reverse=True)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, from the count of each length (index).

    Entry i: pieces of ``length[i]`` numbered from ``first[i]`` on fill bins from ``bin[i]`` on, ``times[i]`` in each, from
    ``offset[i]`` on. Entries are sorted by length and first.
    """
    left = {n: int(c) for n, c in sorted(enumerate(counts.tolist()), reverse=True) if c and n}
    done = dict.fromkeys(left, 0)
    rows, bins = [], 0
    while left:
        longest = next(iter(left))
        left[longest] -= 1
        lengths = [n for n, c in left.items() if c]
        chosen = dict(fullest(lengths, [left[n] for n in lengths], capacity - longest))
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times, offset = min(left[n] // k for n, k in chosen.items()), 0
        for n in sorted(chosen, reverse=True):
            k = chosen[n]
            rows.append((n, done[n], bins, k, offset))
            offset += n * k
            done[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
        bins += times
    out = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "bin", "times", "offset"), out.T)) | {"bins": np.array([bins])}


def place(p: dict[str, np.ndarray], length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the nth pieces of the lengths."""
    key = np.int64(1) << 48
    i = np.searchsorted(p["length"] * key + p["first"], length * key + nth, "right") - 1
    turn, slot = np.divmod(nth - p["first"][i], p["times"][i])
    return p["bin"][i] + turn, p["offset"][i] + slot * length


def pack(cut: DataFrame, *, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """``cut`` (with a column length, at most ``capacity``) with sequence_id and offset."""
    spark: SparkSession = cut.sparkSession
    ship_package(spark)
    names = cut.columns
    own = ("__uid", "__salt", "__nth")
    table = written(cut.withColumn(own[0], F.monotonically_increasing_id()), "pieces")
    table = table.withColumn(own[1], F.pmod(F.xxhash64(own[0]), F.lit(salts)).cast("int"))
    got = table.groupBy("length", own[1]).agg(F.count("*").alias("n")).toArrow()  # at most capacity x salts rows
    counts = np.zeros((capacity + 1, salts), np.int64)
    counts[got.column("length").to_numpy(), got.column(own[1]).to_numpy()] = got.column("n").to_numpy()
    before = np.cumsum(counts, axis=1) - counts
    shared = spark.sparkContext.broadcast((plan(counts.sum(axis=1), capacity), before))  # sizes follow capacity and salts alone
    table = table.withColumn(own[2], F.row_number().over(Window.partitionBy("length", own[1]).orderBy(own[0])) - 1)
    schema = table.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, start = shared.value
        for batch in batches:
            length, salt, nth = (np.asarray(batch.column(batch.schema.get_field_index(c)), np.int64) for c in ("length", *own[1:]))
            sequence, offset = place(p, length, start[length, salt] + nth)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    return table.select(*names, *own[1:]).mapInArrow(run, schema)
