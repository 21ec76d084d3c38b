"""Line dedup by winnowing over line hashes.

Lines are compared without white space at their ends; blank lines do not count. Of each ``run`` lines in a row the one with the smallest hash
(the last one on ties) is a fingerprint, so equal runs share a fingerprint wherever they stand. Positions join by fingerprint: those
that occur once in the corpus are dropped. The others are extended both ways to the windows of ``run`` lines they are the fingerprint
of, by 128-bit hashes; the earliest place of each window stays and every later one is deleted, so longer matches go as a whole.
A place is never paired with another: counts and earliest places are partial aggregates that join back.

``long_words``: fewer lines in a row are a run as well if they hold that many words. Each such span is a fingerprint of its own. The default
has runs of ``run`` lines only.

Defined results: NULL stays NULL; texts with fewer than ``run`` lines stay as they are, but for ``long_words``. Places are ordered by id (NULL last), then line;
rows that share an id do not delete each other's lines at the same place. Runs are judged on the input. Blank lines stay. A text may
become empty; its row stays. An ``n_chars`` column is brought up to date, further columns are passed on, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from roadflow.llm.common import blocks, map_arrow, own_names, parted, ship_package, strings_of, window_hashes
from roadflow.session import written

RUN = 3
#: Words that make fewer lines a run, where asked for.
LONG_WORDS = 50
_W1, _W2 = 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F
_BLANK = b" \t\r\x0b\x0c"


def lines_of(text: bytes) -> list[bytes]:
    """The lines that aren't blank, without white space at their ends."""
    return [x for line in text.split(b"\n") if (x := line.strip(_BLANK))]


def line_hashes(lines: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64)


def long_spans(lines: list[bytes], run: int, long_words: int) -> list[tuple[int, int]]:
    """(start, lines) of all spans of fewer than ``run`` lines with at least ``long_words`` words."""
    total = np.cumsum([0, *(len(x.split()) for x in lines)])
    return [(s, r) for r in range(1, run) for s in np.flatnonzero(total[r:] - total[:-r] >= long_words).tolist()]


def winnow(h: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the fingerprints, and of each the first window and the number of windows it stands for."""
    n = len(h) - run + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    view = np.lib.stride_tricks.sliding_window_view(h, run)[:, ::-1]
    at = np.arange(n) + run - 1 - view.argmin(axis=1)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[new], new, np.diff(np.append(new, n))


def _scan(run: int, long_words: int | None):
    windows = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    sizes = range(1, run) if long_words else ()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            row, f, s, w, lines = [], [], [], [], []
            for i, text in enumerate(strings_of(block.column(2))):
                own = lines_of(text)
                h = line_hashes(own)
                at, first, times = winnow(h, run)
                a, b = (window_hashes(h, run, base).view(np.int64).tolist() for base in (_W1, _W2))
                for p, x, m in zip(h[at].view(np.int64).tolist(), first.tolist(), times.tolist()):
                    row.append(i)
                    f.append(p)
                    s.append(x)
                    w.append([{"a": a[k], "b": b[k]} for k in range(x, x + m)])
                    lines.append(run)
                spans = long_spans(own, run, long_words) if long_words else []
                short = {r: [window_hashes(h, r, base + 2 * r).view(np.int64).tolist() for base in (_W1, _W2)] for r in sizes if spans}
                for x, r in spans:
                    row.append(i)
                    f.append(short[r][0][x])
                    s.append(x)
                    w.append([{"a": short[r][0][x], "b": short[r][1][x]}])
                    lines.append(r)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), block.column(0).take(row), block.column(1).take(row), pa.array(s, pa.int32()), pa.array(lines, pa.int32()), pa.array(w, windows)], ["f", "id", "th", "s", "lines", "windows"])

    return scan


def repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", run: int = RUN, long_words: int | None = None) -> DataFrame:
    """(id, th, spans): starts and lengths of the runs to delete in the rows of that id and xxhash64 of the text, counting lines that aren't blank."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("th"), "text")
    kind = docs.schema["id"].dataType.simpleString()
    marks = written(docs.mapInArrow(_scan(run, long_words), f"f long, id {kind}, th long, s int, lines int, windows array<struct<a:long,b:long>>"), "fingerprints")
    shared = written(marks.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f"), "shared")
    windows = written(marks.join(shared, "f").select("id", "th", "s", "lines", F.posexplode("windows").alias("k", "w")).select("id", "th", (F.col("s") + F.col("k")).alias("s"), "lines", "w.a", "w.b"), "windows")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "s")
    first = written(windows.groupBy("a", "b", "lines").agg(F.min(place).alias("place"), F.count("*").alias("n")).filter("n > 1").select("a", "b", "lines", "place"), "first")
    late = windows.join(first, ["a", "b", "lines"]).filter(place > F.col("place"))
    return written(late.groupBy("id", "th").agg(F.collect_set(F.struct("s", "lines")).alias("spans")), "runs")


def cut_text(text: str, spans: list[dict[str, int]]) -> tuple[str, int, int]:
    """The text without the runs, the number of lines that aren't blank, and how many of them went."""
    gone = {x["s"] + k for x in spans for k in range(x["lines"])}
    kept, n, went = [], 0, 0
    for line in text.split("\n"):
        if line.strip(_BLANK.decode()):
            n += 1
            if n - 1 in gone:
                went += 1
                continue
        kept.append(line)
    return "\n".join(kept), n, went


def dedup(docs: DataFrame, *, id_col: str = "doc_id", run: int = RUN, long_words: int | None = None, counts: bool = False) -> DataFrame:
    """docs with repeated runs deleted from text; with ``counts`` also n_lines and n_removed, in the place of columns of these names."""
    runs = repeated_runs(docs, id_col=id_col, run=run, long_words=long_words)
    if counts:
        docs = docs.drop("n_lines", "n_removed")
    clean, maybe = parted(docs, id_col, runs)
    rid, rth, spans = own_names(docs, "__id", "__th", "__spans")
    runs = runs.select(F.col("id").alias(rid), F.col("th").alias(rth), F.col("spans").alias(spans))
    joined = maybe.join(runs.hint("merge"), F.col(id_col).eqNullSafe(F.col(rid)) & (F.xxhash64("text") == F.col(rth)), "left").drop(rid, rth)  # alike at every size
    fields = [*docs.schema.fields, *(StructField(n, LongType()) for n in ("n_lines", "n_removed") if counts)]
    place = {n: i for i, n in enumerate(docs.columns)}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, place["text"]):
            column = list(block.columns[:-1])
            done = [cut_text(t, s or []) if t is not None else (None, 0, 0) for t, s in zip(column[place["text"]].to_pylist(), block.column(block.num_columns - 1).to_pylist())]
            if "n_chars" in place:
                own = column[place["n_chars"]]
                column[place["n_chars"]] = pa.array([len(d[0]) if d[2] else c for d, c in zip(done, own.to_pylist())], own.type)
            column[place["text"]] = pa.array([d[0] for d in done], column[place["text"]].type)
            extra = [pa.array([d[k] for d in done], pa.int64()) for k in (1, 2)] if counts else []
            yield pa.RecordBatch.from_arrays([*column, *extra], [f.name for f in fields])

    cut = map_arrow(joined, apply, StructType(fields))
    if counts:  # rows without repeats pass by without a second kernel
        blank = F.lit(_BLANK.decode())
        n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.btrim(line, blank) != "")).cast("long")
        clean = clean.withColumns({"n_lines": n_lines, "n_removed": F.lit(0).cast("long")})
    return cut.unionByName(clean)
