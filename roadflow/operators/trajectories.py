"""Kernels over whole trajectories: one shuffle by trajectory, one sort by time, and Arrow blocks of many trajectories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadflow.session import written

#: Fixes that a kernel gets at once: whole trajectories, or a part of a longer one.
ROWS_AT_ONCE = 65_536

#: A kernel: (block, first row of each trajectory and the number of rows, whether its only trajectory goes on, what it carried) to
#: (output, rows settled, what it carries). Rows that are not settled come again, with more.
Kernel = Callable[[pa.RecordBatch, np.ndarray, bool, object], tuple[pa.RecordBatch, int, object]]


def starts(column: pa.Array) -> np.ndarray:
    """The first row of each run of equal values (NULLs are equal), and the number of rows."""
    n = len(column)
    if n < 2:
        return np.arange(n + 1)
    ids = column.dictionary_encode() if not pa.types.is_dictionary(column.type) else column
    code = ids.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1, [n]])


def column(block: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as doubles, NaN for NULL."""
    return np.asarray(pc.cast(block.column(block.schema.get_field_index(name)), pa.float64()).fill_null(np.nan))


def seconds_of(block: pa.RecordBatch) -> np.ndarray:
    """``time`` in seconds, NaN for NULL."""
    t = block.column(block.schema.get_field_index("time"))
    micros = pc.cast(t, pa.timestamp("us")).view(pa.int64()) if pa.types.is_timestamp(t.type) else pc.cast(t, pa.int64())
    out = micros.fill_null(0).to_numpy(zero_copy_only=False) / 1e6
    if t.null_count:
        out[np.asarray(t.is_null())] = np.nan
    return out


def over_trajectories(df: DataFrame, kernel: Kernel, schema: str, *, tie: str | None = "point_id", dealt: bool = False) -> DataFrame:
    """The kernel over df's trajectories (column traj_id, NULLs are one) in time order, NULL times last; ties by ``tie`` if df has it.

    A trajectory that is longer than a block comes in parts, so memory doesn't follow its length. dealt: df's partitions hold whole trajectories in
    that order already, as those of another such kernel's output do.
    """
    if not dealt:
        df = df.repartition("traj_id").sortWithinPartitions("traj_id", F.col("time").asc_nulls_last(), *([tie] if tie and tie in df.columns else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, wait, carried, fresh, current = 0, ROWS_AT_ONCE, None, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < wait:
                continue
            block = _joined(held)
            ids = block.column(block.schema.get_field_index("traj_id"))
            start = starts(ids)
            if not fresh and ids[0].as_py() != current:  # the one that came in parts was settled to its end
                fresh, carried = True, None
            if len(start) > 2:  # all but the last trajectory, which may go on
                cut = int(start[-2])
                if not fresh:  # the one that came in parts ends here
                    first = int(start[1])
                    yield kernel(block.slice(0, first), np.array([0, first]), False, carried)[0]
                    if cut > first:
                        yield kernel(block.slice(first, cut - first), start[1:-1] - first, False, None)[0]
                else:
                    yield kernel(block.slice(0, cut), start[:-1], False, None)[0]
                fresh, carried = True, None
            else:
                out, cut, carried = kernel(block, start, True, carried)
                fresh, current = False, ids[0].as_py()
                yield out
            held = [block.slice(cut)] if cut < block.num_rows else []
            rows = block.num_rows - cut
            wait = max(ROWS_AT_ONCE, 2 * rows)  # what can't be settled yet grows, so that it is not read again and again
        if rows:
            block = _joined(held)
            ids = block.column(block.schema.get_field_index("traj_id"))
            start = starts(ids)
            if not fresh and ids[0].as_py() != current:
                fresh, carried = True, None
            if fresh or len(start) == 2:
                yield kernel(block, start, False, carried)[0]
            else:
                first = int(start[1])
                yield kernel(block.slice(0, first), np.array([0, first]), False, carried)[0]
                yield kernel(block.slice(first), start[1:] - first, False, None)[0]

    return df.mapInArrow(run, schema)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in held]) for i in range(held[0].num_columns)], schema=held[0].schema)


def numbered(df: DataFrame, by: tuple[str, ...], name: str, first: int = 0) -> DataFrame:
    """df with a dense number by the columns' order, without a task that sees all rows.

    The rows are dealt out by range and sorted; each partition counts from the sum of those before, which are as many numbers as there are partitions.
    """
    ranged = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "ranged")
    counts = sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    before = dict(zip((p for p, _ in counts), np.cumsum([first, *(n for _, n in counts)]).tolist()))
    if not before:
        return ranged.withColumn(name, F.lit(None).cast("long")).drop("__part", "__row")
    base = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    return ranged.withColumn(name, (base[F.col("__part")] + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__part", "__row")


#: Numbers of an order column that are counted together.
_CHUNK = 100_000


def dense_number(df: DataFrame, order: str, name: str, first: int = 0) -> DataFrame:
    """df with a dense number in the order of a column of distinct longs, as part of the plan: counts by chunk of the column, and a count within each."""
    at, n, base = "__chunk", "__n", "__base"
    chunked = df.withColumn(at, F.floor(F.col(order) / _CHUNK))
    sums = chunked.groupBy(at).agg(F.count("*").alias(n))
    sums = sums.withColumn(base, F.sum(n).over(Window.orderBy(at)) - F.col(n)).drop(n)  # a row for each chunk
    nth = F.row_number().over(Window.partitionBy(at).orderBy(order))
    return chunked.withColumn(n, nth).join(sums, at).withColumn(name, (F.col(base) + F.col(n) - 1 + first).cast("long")).drop(at, n, base)
