"""Per-key results without a task per hot key: exact offset chunking.

Rows are range-partitioned by (key, value, row id), so partitions have equal
sizes whatever the keys' sizes and a hot key is spread over many of them. The
rows of a key are counted per partition, offsets are prefix-summed, every row
gets its exact number within its key, and equal chunks of a key become small
ordered states that are merged at their boundaries.

Only the first key of a partition can have begun in an earlier one, so the
offsets are one number per partition; that is all the driver sees.

Defined results: a null key is a key of its own; null values count as rows but
not as distinct values; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.runtime import cut, shuffle_parts

#: Rows of a chunk.
CHUNK_ROWS = 65_536


def _changes(col: pa.Array) -> np.ndarray:
    """Whether each row differs from the one before it (nulls are equal); the first does."""
    n = len(col)
    out = np.ones(n, np.bool_)
    if n > 1:
        a, b = col.slice(0, n - 1), col.slice(1)
        ne = pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_valid(a), pc.is_valid(b)))
        out[1:] = np.asarray(ne)
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: rows of its first and of its last key."""
    pid, total, first_n, last_n = TaskContext.get().partitionId(), 0, 0, 0
    first = last = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        col = b.column("__key")
        at = np.flatnonzero(_changes(col))
        runs = np.diff(np.append(at, n))
        heads = [(col[int(at[0])].as_py(),), (col[int(at[-1])].as_py(),)]
        if first is None:
            first, first_n, last, last_n = heads[0], int(runs[0]), heads[0], 0
        elif heads[0] == first and first_n == total:
            first_n += int(runs[0])
        last_n = int(runs[-1]) + (last_n if len(at) == 1 and heads[1] == last else 0)
        last = heads[1]
        total += n
    if first is not None:
        yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "total": pa.array([total], pa.int64()), "first_n": pa.array([first_n], pa.int64()), "last_n": pa.array([last_n], pa.int64()), "first_key": pa.array([first[0]], col.type), "last_key": pa.array([last[0]], col.type)})


def _offsets(df: DataFrame) -> dict[int, int]:
    """Partition -> rows of its first key that lie in earlier partitions."""
    key_type = df.schema["__key"].dataType.simpleString()
    parts = df.select("__key").mapInArrow(_edges, f"pid int, total long, first_n long, last_n long, first_key {key_type}, last_key {key_type}")
    out, carried, key = {}, 0, None
    for r in sorted(parts.collect(), key=lambda r: r.pid):  # one small row per partition
        out[r.pid] = carried if key == (r.first_key,) else 0
        whole = r.first_n == r.total
        carried = (out[r.pid] if whole else 0) + (r.total if whole else r.last_n)
        key = (r.last_key,)
    return out


def _sorted_rows(df: DataFrame, key: str, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    cols = [F.col(f"`{key}`").alias("__key"), *[F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order)], *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]]
    by = ["__key", *[f"__o{i}" for i in range(len(order))]]
    rows = df.select(*cols).withColumn("__id", F.monotonically_increasing_id())
    # The row id splits even a run of equal rows over several partitions.
    return cut(rows.repartitionByRange(shuffle_parts(rows), *by, "__id").sortWithinPartitions(*by, "__id").drop("__id"))


def number_rows(df: DataFrame, key: str, order: Sequence[str], keep: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with ``row_no`` (0-based within the key, by ``order``) and ``chunk_no``.

    Like row_number over a window per key, but no task holds a whole key. Output
    columns: key, order columns, ``keep``, row_no, chunk_no; clashing names in
    ``df`` that aren't asked for are not read.
    """
    rows = _sorted_rows(df, key, order, keep)
    offsets = _offsets(rows)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = offsets.get(TaskContext.get().partitionId(), 0), None
        for b in batches:
            if not b.num_rows:
                continue
            no, last = _row_numbers(b.column("__key"), before, last)
            before = int(no[-1]) + 1
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(no), pa.array(no // chunk_rows)], [*names, "row_no", "chunk_no"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", row_no long, chunk_no long"
    out = rows.mapInArrow(run, schema)
    return out.toDF(key, *order, *keep, "row_no", "chunk_no")


def _row_numbers(col: pa.Array, before: int, last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Numbers within the key of a sorted batch's rows. ``before``: rows of the
    batch's first key seen so far; ``last``: the key of the row before the batch."""
    n = len(col)
    at = np.flatnonzero(_changes(col))
    lens = np.diff(np.append(at, n))
    no = np.arange(n, dtype=np.int64) - np.repeat(at, lens)
    if last is None or last == (col[0].as_py(),):
        no[: lens[0]] += before
    return no, (col[n - 1].as_py(),)


def key_stats(df: DataFrame, key: str, value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """For each key: ``n_rows``, ``n_distinct`` values, ``min_value``, ``max_value``
    and ``n_chunks``, exact, with equal work per task however skewed the keys are.

    Two rows of a key that follow each other in (key, value) order either lie in
    one piece or are the facing ends of two pieces; the merge subtracts one
    wherever those ends are equal. Pieces per key: rows / chunk_rows + partitions.
    """
    rows = _sorted_rows(df, key, [value])
    offsets = _offsets(rows)
    key_type, value_type = (rows.schema[c].dataType.simpleString() for c in ("__key", "__o0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = offsets.get(TaskContext.get().partitionId(), 0), None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys, values = b.column("__key"), b.column("__o0")
            no, last = _row_numbers(keys, before, last)
            before = int(no[-1]) + 1
            chunk = no // chunk_rows
            cut_at = _changes(keys)
            cut_at[1:] |= chunk[1:] != chunk[:-1]
            starts = np.flatnonzero(cut_at)
            ends = np.append(starts[1:], n)
            valid = np.asarray(pc.is_valid(values), dtype=np.int64)
            fresh = (_changes(values) | cut_at) & (valid == 1)
            seen = np.concatenate([[0], np.cumsum(fresh)])
            live = np.concatenate([[0], np.cumsum(valid)])
            # Nulls come first in the order: a piece's first value is its first non-null one.
            lead = np.minimum(starts + (ends - starts) - (live[ends] - live[starts]), ends - 1)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(starts)), pa.array(no[starts]), pa.array(chunk[starts]), pa.array(ends - starts), pa.array(seen[ends] - seen[starts]), values.take(pa.array(lead)), values.take(pa.array(ends - 1))],
                ["k", "start_no", "chunk_no", "n", "d", "lo", "hi"],
            )

    pieces = rows.mapInArrow(run, f"k {key_type}, start_no long, chunk_no long, n long, d long, lo {value_type}, hi {value_type}")
    before = F.lag("hi").over(W.partitionBy("k").orderBy("start_no"))
    merged = pieces.withColumn("twice", F.coalesce((before == F.col("lo")).cast("long"), F.lit(0)))
    return merged.groupBy("k").agg(
        F.sum("n").alias("n_rows"), (F.sum("d") - F.sum("twice")).alias("n_distinct"), F.min("lo").alias("min_value"), F.max("hi").alias("max_value"), F.countDistinct("chunk_no").alias("n_chunks")
    ).withColumnRenamed("k", key)
