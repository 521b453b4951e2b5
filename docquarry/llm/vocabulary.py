"""Frequency of every distinct term, from compressed record bitmaps.

Vertical layout: for each term the set of records that hold it, cut into
containers of 2^16 record numbers. A container is a sorted list of 16-bit
numbers, or a bitmap where that is smaller. Containers are built next to the
scan together with occurrence counters, merged by union per (term, container),
and a term's record count is the sum of its containers' cardinalities. A term
that stands in every record is thereby spread over all its containers.

Records get dense numbers from their distinct keys. The key table is cut on
shared storage first, so a lost executor can't renumber it. A record delivered
several times, even very often, is one number; AQE splits its rows if they are
many, and the union takes them together again.

Defined results: unreadable texts take no part; a readable record without terms
counts as a record; null keys are keys; occurrences are counted over all
delivered rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.runtime import cut

#: Stands for "a record"; no term is empty.
ALL_RECORDS = ""
#: Term occurrences a task holds before it writes containers.
FLUSH_TERMS = 3_000_000
#: Members from which a container may be a bitmap.
_DENSE = 64


def _binary(parts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of a uint16 array, which end at ``ends``, as binary values."""
    off = np.concatenate([[0], ends]).astype(np.int64) * 2
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(parts))]).cast(pa.binary())


def _containers(term: np.ndarray, record: np.ndarray, weight: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    """Containers of (term code, record, occurrences) rows."""
    order = np.lexsort((record, term))
    term, record, weight = term[order], record[order], weight[order]
    chunk, low = record >> 16, (record & 0xFFFF).astype(np.uint16)
    first = np.ones(len(term), np.bool_)
    first[1:] = (term[1:] != term[:-1]) | (chunk[1:] != chunk[:-1])
    fresh = first.copy()
    fresh[1:] |= low[1:] != low[:-1]
    start = np.flatnonzero(first)
    occ = np.add.reduceat(weight, start) if len(start) else np.zeros(0, np.int64)
    held = np.cumsum(fresh)
    ends = held[np.append(start[1:], len(term)) - 1] if len(start) else np.zeros(0, np.int64)
    low = low[fresh]
    card = np.diff(np.concatenate([[0], ends]))
    ids = _binary(low, ends)
    dense, maps = np.flatnonzero(card >= _DENSE), {}
    for i in dense.tolist():
        own = low[ends[i] - card[i] : ends[i]]
        if int(own[-1]) // 8 + 1 < 2 * len(own):
            bits = np.zeros(int(own[-1]) + 1, np.uint8)
            bits[own] = 1
            maps[i] = np.packbits(bits, bitorder="little").tobytes()
    if maps:
        isbit = np.zeros(len(card), np.bool_)
        isbit[list(maps)] = True
        ids = pc.if_else(pa.array(isbit), b"", ids)
    bitmaps = pa.array([maps.get(i) for i in range(len(card))] if maps else [None] * len(card), pa.binary())
    return pa.RecordBatch.from_arrays([names.take(pa.array(term[start])), pa.array(chunk[start]), pa.array(occ), pa.array(card), ids, bitmaps], ["term", "chunk", "occ", "card", "ids", "bits"])


_SHAPE = "term string, chunk long, occ long, card long, ids binary, bits binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (record, terms, counts) to containers."""
    held, rows = [], 0

    def out() -> pa.RecordBatch:
        names = pa.chunked_array([x[0] for x in held]).combine_chunks().dictionary_encode()
        return _containers(np.asarray(names.indices).astype(np.int64), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), names.dictionary)

    for b in batches:
        if not b.num_rows:
            continue
        terms, counts = b.column("terms"), b.column("counts")
        owner = np.asarray(pc.list_parent_indices(terms))
        held.append((pc.list_flatten(terms), np.asarray(b.column("record"))[owner], np.asarray(pc.list_flatten(counts)).astype(np.int64)))
        rows += len(owner)
        if rows >= FLUSH_TERMS:
            yield out()
            held, rows = [], 0
    if rows:
        yield out()


def _members(ids: bytes, bits: bytes | None) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).astype(np.uint16) if bits else np.frombuffer(ids, np.uint16)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers sorted by (term, chunk) to (term, occurrences, cardinality)."""
    rest: pa.Table | None = None

    def union(t: pa.RecordBatch) -> pa.RecordBatch:
        n = t.num_rows
        term, chunk = t.column("term"), np.asarray(t.column("chunk"))
        first = np.ones(n, np.bool_)
        if n > 1:
            first[1:] = np.asarray(pc.not_equal(term.slice(0, n - 1), term.slice(1))) | (chunk[1:] != chunk[:-1])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, n))
        card = np.asarray(t.column("card"))[start].copy()
        for g in np.flatnonzero(size > 1).tolist():
            own = t.slice(int(start[g]), int(size[g]))
            card[g] = len(np.unique(np.concatenate([_members(i, b) for i, b in zip(own.column("ids").to_pylist(), own.column("bits").to_pylist())])))
        occ = np.add.reduceat(np.asarray(t.column("occ")), start)
        return pa.RecordBatch.from_arrays([term.take(pa.array(start)), pa.array(occ), pa.array(card)], ["term", "occ", "card"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        t = t.combine_chunks().to_batches()[0]
        # the last (term, chunk) may go on in the next batch
        last_term, last_chunk = t.column("term")[-1], t.column("chunk")[-1].as_py()
        same = np.asarray(pc.equal(t.column("term"), last_term)) & (np.asarray(t.column("chunk")) == last_chunk)
        at = t.num_rows - int(same.sum())
        if at:
            yield union(t.slice(0, at))
        rest = pa.Table.from_batches([t.slice(at)])
    if rest is not None and rest.num_rows:
        yield union(rest.combine_chunks().to_batches()[0])


def term_frequencies(df: DataFrame, key: Sequence[str], text: str, terms_of: Callable[[str | None], list[str] | None]) -> DataFrame:
    """(term, n_occurrences, n_records) of every term; term '' holds the number of records.

    ``terms_of`` gives a text's terms with repeats, or None if it is unreadable.
    """
    names = [f"k{i}" for i in range(len(key))]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, terms, counts = [], [], []
            for i, s in enumerate(b.column("text").to_pylist()):
                found = terms_of(s)
                if found is None:
                    continue
                n: dict[str, int] = {ALL_RECORDS: 1}
                for w in found:
                    n[w] = n.get(w, 0) + 1
                at.append(i)
                terms.append(list(n))
                counts.append(list(n.values()))
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(rows) for c in names], pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))], [*names, "terms", "counts"])

    rows = df.select(*[F.col(c).cast("string").alias(k) for c, k in zip(key, names)], F.col(text).alias("text"))
    numbered = cut(rows.select(*names).distinct().withColumn("record", F.monotonically_increasing_id()))
    keyed = rows.mapInArrow(tokens, ", ".join(f"{k} string" for k in names) + ", terms array<string>, counts array<int>")
    same = [keyed[k].eqNullSafe(numbered[k]) for k in names]
    on = same[0]
    for s in same[1:]:
        on = on & s
    built = keyed.join(numbered, on).select("record", "terms", "counts").mapInArrow(_build, _SHAPE)
    merged = built.repartition("term", "chunk").sortWithinPartitions("term", "chunk").mapInArrow(_merge, "term string, occ long, card long")
    return merged.groupBy("term").agg(F.sum("occ").alias("n_occurrences"), F.sum("card").alias("n_records"))


def marked(freq: DataFrame, rare: int = 1, common_share: float = 0.25) -> DataFrame:
    """``freq`` with ``mark``: 'rare' for terms in at most ``rare`` records, 'common' for
    those in more than ``common_share`` of them, else null. One total is read by the driver."""
    held = cut(freq)
    total = held.where(F.col("term") == ALL_RECORDS).agg(F.max("n_records")).first()[0] or 0
    share = round(common_share * 1_000_000)
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") * 1_000_000 > F.lit(total * share), "common")
    return held.where(F.col("term") != ALL_RECORDS).withColumn("mark", mark)
