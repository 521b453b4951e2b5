"""Filling fixed-capacity containers: hierarchical residual packing.

1. Every partition measures its items and packs them by best fit, greatest first.
   Only an item above the capacity is split, into full pieces and a rest.
2. Bins filled to NEARLY_FULL of the capacity are final.
3. All other bins are opened, and what they held is merged up the tree of a partial
   aggregation as counts per size: best fit sees nothing of an item but its size, so
   the counts lose nothing, and a level holds at most one number per size, whatever
   the number of items. Best fit runs again over the merged counts, whole runs of
   equal items at once, and says which run goes into which bins.
4. Items find their bins by their number among those of their size: their place in the
   partition plus the counts of the partitions before it.

No item is left out of the second round and no task or driver holds more than the
sizes up to the capacity and the runs that best fit makes of them (a few per size).

Defined results: a null or empty text has no tokens and takes no room, but is in
a bin; repeated ids are items of their own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.runtime import cut, maybe_broadcast

CAPACITY = 4096
NEARLY_FULL = 0.995
#: Items packed together within a partition.
GROUP = 200_000
#: Fixed value: the public pattern that belongs to vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(vocabulary: bytes):
    """Encoder of a rank file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


#: White space the pattern matcher isn't given; it would backtrack too deeply.
_LONG_BLANK = re.compile(r"\s{4096,}")


def count_tokens(text: str | None, vocabulary: bytes) -> int:
    """Tokens of the whole text. A very long run of white space is one piece of the
    pattern (all but its last character where text follows) and is encoded as such."""
    if not text:
        return 0
    enc, n, at = encoding(vocabulary), 0, 0
    for m in _LONG_BLANK.finditer(text):
        end = m.end() - (m.end() < len(text))
        n += len(enc.encode_ordinary(text[at : m.start()])) + len(enc._encode_single_piece(text[m.start() : end].encode()))
        at = end
    return n + len(enc.encode_ordinary(text[at:] if at else text))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number of each item (sizes <= capacity), greatest first; fill of each bin.

    Open bins lie in stacks by their free room; a bit set of the rooms in use finds
    the smallest one that is large enough.
    """
    bins = np.zeros(len(sizes), np.int64)
    rooms: dict[int, list[int]] = {}
    used, fill = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = used >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                used &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        fill[b] += s
        bins[i] = b
        left = room - s
        rooms.setdefault(left, []).append(b)
        used |= 1 << left
    return bins, np.array(fill, np.int64)


class Runs:
    """Best fit over counts per size: where the items of each size go.

    Of a size, the items from ``start`` on fill bins from ``first`` on, ``each`` to a bin."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rooms: dict[int, list[tuple[int, int]]] = {}  # room -> (first bin, bins)
        used = self.bins = 0
        for s in sorted(counts, reverse=True):
            left, start, made = counts[s], 0, []
            while left:
                fits = used >> s
                if fits:
                    room = s + (fits & -fits).bit_length() - 1
                    first, n = rooms[room].pop()
                    if not rooms[room]:
                        used &= ~(1 << room)
                else:
                    room, first = capacity, self.bins
                    n = -(-left // (capacity // s)) if s else 1
                    self.bins += n
                # best fit returns to the bin it has just used until nothing more goes in
                each = room // s if s else left
                whole = min(n, left // each)
                for bins, items in ((whole, each), (min(1, n - whole), left - whole * each if whole < n else 0)):
                    if bins and items:
                        made.append((start, first, items))
                        rooms.setdefault(room - items * s, []).append((first, bins))
                        used |= 1 << (room - items * s)
                        start += bins * items
                        left -= bins * items
                        first += bins
                        n -= bins
                if n:
                    rooms.setdefault(room, []).append((first, n))
                    used |= 1 << room
            self.of[s] = tuple(np.array(c, np.int64) for c in zip(*made))

    def bin_of(self, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Bins of the ``place``-th items of their sizes."""
        out = np.zeros(len(size), np.int64)
        for s in np.unique(size).tolist():
            at = np.flatnonzero(size == s)
            start, first, each = self.of[s]
            run = np.searchsorted(start, place[at], "right") - 1
            out[at] = first[run] + (place[at] - start[run]) // each[run]
        return out


def sized_pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item index, piece number, size) with items above the capacity split."""
    n = np.maximum(1, -(-sizes // capacity))
    owner = np.repeat(np.arange(len(sizes)), n)
    no = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return owner, no, np.minimum(capacity, sizes[owner] - no * capacity)


def pack(df: DataFrame, id_col: str, text: str, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece_no, size, bin_id): the bin of every item or piece of one. ``tokenizer`` is
    the path of a rank file on the driver; its content travels with the job."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, sizes, held = TaskContext.get().partitionId(), [], [], 0
        base, seen = part << 33, np.zeros(capacity + 1, np.int64)

        def out() -> pa.RecordBatch:
            nonlocal base, seen
            owner, no, size = sized_pieces(np.array(sizes, np.int64), capacity)
            bins, fill = best_fit(size, capacity)
            open_ = fill[bins] < capacity * NEARLY_FULL
            # places among the open items of a size, in the whole partition
            order = np.argsort(size[open_], kind="stable")
            own = size[open_][order]
            place = np.zeros(len(size), np.int64)
            place[np.flatnonzero(open_)[order]] = seen[own] + np.arange(len(own)) - np.searchsorted(own, own)
            seen = seen + np.bincount(own, minlength=capacity + 1)
            rows = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids).take(pa.array(owner)), pa.array(no.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(base + bins), pa.array(open_), pa.array(np.full(len(size), part, np.int32)), pa.array(place)],
                ["id", "piece_no", "size", "bin_id", "open", "part", "place"],
            )
            base += len(fill)
            return rows

        for b in batches:
            ids.append(b.column(0))
            sizes += [count_tokens(t, vocabulary.value) for t in b.column(1).to_pylist()]
            held += b.num_rows
            if held >= GROUP:
                yield out()
                ids, sizes, held = [], [], 0
        if held:
            yield out()

    items = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    first = cut(items.mapInArrow(local, "id long, piece_no int, size int, bin_id long, open boolean, part int, place long"))
    rest = first.where("open")
    counts = cut(rest.groupBy("part", "size").agg(F.count("*").alias("n")))
    before = W.partitionBy("size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    offsets = counts.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    runs = first.sparkSession.sparkContext.broadcast(Runs({r.size: r.n for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}, capacity))  # one row per size

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = runs.value
        for b in batches:
            bins = ready.bin_of(np.asarray(b.column("size")).astype(np.int64), np.asarray(b.column("place")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "piece_no", "size")), pa.array(-1 - bins)], ["id", "piece_no", "size", "bin_id"])

    numbered = rest.join(maybe_broadcast(cut(offsets)), ["part", "size"]).select("id", "piece_no", "size", (F.col("place") + F.col("before")).alias("place"))
    return first.where("not open").select("id", "piece_no", "size", "bin_id").unionByName(numbered.mapInArrow(assign, "id long, piece_no int, size int, bin_id long"))
