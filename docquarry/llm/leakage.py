"""Evaluation passages in training text, by greedy string tiling.

Seeds are windows of ``seed`` words of a test item, hashed by a running
Karp-Rabin polynomial over word hashes (prefix sums, so a window of any length
costs one subtraction). A document that shares a seed with an item is compared
with it: the longest match of unmarked words is marked as a tile, again and
again, until no match of ``seed`` words is left. Tiles don't overlap and may
stand in any order, so a passage whose sentences were moved about still covers
its item.

Where the items are small (a counted bound) they travel to the scan and no document
is shuffled. Beyond the bound a filter of the items' seeds travels, FILTER_BITS long
whatever their number; the scan gives only windows that pass it, and those meet the
items in a shuffled join on the seed. Both give the same rows.

Defined results: null and empty texts match nothing; an item shorter than the
seed has none; repeated ids are compared row by row and give one row per pair
with the greatest coverage.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.words import words
from docquarry.llm.nearduplicates import word_hashes
from docquarry.runtime import cut

#: Seed windows up to which the items travel to the scan; a window takes two characters at least.
SEED_ROWS = 2_000_000
#: Bits of the filter of seeds (16 MB).
FILTER_BITS = 1 << 27
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), np.uint64(base))]).astype(np.uint64), out=out)
    return out


class Rolling:
    """Karp-Rabin hashes of all windows of a word sequence, of any length."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, n)[:n], dtype=np.uint64)])
        self.back = _powers(_INVERSE, n + 1)

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return (self.sums[k:] - self.sums[:n]) * self.back[:n]


def _matches(doc: np.ndarray, item: np.ndarray, starts: np.ndarray, seeds: np.ndarray, item_seeds: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """(length, doc position, item position) of all maximal matches of word hashes.

    ``seeds`` are the document's windows at ``starts``. A match is taken up only where it
    begins, so repeated words give one match per diagonal and not one per position."""
    out = []
    for j, h in enumerate(item_seeds):
        at = starts[seeds == h]
        if j and len(at):
            at = at[(at == 0) | (doc[at - 1] != item[j - 1])]
        for i in at.tolist():
            n = min(len(doc) - i, len(item) - j)
            differ = doc[i : i + n] != item[j : j + n]
            k = int(differ.argmax())
            length = k if differ[k] else n
            if length >= seed:
                out.append((length, i, j))
    return out


def tiles(doc: np.ndarray, item: np.ndarray, starts: np.ndarray, seeds: np.ndarray, item_seeds: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """(doc position, item position, length) of the tiles, longest first."""
    waiting = [(-n, i, j) for n, i, j in _matches(doc, item, starts, seeds, item_seeds, seed)]
    heapq.heapify(waiting)
    out: list[tuple[int, int, int]] = []
    in_doc, in_item = set(), np.zeros(len(item), np.bool_)
    while waiting and not in_item.all():
        n, i, j = heapq.heappop(waiting)
        free = [k for k in range(-n) if not in_item[j + k] and i + k not in in_doc]
        if len(free) == -n:
            out.append((i, j, -n))
            in_doc.update(range(i, i - n))
            in_item[j : j - n] = True
        elif len(free) >= seed:
            # what is left of the match between marked words competes again
            for part in np.split(np.array(free), np.flatnonzero(np.diff(free) != 1) + 1):
                if len(part) >= seed:
                    heapq.heappush(waiting, (-len(part), i + int(part[0]), j + int(part[0])))
    return out


class Items:
    """Test items prepared for comparison."""

    def __init__(self, rows: list[tuple[int, str | None]], seed: int) -> None:
        self.seed, self.items, self.by_window = seed, [], {}
        for item_id, text in rows:
            w = words(text)
            if len(w) < seed:
                continue
            hashes = word_hashes(w)
            own = Rolling(hashes).windows(seed)
            for h in set(own.tolist()):
                self.by_window.setdefault(h, []).append(len(self.items))
            self.items.append((item_id, w, hashes, own))
        self.seeds = np.sort(np.array(list(self.by_window), np.uint64))

    def compare(self, text: str | None) -> list[tuple[int, int, int, float, int]]:
        """(item, tiles, covered words, coverage, longest tile) of the items met in a text."""
        w = words(text)
        if len(w) < self.seed or not len(self.seeds):
            return []
        hashes = word_hashes(w)
        windows = Rolling(hashes).windows(self.seed)
        at = np.minimum(np.searchsorted(self.seeds, windows), len(self.seeds) - 1)
        starts = np.flatnonzero(self.seeds[at] == windows)
        if not len(starts):
            return []
        seeds = windows[starts]
        met = sorted({n for h in set(seeds.tolist()) for n in self.by_window[h]})
        out = []
        for n in met:
            item_id, words_of, item_hashes, own = self.items[n]
            found = tiles(hashes, item_hashes, starts, seeds, own, self.seed)
            # the hashes found them, the words decide
            found = [t for t in found if w[t[0] : t[0] + t[2]] == words_of[t[1] : t[1] + t[2]]]
            if found:
                covered = sum(t[2] for t in found)
                out.append((item_id, len(found), covered, covered / len(words_of), found[0][2]))
        return out


_ROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tiles", pa.int32()), ("n_covered", pa.int32()), ("coverage", pa.float64()), ("longest", pa.int32())])
_SHAPE = "doc_id long, item_id long, n_tiles int, n_covered int, coverage double, longest int"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROW)], schema=_ROW)


def _seed_rows(df: DataFrame, seed: int, passed=None) -> DataFrame:
    """(id, seed hash) of every distinct window of a text, or of those in a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if passed is None else np.frombuffer(passed.value, np.uint8)
        for b in batches:
            hashes = [np.unique(Rolling(word_hashes(words(t))).windows(seed)) for t in b.column(1).to_pylist()]
            if bits is not None:
                at = [(h % np.uint64(FILTER_BITS)).astype(np.int64) for h in hashes]
                hashes = [h[(bits[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1] for h, i in zip(hashes, at)]
            at = pa.array(np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]))
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(flat.view(np.int64))], ["id", "seed"])

    return df.mapInArrow(run, "id long, seed long")


def _seed_filter(seeds: DataFrame) -> bytes:
    """One bit for every seed, by its hash modulo FILTER_BITS; built as bitmaps of 4 KB."""
    bit = F.pmod("seed", F.lit(FILTER_BITS)) + 1
    maps = seeds.groupBy(F.bitmap_bucket_number(bit).alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in maps.collect():  # FILTER_BITS / 32,768 rows at most
        out[(r.no - 1) * 4096 : r.no * 4096] = r.bits
    return bytes(out)


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", seed: int = 12, seed_rows: int = SEED_ROWS) -> DataFrame:
    """One row per document and item that share ``seed`` consecutive words: tiles,
    covered words, coverage of the item and longest tile."""
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    t = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text"))
    best = F.max(F.struct("coverage", "longest", "n_tiles", "n_covered")).alias("m")
    few = t.agg(F.sum(F.length("text"))).first()[0] or 0
    if few <= 4 * seed_rows:  # a window needs two characters at least
        held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in t.collect()])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = Items(held.value, seed)
            for b in batches:
                rows = [(i, *r) for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in ready.compare(s)]
                if rows:
                    yield _batch(rows)

        found = d.mapInArrow(scan, _SHAPE)
    else:
        two = cut(_seed_rows(t, seed).withColumnRenamed("id", "item_id"))
        passed = docs.sparkSession.sparkContext.broadcast(_seed_filter(two))
        one = _seed_rows(d, seed, passed).withColumnRenamed("id", "doc_id")
        pairs = one.join(two, "seed").select("doc_id", "item_id").distinct()
        met = pairs.join(d.select(F.col("id").alias("doc_id"), F.col("text").alias("doc_text")), "doc_id").join(t.select(F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item_id")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, *r) for i, s, j, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_text", "item_id", "item_text"))) for r in Items([(j, x)], seed).compare(s)]
                if rows:
                    yield _batch(rows)

        found = met.select("doc_id", "doc_text", "item_id", "item_text").mapInArrow(verify, _SHAPE)
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.n_tiles", "m.n_covered", "m.coverage", "m.longest")
