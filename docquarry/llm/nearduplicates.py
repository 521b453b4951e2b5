"""Near-duplicate records by SuperMinHash, banding, verification and union-find.

1. Every record becomes its set of word shingles. Records of equal sets are one
   class (a fingerprint of the set); only the class's least id goes on.
2. SuperMinHash: each element visits the signature's slots in a permutation of
   its own, at step j with rank j + u. Ranks of one element are correlated, which
   lowers the variance, and a record stops as soon as every slot holds a value of
   an earlier step, usually after a few.
3. Bands of ROWS slots are equi-joined; candidate pairs are verified on the
   shingle sets. Hot buckets are split by AQE's skew join; equal sets can't form
   one, since they are a single class.
4. Verified links are grouped by distributed union-find.

Sets are compared by 32-bit hashes of the shingles: two sets of n shingles agree
falsely in about n*n/2^32 of them. With BANDS x ROWS = 52 x 4 a pair at
similarity 0.6 is missed with probability 0.0007, at 0.7 with 7e-7.

All similar pairs are the result that is asked for, so a bucket of n different but
similar records leads to its candidate pairs; the shuffled join spreads them over
tasks, and only pairs of different classes are formed. Whoever needs groups only
reads :func:`similar_groups`, which gives one row per record.

Defined results: unreadable records and records without a shingle are in no pair
and are a class and a group of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.components import components
from docquarry.runtime import cut, maybe_broadcast

#: Signature slots (a prime), bands and slots of a band.
SLOTS, BANDS, ROWS = 211, 52, 4
#: Records of equal text up to this number are expanded into all their pairs; more
#: are written as links of their least id. Pairs of differing texts always are pairs.
COPY_PAIRS = 256
_MAX = np.uint64(2**64 - 1)
_CACHE: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multiplications)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, remembered for a bounded number of words."""
    if len(_CACHE) > 500_000:
        _CACHE.clear()
    get, out = _CACHE.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _CACHE[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of ``k`` consecutive words, sorted."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(h)


def superminhash(doc: np.ndarray, element: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (docs x slots) of the sets given as (doc, element hash) rows.

    The element's permutation is j -> (a*j + b) mod slots; ``slots`` is prime. Slots
    of an empty set keep the greatest value.
    """
    h = np.full(docs * slots, _MAX, np.uint64)
    with np.errstate(over="ignore"):
        seed = mix(element)
    a = (seed % np.uint64(slots - 1)).astype(np.int64) + 1
    b = ((seed >> np.uint64(20)) % np.uint64(slots)).astype(np.int64)
    base, alive = doc.astype(np.int64) * slots, np.arange(len(doc))
    empty = np.full(docs, slots, np.int64)
    for j in range(slots):
        low = np.uint64(j << 32)
        at = base[alive] + (a[alive] * j + b[alive]) % slots
        if j:
            free = h[at] >= low
            at, mine = at[free], alive[free]
        else:
            mine = alive
        with np.errstate(over="ignore"):
            value = low | (mix(element[mine] + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32))
        new = np.unique(at[h[at] == _MAX])
        np.minimum.at(h, at, value)
        if len(new):
            empty -= np.bincount(new // slots, minlength=docs)
        alive = alive[empty[doc[alive]] > 0]
        if not len(alive):
            break
    return h.reshape(docs, slots)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band (docs x bands)."""
    keys = np.empty((len(signatures), bands), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(bands):
            k = np.full(len(signatures), np.uint64(i + 1))
            for j in range(rows):
                k = mix(k * np.uint64(0x9E3779B97F4A7C15) + signatures[:, i * rows + j])
            keys[:, i] = k
    return keys


def _list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))


#: Records a batch takes at once.
_STEP = 512


def features(df: DataFrame, id_col: str, text_col: str, words_of: Callable[[str | None], list[str] | None], k: int) -> DataFrame:
    """(id, print, same, n, shingles, bands) of every record; n is 0 without a shingle,
    print is of the set, same of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _STEP):
                b = whole.slice(start, _STEP)
                texts = b.column("text").to_pylist()
                sets = [shingle_hashes(word_hashes(words_of(t) or []), k) for t in texts]
                n = np.array([len(s) for s in sets])
                doc = np.repeat(np.arange(len(sets)), n)
                flat = np.concatenate(sets)
                bands = band_keys(superminhash(doc, flat, len(sets)))
                prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                small = [np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) for s in sets]
                full = [x if c else x[:0] for x, c in zip(bands.view(np.int64), n)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(prints, pa.binary()), pa.array([xxhash.xxh3_128_digest(t or "") for t in texts], pa.binary()), pa.array([len(s) for s in small], pa.int32()), _list_array(small, pa.int32()), _list_array(full, pa.int64())], ["id", "print", "same", "n", "shingles", "bands"]
                )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, print binary, same binary, n int, shingles array<int>, bands array<long>")


def classes(feats: DataFrame) -> DataFrame:
    """(id, rep, size, same): records of equal shingle sets share the least id of them."""
    some = feats.where("n > 0")
    reps = some.groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    return some.select("id", "print", "same").join(reps, "print").select("id", "rep", "size", "same")


def similar_classes(feats: DataFrame, member: DataFrame, threshold: float) -> DataFrame:
    """Verified pairs (rep_a < rep_b) of classes at ``threshold`` or above."""
    copies = member.where("id <> rep").select("id")
    own = feats.where("n > 0").join(maybe_broadcast(copies), "id", "left_anti")
    bands = own.select("id", F.explode("bands").alias("band"))
    other = bands.select(F.col("id").alias("id_b"), "band")
    pairs = bands.join(other, "band").where("id < id_b").select(F.col("id").alias("rep_a"), F.col("id_b").alias("rep_b")).distinct()
    cand = cut(pairs)
    met_ids = cand.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
    sets = feats.select("id", "n", "shingles").join(maybe_broadcast(met_ids), "id", "left_semi")
    one = sets.select(F.col("id").alias("rep_a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    two = sets.select(F.col("id").alias("rep_b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    # sizes alone rule out pairs whose smaller set is below the threshold's share
    met = cand.join(one, "rep_a").join(two, "rep_b").where((F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold) - 1e-9))
    both = met.withColumn("both", F.size(F.array_intersect("s_a", "s_b")))
    return both.where(F.col("both") >= (F.col("n_a") + F.col("n_b") - F.col("both")) * F.lit(threshold) - 1e-9).select("rep_a", "rep_b")


def similar_pairs(df: DataFrame, id_col: str, text_col: str, words_of: Callable, k: int, threshold: float) -> DataFrame:
    """All pairs (a < b) of records at ``threshold`` or above, copies included, but for
    texts of more than COPY_PAIRS equal records, which are linked to their least id."""
    feats = cut(features(df, id_col, text_col, words_of, k))
    member = cut(classes(feats))
    links = similar_classes(feats, member, threshold)
    one = member.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    two = member.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    across = links.join(one, "rep_a").join(two, "rep_b").select("x", "y")
    many = member.where("size > 1").select("id", "rep", "same")
    texts = cut(many.groupBy("rep", "same").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    # equal sets, differing texts: pairs of texts, then of their records
    t = texts.select("rep", F.col("same").alias("t_a")).join(texts.select("rep", F.col("same").alias("t_b")), "rep").where("t_a < t_b")
    inside = t.join(many.select("rep", F.col("same").alias("t_a"), F.col("id").alias("x")), ["rep", "t_a"]).join(many.select("rep", F.col("same").alias("t_b"), F.col("id").alias("y")), ["rep", "t_b"]).select("x", "y")
    known = many.join(texts, ["rep", "same"])
    small = known.where(F.col("n") <= COPY_PAIRS)
    copies = small.select("rep", "same", F.col("id").alias("x")).join(small.select("rep", "same", F.col("id").alias("y")), ["rep", "same"]).where("x < y").select("x", "y")
    stars = known.where(F.col("n") > COPY_PAIRS).where("id > first").select(F.col("first").alias("x"), F.col("id").alias("y"))
    return across.unionByName(inside).unionByName(copies).unionByName(stars).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_groups(df: DataFrame, id_col: str, text_col: str, words_of: Callable, k: int, threshold: float) -> DataFrame:
    """One row per record: id, class_id, n_links (classes linked to its own), group_id."""
    feats = cut(features(df, id_col, text_col, words_of, k))
    member = cut(classes(feats))
    links = cut(similar_classes(feats, member, threshold))
    degree = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    group = components(links, "rep_a", "rep_b").select(F.col("node").alias("rep"), F.col("component").alias("group_id"))
    of_class = member.select("id", "rep").join(degree, "rep", "left").join(group, "rep", "left")
    return feats.select("id").join(of_class, "id", "left").select("id", F.coalesce("rep", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "rep", "id").alias("group_id"))
