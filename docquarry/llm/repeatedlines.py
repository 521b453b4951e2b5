"""Lines repeated across one source's documents.

Duplicate documents are collapsed first: documents of equal lines in equal order are
one cluster, and a line counts once per cluster, optionally over publication dates.
Only then are lines compared with the number of clusters of their source; a line may
also have to come on a number of days. Where the caller names places (paths) and wants
lines by distinct places, a cluster counts with the places it was published at, and a
place that was delivered with several contents still counts once.

Counting is a map-side combined distinct on (source, line, cluster), so one
source or one line holding a third of all rows is spread by the cluster. Lines
above a share s of their source's clusters number at most (mean lines per
document) / s per source, whatever the number of documents.

Defined results: unreadable documents take no part; lines without letters are
left out; a null source is a source, a null path one path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.words import letters
from docquarry.model.ast import as_list, read_tree, text_content
from docquarry.runtime import cut, maybe_broadcast

#: A line is repeated excessively from this many clusters and this share of its source's on.
MIN_CLUSTERS, MIN_SHARE = 5, 0.10
#: Publication days of a line, where days are counted: what came out on one day only may be one event.
MIN_DATES = 2


def line_key(line: str) -> int | None:
    """The first 60 bits of a hash of a line's letters, case ignored; None without letters."""
    bare = letters(line)
    return int(hashlib.md5(bare.encode("utf8", "surrogatepass"), usedforsecurity=False).hexdigest()[:15], 16) if bare else None


def body_lines(body: str | None) -> list[str] | None:
    """The text of each element of the document's top-level children."""
    tree = read_tree(body)
    return None if tree is None else [text_content(x) for x in as_list(tree.get("children"))]


def copy_key(keys: list[int]) -> int:
    """Equal for documents of equal lines in equal order, however they are encoded."""
    return (xxhash.xxh3_64_intdigest(np.array(keys, np.int64).tobytes()) ^ (1 << 63)) - (1 << 63)


def keyed_lines(df: DataFrame, doc_id: str, source: str, place: Column | None, body: str) -> DataFrame:
    """One row per line with letters (block_no, line_key) of each readable document,
    and one with null block_no and line_key that stands for the document itself.

    Documents of equal lines in equal order have one ``cluster``, at whatever ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, block, key, copy = [], [], [], []
            for i, text in enumerate(b.column("body").to_pylist()):
                lines = body_lines(text)
                if lines is None:
                    continue
                start = len(key)
                at.append(i)
                block.append(None)
                key.append(None)
                for no, line in enumerate(lines):
                    k = line_key(line)
                    if k is not None:
                        at.append(i)
                        block.append(no)
                        key.append(k)
                copy += [copy_key(key[start + 1 :])] * (len(key) - start)
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(rows) for c in ("doc_id", "source", "place")], pa.array(copy, pa.int64()), pa.array(block, pa.int32()), pa.array(key, pa.int64())], ["doc_id", "source", "place", "cluster", "block_no", "line_key"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), (F.lit(None) if place is None else place).cast("long").alias("place"), F.col(body).alias("body"))
    return rows.mapInArrow(run, "doc_id long, source string, place long, cluster long, block_no int, line_key long")


def line_counts(lines: DataFrame, dates: bool = False) -> DataFrame:
    """source, line_key, n_clusters (and n_dates if ``lines`` has a date); the rows of
    null line_key hold the source's own numbers."""
    names = ["source", "line_key", "cluster"]
    once = lines.groupBy(*names).agg(F.min("date").alias("date")) if dates else lines.select(*names).distinct()
    counts = [F.count("*").alias("n_clusters")]
    if not dates:
        return once.groupBy("source", "line_key").agg(*counts)
    per_day = once.groupBy("source", "line_key", "date").agg(F.count("*").alias("n"))
    return per_day.groupBy("source", "line_key").agg(F.sum("n").alias("n_clusters"), F.count("date").alias("n_dates"))


def place_counts(lines: DataFrame) -> DataFrame:
    """source, line_key, n_places: the distinct places of the clusters that hold the line;
    the rows of null line_key hold the source's own number.

    ``lines`` is read twice. A place belongs to the set of clusters it was delivered with,
    nearly always one. The sets part the places, so a line's places are the sum over the
    sets it occurs in; it is repeated per set of its cluster, at most per place.
    """
    at = lines.where("line_key is null").select("source", "place", "cluster").distinct()
    sets = at.groupBy(F.col("source").alias("__s"), F.col("place").alias("__p")).agg(F.expr("bit_xor(xxhash64(cluster))").alias("held"))
    met = at.join(sets, F.col("source").eqNullSafe(F.col("__s")) & F.col("place").eqNullSafe(F.col("__p")))
    sizes = met.groupBy(F.col("source").alias("__s"), F.col("cluster").alias("__c"), "held").agg(F.count("*").alias("n"))
    once = lines.select("source", "line_key", "cluster").distinct()
    in_sets = once.join(sizes, (F.col("cluster") == F.col("__c")) & F.col("source").eqNullSafe(F.col("__s")))
    # a line in several clusters of one set: the set's places once
    return in_sets.groupBy("source", "line_key", "held").agg(F.max("n").alias("n")).groupBy("source", "line_key").agg(F.sum("n").alias("n_places"))


def excessive(counts: DataFrame, min_clusters: int = MIN_CLUSTERS, min_share: float = MIN_SHARE, min_dates: int = MIN_DATES) -> DataFrame:
    """The lines of ``counts`` that are repeated excessively, with their source's total.
    Days count where ``counts`` has them; lines without any known day aren't on several.
    The limits are on places where ``counts`` has those."""
    n = "n_places" if "n_places" in counts.columns else "n_clusters"
    if "n_dates" in counts.columns:
        counts = counts.where(F.col("line_key").isNull() | (F.col("n_dates") >= min_dates))
    kept = cut(counts.where(F.col("line_key").isNull() | (F.col(n) >= min_clusters)))
    totals = kept.where("line_key is null").select(F.col("source").alias("__s"), F.col(n).alias("n_total"))
    lines = kept.where("line_key is not null").join(totals, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # min_share as a ratio of whole numbers: no rounding at the limit
    return lines.where(F.col(n) * 1_000_000 >= F.col("n_total") * F.lit(round(min_share * 1_000_000)))


def repeated_line_cases(df: DataFrame, doc_id: str, source: str, place: Column | None, body: str, min_clusters: int = MIN_CLUSTERS, min_share: float = MIN_SHARE) -> DataFrame:
    """Every occurrence (doc_id, block_no) of an excessively repeated line: by the places of
    its clusters, or by the clusters alone without a ``place``."""
    lines = cut(keyed_lines(df, doc_id, source, place, body))
    bad = cut(excessive(line_counts(lines) if place is None else place_counts(lines), min_clusters, min_share).select(F.col("source").alias("__s"), F.col("line_key").alias("__k")))
    hit = lines.where("block_no is not null").join(maybe_broadcast(bad), (F.col("line_key") == F.col("__k")) & F.col("source").eqNullSafe(F.col("__s")))
    return hit.select("doc_id", "block_no")


def without_repeated_lines(df: DataFrame, doc_id: str, source: str, place: Column | None, body: str, min_clusters: int = MIN_CLUSTERS, min_share: float = MIN_SHARE) -> DataFrame:
    """Each readable document's text without its source's excessive lines, and how many went.

    A source's excessive lines are one bounded array; documents meet it by source.
    """
    lines = cut(keyed_lines(df, doc_id, source, place, body).select("source", "place", "cluster", "line_key"))
    bad = excessive(line_counts(lines) if place is None else place_counts(lines), min_clusters, min_share).groupBy(F.col("source").alias("__s")).agg(F.collect_list("line_key").alias("bad"))
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(body).alias("body"))
    met = docs.join(maybe_broadcast(cut(bad), 10_000), F.col("source").eqNullSafe(F.col("__s")), "left").select("doc_id", "body", "bad")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, kept_n, gone_n = [], [], [], []
            for i, text, bad_keys in zip(*(c.to_pylist() for c in b.columns)):
                lines = body_lines(text)
                if lines is None:
                    continue
                drop = set(bad_keys or ())
                kept = [x for x in lines if line_key(x) not in drop] if drop else lines
                ids.append(i)
                texts.append("\n".join(kept))
                kept_n.append(len(kept))
                gone_n.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(kept_n, pa.int32()), pa.array(gone_n, pa.int32())], ["doc_id", "text", "n_kept", "n_removed"])

    return met.mapInArrow(run, "doc_id long, text string, n_kept int, n_removed int")
