"""Connected components of a link table, by distributed union-find.

Each partition first reduces its links to a spanning forest with an in-memory
union-find over the nodes it holds, so a dense group shrinks before any shuffle.
Alternating large-star and small-star steps then contract the forest in
DataFrame joins until no link changes; each round is cut on shared storage. No
links or components come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.runtime import cut

#: Links a partition's union-find takes at once.
FOREST_ROWS = 500_000


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes that aren't least."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))
    n = len(a)
    for x, y in zip(ends[:n].tolist(), ends[n:].tolist()):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
    for i in range(len(up)):  # parents precede their children
        up[i] = up[up[i]]
    root = nodes[np.array(up, np.int64)] if len(nodes) else nodes
    moved = root != nodes
    return nodes[moved], root[moved]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, rows = [], [], 0

    def out() -> pa.RecordBatch:
        x, y = spanning_forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    for batch in batches:
        a.append(np.asarray(batch.column(0)))
        b.append(np.asarray(batch.column(1)))
        rows += batch.num_rows
        if rows >= FOREST_ROWS:
            yield out()
            a, b, rows = [], [], 0
    if rows:
        yield out()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node in ``links``; the component is its least node.

    Null ends and self-links are left out; an empty table gives no rows.
    """
    edges = cut(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna().where("a <> b").mapInArrow(_local, "a long, b long"))
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: greater neighbours point to the least of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours point to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = cut(small)
        key = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        if new.agg(F.count("*"), key).first() == edges.agg(F.count("*"), key).first():
            break
        edges = new
    else:
        raise RuntimeError(f"components still changed after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
