"""The link graph of pages, and crawling it breadth first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.runtime import cut


def link_edges(pages: DataFrame, page_id: str, links: str) -> DataFrame:
    """(src, ord, dst): one row per link of a page, in order."""
    return pages.select(F.col(page_id).alias("src"), F.posexplode(links).alias("ord", "dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in) over distinct links."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def held_links(edges: DataFrame, held: DataFrame, dst: str = "dst", path: str = "path") -> DataFrame:
    """Edges whose target is a held page."""
    return edges.join(held.select(F.col(path).alias(dst)).distinct(), dst, "left_semi")


def crawl(edges: DataFrame, entries: DataFrame, max_depth: int = 4, max_pages: int | None = None) -> tuple[DataFrame, bool]:
    """Breadth-first visits (node, depth) from ``entries`` (node), and whether the page cap ended it.

    Entries have depth 1; a node is followed if its depth is below ``max_depth``. Each
    round is one anti-join of the frontier's targets with what was visited, cut on
    shared storage. Within the round that meets ``max_pages``, nodes are taken in order.
    """
    front = cut(entries.select("node").dropna().distinct().withColumn("depth", F.lit(1)))
    e = edges.select(F.col("src").alias("node"), "dst").dropna().distinct()
    visited, n, depth = front, front.count(), 1
    while True:
        if max_pages is not None and n >= max_pages:
            return visited.orderBy("depth", "node").limit(max_pages), True
        if depth >= max_depth:
            return visited, False
        new = front.join(e, "node").select(F.col("dst").alias("node")).distinct().join(visited, "node", "left_anti")
        depth += 1
        front = cut(new.withColumn("depth", F.lit(depth)))
        found = front.count()
        if not found:
            return visited, False
        visited, n = cut(visited.unionByName(front)), n + found
