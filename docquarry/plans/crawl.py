"""Crawling a site: frontier, fetch, parse, links, next frontier.

Breadth first. A round fetches its whole frontier (per host in one task, so the host's
rate holds), keeps the answers that are pages, reads their links, and keeps of those the
ones in scope that no round has asked for, by one anti-join. Rounds are cut on shared
storage; the driver sees counts only. The cap on pages counts pages that were got,
not requests: a round is asked in slices of what is still missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.urls import scope
from docquarry.model.parse import join_url
from docquarry.operators.pages import parse_pages
from docquarry.operators.reconcile import CrawlOutcome
from docquarry.runtime import cut
from docquarry.sources.config import Source
from docquarry.sources.fetch import Transport, failures, fetch_pages, urllib_transport, usable


@dataclass
class Crawl:
    """``pages``: url, depth, ordinal, html, etag, last_modified. ``failed``: url, status, error.
    ``outcome`` says whether pages that weren't met may be removed."""

    pages: DataFrame
    failed: DataFrame
    outcome: CrawlOutcome


def entry_urls(source: Source) -> list[str]:
    """Where a crawl begins: the source's url and its entry points, resolved against it and
    without fragments, each once; what is no http(s) url is left out."""
    found = [join_url(source.url or "", e) for e in ("", *source.entry_points)]
    return list(dict.fromkeys(u.partition("#")[0] for u in found if u and u.startswith(("http://", "https://"))))


def crawl_site(spark: SparkSession, source: Source, transport: Transport = urllib_transport) -> Crawl:
    """All pages of a source in reach. Entry points have depth 1; links are followed from
    pages above ``max_depth``. Within a round, pages come in the order of their addresses.

    Defined results: no entry or no answer gives no pages and a crawl that may remove
    nothing; a page without links ends its branch; 404 and 410 are answers, every other
    failure is ambiguous.
    """
    front = cut(spark.createDataFrame([(u,) for u in entry_urls(source)], "url string"))
    asked, got, failed, n, depth, capped = front, [], [], 0, 1, False
    while front.take(1):
        rest = front
        while not capped and rest.take(1):
            want = source.max_pages - n
            part = cut(rest.orderBy("url").limit(want))
            answers = cut(fetch_pages(part, rate=source.fetch.rate, timeout=source.fetch.timeout, most=source.fetch.max_page_bytes, respect_robots=source.fetch.respect_robots, transport=transport))
            pages = usable(answers).select("url", F.lit(depth).alias("depth"), F.decode("body", "UTF-8").alias("html"), "etag", "last_modified")
            got.append(pages)
            failed.append(failures(answers))
            n += pages.count()
            rest = cut(rest.join(part, "url", "left_anti"))
            capped = n >= source.max_pages and bool(rest.take(1))
        if capped or depth >= source.max_depth:
            break
        level = reduce(DataFrame.unionByName, got).where(F.col("depth") == depth)
        links = parse_pages(level, {"url": "string"}).select(F.explode("links").alias("url")).distinct()
        inside = links.where(scope("url", F.lit(source.url), list(source.include), list(source.exclude)) == "in_scope")
        front = cut(inside.join(asked, "url", "left_anti"))
        asked, depth = cut(asked.unionByName(front)), depth + 1
        if n >= source.max_pages and front.take(1):
            capped = True
            break
    empty = spark.createDataFrame([], "url string, depth int, html string, etag string, last_modified string")
    pages = reduce(DataFrame.unionByName, got, empty)
    lost = reduce(DataFrame.unionByName, failed, spark.createDataFrame([], "url string, status int, error string"))
    ambiguous = lost.where(F.col("status").isNull() | ~F.col("status").isin(404, 410)).count()
    return Crawl(pages, lost, CrawlOutcome(n, ambiguous, capped))
