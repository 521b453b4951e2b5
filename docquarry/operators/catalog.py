"""Metadata lookups over the catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_ROWS, MOST_ROWS = 200, 1000


def list_sources(sources: DataFrame, category: str | None = None) -> DataFrame:
    """By name without regard to case, then id."""
    some = sources if category is None else sources.where(F.col("category") == category)
    return some.orderBy(F.collate("name", "UTF8_LCASE"), "id")


def get_source(sources: DataFrame, source_id: str) -> DataFrame:
    return sources.where(F.col("id") == source_id)


def get_page(pages: DataFrame, source_id: str, path: str) -> DataFrame:
    return pages.where((F.col("source_id") == source_id) & (F.col("path") == path))


def list_pages(pages: DataFrame, source_id: str) -> DataFrame:
    return pages.where(F.col("source_id") == source_id).orderBy("ordinal", "path")


def paged(pages: DataFrame, offset: int = 0, limit: int = PAGE_ROWS) -> DataFrame:
    """A window of a listing by (source_id, ordinal, path); the limit is held to 1..1000."""
    return pages.orderBy("source_id", "ordinal", "path").offset(max(0, offset)).limit(min(MOST_ROWS, max(1, limit)))


def paged_with_total(pages: DataFrame, offset: int = 0, limit: int = PAGE_ROWS) -> DataFrame:
    """The same with the number of all pages as ``total`` beside each row."""
    return paged(pages, offset, limit).withColumn("total", pages.agg(F.count("*")).scalar())


def source_exists(sources: DataFrame, source_id: str) -> bool:
    return bool(sources.where(F.col("id") == source_id).take(1))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("source_id").agg(F.count("*").alias("n_pages"))


def sources_with_counts(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Every source with its live number of pages."""
    n = page_counts(pages).withColumnRenamed("source_id", "id")
    return sources.join(n, "id", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))


def never_pulled(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Configured sources without any page."""
    return sources.join(pages.select(F.col("source_id").alias("id")).distinct(), "id", "left_anti")


def duplicates(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` whose id or URL (closing slashes aside) is configured already."""
    bare = F.regexp_replace("url", "/+$", "")
    by_id = new.join(sources.select("id").distinct(), "id", "left_semi")
    by_url = new.withColumn("__u", bare).join(sources.select(bare.alias("__u")).dropna().distinct(), "__u", "left_semi").drop("__u")
    return by_id.unionByName(by_url).distinct()
