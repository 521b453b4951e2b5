"""One object for what a user asks of a library."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import catalog, pages as page_ops, search as ranked
from docquarry.operators.index import Index, commit
from docquarry.plans.ingest import index_of
from docquarry.runtime import cut
from docquarry.sources.store import PageStore, write_table


class Library:
    """Sources, pages and an index; every answer is a DataFrame."""

    def __init__(self, spark: SparkSession, sources: DataFrame, pages: DataFrame, index: Index | None = None) -> None:
        self.spark, self.sources, self.stored, self.index = spark, sources, pages, index or index_of(pages)

    def search(self, text: str, limit: int = 10, source: str | None = None) -> DataFrame:
        """Best pages for one query, with the sources' names."""
        asked = self.spark.createDataFrame([(0, text)], "query_id long, q string")
        scope = None if source is None else F.col("source_id") == source
        hits = ranked.with_source_names(ranked.search(self.index, asked, limit, scope=scope), self.sources)
        return hits.drop("query_id").orderBy("hit_rank")

    def hits(self, text: str, limit: int = 10, source: str | None = None) -> DataFrame:
        """The same with the number of all hits, and whether they are more than shown."""
        asked = self.spark.createDataFrame([(0, text)], "query_id long, q string")
        scope = None if source is None else F.col("source_id") == source
        shown = ranked.search(self.index, asked, limit, scope=scope)
        return ranked.with_totals(shown, ranked.total_hits(self.index, asked, scope=scope)).drop("query_id").orderBy("hit_rank")

    def suggest(self, text: str) -> DataFrame:
        """(typed, meant) for words that stand nowhere."""
        asked = self.spark.createDataFrame([(0, text)], "query_id long, q string")
        terms = ranked.query_terms(asked)
        return ranked.corrections(self.index, ranked.unknown_terms(terms, ranked.matched(self.index, terms))).select("typed", "meant")

    def lookup_symbol(self, name: str, source: str | None = None) -> DataFrame:
        return self.search("@" + name.lstrip("@"), 10, source)

    def snippets(self, text: str, limit: int = 10) -> DataFrame:
        """The pieces of the hits' snippets, marked by the query's own and corrected terms."""
        asked = self.spark.createDataFrame([(0, text)], "query_id long, q string")
        terms = ranked.query_terms(asked)
        marks = ranked.highlight_terms(terms, ranked.corrections(self.index, ranked.unknown_terms(terms, ranked.matched(self.index, terms))))
        hits = ranked.search(self.index, asked, limit).join(marks, "query_id").join(self.stored.select("source_id", "path", "body"), ["source_id", "path"])
        return page_ops.snippets(hits, {"hit_rank": "int", "source_id": "string", "path": "string"}, "terms")

    def list_sources(self, category: str | None = None) -> DataFrame:
        return catalog.list_sources(catalog.sources_with_counts(self.sources, self.stored), category)

    def pages(self, source_id: str, offset: int = 0, limit: int = catalog.PAGE_ROWS) -> DataFrame:
        return catalog.paged(self.stored.where(F.col("source_id") == source_id), offset, limit)

    def page_markdown(self, source_id: str, path: str) -> DataFrame:
        return page_ops.page_markdown(catalog.get_page(self.stored, source_id, path), {"source_id": "string", "path": "string"})

    def outline(self, source_id: str, path: str) -> DataFrame:
        return page_ops.page_outline(catalog.get_page(self.stored, source_id, path), {"source_id": "string", "path": "string"})


def remove_source(spark: SparkSession, source_id: str, index_path: str, store: PageStore, sources: DataFrame, sources_path: str, config_file: str | None = None) -> DataFrame:
    """Remove a source so that a failure half way leaves nothing that is found but can't be
    read: first from the index, then its pages, then the catalogue's row, the
    configuration last. Removing what isn't there is no error. Gives the new catalogue."""
    commit(index_path, deleted=spark.createDataFrame([(source_id,)], "source_id string"))
    store.remove(source_id)
    left = cut(sources.where(F.col("id") != source_id))
    write_table(left, sources_path)
    if config_file and os.path.exists(config_file):
        os.remove(config_file)
    return left
