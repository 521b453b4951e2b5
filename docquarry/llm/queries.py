"""Registered queries of the training-text operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.words import words
from docquarry.llm import leakage, nearduplicates, packing, repeatedlines, sitetemplates, subjects, vocabulary
from docquarry.llm.sql import SQL
from docquarry.model.ast import read_tree, text_strings
from docquarry.runtime import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
__all__ = ["QUERIES", "SQL"]


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def body_words(body: str | None) -> list[str] | None:
    """Words of each text string of a body, strung together; None if unreadable."""
    tree = read_tree(body)
    return None if tree is None else [w for s in text_strings(tree) for w in words(s)]


# Repeated lines ------------------------------------------------------------

@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of a line repeated excessively within its source.

    Copies collapse to one cluster, which counts with its distinct paths, as the task
    defines a case; it sets no limit on days.
    """
    cases = repeatedlines.repeated_line_cases(table(spark, d, "stored_pages"), "page_id", "source_id", F.xxhash64("path"), "body")
    return cases.select(F.col("doc_id").alias("page_id"), "block_no")


@query
def p1_clean_pages(spark: SparkSession, d: str) -> DataFrame:
    """The readable pages without those lines."""
    return repeatedlines.without_repeated_lines(table(spark, d, "stored_pages"), "page_id", "source_id", F.xxhash64("path"), "body").withColumnRenamed("doc_id", "page_id")


@query
def p1_line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Excessive lines with their distinct document clusters and publication dates.

    Pages delivered again or copied to another path are one cluster (equal lines in
    equal order, however the body is encoded); a cluster's date is the first day any of its paths was fetched.
    """
    pages, stored = table(spark, d, "pages"), table(spark, d, "stored_pages")
    lines = cut(repeatedlines.keyed_lines(stored, "page_id", "source_id", None, "body"))
    paths = stored.select(F.col("page_id").alias("doc_id"), F.xxhash64("path").alias("path"))
    first = pages.groupBy(F.col("source_id").alias("__s"), F.xxhash64(F.regexp_replace("path", "^/", "")).alias("path")).agg(F.to_date(F.min("fetched_at")).alias("date"))
    held = lines.where("line_key is null").select("doc_id", "source", "cluster").join(paths, "doc_id").alias("l")
    met = held.join(first.alias("f"), (F.col("l.path") == F.col("f.path")) & F.col("source").eqNullSafe(F.col("__s")), "left")
    dated = met.groupBy(F.col("source").alias("__s"), F.col("cluster").alias("__c")).agg(F.min("date").alias("date"))
    one = lines.join(dated, (F.col("cluster") == F.col("__c")) & F.col("source").eqNullSafe(F.col("__s")))
    counts = repeatedlines.line_counts(one, dates=True)
    return repeatedlines.excessive(counts).select("source", "line_key", "n_clusters", "n_dates", "n_total")


# Near duplicates -----------------------------------------------------------

#: Words of a shingle and least similarity, as stated for these pages.
P3_SHINGLE, P3_SIMILARITY = 3, 0.6


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pages whose shingle sets share at least 0.6 of their union."""
    pairs = nearduplicates.similar_pairs(table(spark, d, "stored_pages"), "page_id", "body", body_words, P3_SHINGLE, P3_SIMILARITY)
    return pairs.select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"))


@query
def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per page: class of equal sets, linked classes, group of linked pages."""
    groups = nearduplicates.similar_groups(table(spark, d, "stored_pages"), "page_id", "body", body_words, P3_SHINGLE, P3_SIMILARITY)
    return groups.withColumnRenamed("id", "page_id")


# Term frequencies ----------------------------------------------------------


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    bodies = vocabulary.term_frequencies(table(spark, d, "stored_pages"), ["source_id", "path"], "body", body_words)
    titles = vocabulary.term_frequencies(table(spark, d, "hits"), ["query_id", "hit_rank"], "title", words)
    both = [vocabulary.marked(f).withColumn("field_name", F.lit(name)) for f, name in ((bodies, "body"), (titles, "title"))]
    return both[0].unionByName(both[1]).select("field_name", "term", "n_occurrences", "n_records", "mark")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms of bodies and titles in one record only, or in more than a quarter of the records."""
    return _frequencies(spark, d).where("mark is not null").select("field_name", "term", "mark")


@query
def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Every term's occurrences and records."""
    return _frequencies(spark, d)


# Packing -------------------------------------------------------------------

#: A public vocabulary; any rank file of the kind may be named instead.
P8_TOKENIZER = os.environ.get("DOCQUARRY_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that alone exceed a container, so were split by the packing."""
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", P8_TOKENIZER).where("piece_no = 1").select(F.col("id").alias("doc_id"))


@query
def p8_bins(spark: SparkSession, d: str) -> DataFrame:
    """Every container with its pieces and tokens."""
    packed = packing.pack(table(spark, d, "documents"), "doc_id", "text", P8_TOKENIZER)
    return packed.groupBy("bin_id").agg(F.count("*").alias("n_pieces"), F.sum("size").alias("n_tokens"))


# Leakage -------------------------------------------------------------------

#: Seed, and share of an item that its tiles must cover, of the reordered-passage report.
P9_LOOSE_SEED, P9_COVERAGE = 6, 0.5


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 12 consecutive words of an item."""
    return leakage.overlaps(table(spark, d, "documents"), table(spark, d, "eval_items"), seed=12).select("doc_id", "item_id")


@query
def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Items covered to half or more by tiles of a document, in whatever order."""
    found = leakage.overlaps(table(spark, d, "documents"), table(spark, d, "eval_items"), seed=P9_LOOSE_SEED)
    return found.where(F.col("coverage") >= P9_COVERAGE)


# Subjects ------------------------------------------------------------------


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subjects"))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects each document is about."""
    return _subjects(spark, d).select(F.col("doc").alias("doc_id"), "subject")


@query
def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mean share of topical words of each subject."""
    return _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("n_documents"), F.round(F.avg("density"), 6).alias("mean_density"))


# Page boilerplate ----------------------------------------------------------


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each fetched page's main body."""
    profiles = table(spark, d, "profiles").select("kind", "drop_classes")
    kinds = table(spark, d, "sources").select(F.col("id").alias("source_id"), "kind").join(profiles, "kind", "left").select("source_id", "drop_classes")
    place = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    pages = table(spark, d, "raw_pages").join(kinds, "source_id", "left")
    pages = pages.withColumn("host", F.coalesce(F.nullif(place, F.lit("")), "source_id")).withColumn("address", F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^?#]*)", 1))
    return sitetemplates.main_lines(pages, "raw_id", "host", "address", "html", "drop_classes").withColumnRenamed("id", "raw_id")
