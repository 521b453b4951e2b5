"""Stored tables: pages partitioned by source, the catalogue, assets, page files.

Writes replace whole partitions under Spark's commit protocol, so a reader sees the
old or the new state of a source, never half of one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.sources.config import ASSET_BYTES, ASSETS_BYTES

#: Content type -> file ending of the images that are kept.
MEDIA = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg", "image/avif": "avif", "image/x-icon": "ico", "image/vnd.microsoft.icon": "ico"}


class PageStore:
    """Page contents as parquet, a partition per source."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def write(self, pages: DataFrame) -> None:
        """Replace the partitions of the sources in ``pages``; others stay."""
        pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(f"{self.root}/pages")

    def read(self, source_id: str | None = None) -> DataFrame:
        """All pages, or one source's: then only its partition is scanned."""
        df = self.spark.read.parquet(f"{self.root}/pages")
        return df if source_id is None else df.where(F.col("source_id") == source_id)

    def remove(self, source_id: str) -> bool:
        """Drop a source's partition; whether there was one."""
        jvm, name = self.spark.sparkContext._jvm, self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(source_id)
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/pages/source_id={name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def page(self, source_id: str, path: str) -> DataFrame:
        return self.read(source_id).where(F.col("path") == path)


def write_table(df: DataFrame, path: str) -> None:
    """Replace a catalogue table. Rows that came from ``path`` itself must be cut before."""
    df.write.mode("overwrite").parquet(path)


def read_page_files(spark: SparkSession, folder: str) -> DataFrame:
    """Pages kept as one JSON file each: path, title, description, body (JSON)."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder)
    j = F.try_parse_json("value")
    return raw.select(*[F.try_variant_get(j, f"$.{c}", "string").alias(c) for c in ("path", "title", "description")], F.to_json(F.try_variant_get(j, "$.body", "variant")).alias("body")).where("path is not null")


def page_file_name(path: str) -> str:
    """Where a page's file lies: paths can differ by case only, hashes don't."""
    return hashlib.sha256(path.encode()).hexdigest() + ".json"


def assets(images: DataFrame, order: str = "ord", most: int = ASSET_BYTES, budget: int = ASSETS_BYTES) -> DataFrame:
    """The manifest of fetched images (source_id, url, content_type, body, ord): url,
    name (``assets/<sha256>.<ending>``), kept, error.

    A URL counts once, equal bodies are one file; other types, images above ``most``
    bytes and those beyond the source's budget aren't kept."""
    ending = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])[F.lower(F.trim(F.split("content_type", ";")[0]))]
    size = F.octet_length("body")
    one = images.withColumn("__n", F.row_number().over(W.partitionBy("source_id", "url").orderBy(order))).where("__n = 1")
    named = one.select("source_id", "url", order, F.sha2("body", 256).alias("hash"), ending.alias("ext"), size.alias("size"))
    error = F.when(F.col("size").isNull(), "no body").when(F.col("ext").isNull(), "unsupported type").when(F.col("size") > most, "too large")
    judged = named.withColumn("error", error)
    first = F.row_number().over(W.partitionBy("source_id", "hash").orderBy(order, "url")) == 1
    counted = judged.withColumn("__cost", F.when(first & F.col("error").isNull(), F.col("size")).otherwise(0))
    spent = F.sum("__cost").over(W.partitionBy("source_id").orderBy(order, "url"))
    final = F.coalesce("error", F.when(spent > budget, "over the budget"))
    return counted.select("source_id", "url", F.when(final.isNull(), F.concat(F.lit("assets/"), "hash", F.lit("."), "ext")).alias("name"), final.isNull().alias("kept"), final.alias("error"))


def to_json_lines(df: DataFrame, make: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Rows as JSON texts of constant shape: null members are written."""
    d = make(df)
    return d.select(F.to_json(F.struct(*d.columns), {"ignoreNullFields": "false"}).alias("json"))
