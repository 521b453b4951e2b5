"""Reconciling the catalogue, the page store and the index."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("source_id", "path")


def diff(pages: DataFrame, indexed: DataFrame, key: Sequence[str] = KEY, hash_col: str = "content_hash") -> DataFrame:
    """(key..., action): add, update, remove or keep, for every page on either side.

    A full comparison, so a lost or doubled run heals itself. A null hash differs
    from any other; null keys are keys. Keys should be distinct per side.
    """
    one = pages.select(*[F.col(k).alias(f"a_{k}") for k in key], F.col(hash_col).alias("a_hash"), F.lit(True).alias("a_there"))
    two = indexed.select(*[F.col(k).alias(f"b_{k}") for k in key], F.col(hash_col).alias("b_hash"), F.lit(True).alias("b_there"))
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    action = F.when(F.col("b_there").isNull(), "add").when(F.col("a_there").isNull(), "remove").when(F.col("a_hash").eqNullSafe(F.col("b_hash")), "keep").otherwise("update")
    return one.join(two, on, "full").select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in key], action.alias("action"))


def has_work(changes: DataFrame) -> bool:
    """False if nothing is to be written, so that no commit is made."""
    return bool(changes.where("action <> 'keep'").take(1))


@dataclass(frozen=True)
class CrawlOutcome:
    """What a crawl says about itself. Errors other than 404 and 410 are ambiguous, a
    page that failed to render among them."""

    produced: int
    ambiguous_errors: int = 0
    capped: bool = False

    @property
    def safe_to_prune(self) -> bool:
        """Only a complete crawl may remove anything."""
        return not self.capped and self.ambiguous_errors == 0 and self.produced > 0


def safe_to_prune(log: DataFrame, source: str = "source_id", status: str = "status", capped: str = "capped") -> DataFrame:
    """(source, safe) from a crawl log with a row per fetched page."""
    bad = F.count_if(~F.col(status).isin(200, 404, 410) | F.col(status).isNull())
    return log.groupBy(source).agg(((bad == 0) & (F.count_if(F.col(status) == 200) > 0) & ~F.coalesce(F.bool_or(capped), F.lit(False))).alias("safe"))


def prune_missing(pages: DataFrame, held: DataFrame, outcome: CrawlOutcome, key: Sequence[str] = KEY) -> DataFrame:
    """The pages to keep: those the crawl held, or all if it may not prune."""
    return pages.join(held.select(*key).distinct(), list(key), "left_semi") if outcome.safe_to_prune else pages


def missing(pages: DataFrame, held: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Pages that the crawl no longer produced. A page with a null key is never held."""
    return pages.join(held.select(*key).distinct(), list(key), "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put over it by key. Of several new rows of a key the
    last by ``order`` wins, then the greatest. Columns are those of ``old``; ones that
    ``new`` lacks become null. Rows of other keys stay untouched."""
    rest = [c for c in old.columns if c not in key]
    fit = new.select(*key, *[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in rest], *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*[F.desc(f"__o{i}") for i in range(len(order))], *[F.desc(c) for c in rest]))
    last = fit.withColumn("__n", rank).where("__n = 1").select(*old.columns)
    return old.join(last.select(*key), list(key), "left_anti").select(*old.columns).unionByName(last)


def delete(df: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*key).distinct(), list(key), "left_anti")


def delete_source(sources: DataFrame, pages: DataFrame, source_id: str) -> tuple[DataFrame, DataFrame]:
    """Sources and pages without a source and all its pages."""
    return sources.where(~F.col("id").eqNullSafe(F.lit(source_id))), pages.where(~F.col("source_id").eqNullSafe(F.lit(source_id)))


def agreement(stored: DataFrame, indexed: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, n_stored, n_indexed, agrees) for every source on either side."""
    a = stored.groupBy(source).agg(F.count("*").alias("n_stored"))
    b = indexed.groupBy(source).agg(F.count("*").alias("n_indexed"))
    both = a.join(b, source, "full").select(source, F.coalesce("n_stored", F.lit(0)).alias("n_stored"), F.coalesce("n_indexed", F.lit(0)).alias("n_indexed"))
    return both.withColumn("agrees", F.col("n_stored") == F.col("n_indexed"))


#: Days between scheduled syncs.
SCHEDULE_DAYS = {"daily": 1, "weekly": 7, "monthly": 30}


def sync_due(sync: Column, last: Column, trigger: str, now: Column) -> Column:
    """now, not_yet, only_manually, pinned or watch_undecided, from a source's sync JSON.
    Null for a null or unknown strategy."""
    strategy = F.get_json_object(sync, "$.strategy.strategy")
    days = F.lit(None).cast("int")
    for name, n in SCHEDULE_DAYS.items():
        days = F.when(F.get_json_object(sync, "$.strategy.schedule") == name, n).otherwise(days)
    waited = last.isNull() | (F.unix_micros(now) - F.unix_micros(last) >= days.cast("long") * 86_400_000_000)
    return (
        F.when(F.get_json_object(sync, "$.pin_version") == "true", "pinned")
        .when(strategy == "manual", "only_manually")
        .when(strategy == "on_launch", "now" if trigger == "launch" else "not_yet")
        .when(strategy == "scheduled", F.when(waited, "now").otherwise("not_yet"))
        .when(strategy == "watch", "watch_undecided")
    )
