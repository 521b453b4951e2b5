"""Offline evaluation: ranks, their movement, confusion, percentiles, goldens."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators.keychunks import number_rows

#: Positions looked at; greatest drop of a metric, greatest net loss of queries.
TOP = 10
MAX_DROP, MAX_NET_LOSS = 0.02, 3


def first_relevant(queries: DataFrame, hits: DataFrame, labels: DataFrame, doc: Sequence[str]) -> DataFrame:
    """(query_id, rank): the first wanted document among the top hits, 0 for none."""
    wanted = hits.where(F.col("hit_rank") <= TOP).join(labels.select("query_id", *doc).distinct(), ["query_id", *doc])
    found = wanted.groupBy("query_id").agg(F.min("hit_rank").alias("rank"))
    return queries.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("rank", F.lit(0)).alias("rank"))


def _metrics() -> list[Column]:
    def within(n: int) -> Column:
        return F.avg(F.when(F.col("rank").between(1, n), 1.0).otherwise(0.0))

    return [F.count("*").alias("n"), F.avg(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"), within(1).alias("recall_at_1"), within(3).alias("recall_at_3"), within(10).alias("recall_at_10")]


def metrics(ranks: DataFrame, by: str | None = None) -> DataFrame:
    """n, mrr and recall at 1, 3, 10; per ``by`` and, with null ``by``, overall."""
    return ranks.agg(*_metrics()) if by is None else ranks.rollup(by).agg(*_metrics())


def movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, old, new, moved): better, worse, same, added or dropped; rank 0 is the worst."""
    both = before.select("query_id", F.col("rank").alias("old")).join(after.select("query_id", F.col("rank").alias("new")), "query_id", "full")

    def depth(c: str) -> Column:
        return F.when(F.col(c) == 0, 2**31 - 1).otherwise(F.col(c))

    moved = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "dropped").when(depth("new") < depth("old"), "better").when(depth("new") > depth("old"), "worse").otherwise("same")
    return both.withColumn("moved", moved)


def gate(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: drops of mrr and recall, net loss, and whether it passes. An empty suite fails."""
    a, b = metrics(before), metrics(after)
    drops = a.select(F.lit(1).alias("k"), *[F.col(c).alias(f"a_{c}") for c in a.columns]).join(b.select(F.lit(1).alias("k"), *b.columns), "k")
    loss = movement(before, after).agg(F.greatest(F.count_if(F.col("moved") == "worse") - F.count_if(F.col("moved") == "better"), F.lit(0)).alias("net_loss")).withColumn("k", F.lit(1))
    out = drops.join(loss, "k").select((F.col("a_mrr") - F.col("mrr")).alias("mrr_drop"), (F.col("a_recall_at_3") - F.col("recall_at_3")).alias("recall_drop"), "net_loss", "n")
    return out.withColumn("passes", F.coalesce((F.col("n") > 0) & (F.col("mrr_drop") <= MAX_DROP) & (F.col("recall_drop") <= MAX_DROP) & (F.col("net_loss") <= MAX_NET_LOSS), F.lit(False)))


def confusion(df: DataFrame, expected: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Rows by expected label, a column of counts per predicted one."""
    return df.groupBy(expected).pivot(predicted, list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def accuracy(df: DataFrame, expected: str, predicted: str, confidence: str, sure: float) -> DataFrame:
    """accuracy, and errors made with a confidence of ``sure`` or more; no rows: null accuracy."""
    hit = F.col(expected).eqNullSafe(F.col(predicted))
    return df.agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"), F.count_if(~hit & (F.col(confidence) >= sure)).alias("confident_errors"))


def class_balance(df: DataFrame, label: str, most: float = 0.5) -> DataFrame:
    """(label, n, share, balanced): no class may hold ``most`` of the rows or more."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / n.agg(F.sum("n")).scalar()).withColumn("balanced", F.col("share") < most)


def nearest_rank(df: DataFrame, value: str, by: str, shares: Sequence[float]) -> DataFrame:
    """Nearest-rank percentiles (an observed value each, no interpolation) of the non-null
    values: by, p50, p95... Rows get their exact place within the group by offset
    chunking, so a group that holds most rows is in no task as a whole."""
    placed = number_rows(df.where(F.col(value).isNotNull()), by, [value])
    total = placed.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"))
    met = placed.join(total, F.col(by).eqNullSafe(F.col("__by")))
    picks = [F.max(F.when(F.col("row_no") + 1 == F.greatest(F.ceil(F.col("__n") * s), F.lit(1)), F.col(value))).alias(f"p{round(s * 100)}") for s in shares]
    return met.groupBy(by).agg(*picks)


def golden(got: DataFrame, kept: DataFrame, name: str = "name", value: str = "value", update: bool = False) -> DataFrame:
    """(name, state): pass, mismatch, missing (no golden) or orphan (nothing made it). Where goldens
    are being updated, what was made anew or differs is ``updated``: it is the golden now."""
    a, b = got.select(name, F.col(value).alias("got"), F.lit(True).alias("made")), kept.select(name, F.col(value).alias("want"), F.lit(True).alias("held"))
    state = F.when(F.col("held").isNull(), "missing").when(F.col("made").isNull(), "orphan").when(F.col("got").eqNullSafe(F.col("want")), "pass").otherwise("mismatch")
    state = F.when(state.isin("missing", "mismatch"), "updated").otherwise(state) if update else state
    return a.join(b, name, "full").select(name, state.alias("state"))


def golden_passes(states: DataFrame) -> bool:
    """Every golden passes, and there is one."""
    r = states.agg(F.count("*").alias("n"), F.count_if(F.col("state") != "pass").alias("bad")).first()
    return r.n > 0 and r.bad == 0


def coordinate_descent(start: dict[str, float], grid: dict[str, Sequence[float]], score: Callable[[dict[str, float]], float], allowed: Callable[[dict[str, float]], bool] = lambda p: True, passes: int = 4) -> tuple[dict[str, float], float]:
    """Best parameters found by changing one at a time, as long as a pass improves.

    Each ``score`` is a distributed run; only the parameters are on the driver.
    """
    best, value = dict(start), score(start)
    for _ in range(passes):
        before = value
        for name, values in grid.items():
            for v in values:
                tried = best | {name: v}
                if v != best[name] and allowed(tried) and (s := score(tried)) > value:
                    best, value = tried, s
        if value <= before:
            break
    return best, value
