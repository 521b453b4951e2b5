"""What changed between consecutive full snapshots, by signed cells.

Every row of snapshot s is unpivoted into (key, field, value) cells and a
key-presence marker. A cell counts +1 for the transition into s and -1 for the
transition out of it. Within a transition equal cells cancel; what stays is
exactly the difference: a presence sum of +1 is an added key, -1 a removed one,
and field cells alone a changed one, with the names of its changed fields.

One shuffle brings all rows of a key together; unpivoting and both sums then run
in place. Rows that repeat a key within a snapshot are reduced before it, with
map-side combination, so a key delivered very often doesn't meet in one task.

Defined results: a null field value is a value; a null key column is a key value;
the snapshot before is the next lower number delivered; of repeated rows the one
with the latest time counts (null the earliest; ties by the greater field values).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, by: Sequence[str], time: str, fields: Sequence[str]) -> DataFrame:
    """The row of each ``by`` group with the greatest (time, fields)."""
    best = F.max(F.struct(F.col(time).alias("t"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])).alias("best")
    return df.groupBy(*by).agg(best).select(*by, F.col("best.t").alias(time), *[F.col(f"best.f{i}").alias(f) for i, f in enumerate(fields)])


def snapshot_changes(df: DataFrame, snapshot: str, key: Sequence[str], fields: Sequence[str], time: str) -> DataFrame:
    """Columns: ``snapshot``, ``key``..., ``change_kind`` (added, removed, changed) and
    ``changed_fields`` (sorted; empty unless changed)."""
    keys, cols = [f"__k{i}" for i in range(len(key))], [f"__f{i}" for i in range(len(fields))]
    named = df.select(F.col(snapshot).alias("__s"), *[F.col(k).alias(n) for k, n in zip(key, keys)], F.col(time).alias("__t"), *[F.col(f).alias(n) for f, n in zip(fields, cols)])
    rows = latest_rows(named, ["__s", *keys], "__t", cols)
    # One row per delivery: tiny by nature, and joined without a hint.
    order = W.orderBy("__at")
    steps = named.select(F.col("__s").alias("__at")).distinct().select("__at", F.lag("__at").over(order).alias("__before"), F.lead("__at").over(order).alias("__next"))
    signed = F.filter(
        F.array(
            F.struct(F.when(F.col("__before").isNotNull(), F.col("__s")).alias("into"), F.lit(1).alias("sign")),
            F.struct(F.col("__next").alias("into"), F.lit(-1).alias("sign")),
        ),
        lambda c: c["into"].isNotNull(),
    )
    cells = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(f).alias("field"), F.col(n).cast("string").alias("value")) for f, n in zip(fields, cols)])
    met = rows.join(steps, F.col("__s") == F.col("__at")).repartition(*keys)
    unpivoted = met.select(*keys, F.explode(signed).alias("m"), cells.alias("cells")).select(*keys, F.col("m.into").alias("__into"), F.col("m.sign").alias("__sign"), F.explode("cells").alias("c"))
    sums = unpivoted.groupBy(*keys, "__into", F.col("c.field").alias("__field"), F.col("c.value").alias("__value")).agg(F.sum("__sign").alias("__total")).where("__total <> 0")
    present: Column = F.sum(F.when(F.col("__field").isNull(), F.col("__total")))
    found = sums.groupBy(*keys, "__into").agg(present.alias("__p"), F.array_sort(F.collect_set("__field")).alias("__named"))
    kind = F.when(F.col("__p") > 0, "added").when(F.col("__p") < 0, "removed").otherwise("changed")
    changed = F.when(F.col("__p").isNull(), F.col("__named")).otherwise(F.array().cast("array<string>"))
    return found.select(F.col("__into").alias(snapshot), *[F.col(n).alias(k) for n, k in zip(keys, key)], kind.alias("change_kind"), changed.alias("changed_fields"))
