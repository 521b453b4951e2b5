"""Session helpers: lineage cuts, size-checked broadcasts, table loading.

Checkpoints go to the folder the cluster names in ``spark.checkpoint.dir``; a
private temporary folder is used only in local mode where that setting is absent
(tests). A cluster without the setting is an error: its nodes share no folder.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, NumericType, StringType, StructType

#: Rows up to which a side may be broadcast once it has been counted.
BROADCAST_ROWS = 200_000
#: Bytes up to which it may, by the lengths of its strings and arrays.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docquarry-ck-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on shared storage; later reads don't recompute it and
    survive the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row, by the types of its columns."""
    size = F.lit(16)
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (StringType, BinaryType)):
            own = F.octet_length(c)
        elif isinstance(t, ArrayType) and isinstance(t.elementType, NumericType):
            own = F.size(c) * 8
        elif isinstance(t, (ArrayType, MapType, StructType)):
            own = F.octet_length(F.to_json(c))
        else:
            own = F.lit(0)
        size = size + 8 + F.coalesce(own, F.lit(0))
    return size


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for ``df`` only if it has at most ``max_rows`` rows and about
    ``max_bytes`` bytes.

    ``df`` should be cheap to read (a checkpoint or a small scan). Beyond the bounds
    the plain frame is returned: the join then shuffles and AQE splits its skewed
    partitions.
    """
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


#: Bytes of a partition where the number of partitions is chosen here.
PARTITION_BYTES = 128 << 20


def shuffle_parts(df: DataFrame) -> int:
    """Partitions for a shuffle of ``df`` whose number AQE can't raise: those of the session,
    or more where the rows, as the optimizer estimates them, need more."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an estimate of unknown input is the greatest long, and says nothing
    return wanted if size >= 2**62 else max(wanted, -(-size // PARTITION_BYTES))
