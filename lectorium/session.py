"""What depends on the session: reliable checkpoints, and ranks that no single task has to count."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever folder they start in.

    For a shared or local file system; on other clusters the package is installed with Spark's usual means.
    """
    place = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if place not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [place, *paths]))


def _temporary() -> str:
    place = tempfile.mkdtemp(prefix="lectorium-checkpoint-")
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    return place


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the cluster's shared folder.

    The folder is the session's spark.checkpoint.dir; where none is set, a local master gets a temporary one, which
    goes with the process, and a cluster is an error, as its workers wouldn't share such a folder.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all workers share")
        context.setCheckpointDir(named or _temporary())
    return df.checkpoint(eager=True)


#: Rows of a side that may be sent to every task: some tens of MB of vectors at most.
BROADCAST_ROWS = 20_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcasting if it has at most `rows` rows, else as it is, to be joined as Spark plans it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_numbers(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "row_number") -> DataFrame:
    """`df` with 1-based ranks within `keys` by `order`, even if one key holds most rows.

    Rows are range-partitioned by key and order, ranked within their partition, and offset by what the key has in
    the partitions before. The ranges are checkpointed, as their bounds come from a sample.
    """
    by = [*keys, *order]
    parts = checkpointed(df.repartitionByRange(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by).withColumn("_part", F.spark_partition_id()))
    inside = parts.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    counts = parts.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    # a key is in few partitions, and a partition holds parts of at most two keys that are in others too
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ("_part", *keys)]
    joined = inside.alias("i").join(starts.alias("s"), same)
    return joined.select(*[F.col(f"i.{c}") for c in df.columns], (F.col("s._start") + F.col("i._at")).alias(name))
