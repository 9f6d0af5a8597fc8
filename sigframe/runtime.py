"""Session-level helpers: where durable tables go and how finely work is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session,
    where driver and executors share one machine, may fall back to a temporary
    folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sigframe-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call will be given."""
    return f"{shared_dir(spark)}/sigframe/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike cached blocks the table survives the loss of executors, and unlike an
    RDD checkpoint later steps still prune its columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_null_safe(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner"
) -> DataFrame:
    """Equi-join where null keys match each other; key columns come from ``left``."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        condition = same if condition is None else condition & same
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_r_{c}" for c in on])


def total(df: DataFrame, column: str) -> Column:
    """``sum(column)`` over the whole frame as a scalar subquery."""
    return df.select(F.sum(column)).scalar()


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt to all tasks by a hash of ``columns`` and sorted by it.

    For repeated passes over training data: a table of a few files would be scanned by
    as many tasks, and in an order that follows its files.
    """
    mixed = F.xxhash64(*columns)
    return df.repartition(shuffle_width(df.sparkSession), mixed).sortWithinPartitions(mixed)
