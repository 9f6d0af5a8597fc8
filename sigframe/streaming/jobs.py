"""Incremental scans and windowed features.

Event times must be ``timestamp`` columns: watermarks reject ``timestamp_ntz``.
Windows are kept per key and window; only partial aggregates are state, so a hot
key costs one row per open window.

A stream with a watermark gives a window once, when it is over, and leaves out rows that
come later.  :func:`collect_windows` leaves out none: every batch adds partial aggregates
to a table, and :func:`merged_windows` sums them up whenever it is read, so the result does
not depend on the order or the batching of the files.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigframe.operators.vectors import mean_std_columns, sound
from sigframe.runtime import join_null_safe, scratch_path


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType | str, glob: str = "*.parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Stream of the Parquet files in a directory; a checkpoint remembers what was read."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _windowed(
    df: DataFrame, by: list[str], window: Column, value: str, t: str, watermark: str
) -> DataFrame:
    """Aggregates of ``value`` per key and window.

    A number gives count, mean, population deviation and extremes; a vector gives
    count and ``stats``, the means and deviations of its elements.
    """
    if dict(df.dtypes)[value].startswith("array"):
        df = df.where(F.col(value).isNotNull())
        measures = [F.count("*").alias("n"), mean_std_columns(value).alias("stats")]
    else:
        measures = [
            F.count("*").alias("n"),
            F.avg(value).alias("mean"),
            F.stddev_pop(value).alias("std"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
        ]
    found = df.withWatermark(t, watermark).groupBy(*by, window.alias("_w")).agg(*measures)
    bounds = [F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end")]
    return found.select(*by, *bounds, *[c for c in found.columns if c not in (*by, "_w")])


def stream_bucket_features(
    df: DataFrame, by: list[str], value: str, t: str = "ts", seconds: int = 5,
    watermark: str = "1 minute",
) -> DataFrame:
    """Features per key and fixed bucket; works on batch and streaming frames alike."""
    return _windowed(df, by, F.window(t, f"{seconds} seconds"), value, t, watermark)


def stream_clips(
    df: DataFrame, by: list[str], value: str, t: str = "ts", length: int = 5, step: int = 1,
    watermark: str = "1 minute",
) -> DataFrame:
    """Features per key and overlapping clip of ``length`` seconds every ``step``."""
    window = F.window(t, f"{length} seconds", f"{step} seconds")
    return _windowed(df, by, window, value, t, watermark)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now, append it to a Parquet table, remember the position."""
    query = (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()


def drained(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over the data available now and return the table it wrote."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    drain(df, f"{path}/table", f"{path}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{path}/table")


def window_of(t: str, length: int, step: int | None = None) -> Column:
    """Fixed windows of ``length`` seconds, or overlapping ones every ``step``."""
    return F.window(t, f"{length} seconds", f"{step or length} seconds")


def partial_windows(df: DataFrame, by: list[str], window: Column, value: str) -> DataFrame:
    """Mergeable aggregates per key and window: ``n`` rows, and over the ``m`` values that
    are not null ``mean``, ``gap`` (summed squared distances from the mean), ``low, high``.

    ``mean`` and ``gap`` are arrays, of one element where the value is a number.
    """
    if dict(df.dtypes)[value].startswith("array"):
        df = df.where(F.col(value).isNotNull())
        stats = Summarizer.metrics("mean", "variance", "count").summary(sound(value))
        m = stats["count"]
        gap = F.transform(vector_to_array(stats["variance"]), lambda v: v * (m - 1))
        mean, low, high = vector_to_array(stats["mean"]), F.lit(None), F.lit(None)
    else:
        m = F.count(value)
        mean, gap = F.array(F.avg(value)), F.array(F.var_pop(value) * m)
        low, high = F.min(value), F.max(value)
    found = df.groupBy(*by, window.alias("_w")).agg(
        F.count("*").alias("n"), m.cast("long").alias("m"), mean.alias("mean"), gap.alias("gap"),
        low.cast("double").alias("low"), high.cast("double").alias("high"),
    )
    return found.select(
        *by, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
        *[c for c in found.columns if c not in (*by, "_w")],
    )


def merged_windows(parts: DataFrame, by: list[str]) -> DataFrame:
    """``by, window_start, window_end, n, mean, std, low, high`` of partial aggregates;
    ``mean`` and population deviation ``std`` are arrays.

    A key and window has one row per batch.
    """
    keys = [*by, "window_start", "window_end"]
    each = parts.select(*keys, "m", F.posexplode(F.arrays_zip("mean", "gap")).alias("pos", "v"))
    group = Window.partitionBy(*keys, "pos")
    whole = F.sum("m").over(group)
    centre = F.sum(F.col("v.mean") * F.col("m")).over(group) / F.nullif(whole, F.lit(0))
    apart = F.col("v.mean") - F.col("centre")
    moved = each.withColumn("centre", centre).groupBy(*keys, "pos").agg(
        F.first("centre").alias("mean"),
        F.sqrt(
            F.sum(F.col("v.gap") + F.col("m") * apart * apart) / F.nullif(F.sum("m"), F.lit(0))
        ).alias("std"),
    )
    listed = moved.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "mean", "std"))).alias("s"))
    counted = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    return join_null_safe(counted, listed, keys).select(
        *keys, "n", F.col("s.mean").alias("mean"), F.col("s.std").alias("std"), "low", "high"
    )


def collect_windows(
    df: DataFrame, by: list[str], window: Column, value: str, path: str, checkpoint: str
) -> None:
    """Add the partial aggregates of what is there now to the table at ``path``.

    A batch writes a folder of its own; a batch that is repeated after a failure writes
    the same folder again.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = partial_windows(batch, by, window, value)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    started = df.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    started.trigger(availableNow=True).start().awaitTermination()


def windows_so_far(
    df: DataFrame, by: list[str], window: Column, value: str, name: str
) -> DataFrame:
    """Run a stream over the data available now and return all its windows, merged."""
    path = scratch_path(df.sparkSession, name)
    collect_windows(df, by, window, value, f"{path}/parts", f"{path}/checkpoint")
    parts = df.sparkSession.read.option("basePath", f"{path}/parts").parquet(f"{path}/parts/batch=*")
    return merged_windows(parts.drop("batch"), by)
