"""Streaming queries, run over what the tables hold now."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.catalog.registry import query, rounded, table
from sigframe.streaming import jobs


def _stamped(events):
    """Events with a timestamp a watermark accepts, values off the rounding edges."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withColumn("value", F.col("value") * F.pi())


def _stream(spark, sf):
    """Stream of the events table, whether it is one file or a directory."""
    events = table(spark, sf, "events")
    files = events.select("_metadata.file_path").distinct().limit(2).collect()
    if files and files[0][0].endswith("/events.parquet"):
        raw = jobs.stream_files(spark, sf, events.schema, "events.parquet")
    else:
        raw = jobs.stream_files(spark, f"{sf}/events.parquet", events.schema)
    return _stamped(raw)


def _check(df):
    return df.select(
        "event_type",
        F.unix_seconds("window_start").alias("start"),
        F.unix_seconds("window_end").alias("end"),
        "n", rounded("mean").alias("mean"), rounded("std", 4).alias("std"),
        rounded("low").alias("low"), rounded("high").alias("high"),
    )


def _merged(df):
    """Windows of a number, whose means and deviations are arrays of one."""
    return _check(df.withColumn("mean", F.get("mean", F.lit(0))).withColumn("std", F.get("std", F.lit(0))))


WINDOWED = """stats AS (
  SELECT event_type, s AS start, s + {length} AS "end", count(*) AS n, round(avg(value * pi()), 6) + 0e0 AS mean,
         round(stddev_pop(value * pi()), 4) + 0e0 AS std,
         round(min(value * pi()), 6) AS low, round(max(value * pi()), 6) AS high
  FROM starts GROUP BY event_type, s)
SELECT * FROM stats"""


@query("stream_files", "SELECT event_id, user_id, event_type FROM events")
def stream_files(spark, sf):
    return jobs.drained(_stream(spark, sf).select("event_id", "user_id", "event_type"), "files")


@query("stream_bucket_features", """WITH starts AS (
  SELECT event_type, value, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS s FROM events),
""" + WINDOWED.format(length=3600))
def stream_bucket_features(spark, sf):
    window = jobs.window_of("ts", 3600)
    return _merged(jobs.windows_so_far(_stream(spark, sf), ["event_type"], window, "value", "buckets"))


@query("stream_vector_features", """WITH parts AS (
  SELECT event_type, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS start, [value * pi(), user_id * pi()] AS v FROM events),
stats AS (
  SELECT event_type, start, count(*) AS n, round(avg(v[1]), 6) AS m0, round(avg(v[2]), 6) AS m1,
         round(stddev_pop(v[1]), 4) + 0e0 AS s0, round(stddev_pop(v[2]), 4) + 0e0 AS s1
  FROM parts GROUP BY event_type, start)
SELECT * FROM stats""")
def stream_vector_features(spark, sf):
    stream = _stream(spark, sf)
    framed = stream.withColumn("v", F.array("value", F.col("user_id") * F.pi()))
    found = jobs.windows_so_far(framed, ["event_type"], jobs.window_of("ts", 3600), "v", "vectors")
    return found.select(
        "event_type", F.unix_seconds("window_start").alias("start"), "n",
        *[rounded(F.get("mean", F.lit(i))).alias(f"m{i}") for i in range(2)],
        *[rounded(F.get("std", F.lit(i)), 4).alias(f"s{i}") for i in range(2)],
    )


@query("stream_clips", """WITH starts AS (
  SELECT event_type, value, (floor(epoch(ts) / 1800) * 1800 - k * 1800)::BIGINT AS s
  FROM events, unnest(range(4)) AS t(k)),
""" + WINDOWED.format(length=7200))
def stream_clips(spark, sf):
    window = jobs.window_of("ts", 7200, 1800)
    return _merged(jobs.windows_so_far(_stream(spark, sf), ["event_type"], window, "value", "clips"))


@query("batch_bucket_features", """WITH starts AS (
  SELECT event_type, value, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS s FROM events),
""" + WINDOWED.format(length=3600))
def batch_bucket_features(spark, sf):
    return _check(jobs.stream_bucket_features(_stamped(table(spark, sf, "events")), ["event_type"], "value", "ts", 3600))
