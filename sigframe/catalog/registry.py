"""Registration of queries and the table shapes they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under ``name``, with SQL that must give the same rows."""

    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- shapes -----------------------------------------------------------------
# The tables stand in for recordings: embeddings for clip vectors, lineitem for
# frames of a few coefficients, events for token streams and file inventories.


def clips(spark: SparkSession, sf: str) -> DataFrame:
    """``file, start_time, end_time, class, label, vec_id, embedding``."""
    v = F.col("vec_id")
    start = (v % 5) * 5.0
    return table(spark, sf, "embeddings").select(
        F.format_string("root/train_audio/c%d/f%d.ogg", "label", F.floor(v / 5)).alias("file"),
        start.alias("start_time"),
        (start + 5.0).alias("end_time"),
        F.format_string("c%d", "label").alias("class"),
        "label",
        "vec_id",
        "embedding",
    )


CLIPS = """clips AS (
  SELECT concat('root/train_audio/c', label, '/f', vec_id // 5, '.ogg') AS file,
         (vec_id % 5) * 5e0 AS start_time, (vec_id % 5) * 5e0 + 5e0 AS end_time,
         concat('c', label) AS class, label, vec_id, embedding::DOUBLE[] AS embedding
  FROM embeddings)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """``file, timestamp, part, bin, mfcc``: four coefficients, eight frames a second.

    The factor pi keeps means of round numbers off the edges of decimal rounding.
    """
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("file"),
        (((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 960) / 8.0).alias("timestamp"),
        (F.col("l_orderkey") % 100).alias("part"),
        F.floor(F.col("l_quantity") / 10).cast("bigint").alias("bin"),
        F.array(
            F.col("l_quantity") * F.pi(),
            F.col("l_extendedprice") / 1000.0 * F.pi(),
            F.col("l_discount") * 100.0 * F.pi(),
            F.col("l_tax") * 100.0 * F.pi(),
        ).alias("mfcc"),
    )


FRAMES = """frames AS (
  SELECT concat('s', l_suppkey) AS file,
         ((l_orderkey * 7 + l_linenumber) % 960) / 8e0 AS timestamp,
         l_orderkey % 100 AS part, floor(l_quantity / 10)::BIGINT AS bin,
         [l_quantity * pi(), l_extendedprice / 1e3 * pi(), l_discount * 1e2 * pi(), l_tax * 1e2 * pi()] AS mfcc
  FROM lineitem)"""


def codebook(spark: SparkSession, sf: str) -> DataFrame:
    """``token, centroid``: the mean frame of each bin."""
    from sigframe.operators.vectors import mean_vector

    means = mean_vector(frames(spark, sf), ["bin"], "mfcc", width=4)
    return means.select(F.col("bin").alias("token"), F.col("mfcc").alias("centroid"))


CODEBOOK = """codebook AS (
  SELECT bin AS token, [avg(mfcc[1]), avg(mfcc[2]), avg(mfcc[3]), avg(mfcc[4])] AS centroid
  FROM frames GROUP BY bin)"""


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """``file, ts, event_id, token``: one token stream per user."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id").alias("file"),
        "ts",
        "event_id",
        F.col("event_type").alias("token"),
    )


TOKENS = """tokens AS (
  SELECT concat('u', user_id) AS file, ts, event_id, event_type AS token FROM events)"""


def durations(spark: SparkSession, sf: str) -> DataFrame:
    """``path, duration``: a file inventory of two datasets."""
    dataset = F.when(F.col("event_id") % 3 == 0, "train_audio").otherwise("train_soundscapes")
    return table(spark, sf, "events").select(
        F.concat(dataset, F.lit("/"), "event_type", F.lit("/"), "event_id", F.lit(".ogg")).alias(
            "path"
        ),
        F.col("value").alias("duration"),
    )


DURATIONS = """durations AS (
  SELECT concat(CASE WHEN event_id % 3 = 0 THEN 'train_audio' ELSE 'train_soundscapes' END,
                '/', event_type, '/', event_id, '.ogg') AS path, value AS duration
  FROM events)"""


def prototypes(spark: SparkSession, sf: str) -> DataFrame:
    """``token, centroid``: the mean vector of each label."""
    from sigframe.operators.vectors import class_prototypes

    means = class_prototypes(table(spark, sf, "embeddings"), "label")
    return means.select(
        F.col("label").cast("bigint").alias("token"), F.col("embedding").alias("centroid")
    )


# Long form of the prototypes, then arrays again.
PROTOTYPES = """proto_long AS (
  SELECT label, pos, avg(embedding[pos + 1]::DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range(64)) AS pos) GROUP BY label, pos),
prototypes AS (
  SELECT label::BIGINT AS token, list(value ORDER BY pos) AS centroid
  FROM proto_long GROUP BY label)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``vec_id, truth, pred, distance``: the nearest class mean of every clip."""
    from sigframe.operators.joins import nearest_centroid

    vectors = table(spark, sf, "embeddings")
    found = nearest_centroid(vectors, "embedding", prototypes(spark, sf), "pred", "distance")
    return found.select(
        "vec_id", F.col("label").alias("truth"), F.col("pred").cast("int").alias("pred"),
        "distance",
    )


PREDICTIONS = f"""{PROTOTYPES},
scored AS (
  SELECT vec_id, label AS truth, token,
         list_sum(list_transform(range(1, 65),
           lambda i: pow(embedding[i]::DOUBLE - centroid[i], 2))) AS distance
  FROM embeddings, prototypes),
predictions AS (
  SELECT vec_id, truth, token::INTEGER AS pred, distance FROM scored
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, token) = 1)"""


def rounded(column: str | Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)
