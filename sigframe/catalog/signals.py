"""Clips, frames, resampling and cepstral coefficients."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sigframe.catalog.registry import CLIPS, FRAMES, clips, frames, query, rounded, table
from sigframe.operators import signal, vectors


def series(spark, sf):
    """One sample array per embedding: 64 samples at 8 a second."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("file"), F.lit(8).alias("sample_rate"), F.col("embedding").alias("samples")
    )


@query("series_duration", """SELECT vec_id AS file, len(embedding) / 8 AS duration FROM embeddings""")
def series_duration(spark, sf):
    return series(spark, sf).select("file", signal.series_duration().alias("duration"))


@query("long_duration", f"""WITH {FRAMES}
SELECT file, max(timestamp) - min(timestamp) AS duration FROM frames GROUP BY file""")
def long_duration(spark, sf):
    return signal.long_duration(frames(spark, sf), ["file"])


@query("clip_windows", """WITH recs AS (SELECT event_id, round(value * 1000)::BIGINT AS ms FROM events),
counted AS (SELECT event_id, CASE WHEN ms >= 960 THEN (ms - 960) // 480 + 1 ELSE 0 END AS n FROM recs)
SELECT event_id, count(*) AS n, max(clip) AS last, round(sum(clip * 480 / 1e3), 2) AS starts,
       max((clip * 480 + 960) / 1e3) AS end_time
FROM counted, unnest(range(n)) AS t(clip) GROUP BY event_id""")
def clip_windows(spark, sf):
    recordings = table(spark, sf, "events").select("event_id", F.col("value").alias("duration"))
    found = signal.clip_windows(recordings, 960, 480)
    return found.groupBy("event_id").agg(
        F.count("*").alias("n"), F.max("clip").alias("last"),
        F.round(F.sum("start_time"), 2).alias("starts"), F.max("end_time").alias("end_time"),
    )


@query("cut_clips", """
SELECT vec_id AS file, clip, clip * 2e0 AS start_time, clip * 2e0 + 5 AS end_time,
       round(list_sum(embedding[clip * 16 + 1 : clip * 16 + 40]::DOUBLE[]), 6) + 0e0 AS total
FROM embeddings, unnest(range(2)) AS t(clip)""")
def cut_clips(spark, sf):
    from sigframe.functions.arrays import array_sum

    cut = signal.cut_clips(series(spark, sf), 5000, 2000)
    return cut.select(
        "file", "clip", "start_time", "end_time", rounded(array_sum("samples")).alias("total")
    )


@query("frame", """
SELECT vec_id AS file, i AS index, (i * 4 + 4) / 8 AS timestamp,
       round(list_sum(embedding[i * 4 + 1 : i * 4 + 8]::DOUBLE[]), 6) + 0e0 AS total
FROM embeddings, unnest(range(15)) AS t(i)""")
def frame(spark, sf):
    from sigframe.functions.arrays import array_sum

    found = signal.frame(series(spark, sf), 8, 4)
    return found.select("file", "index", "timestamp", rounded(array_sum("samples")).alias("total"))


@query("resample", """WITH raw AS (
  SELECT user_id, epoch(ts) AS t, value FROM events),
stepped AS (SELECT user_id, floor(t / 3600)::BIGINT AS step, avg(value) AS v FROM raw GROUP BY ALL),
spans AS (SELECT user_id, min(step) AS lo, max(step) AS hi FROM stepped GROUP BY user_id),
grid AS (SELECT user_id, unnest(range(lo, hi + 1)) AS step FROM spans)
SELECT user_id, step, step * 3600e0 AS t,
       round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY step), 6) AS value
FROM grid LEFT JOIN stepped USING (user_id, step)""")
def resample(spark, sf):
    stamped = table(spark, sf, "events").select(
        "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value"
    )
    found = signal.resample(stamped, ["user_id"], "t", "value", 3600.0, chunk=64)
    return found.withColumn("value", F.round("value", 6))


# Band edges are equally spaced on the mel scale; band b spans edges b to b + 2.
MEL_BANDS = """WITH edges AS (
  SELECT i, CASE WHEN m < 15 THEN m * 200 / 3 ELSE 1000 * exp(ln(64e-1) / 27 * (m - 15)) END AS hz
  FROM (SELECT i, (15 + ln(16e0) / (ln(64e-1) / 27)) * i / 9 AS m FROM range(10) AS t(i))),
bank AS (
  SELECT a.i AS band, k, greatest(0, least((k * 500 - a.hz) / (b.hz - a.hz), (c.hz - k * 500) / (c.hz - b.hz)))
         * 2 / (c.hz - a.hz) AS weight
  FROM edges a JOIN edges b ON b.i = a.i + 1 JOIN edges c ON c.i = a.i + 2, range(33) AS t(k)),
framed AS (
  SELECT vec_id AS file, i AS index, embedding[i * 16 + 1 : i * 16 + 32]::DOUBLE[] AS s
  FROM embeddings, range(3) AS t(i)),
tapered AS (
  SELECT file, index, list_transform(range(32), lambda j:
    (s[j + 1] - list_avg(s)) * (5e-1 - 5e-1 * cos(2 * pi() * j / 32))) AS x FROM framed),
spectrum AS (
  SELECT file, index, k, (pow(list_sum(list_transform(range(32), lambda j: x[j + 1] * cos(2 * pi() * j * k / 64))), 2)
    + pow(list_sum(list_transform(range(32), lambda j: x[j + 1] * sin(2 * pi() * j * k / 64))), 2))
    / pow(16, 2) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS power
  FROM tapered, range(33) AS t(k)),
bands AS (SELECT file, index, band, sum(power * weight) AS power FROM spectrum JOIN bank USING (k) GROUP BY ALL)"""


@query("mel_spectrogram", f"""{MEL_BANDS}
SELECT file, index, band::INTEGER AS band, round(power * 1e6, 6) + 0e0 AS power FROM bands""")
def mel_spectrogram(spark, sf):
    framed = signal.frame(series(spark, sf), 32, 16)
    bands = signal.mel_spectrogram(framed, rate=32000, size=32, n_fft=64, n_mels=8)
    long = bands.select("file", "index", F.posexplode("bands").alias("band", "power"))
    return long.withColumn("power", rounded(F.col("power") * 1e6))


# One frame of 64 samples: the same transform written as sums over the samples.
@query("frame_power", """WITH tapered AS (
  SELECT vec_id AS file, list_transform(range(64), lambda j:
    (embedding[j + 1]::DOUBLE - list_avg(embedding::DOUBLE[])) * (5e-1 - 5e-1 * cos(2 * pi() * j / 64))) AS x
  FROM embeddings),
spectrum AS (
  SELECT file, k, (pow(list_sum(list_transform(range(64), lambda j: x[j + 1] * cos(2 * pi() * j * k / 64))), 2)
    + pow(list_sum(list_transform(range(64), lambda j: x[j + 1] * sin(2 * pi() * j * k / 64))), 2))
    / pow(32, 2) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS power
  FROM tapered, unnest(range(33)) AS t(k))
SELECT file, k::INTEGER AS band, round(power, 9) + 0e0 AS power FROM spectrum""")
def frame_power(spark, sf):
    from sigframe.functions.kernels import power_bands_udf

    hann = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(64) / 64)
    kernel = power_bands_udf(spark, 64, hann, np.eye(33))
    found = series(spark, sf).select("file", F.posexplode(kernel("samples")).alias("band", "power"))
    return found.withColumn("power", rounded("power", 9))


@query("mfcc", """WITH coef AS (
  SELECT vec_id, k, list_sum(list_transform(range(64), lambda j:
    embedding[j + 1]::DOUBLE * cos(pi() * k * (2 * j + 1) / 128))) * sqrt(CASE WHEN k = 0 THEN 1 / 64 ELSE 2 / 64 END) AS c
  FROM embeddings, unnest(range(20)) AS t(k))
SELECT vec_id, k::INTEGER AS pos, round(c, 6) + 0e0 AS value FROM coef""")
def mfcc(spark, sf):
    found = signal.mfcc(table(spark, sf, "embeddings"), 64, 20, bands="embedding")
    long = vectors.long_form(found, ["vec_id"], "mfcc")
    return long.withColumn("value", rounded("value"))


# Samples to frames to mel bands to coefficients, for every frame of every series.
@query("mfcc_of_series", f"""{MEL_BANDS}
SELECT file, index, n::INTEGER AS pos,
       round(sum(power * cos(pi() * n * (2 * band + 1) / 16)) * sqrt(CASE WHEN n = 0 THEN 1 / 8 ELSE 2 / 8 END) * 1e6, 6) + 0e0 AS value
FROM bands, range(5) AS t(n) GROUP BY file, index, n""")
def mfcc_of_series(spark, sf):
    framed = signal.frame(series(spark, sf), 32, 16)
    bands = signal.mel_spectrogram(framed, rate=32000, size=32, n_fft=64, n_mels=8)
    long = vectors.long_form(signal.mfcc(bands, 8, 5), ["file", "index"], "mfcc")
    return long.withColumn("value", rounded(F.col("value") * 1e6))


@query("embed_clips", f"""WITH {CLIPS}
SELECT file, start_time, round(list_avg(embedding), 6) + 0e0 AS mean,
       round(list_max(embedding), 6) AS top FROM clips""")
def embed_clips(spark, sf):
    def load():
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            matrix = np.stack(batch["embedding"]).astype("float64")
            keys = batch[["file", "start_time"]]
            return keys.assign(mean=matrix.mean(axis=1), top=matrix.max(axis=1))

        return model

    data = clips(spark, sf).select("file", "start_time", "embedding")
    found = signal.embed_clips(
        data, load, "file string, start_time double, mean double, top double"
    )
    return found.select("file", "start_time", rounded("mean").alias("mean"), rounded("top").alias("top"))
