"""Signal operators: clips, frames, resampling, mel bands and cepstral coefficients.

A series table holds one row per recording, ``(file, sample_rate, samples)``; a
recording is the unit a row is bounded by.  Long tables ``(file, t, value)`` have
no such bound and are cut into chunks where order matters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.functions.kernels import dense_udf, power_bands_udf
from sigframe.runtime import shuffle_width


def series_duration(samples: str = "samples", rate: str = "sample_rate") -> Column:
    """Length of a recording in seconds."""
    return F.size(samples) / F.col(rate)


def long_duration(df: DataFrame, by: list[str], t: str = "timestamp") -> DataFrame:
    return df.groupBy(*by).agg((F.max(t) - F.min(t)).alias("duration"))


def clip_count(duration: Column, length_ms: int, step_ms: int) -> Column:
    """Whole clips in a recording, counted in integer milliseconds."""
    ms = F.round(duration * 1000).cast("bigint")
    full = F.floor((ms - length_ms) / step_ms) + 1
    return F.when(ms >= length_ms, full).otherwise(F.lit(0)).cast("bigint")


def clip_windows(
    df: DataFrame, length_ms: int, step_ms: int, duration: str = "duration"
) -> DataFrame:
    """One row per whole clip ``[start_time, end_time)``; a remainder gives no clip."""
    n = clip_count(F.col(duration), length_ms, step_ms)
    numbered = df.withColumn("_n", n).where("_n > 0").withColumn(
        "clip", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))
    )
    start = F.col("clip") * step_ms
    return (
        numbered.withColumn("start_time", start / 1000.0)
        .withColumn("end_time", (start + length_ms) / 1000.0)
        .drop("_n")
    )


def cut_clips(
    df: DataFrame, length_ms: int, step_ms: int, samples: str = "samples",
    rate: str = "sample_rate",
) -> DataFrame:
    """:func:`clip_windows` of a series table, each clip with its own samples."""
    timed = df.withColumn("_seconds", series_duration(samples, rate))
    clips = clip_windows(timed, length_ms, step_ms, "_seconds").drop("_seconds")
    first = F.floor(F.col("clip") * step_ms * F.col(rate) / 1000).cast("int")
    count = F.floor(F.lit(length_ms) * F.col(rate) / 1000).cast("int")
    return clips.withColumn(samples, F.slice(samples, first + 1, count))


def frame(
    df: DataFrame, size: int = 8000, hop: int = 4000, samples: str = "samples",
    rate: str = "sample_rate",
) -> DataFrame:
    """Overlapping frames of each series with the time of their centre in seconds."""
    count = F.floor((F.size(samples) - size) / hop) + 1
    numbered = df.where(F.size(samples) >= size).withColumn(
        "index", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))
    )
    begin = F.col("index") * hop
    return numbered.withColumn("timestamp", (begin + size / 2) / F.col(rate)).withColumn(
        samples, F.slice(samples, (begin + 1).cast("int"), F.lit(size))
    )


def mel_bank(rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangular mel filters (bands x bins), each scaled to unit area.

    The mel scale is linear up to 1 kHz and logarithmic above (Slaney).
    """
    knee, slope = 1000.0, 200.0 / 3.0
    growth = np.log(6.4) / 27.0
    top = rate / 2.0
    high = knee / slope + np.log(top / knee) / growth if top > knee else top / slope
    mels = np.linspace(0.0, high, n_mels + 2)
    edges = np.where(
        mels < knee / slope, mels * slope, knee * np.exp(growth * (mels - knee / slope))
    )
    bins = np.linspace(0.0, top, n_fft // 2 + 1)
    low, mid, up = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rise, fall = (bins - low) / (mid - low), (up - bins) / (up - mid)
    return np.maximum(0.0, np.minimum(rise, fall)) * 2.0 / (up - low)


def mel_spectrogram(
    df: DataFrame, rate: int, size: int = 8000, n_fft: int = 8192, n_mels: int = 128,
    samples: str = "samples", out: str = "bands",
) -> DataFrame:
    """Power in ``n_mels`` mel bands per frame of ``size`` samples, without decibels.

    Frames get a periodic Hann window and are padded with zeros to ``n_fft``.
    """
    hann = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(size) / size)
    kernel = power_bands_udf(df.sparkSession, n_fft, hann, mel_bank(rate, n_fft, n_mels))
    return df.withColumn(out, kernel(F.col(samples)))


def cosine_matrix(n_bands: int, n: int) -> np.ndarray:
    """Orthonormal DCT-II, bands x coefficients."""
    j, k = np.arange(n_bands)[:, None], np.arange(n)[None, :]
    scale = np.where(k == 0, np.sqrt(1.0 / n_bands), np.sqrt(2.0 / n_bands))
    return scale * np.cos(np.pi * k * (2 * j + 1) / (2 * n_bands))


def mfcc(
    df: DataFrame, n_bands: int, n: int = 20, bands: str = "bands", out: str = "mfcc"
) -> DataFrame:
    """First ``n`` cepstral coefficients of the bands; no logarithm is taken."""
    kernel = dense_udf(df.sparkSession, [(cosine_matrix(n_bands, n), np.zeros(n))])
    return df.withColumn(out, kernel(F.col(bands)))


def resample(
    df: DataFrame, by: list[str], order: str, value: str, step: float, chunk: int = 4096,
    max_gap: float | None = None,
) -> DataFrame:
    """One mean value per time step and series, empty steps filled from the last one.

    Every step with values is repeated up to the next such step.  That step is
    looked up inside a chunk of ``chunk`` steps, and for the last one of a chunk in
    a table with one row per chunk, so a long series is spread over many tasks.
    A gap longer than ``max_gap`` is left open; set it where a stray time is possible,
    as one of 1970 would otherwise be filled up for decades.  Rows without time or
    value are ignored.  Output: ``by..., step, t, value``.
    """
    names = [f"k{i}" for i in range(len(by))]
    series = [F.col(c).alias(n) for c, n in zip(by, names)]
    stepped = (
        df.where(F.col(order).isNotNull() & F.col(value).isNotNull())
        .groupBy(*by, F.floor(F.col(order) / step).cast("bigint").alias("step"))
        .agg(F.avg(value).alias("value"))
        .withColumn("_key", F.struct(*series, _chunk_of(F.col("step"), chunk).alias("chunk")))
    )
    firsts = stepped.groupBy("_key").agg(F.min("step").alias("_first"))
    along = Window.partitionBy(*[F.col(f"_key.{n}") for n in names]).orderBy("_key.chunk")
    following = firsts.select(F.col("_key").alias("_of"), F.lead("_first").over(along).alias("_next"))
    inside = Window.partitionBy("_key").orderBy("step")
    held = (
        stepped.withColumn("_lead", F.lead("step").over(inside))
        .join(following, F.col("_key") == F.col("_of"))
        .withColumn("_end", F.coalesce("_lead", "_next", F.col("step") + 1) - 1)
    )
    if max_gap is not None:
        wide = (F.col("_end") + 1 - F.col("step")) * step > max_gap
        held = held.withColumn("_end", F.when(wide, F.col("step")).otherwise(F.col("_end")))
    # A wide gap is unrolled chunk by chunk, so no array exceeds one chunk.
    chunks = F.sequence(_chunk_of(F.col("step"), chunk), _chunk_of(F.col("_end"), chunk))
    low = F.greatest("step", F.col("_c") * chunk)
    high = F.least("_end", (F.col("_c") + 1) * chunk - 1)
    filled = held.withColumn("_c", F.explode(chunks)).select(
        *by, "value", F.explode(F.sequence(low, high)).alias("step")
    )
    return filled.select(*by, "step", (F.col("step") * step).alias("t"), "value")


def _chunk_of(position: Column, chunk: int) -> Column:
    return F.floor(position / chunk).cast("bigint")


def embed_clips(
    df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str
) -> DataFrame:
    """Map clips to vectors with a model of the caller's.

    ``load`` runs once per task and returns the function that is then applied to
    every batch of rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)


def group_map(
    df: DataFrame,
    by: list[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    finish: Callable[[pd.DataFrame], pd.DataFrame],
    state_schema: str,
    schema: str,
    salts: int = 64,
) -> DataFrame:
    """An aggregate written in pandas, without bringing a group into one task.

    All three functions see the rows of many keys at once and work by
    ``groupby(by)``: ``partial`` turns a batch of rows into one state row per key,
    ``merge`` combines state rows into one per key, ``finish`` turns merged states
    into result rows.  Keys are hashed into buckets; merging runs in two rounds, the
    first within the states of every ``salts``-th task only, so a key that occurs
    in all tasks is spread as well.
    """

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield partial(batch)

    def merge_some(rows: pd.DataFrame) -> pd.DataFrame:
        return merge(rows.drop(columns=["_bucket", "_salt"]))

    def merge_finish(rows: pd.DataFrame) -> pd.DataFrame:
        return finish(merge(rows.drop(columns="_bucket")))

    buckets = 16 * shuffle_width(df.sparkSession)
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets))
    states = df.mapInPandas(reduce_batches, state_schema)
    salted = states.withColumn("_bucket", bucket).withColumn(
        "_salt", F.pmod(F.spark_partition_id(), F.lit(salts))
    )
    merged = salted.groupBy("_bucket", "_salt").applyInPandas(merge_some, state_schema)
    return merged.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandas(
        merge_finish, schema
    )
