"""Operators on vector columns: packing, group means, scaling, rotation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.functions.kernels import dense_udf

CLIP_KEYS = ("file", "start_time", "end_time")


def pack_vector(
    df: DataFrame, keys: Sequence[str] = CLIP_KEYS, vec: str = "embedding", size: int | None = None
) -> DataFrame:
    """Pack every column that is not a key, in schema order, into one array."""
    values = [c for c in df.columns if c not in keys]
    if size is not None and len(values) != size:
        raise ValueError(f"expected {size} vector columns, found {len(values)}")
    quoted = [F.col(f"`{c}`") for c in values]
    return df.select(*[k for k in keys if k in df.columns], F.array(*quoted).alias(vec))


def unpack_predictions(
    df: DataFrame, vec: str, labels: dict[str, int], keep: Sequence[str] = ()
) -> DataFrame:
    """One column per label, ordered by the label's index in the array."""
    ordered = sorted(labels.items(), key=lambda item: item[1])
    return df.select(*keep, *[F.get(vec, F.lit(i)).alias(label) for label, i in ordered])


def _present(df: DataFrame, vec: str) -> DataFrame:
    return df.where(F.col(vec).isNotNull())


def sound(vec: str, width: int | None = None) -> Column:
    """The vector for MLlib; one with a null element, or of another width, raises."""
    values = F.col(vec)

    def failure(text: str) -> Column:
        return F.raise_error(F.lit(text)).cast("array<double>")

    checked = F.when(F.exists(values, lambda x: x.isNull()), failure("a vector has a null element"))
    if width is not None:
        checked = checked.when(F.size(values) != width, failure(f"expected vectors of {width} values"))
    return array_to_vector(checked.otherwise(values.cast("array<double>")))


def mean_vector(
    df: DataFrame, by: list[str], vec: str = "embedding", width: int | None = None
) -> DataFrame:
    """Element-wise mean per group, with the number ``n`` of vectors behind it.

    Sums are built before the shuffle, so a group of any size sends one partial
    sum per task.  Null vectors are left out (see :func:`missing_vectors`); a null
    element raises, as do vectors of different lengths in one group or, if ``width``
    is stated, of any other.
    """
    mean = vector_to_array(Summarizer.mean(sound(vec, width)))
    return _present(df, vec).groupBy(*by).agg(mean.alias(vec), F.count("*").alias("n"))


def class_prototypes(df: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """Mean over all clips of a class; files with more clips weigh more."""
    return mean_vector(df, [label], vec)


def missing_vectors(df: DataFrame, by: list[str], vec: str = "embedding") -> DataFrame:
    """Rows per group, and how many of them have no vector."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(vec).isNull()).alias("n_missing")
    )


def mean_std_columns(vec: str, width: int | None = None) -> Column:
    """Aggregate: means followed by population standard deviations, as one array."""
    stats = Summarizer.metrics("mean", "variance", "count").summary(sound(vec, width))
    n = stats["count"].cast("double")
    to_std = F.transform(
        vector_to_array(stats["variance"]),
        lambda v: F.sqrt(F.greatest(v, F.lit(0.0)) * (n - 1) / n),
    )
    return F.concat(vector_to_array(stats["mean"]), to_std)


def vector_mean_std(
    df: DataFrame, by: list[str], vec: str = "embedding", out: str = "stats",
    width: int | None = None,
) -> DataFrame:
    """Length 2d array per group: d means, then d population standard deviations."""
    return _present(df, vec).groupBy(*by).agg(
        mean_std_columns(vec, width).alias(out), F.count("*").alias("n")
    )


def long_form(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """``(keys, pos, value)`` rows of an array column."""
    return df.select(*keys, F.posexplode(vec).alias("pos", "value"))


def moments(df: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation of all vectors, as driver arrays."""
    stats = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vec)))
    row = _present(df, vec).agg(stats.alias("s")).first()["s"]
    n = row["count"]
    return row["mean"].toArray(), np.sqrt(row["variance"].toArray() * (n - 1) / n)


def standardize(
    df: DataFrame, vec: str = "embedding", fit_on: DataFrame | None = None
) -> DataFrame:
    """``(x - mean) / std`` per element, fitted on ``fit_on`` (``df`` by default).

    The population standard deviation is used; constant elements are only centred.
    """
    mean, std = moments(fit_on if fit_on is not None else df, vec)
    scale = np.where(std == 0, 1.0, std)
    means, scales = F.lit(mean.tolist()), F.lit(scale.tolist())
    centred = F.zip_with(F.col(vec), means, lambda x, m: x.cast("double") - m)
    return df.withColumn(vec, F.zip_with(centred, scales, lambda x, s: x / s))


def linear(
    df: DataFrame, vec: str, weight: np.ndarray, bias: np.ndarray, out: str = "logits"
) -> DataFrame:
    """``x @ weight + bias`` (weight is d x C) as a new array column."""
    layer = dense_udf(df.sparkSession, [(weight, bias)])
    return df.withColumn(out, layer(F.col(vec)))


def rotate(df: DataFrame, vec: str, model: PipelineModel, out: str = "rotated") -> DataFrame:
    """Centre and project on the components of a rotation from ``fit_rotation``."""
    scaler, pca = model.stages[0], model.stages[1]
    components = pca.pc.toArray()
    bias = -scaler.mean.toArray() @ components
    return linear(df, vec, components, bias, out)
