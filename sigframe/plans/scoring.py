"""Batch scoring of clips and the wide result table."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.functions.kernels import dense_udf
from sigframe.functions.paths import row_id
from sigframe.operators.vectors import unpack_predictions

Layers = list[tuple[np.ndarray, np.ndarray]]


def network_layers(model: MultilayerPerceptronClassificationModel) -> Layers:
    """Weight and bias of each layer of a fitted Spark network (sigmoid between layers)."""
    flat, widths, layers, at = model.weights.toArray(), model.getLayers(), [], 0
    for d, c in zip(widths[:-1], widths[1:]):
        # Spark stores an (outputs x inputs) matrix by columns, then the bias.
        weight = flat[at : at + d * c].reshape(d, c)
        layers.append((weight, flat[at + d * c : at + d * c + c]))
        at += d * c + c
    return layers


def score_clips(
    df: DataFrame, vec: str, layers: Layers, hidden: str = "relu", out: str = "predictions"
) -> DataFrame:
    """Class probabilities of every clip from a dense network, as an array column."""
    network = dense_udf(df.sparkSession, layers, final="softmax", hidden=hidden)
    return df.withColumn(out, network(F.col(vec)))


def submission(
    df: DataFrame, labels: dict[str, int], predictions: str = "predictions", ext: str = ".ogg"
) -> DataFrame:
    """``row_id`` and one probability column per label, sorted by ``row_id`` as text."""
    named = df.withColumn("row_id", row_id("file", "end_time", ext))
    return unpack_predictions(named, predictions, labels, keep=["row_id"]).orderBy("row_id")
