"""A ReLU network trained by mini-batch Adam over partitioned rows.

Rows are dealt to partitions by a hash and lie there as blocks.  A step needs the weights
that the step before has left, so the steps of an epoch follow each other whatever the
number of tasks; the weights (bounded by a check) go from partition to partition, and each
makes the Adam steps of its mini-batches where its rows are.  Rows that do not fill a
mini-batch go on with the weights.  An epoch passes over all rows once, in an order drawn
from the seed and the epoch, and ends with the loss on held-out rows, which all tasks judge
at once.  Training stops when that loss has not fallen for ``patience`` epochs, and the
best epoch's weights are returned.

With a ``path`` the state after every epoch is written there, and a run that was stopped
goes on from it to the same weights.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.functions.kernels import dense_udf, rows_of
from sigframe.plans.quantizer import finite
from sigframe.sources.sinks import is_complete

#: Most weights: those of 2,048 inputs, 512 units and 10,932 classes are 6.7 million.
MAX_WEIGHTS = 20_000_000
TASK_ROWS = 20_000
Weights = list[np.ndarray]


class ReluClassifier:
    """Weights of a fitted network, the losses of its epochs, and the number of the best one."""

    def __init__(self, vec: str, weights: Weights, losses: list[tuple[float, float]], best: int):
        self.vec, self.weights, self.losses, self.best = vec, weights, losses, best

    @property
    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.weights[0], self.weights[1]), (self.weights[2], self.weights[3])]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` (an array by class) and ``prediction`` (the likeliest class as
        a double, the lowest on ties); both are null for null and non-finite vectors."""
        network = dense_udf(df.sparkSession, self.layers, final="softmax", hidden="relu")
        vec = F.when(finite(self.vec), F.col(self.vec).cast("array<double>"))
        found = df.withColumn("probability", network(vec))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return found.withColumn("prediction", best.cast("double"))

    def save(self, path: str) -> None:
        """Save as one table, replacing what is at ``path``."""
        spark = SparkSession.active()
        about = json.dumps({"vec": self.vec, "losses": self.losses, "best": self.best})
        _write(spark, self.weights, about, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> ReluClassifier:
        weights, about = _read(spark, path)
        kept = json.loads(about)
        return ReluClassifier(kept["vec"], weights, [tuple(p) for p in kept["losses"]], kept["best"])


def _write(spark: SparkSession, arrays: list[np.ndarray], about: str, path: str) -> None:
    rows = [(k, list(a.shape), a.ravel().tolist(), about if k == 0 else None) for k, a in enumerate(arrays)]
    made = spark.createDataFrame(rows, "k int, shape array<int>, body array<double>, about string")
    made.coalesce(1).write.mode("overwrite").parquet(path)


def _read(spark: SparkSession, path: str) -> tuple[list[np.ndarray], str]:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["k"])
    return [np.array(r["body"]).reshape(r["shape"]) for r in rows], rows[0]["about"]


def _blocks(rows: DataFrame, width: int) -> RDD:
    """A partition's rows as one pair of matrix and labels, held for all steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = rows_of(batch.column(0), width)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"x": [x.astype(np.float32).tobytes()], "y": [y.tobytes()]})

    def opened(part: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        pairs = [(np.frombuffer(r["x"], np.float32).reshape(-1, width), np.frombuffer(r["y"], np.int32)) for r in part]
        if pairs:
            yield np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])

    return rows.mapInArrow(run, "x binary, y binary").rdd.mapPartitions(opened).persist(StorageLevel.MEMORY_AND_DISK)


def forward(weights: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden units and class probabilities."""
    hidden = np.maximum(x @ weights[0] + weights[1], 0.0)
    scores = hidden @ weights[2] + weights[3]
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return hidden, scores / scores.sum(axis=1, keepdims=True)


def gradient(weights: Weights, x: np.ndarray, y: np.ndarray) -> tuple[Weights, float]:
    """Summed gradients and summed cross-entropy of some rows."""
    x = x.astype(np.float64)
    hidden, p = forward(weights, x)
    loss = -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
    p[np.arange(len(y)), y] -= 1.0
    back = (p @ weights[2].T) * (hidden > 0)
    return [x.T @ back, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)], loss


def _visit(part: int, rows: Iterator, shared, order: list[int], batch: int, rate: float, last: bool) -> Iterator[tuple]:
    """The state after the steps of a partition's mini-batches, and their summed loss.

    The state are weights, moments, the steps made, and rows left for the next mini-batch.
    """
    for x, y in rows:
        weights, moments, step, (left_x, left_y) = shared.value
        weights, moments = ([w.copy() for w in some] for some in (weights, moments))
        mine = np.random.default_rng([*order, part]).permutation(len(y))
        x, y = np.concatenate([left_x, x[mine]]), np.concatenate([left_y, y[mine]])
        end, total = len(y) if last else len(y) - len(y) % batch, 0.0
        for begin in range(0, end, batch):
            some = slice(begin, min(begin + batch, end))
            slopes, loss = gradient(weights, x[some], y[some])
            step += 1
            adam(weights, moments, [g / (some.stop - begin) for g in slopes], step, rate)
            total += loss
        yield (weights, moments, step, (x[end:], y[end:])), total


def _held_out_loss(rows: Iterator, weights) -> Iterator[tuple[float, int]]:
    for x, y in rows:
        _, p = forward(weights.value, x.astype(np.float64))
        yield -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()), len(y)


def adam(weights: Weights, moments: Weights, slopes: Weights, step: int, rate: float) -> None:
    """One step in place; ``moments`` are the first and then the second ones of all weights."""
    for k, (w, g) in enumerate(zip(weights, slopes)):
        m, v = moments[k], moments[len(weights) + k]
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def first_weights(inputs: int, hidden: int, classes: int, seed: int) -> Weights:
    """Uniform within one over the root of a unit's inputs."""
    draw = np.random.default_rng(seed)
    a, b = inputs**-0.5, hidden**-0.5
    return [
        draw.uniform(-a, a, (inputs, hidden)), draw.uniform(-a, a, hidden),
        draw.uniform(-b, b, (hidden, classes)), draw.uniform(-b, b, classes),
    ]


def train_relu_classifier(
    df: DataFrame, vec: str, label: str = "idx", hidden: int = 512, epochs: int = 50, rate: float = 1e-3,
    batch: int = 64, patience: int = 5, held_out: DataFrame | None = None, share: float = 0.2, seed: int = 42,
    path: str | None = None,
) -> ReluClassifier:
    """A network of one hidden ReLU layer on vectors ``vec`` with class index ``label``.

    ``held_out`` are the rows whose loss decides; without them a ``share`` of ``df`` by a hash of
    vector and label.  A mini-batch has ``batch`` rows, the last one of an epoch what is left.
    Rows with a null label or a vector that is not finite are left out; without rows to
    train on it raises.  ``path`` keeps the state of the run.
    """
    spark = df.sparkSession

    def usable(some: DataFrame) -> DataFrame:
        return some.select(F.col(vec).alias("v"), F.col(label).cast("int").alias("y")).where(finite("v") & F.col("y").isNotNull())

    train = usable(df)
    mixed = F.xxhash64("v", "y", F.lit(seed))
    if held_out is None:
        aside = F.pmod(mixed, F.lit(1_000_000)) < int(share * 1_000_000)
        train, test = train.where(~aside), train.where(aside)
    else:
        test = usable(held_out)
    seen = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.max("y").alias("y")).first()
    n_test, y_test = test.agg(F.count(F.lit(1)), F.coalesce(F.max("y"), F.lit(0))).first()
    if not seen["n"]:
        raise ValueError("there are no rows to train on")
    width, classes = seen["d"], max(2, seen["y"] + 1, y_test + 1)
    if width * hidden + hidden * classes > MAX_WEIGHTS:
        raise ValueError("a network of this size is not held by every task")
    tasks = -(-seen["n"] // TASK_ROWS)
    dealt = [some.repartition(tasks, mixed).sortWithinPartitions(mixed, "y") for some in (train, test)]
    rows, aside = (_blocks(some, width) for some in dealt)
    sizes = dict(rows.mapPartitionsWithIndex(lambda k, part: [(k, len(y)) for _, y in part]).collect())
    n_train = sum(sizes.values())
    nothing = np.empty((0, width), np.float32), np.empty(0, np.int32)
    weights = first_weights(width, hidden, classes, seed)
    moments = [np.zeros_like(w) for w in weights * 2]
    best, losses, epoch = [w.copy() for w in weights], [], 0
    state = f"{path}/epoch={{:06d}}"
    while path is not None and is_complete(spark, state.format(epoch + 1)):
        epoch += 1
    if epoch:
        arrays, about = _read(spark, state.format(epoch))
        weights, moments, best = arrays[:4], arrays[4:12], arrays[12:]
        losses = [tuple(p) for p in json.loads(about)]
    try:
        while epoch < epochs and not _stalled(losses, patience):
            total, made, left = 0.0, epoch * -(-n_train // batch), nothing
            way = np.random.default_rng([seed, epoch]).permutation(sorted(sizes)).tolist()
            for part in way:
                shared = spark.sparkContext.broadcast((weights, moments, made, left))
                visit = partial(_visit, shared=shared, order=[seed, epoch], batch=batch, rate=rate, last=part == way[-1])
                ((weights, moments, made, left), loss), = spark.sparkContext.runJob(rows.mapPartitionsWithIndex(visit), list, [part])
                shared.destroy()
                total += loss
            shared = spark.sparkContext.broadcast(weights)
            found = aside.mapPartitions(partial(_held_out_loss, weights=shared)).collect()
            shared.destroy()
            judged = sum(loss for loss, _ in found) / n_test if n_test else total / n_train
            if all(judged < loss for _, loss in losses):
                best = [w.copy() for w in weights]
            losses.append((total / n_train, judged))
            epoch += 1
            if path is not None:
                _write(spark, [*weights, *moments, *best], json.dumps(losses), state.format(epoch))
    finally:
        rows.unpersist()
        aside.unpersist()
    found = min(range(len(losses)), key=lambda k: losses[k][1], default=0)
    return ReluClassifier(vec, best, losses, found)


def _stalled(losses: list[tuple[float, float]], patience: int) -> bool:
    judged = [loss for _, loss in losses]
    return len(judged) > patience and min(judged[-patience:]) >= min(judged[:-patience])
