"""Boosted trees with softmax loss from gradient histograms.

Features are cut into bins once, by quantile sketches.  All classes of a round grow
together, one job per tree level: tasks add up the gradients of their rows by class, node,
feature and bin, a shuffle by slices of features adds the tasks' histograms, and the slice's
task returns the best split of each node, so the driver sees one row per slice, class and
node.  Gradients are rounded to whole units before they are added: sums do not depend on
the order, and a tree does not depend on how rows lie in partitions.

Rows are held as blocks of bytes with their scores.  A round adds what the trees of the round
before give to the scores held, once; every ``keep_every`` rounds the scores are written to the
shared folder, so that neither the work of a round nor the loss of an executor grows with the
rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.functions.kernels import arrays_from, rows_of
from sigframe.plans.quantizer import finite
from sigframe.runtime import durable, shuffle_width

#: Rows of a block, cells of a slice of the histograms, and numbers of a model.  A task sends a
#: histogram whatever its rows, so it needs rows enough to be worth it.
BLOCK_ROWS, SLICE_CELLS, MAX_MODEL = 16_384, 1 << 19, 50_000_000
UNITS = 2.0**24
BLOCKS = "n int, x binary, y binary, w binary, f binary"


class BoostedTrees:
    """Fitted trees: ``features``, ``thresholds`` (round, class, node) and ``leaves``.

    A node's children are 2 k + 1 and 2 k + 2; values above the threshold go right.
    ``losses`` has the mean training loss before each round.
    """

    def __init__(self, vec: str, features: np.ndarray, thresholds: np.ndarray, leaves: np.ndarray, losses: list[float]):
        self.vec, self.features, self.thresholds, self.leaves, self.losses = vec, features, thresholds, leaves, losses

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` (an array by class) and ``prediction`` (the likeliest class as
        a double, the lowest on ties); both are null for null and non-finite vectors."""
        shared = df.sparkSession.sparkContext.broadcast((self.features, self.thresholds, self.leaves))

        def run(column: pa.Array) -> pa.Array:
            features, thresholds, leaves = shared.value
            width = int(features.max(initial=0)) + 1
            present = np.array(column.is_valid())
            lengths = column.drop_null().value_lengths().to_numpy(zero_copy_only=False)
            if len(lengths) and (lengths != lengths[0]).any() or len(lengths) and lengths[0] < width:
                raise ValueError(f"vectors need one length of at least {width}")
            x, present = rows_of(column, int(lengths[0]) if len(lengths) else width)
            sound = np.isfinite(x).all(axis=1)
            present[present] = sound
            x = x[sound]
            out = np.empty((len(x), leaves.shape[1]))
            for begin in range(0, len(x), 256):
                out[begin : begin + 256] = softmax(_scores(x[begin : begin + 256], features, thresholds, leaves))
            return arrays_from(out, present, pa.float64())

        probability = F.arrow_udf(run, "array<double>")
        found = df.withColumn("probability", probability(F.col(self.vec)))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return found.withColumn("prediction", best.cast("double"))

    def save(self, path: str) -> None:
        """Save as tables, one row per round and class, replacing what is at ``path``."""
        spark = SparkSession.active()
        rows = [
            (r, c, self.features[r, c].tolist(), self.thresholds[r, c].tolist(), self.leaves[r, c].tolist())
            for r in range(self.features.shape[0]) for c in range(self.features.shape[1])
        ]
        schema = "round int, class int, features array<int>, thresholds array<double>, leaves array<double>"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        about = spark.createDataFrame([(self.vec, self.losses)], "vec string, losses array<double>")
        about.coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        about = spark.read.schema("vec string, losses array<double>").json(f"{path}/about").first()
        rows = spark.read.parquet(f"{path}/trees").orderBy("round", "class").collect()
        shape = (rows[-1]["round"] + 1, rows[-1]["class"] + 1, -1)
        columns = [np.array([r[c] for r in rows]).reshape(shape) for c in ("features", "thresholds", "leaves")]
        return BoostedTrees(about["vec"], columns[0].astype(np.int32), columns[1], columns[2], about["losses"])


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def _places(x: np.ndarray, features: np.ndarray, cuts: np.ndarray, levels: int) -> np.ndarray:
    """For every row and tree (rows x trees), the node of level ``levels`` it comes to."""
    node = np.zeros((len(x), len(features)), np.int64)
    rows, trees = np.arange(len(x))[:, None], np.arange(len(features))[None]
    for _ in range(levels):
        node = 2 * node + 1 + (x[rows, features[trees, node]] > cuts[trees, node])
    return node - (2**levels - 1)


def _scores(x: np.ndarray, features: np.ndarray, cuts: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Sum over the rounds of what each class's trees give."""
    rounds, classes, n_leaves = leaves.shape
    flat = (rounds * classes, features.shape[2])
    at = _places(x, features.reshape(flat), cuts.reshape(flat), n_leaves.bit_length() - 1)
    found = leaves.reshape(-1, n_leaves)[np.arange(rounds * classes)[None], at]
    return found.reshape(len(x), rounds, classes).sum(axis=1)


def feature_cuts(df: DataFrame, vec: str, bins: int) -> list[np.ndarray]:
    """Up to ``bins - 1`` rising values for each position, by quantile sketches."""
    shares = [k / bins for k in range(1, bins)]
    sketched = df.select(F.posexplode(vec)).groupBy("pos").agg(F.percentile_approx("col", shares, 10_000).alias("q"))
    rows = sorted(sketched.collect())
    return [np.unique(np.array(r["q"], np.float64)) for r in rows]


def _packed(df: DataFrame, cuts: list[np.ndarray], classes: int) -> DataFrame:
    """Rows ``vec, label, weight`` as blocks: bins, labels, weights, and scores of zero."""
    shared = df.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(begin, BLOCK_ROWS)
                values, _ = rows_of(some.column(0), len(cuts))
                x = np.column_stack([np.searchsorted(c, values[:, j]) for j, c in enumerate(cuts)]).astype(np.uint8)
                y = some.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
                w = some.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                yield _block(x, y, w, np.zeros((len(y), classes)))

    return df.mapInArrow(run, BLOCKS)


def _block(x: np.ndarray, y: np.ndarray, w: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([len(y)], pa.int32())] + [pa.array([a.tobytes()], pa.binary()) for a in (x, y, w, f)]
    return pa.RecordBatch.from_arrays(columns, names=["n", "x", "y", "w", "f"])


def _opened(row: tuple) -> tuple[np.ndarray, ...]:
    n, x, y, w, f = row
    return (
        np.frombuffer(x, np.uint8).reshape(n, -1), np.frombuffer(y, np.int32), np.frombuffer(w),
        np.frombuffer(f).reshape(n, -1),
    )


def _held(blocks: DataFrame) -> RDD:
    """The blocks in memory.  A round is three small jobs over them, which Spark plans faster
    from plain partitions than as queries."""
    return blocks.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def _with_scores(blocks: DataFrame, recent: tuple) -> DataFrame:
    """The blocks with the scores of the recent trees added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y, w, f = _opened(tuple(row.values()))
                yield _block(x, y, w, f + _scores(x, *recent))

    return blocks.mapInArrow(run, BLOCKS)


def _advanced(row: tuple, trees: tuple) -> tuple:
    """A held block with the scores of some trees added."""
    x, y, w, f = _opened(row)
    return *row[:4], (f + _scores(x, *trees)).tobytes()


def _histograms(rows: Iterator[tuple], level: int, growing: tuple, unit: float, slices: list, bins: int) -> Iterator[tuple]:
    """``(slice, (sums, loss, weight))`` of a task's rows: gradients (G, then H) by class,
    node, feature of the slice and bin, in whole units."""
    held, loss, total = [], 0.0, 0.0
    for row in rows:
        x, y, w, f = _opened(row)
        p = softmax(f)
        mine = np.arange(len(y)), y
        loss -= float((w * np.log(np.maximum(p[mine], 1e-300))).sum())
        total += float(w.sum())
        h = 2.0 * p * (1.0 - p)
        p[mine] -= 1.0
        g, h = (np.rint(v * w[:, None] / unit) for v in (p, h))
        held.append([np.ascontiguousarray(a.T) for a in (x, _places(x, *growing, level) * bins, g, h)])
    for k, (low, high) in enumerate(slices if held else []):
        sums = np.zeros((2, len(held[0][1]), 2**level, high - low, bins))
        for x, node, g, h in held:
            for j in range(low, high):
                # One feature and class at a time: few cells, which stay in the processor's cache.
                bin_of = x[j].astype(np.intp)
                for c in range(len(node)):
                    at = bin_of + node[c]
                    for s, v in enumerate((g, h)):
                        sums[s, c, :, j - low] += np.bincount(at, v[c], 2**level * bins).reshape(-1, bins)
        yield k, (sums.reshape(2, len(held[0][1]), -1).astype(np.int64), loss, total)


def _added(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def _best_splits(k: int, found: tuple, level: int, unit: float, slices: list, bins: int, l2: float, least: float) -> tuple:
    """The best split of every class and node within a slice of features, as columns."""
    (low, high), (sums, loss, weight) = slices[k], found
    sums = sums.reshape(2, -1, high - low, bins) * unit
    g, h = np.cumsum(sums, axis=-1)
    whole_g, whole_h = g[:, :1, -1:], h[:, :1, -1:]
    gain = g * g / (h + l2) + (whole_g - g) ** 2 / (whole_h - h + l2) - whole_g**2 / (whole_h + l2)
    gain[(h < least) | (whole_h - h < least)] = 0.0
    gain = gain.reshape(len(g), -1)
    best = gain.argmax(axis=1)
    rows = np.arange(len(gain))
    pick = [a.reshape(len(g), -1)[rows, best] for a in (gain, g, h)]
    return k, loss, weight, low + best // bins, best % bins, *pick, whole_g.ravel(), whole_h.ravel()


def train_boosted_trees(
    df: DataFrame, vec: str, label: str = "idx", trees: int = 400, depth: int = 3,
    weight: str | None = None, rate: float = 0.3, l2: float = 1.0, least: float = 1.0,
    bins: int = 256, rows_per_bin: int = 3, keep_every: int = 20,
) -> BoostedTrees:
    """``trees`` rounds of one tree per class on vectors ``vec`` with class index ``label``.

    ``least`` is the smallest sum of second derivatives in a child, ``l2`` is added to it in
    a leaf's value, ``rate`` scales the values.  Features are cut into at most ``bins`` bins
    of about ``rows_per_bin`` rows at least; scaling them would change nothing, as only their
    order counts.  Training ends before ``trees`` rounds when no node of any class
    can be split any more.  Rows with a null label, a missing weight or a vector that is not finite are left
    out; vectors of unequal length raise.  Equal gains go to the lowest feature and bin.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins: 2 to 256")
    spark = df.sparkSession
    amount = F.col(weight).cast("double") if weight is not None else F.lit(1.0)
    rows = df.select(F.col(vec).alias("v"), F.col(label).cast("int").alias("y"), amount.alias("w"))
    rows = rows.where(finite("v") & F.col("y").isNotNull() & F.col("w").isNotNull())
    seen = rows.agg(F.max("y").alias("y"), F.max("w").alias("w"), F.count(F.lit(1)).alias("n")).first()
    if not seen["n"]:
        raise ValueError("there are no rows to train on")
    rows = rows.repartition(min(shuffle_width(spark), -(-seen["n"] // BLOCK_ROWS)), F.xxhash64("v", "y", "w"))
    classes, unit = max(2, seen["y"] + 1), max(seen["w"], 1e-300) / UNITS
    inner, ends = 2**depth - 1, 2**depth
    if trees * classes * (2 * inner + ends) > MAX_MODEL:
        raise ValueError("a model of this size is not held by every task")
    bins = min(bins, max(2, seen["n"] // rows_per_bin))
    cuts = feature_cuts(rows, "v", bins)
    part = max(1, SLICE_CELLS // (classes * ends * bins))
    slices = [(a, min(a + part, len(cuts))) for a in range(0, len(cuts), part)]
    features = np.zeros((trees, classes, inner), np.int32)
    steps = np.full((trees, classes, inner), bins, np.int64)  # a bin that no value is above
    leaves = np.zeros((trees, classes, ends))
    losses: list[float] = []
    blocks = durable(_packed(rows, cuts, classes), "blocks")
    held = before = _held(blocks)
    since = 0
    try:
        for r in range(trees):
            if r - since >= keep_every:
                blocks = durable(_with_scores(blocks, (features[since:r], steps[since:r], leaves[since:r])), "blocks")
                held.unpersist()
                held, since = _held(blocks), r
            elif r > since:
                last = (features[r - 1 : r], steps[r - 1 : r], leaves[r - 1 : r])
                before, held = held, held.map(partial(_advanced, trees=last)).persist(StorageLevel.MEMORY_AND_DISK)
            for level in range(depth):
                add = partial(_histograms, level=level, growing=(features[r], steps[r]), unit=unit, slices=slices, bins=bins)
                pick = partial(_best_splits, level=level, unit=unit, slices=slices, bins=bins, l2=l2, least=least)
                sums = held.mapPartitions(add)
                if held.getNumPartitions() > 1:
                    sums = sums.reduceByKey(_added, min(len(slices), shuffle_width(spark)))
                found = sorted(sums.map(lambda kv, pick=pick: pick(*kv)).collect(), key=lambda s: s[0])
                if level == 0:
                    losses.append(found[0][1] / found[0][2])
                    if before is not held:
                        before.unpersist()
                if not _grow(found, level, depth, features[r], steps[r], leaves[r], rate, l2):
                    break
            if level == 0 and depth > 0 and (steps[r] == bins).all():
                features, steps, leaves = features[:r], steps[:r], leaves[:r]
                break
    finally:
        held.unpersist()
        before.unpersist()
    thresholds = np.full(steps.shape, np.inf)
    for j, c in enumerate(cuts):
        mine = (features == j) & (steps < bins)
        thresholds[mine] = np.append(c, np.inf)[steps[mine]]
    return BoostedTrees(vec, features, thresholds, leaves, losses)


def _grow(found: list[tuple], level: int, depth: int, features: np.ndarray, steps: np.ndarray, leaves: np.ndarray, rate: float, l2: float) -> bool:
    """Enter a level's splits of all classes, and the values of the children as leaves;
    whether there are any.

    A node that is not split passes all its rows left, so its value is that of the leftmost
    leaf below it.
    """
    width, below = 2**level, 2 ** (depth - level)
    columns = [np.stack(c) for c in zip(*[s[3:] for s in found])]
    nodes = np.arange(columns[0].shape[1])
    feature, step, gain, g, h, whole_g, whole_h = (c[columns[2].argmax(axis=0), nodes] for c in columns)
    c, node = np.divmod(nodes, width)

    def value(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return -rate * g / (h + l2)

    if level == 0:
        leaves[:, 0] = value(whole_g, whole_h)
    split = gain > 1e-9
    c, node = c[split], node[split]
    features[c, width - 1 + node], steps[c, width - 1 + node] = feature[split], step[split]
    leaves[c, node * below] = value(g, h)[split]
    leaves[c, node * below + below // 2] = value(whole_g - g, whole_h - h)[split]
    return bool(split.any())
