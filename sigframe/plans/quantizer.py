"""K-means tokenizers over frame vectors, with or without a rotation first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.functions.kernels import ORDERED_BOOK, added, cluster_sums, leaves_of, near_cuts, near_place_udf, ordered_blocks, rows_of
from sigframe.operators.joins import nearest_centroid
from sigframe.operators.vectors import rotate
from sigframe.runtime import dealt, shuffle_width

CODEBOOK_SCHEMA = "token bigint, centroid array<double>"
#: Cells of a slice of the centroids that tasks' sums are added by.
SLICE_CELLS = 1 << 15


@dataclass
class Tokenizer:
    """A codebook ``(token, centroid)`` and the rotation applied before it, if any."""

    codebook: DataFrame
    rotation: PipelineModel | None = None

    def save(self, path: str) -> None:
        self.codebook.write.mode("overwrite").parquet(f"{path}/codebook")
        if self.rotation is not None:
            self.rotation.write().overwrite().save(f"{path}/rotation")

    @staticmethod
    def load(spark: SparkSession, path: str, rotated: bool = False) -> Tokenizer:
        codebook = spark.read.schema(CODEBOOK_SCHEMA).parquet(f"{path}/codebook")
        return Tokenizer(codebook, PipelineModel.load(f"{path}/rotation") if rotated else None)


def _features(df: DataFrame, vec: str) -> DataFrame:
    return df.where(finite(vec)).select(
        "*", array_to_vector(F.col(vec)).alias("_features")
    )


def finite(vec: str) -> Column:
    """Whether there is a vector without null, NaN and infinite elements."""
    usable = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(usable, F.lit(False))


def unusable_vectors(df: DataFrame, vec: str) -> DataFrame:
    """``n_rows``, and ``n_unusable`` of them that training leaves out."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(~finite(vec)).alias("n_unusable"))


def _seeds(train: DataFrame, vec: str, k: int, seed: int) -> np.ndarray:
    """``k`` different vectors that lie apart, drawn from ``2 k + 256`` of smallest hash.

    Copies of a vector count once.  Each next one is the end of a chain of draws that
    prefers vectors far from those taken (k-means++ by Markov chains), so the cost is
    ``2 k**2`` distances on the driver, which holds the pool.
    """
    pool = 2 * k + 256
    keyed = train.select(F.xxhash64(vec, F.lit(seed)).alias("h"), vec)
    rows = train.count()
    # About 4 times the pool lies below the bound, unless there are many copies.
    bound = -(2.0**63) + 2.0**64 * min(1.0, 4.0 * pool / max(1, rows))
    for some in (keyed.where(F.col("h").cast("double") < bound), keyed):
        found = some.groupBy("h").agg(F.first(vec).alias("v")).orderBy("h").limit(pool).collect()
        if len(found) == pool:
            break
    if not found:
        raise ValueError("there are no vectors to cluster")
    return _apart(np.array([r["v"] for r in found], dtype=np.float64), k, seed)


def _apart(pool: np.ndarray, k: int, seed: int, chain: int = 32) -> np.ndarray:
    """``k`` rows of the pool, or all of fewer."""
    if len(pool) <= k:
        return pool
    draw = np.random.default_rng(seed)
    squares = (pool * pool).sum(axis=1)
    lifted = np.vstack([-2 * pool.T, squares, np.ones(len(pool))])
    near = np.full(len(pool), np.inf)  # squared distance to the nearest one taken
    left = draw.permutation(len(pool)).tolist()
    taken = [left.pop()]
    while len(taken) < k:
        new = taken[-1]
        np.minimum(near, np.array([*pool[new], 1.0, squares[new]]) @ lifted, out=near)
        places = draw.integers(0, len(left), chain)
        options = [left[p] for p in places]
        at = 0
        for other, chance in enumerate(draw.random(chain)):
            if max(near[options[other]], 0.0) > chance * max(near[options[at]], 0.0):
                at = other
        place = places[at]
        taken.append(options[at])
        left[place] = left[-1]
        left.pop()
    return pool[taken]


def fit_kmeans(
    df: DataFrame, vec: str, k: int, iters: int = 25, seed: int = 42
) -> tuple[np.ndarray, float]:
    """Centroids and cost of k-means by Lloyd's algorithm, also for thousands of clusters.

    Each round is one job: tasks assign their rows by matrix products and add up
    their clusters, a shuffle by slices of centroids adds the tasks' sums, and the driver
    gets one vector per centroid.  Rows are held as blocks in which neighbours lie together,
    so a run of rows is compared with the centroids around it only; the result is that of
    comparing all.  Vectors that are not :func:`finite` are left out.  A cluster left empty
    restarts beside the largest one.  With fewer than ``k`` different vectors there are as
    many centroids as vectors.
    """
    spark = df.sparkSession
    train = dealt(df.where(finite(vec)).select(vec), vec).persist()
    blocks = None
    cost = float("inf")
    try:
        centroids = _seeds(train, vec, k, seed)
        blocks = _blocks(train, vec, centroids)
        per = sum(blocks.map(len).collect()) / len(centroids)
        train.unpersist()
        for _ in range(iters):
            leaves = leaves_of(centroids, ORDERED_BOOK)
            shared = spark.sparkContext.broadcast((centroids, leaves))
            parts = blocks.mapPartitions(partial(cluster_sums, shared=shared, cells=SLICE_CELLS, per=per))
            slices = -(-centroids.size // SLICE_CELLS)
            found = parts.reduceByKey(added, min(slices, shuffle_width(spark))).collect()
            shared.destroy()
            sizes = np.zeros(len(centroids), dtype=np.int64)
            moved = centroids.copy()
            for at, (n, sums, _) in found:
                begin = at * max(1, SLICE_CELLS // centroids.shape[1])
                used = begin + np.flatnonzero(n)
                sizes[used], moved[used] = n[n > 0], sums[n > 0] / n[n > 0, None]
            cost = sum(c for _, (_, _, c) in sorted(found, key=lambda f: f[0]))
            for empty in np.flatnonzero(sizes == 0):
                largest = sizes.argmax()
                nudge = 1e-3 * (np.abs(moved[largest]) + 1e-6)
                moved[empty], moved[largest] = moved[largest] + nudge, moved[largest] - nudge
                sizes[empty] = sizes[largest] // 2
                sizes[largest] -= sizes[empty]
            if np.array_equal(moved, centroids):
                break
            centroids = moved
    finally:
        train.unpersist()
        if blocks is not None:
            blocks.unpersist()
    return centroids, cost


def _blocks(train: DataFrame, vec: str, seeds: np.ndarray) -> RDD:
    """The vectors as matrices whose neighbouring rows lie together, held for all rounds.

    The rows of a task lie together too, in parts of the space that the seeds give; Spark cuts
    their order into equal ranges, whatever a part holds.
    """
    k, width = seeds.shape
    if leaves_of(seeds, ORDERED_BOOK) is not None:
        cuts = near_cuts(seeds, min(10, (k // 8).bit_length() - 1))
        place = near_place_udf(train.sparkSession, cuts)(F.col(vec))
        placed = train.select(vec, place.alias("_place"), F.xxhash64(vec).alias("_mixed"))
        train = placed.repartitionByRange(shuffle_width(train.sparkSession), "_place", "_mixed").select(vec)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _ = rows_of(batch.column(0), width)
            yield pa.RecordBatch.from_pydict({"x": [rows.tobytes()]})

    def opened(part: Iterator) -> Iterator[np.ndarray]:
        return ordered_blocks(np.frombuffer(r["x"]).reshape(-1, width) for r in part)

    return train.mapInArrow(packed, "x binary").rdd.mapPartitions(opened).persist(StorageLevel.MEMORY_AND_DISK)


def codebook_of(spark: SparkSession, centroids: Iterable[np.ndarray]) -> DataFrame:
    """Centroids as a table; they are k x d values, which the driver holds anyway."""
    rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
    return spark.createDataFrame(rows, CODEBOOK_SCHEMA)


def _centroids(
    df: DataFrame, vec: str, k: int, iters: int, seed: int, restarts: int
) -> np.ndarray:
    """The centroids of lowest training cost over ``restarts`` seeds."""
    fits = [fit_kmeans(df, vec, k, iters, seed + i) for i in range(restarts)]
    return min(fits, key=lambda fit: fit[1])[0]


def build_tokenizer(
    df: DataFrame, vec: str, k: int = 16383, iters: int = 25, seed: int = 42, restarts: int = 1
) -> Tokenizer:
    """K-means codebook."""
    return Tokenizer(codebook_of(df.sparkSession, _centroids(df, vec, k, iters, seed, restarts)))


def fit_rotation(df: DataFrame, vec: str, k: int | None = None) -> PipelineModel:
    """Centring followed by a projection on the ``k`` leading (by default all) components."""
    train = _features(df, vec)
    width = k or len(train.select("_features").first()[0])
    centre = StandardScaler(
        withMean=True, withStd=False, inputCol="_features", outputCol="_centred"
    )
    pca = PCA(k=width, inputCol="_centred", outputCol="_rotated")
    return Pipeline(stages=[centre, pca]).fit(train)


def build_pca_tokenizer(
    df: DataFrame, vec: str, k: int = 16383, iters: int = 25, seed: int = 42, restarts: int = 1
) -> Tokenizer:
    """:func:`build_tokenizer` on rotated vectors."""
    rotation = fit_rotation(df, vec)
    turned = rotate(df, vec, rotation, "_turned")
    centroids = _centroids(turned, "_turned", k, iters, seed, restarts)
    return Tokenizer(codebook_of(df.sparkSession, centroids), rotation)


def tokenize(
    df: DataFrame, tokenizer: Tokenizer, vec: str = "mfcc", out: str = "token",
    distance: str | None = None,
) -> DataFrame:
    """Add the nearest token of every frame, after the tokenizer's rotation."""
    if tokenizer.rotation is None:
        return nearest_centroid(df, vec, tokenizer.codebook, out, distance)
    turned = rotate(df, vec, tokenizer.rotation, "_turned")
    return nearest_centroid(turned, "_turned", tokenizer.codebook, out, distance).drop("_turned")


def cluster_embeddings(
    df: DataFrame, vec: str, k: int = 5, seed: int = 0, out: str = "cluster"
) -> DataFrame:
    """Add a k-means cluster number to every row that has a vector."""
    centroids, _ = fit_kmeans(df, vec, k, seed=seed)
    book = codebook_of(df.sparkSession, centroids)
    found = nearest_centroid(df.where(F.col(vec).isNotNull()), vec, book, out)
    return found.withColumn(out, F.col(out).cast("int"))
