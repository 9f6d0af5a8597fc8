"""Joins.  No side is hinted: Spark broadcasts one only after a check of its
size and otherwise shuffles, where adaptive execution splits hot keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.functions.arrays import time_bucket
from sigframe.functions.kernels import nearest_udf
from sigframe.operators.ranking import global_rank
from sigframe.runtime import join_null_safe

# Bytes of a codebook that are broadcast together.
BLOCK_BYTES = 1 << 28


def join_cluster_labels(
    df: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("file", "start_time")
) -> DataFrame:
    """Attach cluster labels by clip key."""
    return df.join(labels, list(keys), "inner")


def join_dimension(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Inner join to a dimension under another key name; rows without a match drop out."""
    return df.join(dim.withColumnRenamed(dim_key, key), key, "inner")


def lookup_map(
    df: DataFrame, key: str, mapping: DataFrame, out: str = "idx", strict: bool = True
) -> DataFrame:
    """Add the code of ``key`` from ``mapping(key, out)``; ``strict`` raises on a miss."""
    found = df.join(mapping.select(key, out), key, "left")
    if not strict:
        return found
    shown = F.coalesce(F.col(key).cast("string"), F.lit("a null key"))
    failure = F.raise_error(F.concat(F.lit("no code for "), shown))
    code = F.when(F.col(out).isNull(), failure.cast(mapping.schema[out].dataType))
    return found.withColumn(out, code.otherwise(F.col(out)))


def lookup_word_vector(
    df: DataFrame, vectors: DataFrame, token: str = "token", vector: str = "word_vector"
) -> DataFrame:
    """Add the vector of each token; unknown tokens get null."""
    return df.join(vectors.select(token, vector), token, "left")


def first_clip_per_file(
    df: DataFrame, file: str = "file", order: str = "start_time"
) -> DataFrame:
    """The earliest clip row of every file; of clips that start together the one whose
    other columns are smallest.

    An aggregate rather than a window: every task sends one row per file.
    """
    rest = [c for c in df.columns if c != file]
    ranked = F.struct(F.col(order).alias("_order"), *rest)
    first = F.min(F.when(F.col(order).isNotNull(), ranked)).alias("_first")
    found = df.groupBy(file).agg(first).where("_first IS NOT NULL")
    return found.select(file, "_first.*").select(*df.columns)


def with_first_vector(
    df: DataFrame,
    file: str = "file",
    order: str = "start_time",
    vec: str = "embedding",
    out: str = "first_vector",
) -> DataFrame:
    """Every clip with the vector of its file's first clip."""
    first = first_clip_per_file(df.select(file, order, vec), file, order)
    return join_null_safe(df, first.select(file, F.col(vec).alias(out)), [file], "left")


def positional_join(
    left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str],
    pos: str = "pos",
) -> DataFrame:
    """Rows at the same place of two sorted tables, side by side; the longer one is cut."""
    return global_rank(left, left_order, pos).join(global_rank(right, right_order, pos), pos)


def missing_classes(have: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``expected`` that ``have`` lacks."""
    return expected.select(key).distinct().join(have.select(key).distinct(), key, "left_anti")


def time_bucket_join(
    frames: DataFrame,
    clips: DataFrame,
    file: str = "file",
    t: str = "timestamp",
    clip_start: str = "start_time",
    seconds: int = 5,
) -> DataFrame:
    """Frames with the clip of the same file whose bucket they fall into.

    Both sides are cut to the integer bucket edge, so the join is an equi-join on
    (file, bucket).  Rows without a valid time have no bucket and drop out.
    """
    edge = f"{clip_start}"
    left = frames.withColumn(edge, time_bucket(t, seconds, None)).where(F.col(edge) >= 0)
    right = clips.withColumn(edge, time_bucket(clip_start, seconds, None)).where(F.col(edge) >= 0)
    return left.join(right, [file, edge], "inner")


def _matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["token"] for r in rows]), np.array([r["centroid"] for r in rows])


def nearest_centroid(
    df: DataFrame,
    vec: str,
    codebook: DataFrame,
    out: str = "token",
    distance: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add the token of the nearest centroid by Euclidean distance, lowest on ties.

    ``codebook`` has columns ``token`` and ``centroid``.  It is cut into blocks of about
    ``block_bytes`` by a hash of the token; every block is broadcast, and all are searched
    in the same pass over the rows, which are neither shuffled nor written.  Null vectors
    and those with a null or non-finite element get a null token.  ``distance`` names an
    optional column with the squared distance.
    """
    spark = df.sparkSession
    book = codebook.select("token", "centroid")
    size = book.agg(F.sum(8 * (F.size("centroid") + 1))).first()[0]
    if not size:
        raise ValueError("the codebook is empty")
    blocks = -(-size // block_bytes)
    part = F.pmod(F.xxhash64("token"), F.lit(blocks))
    hits = []
    for k in range(blocks):
        rows = book.where(part == k).orderBy("token").collect()
        if rows:
            hits.append(nearest_udf(spark, *_matrix(rows))(F.col(vec)))
    # Structs compare by distance, then by token; a null hit is skipped.
    best = hits[0] if len(hits) == 1 else F.least(*hits)
    found = df.withColumn("_hit", best).withColumn(out, F.col("_hit.token"))
    if distance is not None:
        found = found.withColumn(distance, F.col("_hit.distance"))
    return found.drop("_hit")
