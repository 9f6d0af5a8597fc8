"""Matrix profile: nearest neighbour of every subsequence of a series.

A series is cut into blocks of consecutive subsequences.  Each block is first
searched against itself, which bounds the distances still of interest.  Two blocks
are compared only if the boxes around their subsequences' sketches are close
enough to improve on those bounds; the skipped pairs cannot change the result.
A comparison returns one best row per subsequence, never the pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.operators.ranking import group_rank
from sigframe.runtime import durable, join_null_safe, shuffle_width

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Blocks searched before their rows are handed back.
GROUP = 256


def normalized(values: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Z-normalised subsequences as rows, which of them are constant, and which hold a
    null or another value that is not finite."""
    usable = np.isfinite(values)
    bad = ~np.lib.stride_tricks.sliding_window_view(usable, m).all(axis=1)
    windows = np.lib.stride_tricks.sliding_window_view(np.where(usable, values, 0.0), m)
    centred = windows - windows.mean(axis=1, keepdims=True)
    std = np.sqrt((centred * centred).mean(axis=1))
    flat = windows.max(axis=1) == windows.min(axis=1)
    return np.where(flat[:, None], 0.0, centred / np.where(flat, 1.0, std)[:, None]), flat, bad


def sketch(rows: np.ndarray, segments: int) -> np.ndarray:
    """Scaled segment means; distances between sketches never exceed the true ones."""
    width = rows.shape[1] // segments
    head = rows[:, : width * segments].reshape(len(rows), segments, width)
    return head.mean(axis=2) * np.sqrt(width)


def best_matches(
    a: np.ndarray, a_flat: np.ndarray, a_bad: np.ndarray, a_start: int,
    b: np.ndarray, b_flat: np.ndarray, b_bad: np.ndarray, b_start: int, zone: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest squared distance and partner for the rows of ``a`` and those of ``b``."""
    m = a.shape[1]
    square = np.maximum(2.0 * m - 2.0 * (a @ b.T), 0.0)
    # A constant subsequence is at distance 0 from a constant one and sqrt(m) from others.
    square[a_flat] = np.where(b_flat, 0.0, float(m))
    square[:, b_flat] = np.where(a_flat, 0.0, float(m))[:, None]
    square[a_bad], square[:, b_bad] = np.inf, np.inf
    apart = np.abs(
        (a_start + np.arange(len(a)))[:, None] - (b_start + np.arange(len(b)))[None, :]
    )
    square[apart <= zone] = np.inf
    return square.min(axis=1), square.argmin(axis=1), square.min(axis=0), square.argmin(axis=0)


def _box_gap(a_low: str, a_high: str, b_low: str, b_high: str) -> Column:
    """Squared gap between two axis-parallel boxes given by corner arrays."""
    above = F.zip_with(F.col(b_low), F.col(a_high), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    below = F.zip_with(F.col(a_low), F.col(b_high), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    sides = F.zip_with(above, below, lambda x, y: F.greatest(x, y))
    return F.aggregate(sides, F.lit(0.0), lambda acc, x: acc + x * x)


def matrix_profile(
    df: DataFrame, by: list[str], order: list[str], value: str, m: int, block: int = 1024
) -> DataFrame:
    """Distance to and position of the nearest z-normalised subsequence of length ``m``.

    Output: ``by..., pos, distance, neighbor``, one row per subsequence; matches at
    most ``ceil(m / 4)`` positions away are trivial and excluded, and a subsequence
    with no other match, or with a value that is null or not finite, has nulls.  Ties go to the lowest position.
    """
    if m < 3:
        raise ValueError("subsequences need at least three values")
    zone = -(-m // 4)
    segments = min(8, m)
    block = max(block, m)
    ranked = group_rank(df.select(*by, *order, value), by, order, "_pos")
    own = F.floor(F.col("_pos") / block).cast("bigint")
    # A block also holds the first m - 1 values of the next one.
    # A stated number of partitions keeps adaptive execution from packing the blocks,
    # which are few bytes but much work, into few tasks.
    width = shuffle_width(df.sparkSession)
    homes = F.filter(
        F.array(own - 1, own), lambda b: (b >= 0) & (F.col("_pos") < (b + 1) * block + m - 1)
    )
    cast_value = F.col(value).cast("double").alias("v")
    blocks = (
        ranked.withColumn("_block", F.explode(homes))
        .repartition(width, *by, "_block")
        .groupBy(*by, "_block")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", cast_value))).alias("_items"))
        .select(*by, "_block", F.col("_items.v").alias("_values"))
        .where(F.size("_values") >= m)
    )

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices = (b.iloc[i : i + GROUP] for b in batches for i in range(0, len(b), GROUP))
        for some in slices:
            out = []
            for number, values in zip(some["_block"], some["_values"]):
                rows, flat, bad = normalized(np.asarray(values, dtype=np.float64), m)
                start = number * block
                best, at, _, _ = best_matches(rows, flat, bad, start, rows, flat, bad, start, zone)
                marks = sketch(rows[~bad], segments)
                # Constant subsequences have a fixed distance no sketch bounds.
                open_box = (flat & ~bad).any() or bad.all()
                low = np.full(segments, -1e300) if open_box else marks.min(axis=0)
                high = np.full(segments, 1e300) if open_box else marks.max(axis=0)
                bound = float(best[~bad].max(initial=-1.0))
                out.append((low, high, bound, best, start + at))
            names = ["_low", "_high", "_bound", "_best", "_at"]
            yield some.assign(**{c: [o[i] for o in out] for i, c in enumerate(names)})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    searched = durable(
        blocks.mapInPandas(
            within,
            f"{kept}, _low array<double>, _high array<double>, _bound double,"
            " _best array<double>, _at array<bigint>",
        ),
        "profile",
    )

    # Box pairs are tested on the small box rows, a series being dealt to all tasks.
    boxes = searched.select(*by, "_block", "_low", "_high", "_bound")
    left = boxes.select(
        *by,
        *[F.col(c).alias(f"_a{c}") for c in ("_block", "_low", "_high", "_bound")],
        F.pmod("_block", F.lit(width)).alias("_salt"),
    )
    lanes = F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))
    right = boxes.withColumn("_salt", F.explode(lanes))
    # Rounding slack keeps pairs whose gap equals the bound.
    promising = _box_gap("_a_low", "_a_high", "_low", "_high") <= (
        F.greatest("_a_bound", "_bound") * (1 + 1e-9) + 1e-9
    )
    pairs = (
        join_null_safe(left, right, [*by, "_salt"])
        .where((F.col("_a_block") < F.col("_block")) & promising)
        .select(*by, "_a_block", "_block")
        .repartition(width, *by, "_a_block", "_block")
    )
    values = searched.select(*by, "_block", "_values")
    firsts = values.withColumnsRenamed({"_block": "_a_block", "_values": "_a_values"})
    tiles = join_null_safe(
        join_null_safe(pairs, firsts, [*by, "_a_block"]), values, [*by, "_block"]
    )

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices = (b.iloc[i : i + GROUP] for b in batches for i in range(0, len(b), GROUP))
        for some in slices:
            ends = []
            for i, j, left_values, right_values in zip(
                some["_a_block"], some["_block"], some["_a_values"], some["_values"]
            ):
                a, a_flat, a_bad = normalized(np.asarray(left_values, dtype=np.float64), m)
                b, b_flat, b_bad = normalized(np.asarray(right_values, dtype=np.float64), m)
                down, down_at, up, up_at = best_matches(
                    a, a_flat, a_bad, i * block, b, b_flat, b_bad, j * block, zone
                )
                ends.append((i, down, j * block + down_at, j, up, i * block + up_at))
            for side in (ends_of(ends, 0), ends_of(ends, 3)):
                yield some[by].assign(**side)

    def ends_of(ends: list[tuple], first: int) -> dict[str, list]:
        return {c: [e[first + k] for e in ends] for k, c in enumerate(("_block", "_best", "_at"))}

    key_schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    key_schema = f"{key_schema}, " if by else ""
    other = tiles.mapInPandas(
        across, f"{key_schema}_block bigint, _best array<double>, _at array<bigint>"
    )
    found = searched.select(*by, "_block", "_best", "_at").unionByName(other)
    hits = found.select(
        *by, "_block", F.posexplode(F.arrays_zip("_best", "_at")).alias("_i", "_hit")
    ).select(
        *by,
        (F.col("_block") * block + F.col("_i")).alias("pos"),
        F.struct(F.col("_hit._best").alias("d"), F.col("_hit._at").alias("at")).alias("_hit"),
    )
    best = hits.groupBy(*by, "pos").agg(F.min("_hit").alias("_hit"))
    real = F.col("_hit.d") < F.lit(float("inf"))
    return best.select(
        *by,
        "pos",
        F.when(real, F.sqrt("_hit.d")).alias("distance"),
        F.when(real, F.col("_hit.at")).alias("neighbor"),
    )
