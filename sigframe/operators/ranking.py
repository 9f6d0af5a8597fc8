"""Exact positions in sorted order, without putting a whole group in one task.

``row_number()`` over a hot key sorts that key in a single task.  Here a group is
first cut into slices of its order column; rows are numbered inside the small
(group, slice) windows, and the sizes of earlier slices are added.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.runtime import durable, shuffle_width


NUMBERS = (
    "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz",
)


def order_number(df: DataFrame, column: str) -> Column:
    """The column as a double that never decreases where the column does not."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    zero = F.lit(0.0)  # added so that negative zero gets the same number as zero
    if kind == "timestamp_ntz":
        # Built from its fields: a cast would pass through a time zone with gaps.
        seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c)
        return F.unix_date(c.cast("date")).cast("double") * 86400 + seconds.cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    return c.cast("double") + zero


def cut_points(df: DataFrame, column: str, slices: int) -> tuple[list[float], list[float], bool]:
    """Increasing values that split ``column`` evenly, those of them that many rows
    share, and whether there are nulls."""
    shares = [i / slices for i in range(1, slices)] or [0.5]
    number = order_number(df, column)
    row = df.agg(
        F.percentile_approx(number, shares, max(10_000, 10 * slices)).alias("q"),
        F.count_if(number.isNull()).alias("nulls"),
    ).first()
    found = Counter(v for v in row["q"] or [] if math.isfinite(v))
    # A value that is several quantiles; only where the number stands for the value.
    kind = dict(df.dtypes)[column]
    exact = 2.0**53 if kind == "bigint" else 0.0 if kind.startswith("decimal") else float("inf")
    crowded = [v for v, n in found.items() if n > 1 and abs(v) < exact]
    return sorted(found) if slices > 1 else [], crowded, row["nulls"] > 0


def _bucket(df: DataFrame, column: str, cuts: list[float], out: str) -> DataFrame:
    """Add the number of the interval between cuts; nulls sort first and get -1."""
    keyed = df.withColumn("_number", order_number(df, column))
    place = F.lit(0.0)
    if cuts:
        bucketizer = Bucketizer(
            splits=[-float("inf"), *cuts, float("inf")],
            inputCol="_number", outputCol="_place", handleInvalid="keep",
        )
        keyed, place = bucketizer.transform(keyed), F.col("_place")
    number = F.when(F.col("_number").isNull(), -1).otherwise(place.cast("int"))
    return keyed.withColumn(out, number).drop("_number", "_place")


def _with_slice(df: DataFrame, order: list[str], slices: int) -> DataFrame:
    """Add ``_slice`` and ``_sub``, which together do not decrease along ``order``.

    Rows that share a crowded value of ``order[0]``, or its null, get a slice of
    their own, which ``order[1]`` cuts further.
    """
    cuts, crowded, nulls = cut_points(df, order[0], slices)
    tied = F.coalesce(order_number(df, order[0]).isin(crowded), F.lit(True))
    sliced = _bucket(df, order[0], cuts, "_slice")
    # A crowded value is the lower end of its interval, so its rows come first there.
    place = 2 * F.col("_slice") + F.when(tied, 0).otherwise(1)
    sliced = sliced.withColumn("_slice", F.when(F.col("_slice") < 0, -1).otherwise(place))
    if len(order) < 2 or not (crowded or nulls) or dict(df.dtypes)[order[1]] not in NUMBERS:
        return sliced.withColumn("_sub", F.lit(0))
    inner, _, _ = cut_points(df, order[1], slices)
    sliced = _bucket(sliced, order[1], inner, "_sub")
    return sliced.withColumn("_sub", F.when(tied, F.col("_sub")).otherwise(0))


def group_rank(
    df: DataFrame,
    by: list[str],
    order: list[str],
    out: str = "pos",
    size: str | None = None,
    slice_of: Column | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its group, ascending by ``order``.

    ``order[0]`` must be numeric, a date or a timestamp, further columns break ties; the
    whole list must identify a row of the group for the result to be
    deterministic.  ``size`` names an optional column with the group's row
    count.  ``slice_of`` gives an integer that does not decrease along
    ``order[0]`` and saves the pass that finds cut points.
    """
    if slice_of is not None:
        sliced = df.withColumn("_slice", slice_of).withColumn("_sub", F.lit(0))
    else:
        if slices is None:
            slices = 4 * shuffle_width(df.sparkSession)
        sliced = _with_slice(df, order, slices)
    # One struct key: null group values compare equal inside it, and the window, the
    # counts and the join all share its partitioning, so rows are shuffled once.
    names = [f"k{i}" for i in range(len(by))]
    groups = [F.col(c).alias(n) for c, n in zip(by, names)]
    key = F.struct(*groups, F.col("_slice").alias("slice"), F.col("_sub").alias("sub"))
    keyed = sliced.withColumn("_key", key).drop("_slice", "_sub")
    sizes = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*[F.col(f"_key.{n}") for n in names])
    earlier = group.orderBy("_key.slice", "_key.sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_key").alias("_of"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_total"),
    )
    local = Window.partitionBy("_key").orderBy(*order)
    numbered = keyed.withColumn("_local", F.row_number().over(local) - 1)
    ranked = numbered.join(offsets, F.col("_key") == F.col("_of"))
    ranked = ranked.withColumn(out, F.col("_local") + F.col("_before"))
    if size is not None:
        ranked = ranked.withColumn(size, F.col("_total"))
    return ranked.drop("_key", "_of", "_local", "_before", "_total")


def global_rank(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in the order of the whole table.

    One range shuffle sorts the table; row ids inside each sorted run are written
    to a durable table, so a retried task cannot renumber them.  What is
    broadcast holds one row per run, that is per shuffle partition.
    """
    runs = shuffle_width(df.sparkSession)
    # Rows equal in ``order`` are told apart by a hash, and copies of one row by the
    # task they come from, so that many of them still spread over several runs.
    plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    told = df.withColumn("_hash", F.xxhash64(*plain)).withColumn("_from", F.spark_partition_id())
    keys = [*order, "_hash", "_from"]
    placed = durable(
        told.repartitionByRange(runs, *keys)
        .sortWithinPartitions(*keys)
        .drop("_hash", "_from")
        .withColumn("_row_id", F.monotonically_increasing_id()),
        "ranked",
    )
    run = F.shiftright("_row_id", 33)
    # Row ids restart at run * 2^33, so a row's offset in its run is the id minus that.
    sizes = placed.groupBy(run.alias("_run")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_run"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        placed.withColumn("_run", run)
        .join(F.broadcast(starts), "_run")
        .withColumn(out, F.col("_row_id") - F.shiftleft(F.col("_run"), 33) + F.col("_before"))
        .drop("_row_id", "_run", "_before")
    )


def spread_key(column: str, seed: int) -> Column:
    """Integer in [0, 2^32) from a hash of the id and the seed; seeds are independent."""
    digest = F.md5(F.concat_ws(":", F.col(column).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def spread_slice(df: DataFrame, key: str) -> Column:
    """Slice of a key from :func:`spread_key`, not decreasing along the key.

    There are 16 slices per shuffle partition, so a group of a third of all rows
    has windows of a small part of a partition.
    """
    slices = max(1024, 16 * shuffle_width(df.sparkSession))
    return F.floor(F.col(key) * slices / F.lit(4294967296)).cast("int")
