"""Filters by class size, hash samples, part numbers, splits and sample sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.constants import Z_SCORES
from sigframe.functions.paths import has_letter
from sigframe.operators.ranking import global_rank, group_rank, spread_key, spread_slice
from sigframe.runtime import join_null_safe


def filter_rare_classes(df: DataFrame, label: str, min_count: int = 2) -> DataFrame:
    """Rows of classes that have at least ``min_count`` rows."""
    common = df.groupBy(label).count().where(F.col("count") >= min_count)
    return df.join(common, label, "left_semi")


def subset_classes(
    df: DataFrame, label: str, n: int = 10, letters_only: bool = True
) -> DataFrame:
    """Rows of the first ``n`` classes by name, by default only names with a letter."""
    names = df.select(label).distinct()
    if letters_only:
        names = names.where(has_letter(label))
    return df.join(names.orderBy(label).limit(n), label, "left_semi")


def hash_sample(df: DataFrame, key: str, m: int = 10, r: int = 0) -> DataFrame:
    """Rows whose key has CRC-32 equal to ``r`` modulo ``m``; equal keys stay together."""
    return df.where(F.crc32(F.col(key).cast("string").cast("binary")) % m == r)


def assign_round_robin(
    df: DataFrame, order: list[str], n: int, out: str = "part"
) -> DataFrame:
    """The i-th row in sorted order gets part ``i % n``."""
    return global_rank(df, order, "_pos").withColumn(out, F.col("_pos") % n).drop("_pos")


def limit_parts(df: DataFrame, n: int, part: str = "part") -> DataFrame:
    """Rows of the first ``n`` parts; ``n <= 0`` keeps all."""
    return df.where(F.col(part) < n) if n > 0 else df


def limit_files(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first ``n`` rows in sorted order, found by position; None keeps all.

    A limit would bring a long list into one task.
    """
    if n is None:
        return df
    found = global_rank(df, order, "_pos").where(F.col("_pos") < n)
    return found.orderBy("_pos").drop("_pos")


def train_holdout_by_part(
    df: DataFrame, lt: int = 80, part: str = "part"
) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(part) < lt), df.where(F.col(part) >= lt)


def _spread(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Add ``_spread``, a pseudo-random order key in [0, 2^32) that depends on the id only."""
    return df.withColumn("_spread", spread_key(id_col, seed))


def with_test_flag(
    df: DataFrame,
    label: str,
    id_col: str,
    frac: float = 0.2,
    seed: int = 42,
    group: str | None = None,
    out: str = "is_test",
) -> DataFrame:
    """Mark a share ``frac`` of every class as test rows.

    A class of n rows gives ``round(frac * n)`` test rows, but at least one and at
    most n - 1; a class of one row stays in training.  With ``group`` whole groups
    of a class move together and are what is counted.
    """
    units = df if group is None else df.select(label, group).distinct()
    unit_id = id_col if group is None else group
    spread = _spread(units, unit_id, seed)
    ranked = group_rank(
        spread,
        [label],
        ["_spread", unit_id],
        out="_pos",
        size="_n",
        slice_of=spread_slice(spread, "_spread"),
    )
    wanted = F.greatest(F.lit(1), F.floor(F.col("_n") * frac + 0.5))
    flag = F.col("_pos") < F.least(wanted, F.col("_n") - 1)
    flagged = ranked.withColumn(out, flag).drop("_spread", "_pos", "_n")
    return flagged if group is None else join_null_safe(df, flagged, [label, group])


def stratified_split(
    df: DataFrame,
    label: str,
    id_col: str,
    frac: float = 0.2,
    seed: int = 42,
    group: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` with the same class shares, see :func:`with_test_flag`."""
    flagged = with_test_flag(df, label, id_col, frac, seed, group)
    return flagged.where(~F.col("is_test")).drop("is_test"), flagged.where("is_test").drop(
        "is_test"
    )


def stratified_folds(
    df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Add a fold number 0..k-1; within a class fold sizes differ by at most one."""
    spread = _spread(df, id_col, seed)
    ranked = group_rank(
        spread, [label], ["_spread", id_col], "_pos", slice_of=spread_slice(spread, "_spread")
    )
    return ranked.withColumn(out, (F.col("_pos") % k).cast("int")).drop("_spread", "_pos")


def shuffle_rows(df: DataFrame, seed: int) -> DataFrame:
    """Rows in an order that depends on their content and the seed only.

    A hash takes the place of random numbers, which a retried task would draw anew.
    """
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed)))


def needed_sample(population: Column, confidence: int = 95, interval: float = 2.0) -> Column:
    """Cochran's sample size at p = 0.5 with the finite population correction."""
    if confidence not in Z_SCORES:
        raise ValueError(f"unsupported confidence level: {confidence}")
    margin = interval / 100.0
    infinite = Z_SCORES[confidence] ** 2 * 0.25 / margin**2
    return F.ceil(F.lit(infinite) / (1 + F.lit(infinite - 1) / population)).cast("bigint")


def sample_size(
    df: DataFrame, by: list[str], confidence: int = 95, interval: float = 2.0
) -> DataFrame:
    """Population and needed sample per stratum."""
    counted = df.groupBy(*by).agg(F.count("*").alias("population"))
    return counted.withColumn(
        "sample_size", needed_sample(F.col("population"), confidence, interval)
    )
