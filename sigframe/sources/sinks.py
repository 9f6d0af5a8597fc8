"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.util import DefaultParamsReader, MLWritable
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sigframe.functions.paths import part_name
from sigframe.runtime import durable, join_null_safe


def _rebalanced(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Partitions of about ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, as measured
    when they are shuffled; rows of one value of ``by`` lie together unless they are more."""
    names = ", ".join(f"`{c.replace('`', '``')}`" for c in by)
    hint = f"REBALANCE({names})" if by else "REBALANCE"
    return df.sparkSession.sql(f"SELECT /*+ {hint} */ * FROM {{df}}", df=df)


def write_features(df: DataFrame, path: str, files: int | None = None) -> None:
    """Overwrite ``path`` with Parquet files of even size: as many as the bytes ask for, or
    ``files``."""
    even = _rebalanced(df) if files is None else df.repartition(files)
    even.write.mode("overwrite").parquet(path)


def write_zstd(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str] = ("part",), spread: int | None = None,
    mode: str = "overwrite",
) -> None:
    """One directory per value of ``by``.

    A small directory gets one file, a large one as many as its bytes ask for, each written
    by another task.  ``spread`` deals the rows of every value to so many tasks instead.
    """
    if spread is None:
        _rebalanced(df, by).write.mode(mode).partitionBy(*by).parquet(path)
        return
    # Dealt by content, so that a retried task deals the same way; maps have no hash.
    plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    dealt = df.withColumn("_deal", F.pmod(F.xxhash64(*plain), F.lit(spread)))
    dealt = dealt.repartition(*by, "_deal").drop("_deal")
    dealt.write.mode(mode).partitionBy(*by).parquet(path)


def write_stamped(df: DataFrame, path: str, params: dict[str, object], mode: str = "overwrite") -> None:
    """Write below ``name=value`` directories, so runs are read back as one table.

    Only the directory of this run is replaced.
    """
    run = "/".join(f"{k}={v}" for k, v in params.items())
    df.write.mode(mode).parquet(f"{path}/{run}")


def write_two(
    df: DataFrame, vec_path: str, pred_path: str, keys: Sequence[str],
    vec: str = "embedding", pred: str = "predictions",
) -> None:
    """Write vectors and predictions to two tables, computing ``df`` once."""
    once = durable(df.select(*keys, vec, pred), "scored")
    once.select(*keys, vec).write.mode("overwrite").parquet(vec_path)
    once.select(*keys, pred).write.mode("overwrite").parquet(pred_path)


def write_submission(df: DataFrame, path: str) -> None:
    """CSV files with a header, sorted by ``row_id``.

    The files are range-sorted, so reading them by name gives the whole order.
    """
    ordered = df.orderBy("row_id")
    ordered.write.mode("overwrite").option("header", True).csv(path)


def run_metrics(df: DataFrame, part: str = "part", file: str = "file", elapsed: str = "elapsed",
                new: str | None = None) -> DataFrame:
    """Per part: its name, files, seconds spent and, given a flag, files newly processed."""
    aggregates = [
        F.countDistinct(file).alias("num_files"),
        F.sum(elapsed).alias("elapsed"),
    ]
    if new is not None:
        aggregates.append(F.countDistinct(F.when(F.col(new), F.col(file))).alias("processed"))
    return df.groupBy(part).agg(*aggregates).withColumn("part_name", part_name(part)).select(
        "part_name", "num_files", "elapsed", *(["processed"] if new is not None else [])
    )


def write_metrics(df: DataFrame, path: str) -> None:
    """Append metric rows as JSON objects."""
    df.write.mode("append").json(path)


def resume_incremental(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` whose keys ``done`` does not have yet."""
    return join_null_safe(todo, done.select(*keys), keys, "left_anti")


def save_label_map(df: DataFrame, path: str, label: str = "label", idx: str = "idx") -> None:
    """One ``{label: idx}`` JSON object per line, in index order."""
    pairs = df.orderBy(idx).select(
        F.to_json(F.create_map(F.col(label).cast("string"), F.col(idx))).alias("value")
    )
    pairs.write.mode("overwrite").text(path)


def save_model(model: MLWritable, path: str) -> None:
    """Save a fitted Spark model, replacing what is at ``path``."""
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> MLWritable:
    """Load a model of any class written by :func:`save_model`."""
    return DefaultParamsReader.loadParamsInstance(path, spark)


def collect_bounded(df: DataFrame, max_rows: int = 100_000) -> list[Row]:
    """All rows on the driver, for results whose size does not follow the data.

    One row more than ``max_rows`` is asked for; if it comes, nothing is returned but an
    error, so that a table that has grown is neither cut nor pulled in whole.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; write them to a table instead")
    return rows


def save_report(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").json(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a job has committed its output, that is left a success marker."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
