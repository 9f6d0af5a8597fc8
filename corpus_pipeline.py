"""A corpus from raw documents: five stages, each written and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and applies one operator to all documents its
predecessor kept.  All but the last return the columns of ``docs``.  Decisions are made
on narrow rows and brought back to the documents.  Copies and benchmark passages are told
by id and text, so a text is not lost by what else has its id or has none; only the
classifier's verdict, learnt from labels by id, holds for all rows of an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.llm import decontaminate, exact_dedup, jaccard_join, mixing, quality
from sigframe.runtime import durable


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is among ``ids`` (``doc_id``); null matches null."""
    wanted = ids.select(F.col("doc_id").alias("_wanted")).distinct()
    return docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def _without_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents of whose ``doc_id`` and ``body`` (hash of the text) no row is in ``rows``."""
    gone = rows.select(F.col("doc_id").alias("_gone"), F.col("body").alias("_body")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.xxhash64("text") == F.col("_body"))
    return docs.join(gone, same, "left_anti")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go, with all rows of their id.

    Null and empty texts are scored like others; a null id is an id; an empty table
    stays empty.
    """
    judged = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, judged.filter("predicted = 0"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays, of rows equal in both one.

    Null counts as an empty text and a null id comes last; an empty table stays empty.
    """
    fate = exact_dedup.exact_duplicates(docs).groupBy("doc_id", "text_sha256", "keep_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    fate = durable(fate.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id"))), "fate")
    gone = fate.filter("NOT stays").select("doc_id")
    # Rows alike in id and text, and ids with several texts, need more than the id.
    odd = durable(fate.groupBy("doc_id").agg(F.sum("n").alias("n")).filter("n > 1"), "odd")
    kept = _without(docs, gone.unionByName(odd.select("doc_id")))
    if odd.isEmpty():
        return kept
    repeated = _only(docs, odd).withColumn("_sha", F.lower(F.hex(exact_dedup.text_digest(docs["text"]))))
    staying = fate.filter("stays").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_stay"))
    one = repeated.join(
        staying, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_stay")), "left_semi"
    ).dropDuplicates(["doc_id", "_sha"])
    return kept.unionByName(one.drop("_sha"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays.

    Rows without an id go if a row with one is in their class and stay otherwise.  Null
    and empty texts are copies of nothing; an empty table stays empty.
    """
    classes = jaccard_join.near_duplicates(docs)
    return _without_texts(docs, classes.filter("NOT (doc_id <=> class_id)"))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; other texts of their id stay.

    Null and empty texts hold nothing; an empty table, or benchmark, changes nothing.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    leaks = decontaminate.find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = leaks.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.xxhash64("doc_id", "text") == F.col("_gone"), "left_anti")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; documents it leaves out go.

    Null and empty texts have no words and go; a null source is a source of its own.
    """
    return mixing.mix_sources(docs).filter("taken > 0").select("doc_id", "size", "source", "target", "taken")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontaminate", clean_of_benchmark),
    ("mix", mixed_sources),
]

# The classifier and the near copies are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return durable(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
