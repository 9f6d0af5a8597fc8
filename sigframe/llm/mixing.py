"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in SQL functions.

A source's target is its share of all words by weight, cut at ``max_epochs`` times its
size, with the excess dealt out again by weight.  A source is taken in whole epochs
first; the rest is drawn without replacement: every document gets the key
``-ln(u) / quality`` with ``u`` from a hash of its id, and documents are taken in the
order of their keys until the words are used up.  The last one is taken in part.

The running sum over a source is cut into slices of keys: words are summed by slice,
slices are summed up, and only documents of one slice are ordered together, so a source
with a third of all rows is spread over as many tasks as it has slices.  No Python runs
on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigframe.llm.text import WORD
from sigframe.runtime import durable, join_null_safe

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
PER_SLICE = 2_000


def word_count(text: str | Column = "text") -> Column:
    """Number of words; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: str | Column = "text") -> Column:
    """Weight from 0.1 to 1: the share of ASCII signs and capitals, from 1/4 up, lowers it."""
    text = F.col(text) if isinstance(text, str) else text
    signs = F.length(F.regexp_replace(text, "[^!-@\\[-`{-~A-Z]+", ""))
    noise = F.try_divide(signs, F.length(text))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.greatest(F.lit(0.0), F.coalesce(noise, F.lit(1.0)) - 0.25))


def sampling_key(doc_id: str, quality: Column, seed: int) -> Column:
    """Exponential variate of rate ``quality``, the same for an id in every run."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(str(seed))))
    draw = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1.0) / float(2**48 + 1)
    return -F.log(draw) / quality


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Weights repeat along the sources in order of their names (UTF-8 bytes, which is
    code point order), null last.  A source is cut at its cap if the level at which all
    words are used up lies above it: caps are tried in order of cap / weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    named = sizes.withColumn("weight", weight).withColumn(
        "cap", F.col("source_size").cast("double") * float(max_epochs)
    )
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(onward)
    # From the first source that stays below its cap on, all have that source's level.
    tried = named.withColumn("level", level).withColumn(
        "open", F.col("level") * F.col("weight") <= F.col("cap")
    )
    first_open = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)
    return tried.withColumn("found", first_open["level"]).select(
        "source", "source_size",
        F.coalesce(F.least(F.col("cap"), F.col("found") * F.col("weight")), F.col("cap")).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    quality: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 7,
    per_slice: int = PER_SLICE,
) -> DataFrame:
    """``doc_id, size, source, source_size, target, quality, taken`` for every row of ``docs``.

    Reads ``doc_id, text, source``; other columns are ignored unless ``quality`` (the
    weight of a document, above 0) uses them.  Null texts have size 0 and take 0, a null
    source is a source, null and repeated ids draw equal keys and are ordered by size;
    rows alike in both are interchangeable.  A source without words has target 0.  An
    empty table gives an empty result.
    """
    rows = durable(
        docs.select(
            F.col("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(docs["text"]).alias("size"),
            F.coalesce(quality if quality is not None else text_quality(docs["text"]), F.lit(0.1)).alias("quality"),
        ),
        "sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.avg("quality").alias("rate"))
    targets = durable(
        join_null_safe(
            source_targets(sizes.select("source", "source_size"), weights, max_epochs),
            sizes.select("source", "n", "rate"), ["source"],
        ),
        "targets",
    )
    keyed = _with_source(rows, targets).withColumn("key", sampling_key("doc_id", F.col("quality"), seed))
    # 1 - exp(-key * rate) is close to uniform, so slices are close to equal.
    slices = F.ceil(F.col("n") / per_slice)
    cut = F.least(slices - 1, F.floor((1.0 - F.exp(-F.col("key") * F.col("rate"))) * slices))
    keyed = keyed.withColumn("slice", cut.cast("long"))
    by_slice = keyed.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_slice.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    inside = (
        Window.partitionBy("source", "slice")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = join_null_safe(
        keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))),
        starts, ["source", "slice"],
    )
    epochs = F.least(F.lit(max_epochs), F.floor(F.try_divide("target", "source_size"))).cast("long")
    epochs = F.when(F.col("source_size") > 0, epochs).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - epochs * F.col("source_size") + 0.5).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead") - F.col("inside")))
    return placed.select(
        "doc_id", "size", "source", "source_size", "target", "quality",
        (epochs * F.col("size") + part).cast("long").alias("taken"),
    )


def _with_source(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with the facts of their source; without a hint, as sources have no bound."""
    return join_null_safe(rows, targets, ["source"])
