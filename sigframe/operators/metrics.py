"""Classification metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.functions.arrays import log_sum_exp


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    hit = F.col(truth).eqNullSafe(F.col(pred)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"))


def confusion_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Rows per (truth, prediction) pair."""
    return df.groupBy(truth, pred).agg(F.count("*").alias("n"))


def _ratio(part: str, *whole: str):
    """``part / sum(whole)``, zero where the denominator is zero."""
    below = sum((F.col(w) for w in whole[1:]), F.col(whole[0]))
    return F.when(below == 0, F.lit(0.0)).otherwise(F.col(part) / F.nullif(below, F.lit(0)))


def class_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class that occurs in truth or prediction.

    The data are reduced to confusion counts first; each count is then credited to
    its true and to its predicted class, which replaces a full outer join.
    """
    same = F.col(truth).eqNullSafe(F.col(pred))
    credits = F.array(
        F.struct(
            F.col(truth).alias("label"),
            F.when(same, F.col("n")).otherwise(0).alias("tp"),
            F.when(same, 0).otherwise(F.col("n")).alias("fn"),
            F.lit(0).cast("bigint").alias("fp"),
        ),
        F.struct(
            F.col(pred).alias("label"),
            F.lit(0).cast("bigint").alias("tp"),
            F.lit(0).cast("bigint").alias("fn"),
            F.when(same, 0).otherwise(F.col("n")).alias("fp"),
        ),
    )
    per_class = (
        confusion_counts(df, truth, pred)
        .select(F.inline(credits))
        .groupBy("label")
        .agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))
    )
    scored = per_class.withColumn("precision", _ratio("tp", "tp", "fp")).withColumn(
        "recall", _ratio("tp", "tp", "fn")
    )
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both == 0, 0.0).otherwise(
        2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0))
    )
    return scored.select(
        "label", "precision", "recall", f1.alias("f1"), (F.col("tp") + F.col("fn")).alias("support")
    )


def macro_scores(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy and the unweighted class means of precision, recall and F1, to 3 places."""
    report = class_report(df, truth, pred)
    hits = F.sum(F.col("recall") * F.col("support")) / F.sum("support")
    return report.agg(
        F.round(hits, 3).alias("accuracy"),
        *[F.round(F.avg(c), 3).alias(c) for c in ("precision", "recall", "f1")],
    )


def cross_entropy(df: DataFrame, logits: str, label: str) -> DataFrame:
    """Mean of ``-log softmax(logits)[label]``; a label beyond the logits raises."""
    at = F.col(label).cast("int")
    beyond = at.isNotNull() & ((at < 0) | (at >= F.size(logits)))
    failure = F.raise_error(F.concat(F.lit("no logit for label "), at.cast("string"))).cast("double")
    picked = F.when(beyond, failure).otherwise(F.get(F.col(logits), at).cast("double"))
    return df.agg(F.avg(log_sum_exp(logits) - picked).alias("cross_entropy"))


def best_run(
    df: DataFrame, metric: str, mode: str = "min", by: list[str] | None = None
) -> DataFrame:
    """The row with the best metric, per ``by`` or overall; the rest of the row breaks ties."""
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be min or max, not {mode}")
    rest = [c for c in df.columns if c != metric and c not in (by or [])]
    ranked = F.col(metric) if mode == "min" else -F.col(metric)
    valid = df.where(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    best = F.min(F.struct(ranked.alias("_m"), F.col(metric), *rest)).alias("_b")
    return valid.groupBy(*(by or [])).agg(best).where("_b IS NOT NULL").select(
        *(by or []), *[F.col(f"_b.{c}").alias(c) for c in [metric, *rest]]
    )


def early_stop_epoch(
    df: DataFrame,
    run: str = "run",
    epoch: str = "epoch",
    loss: str = "val_loss",
    patience: int = 5,
    max_epochs: int = 50,
) -> DataFrame:
    """Epoch at which training stops, per run, with the best loss so far and its epoch.

    Training stops at the first epoch ``patience`` after the last improvement, or
    with the last epoch below ``max_epochs``.  A window holds at most
    ``max_epochs`` rows.
    """
    upto = Window.partitionBy(run).orderBy(epoch)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    seen = upto.rowsBetween(Window.unboundedPreceding, 0)
    best_before = F.min(loss).over(before)
    better = best_before.isNull() | (F.col(loss) < best_before)
    state = (
        df.where(F.col(epoch) < max_epochs)
        .withColumn("_at", F.when(better, F.col(epoch)))
        .withColumn("_at", F.max("_at").over(seen))
        .withColumn("_best", F.min(loss).over(seen))
        .withColumn("_stop", F.col(epoch) - F.col("_at") >= patience)
    )
    first_stop = F.min(F.when(F.col("_stop"), F.col(epoch)))
    return (
        state.withColumn("_end", F.min(F.when(F.col("_stop"), F.col(epoch))).over(
            Window.partitionBy(run)
        ))
        .where(F.col("_end").isNull() | (F.col(epoch) <= F.col("_end")))
        .groupBy(run)
        .agg(
            F.coalesce(first_stop, F.max(epoch)).alias("stop_epoch"),
            F.max("_at").alias("best_epoch"),
            F.min("_best").alias("best_loss"),
        )
    )
