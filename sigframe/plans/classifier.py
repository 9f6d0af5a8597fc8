"""Label codes, class weights, training, parameter search and evaluation."""

from __future__ import annotations

import itertools
import json
import random
import time
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.operators.joins import lookup_map
from sigframe.operators.metrics import best_run, macro_scores
from sigframe.operators.ranking import global_rank
from sigframe.operators.sampling import stratified_folds
from sigframe.plans.boosting import train_boosted_trees  # noqa: F401
from sigframe.runtime import dealt, durable, join_null_safe
from sigframe.sources.sinks import load_model, save_model


def label_index(df: DataFrame, label: str, out: str = "idx") -> DataFrame:
    """``(label, idx)``: the distinct labels numbered from zero in sorted order."""
    names = df.select(label).where(F.col(label).isNotNull()).distinct()
    ranked = global_rank(names, [label], out)
    return ranked.withColumn(out, F.col(out).cast("int"))


def label_encode(
    df: DataFrame, label: str, fit_on: DataFrame | None = None, out: str = "idx",
    strict: bool = True,
) -> DataFrame:
    """Add the label's index, fitted on ``fit_on`` (``df`` by default).

    A label that was not fitted raises, or gets null if not ``strict``.
    """
    mapping = label_index(fit_on if fit_on is not None else df, label, out)
    return lookup_map(df, label, mapping, out, strict)


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Add ``n / (classes * n_c)`` per row."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    overall = sizes.agg(F.sum("_n").alias("n"), F.count("*").alias("c"))
    share = overall.select(F.col("n") / F.col("c")).scalar()
    weights = sizes.select(label, (share / F.col("_n")).alias(out))
    return join_null_safe(df, weights, [label])


def _with_features(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec)))


class FittedClassifier:
    """A fitted Spark model together with the array column it reads."""

    def __init__(self, model: Model, vec: str):
        self.model, self.vec = model, vec

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (a double holding the label index)."""
        scored = self.model.transform(_with_features(df, self.vec))
        return scored.drop("features", "_scaled", "rawPrediction")

    def save(self, path: str) -> None:
        """Save the model and the name of its column, replacing what is at ``path``."""
        save_model(self.model, f"{path}/model")
        spark = SparkSession.active()
        spark.createDataFrame([(self.vec,)], "vec string").write.mode("overwrite").json(f"{path}/column")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedClassifier:
        vec = spark.read.schema("vec string").json(f"{path}/column").first()["vec"]
        return FittedClassifier(load_model(spark, f"{path}/model"), vec)


def train_classifier(
    df: DataFrame, vec: str, label: str = "idx", hidden: int = 512, max_iter: int = 50,
    seed: int = 42,
) -> FittedClassifier:
    """Network of one hidden layer on vectors ``vec`` with class index ``label``."""
    data = _with_features(dealt(df.select(vec, label), vec, label), vec)
    shape = data.agg(F.max(F.size(vec)).alias("d"), (F.max(label) + 1).alias("c")).first()
    learner = MultilayerPerceptronClassifier(
        layers=[int(shape["d"]), hidden, max(2, int(shape["c"]))],
        maxIter=max_iter, seed=seed, labelCol=label,
    )
    return FittedClassifier(learner.fit(data), vec)


def param_points(
    grid: dict[str, list], method: str = "grid", draws: int = 5, seed: int = 42
) -> list[dict]:
    """All points of a grid, or up to ``draws`` distinct random ones."""
    names = sorted(grid)
    points = [
        dict(zip(names, values)) for values in itertools.product(*[grid[n] for n in names])
    ]
    if method == "grid":
        return points
    if method == "random":
        return random.Random(seed).sample(points, min(draws, len(points)))
    raise ValueError(f"unknown search method: {method}")


def search_params(
    df: DataFrame, build: Callable[..., FittedClassifier], grid: dict[str, list], id_col: str,
    label: str = "idx", folds: int = 5, metric: str = "f1", method: str = "grid",
    draws: int = 5, seed: int = 42, parallelism: int = 4,
) -> tuple[DataFrame, dict]:
    """Cross-validated scores of every parameter point, and the best point.

    ``build(train, **params)`` fits a model.  Each fold of a point is a distributed
    training job; ``parallelism`` of them run at a time, and the driver holds only
    the score rows.  The best point has the highest mean ``metric`` over the folds.
    """
    spark = df.sparkSession
    folded = durable(stratified_folds(df, label, id_col, folds, seed, "_fold"), "folds")

    def score(run: tuple[dict, int]) -> tuple:
        point, fold = run
        model = build(folded.where(F.col("_fold") != fold), **point)
        scored = model.transform(folded.where(F.col("_fold") == fold))
        row = macro_scores(scored, label, "prediction").first()
        return (json.dumps(point, sort_keys=True), fold, *[float(v) for v in row])

    runs = list(itertools.product(param_points(grid, method, draws, seed), range(folds)))
    with ThreadPool(min(parallelism, len(runs))) as pool:
        rows = pool.map(inheritable_thread_target(spark)(score), runs)
    scores = spark.createDataFrame(
        rows, "params string, fold int, accuracy double, precision double, recall double, f1 double"
    )
    means = scores.groupBy("params").agg(
        *[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")]
    )
    best = best_run(means, metric, "max").first()
    return scores, json.loads(best["params"])


def fit_best(
    df: DataFrame, build: Callable[..., FittedClassifier], grid: dict[str, list], id_col: str,
    path: str, label: str = "idx", **search,
) -> tuple[FittedClassifier, DataFrame]:
    """Search, fit the best point on all rows of ``df``, save the model under ``path``."""
    scores, best = search_params(df, build, grid, id_col, label, **search)
    model = build(df, **best)
    model.save(path)
    return model, scores


def evaluate(
    train: DataFrame, test: DataFrame, build: Callable[[DataFrame], FittedClassifier],
    label: str = "idx",
) -> tuple[FittedClassifier, DataFrame]:
    """Fit on ``train`` and report scores on both sides and the time each step took."""
    started = time.perf_counter()
    model = build(train)
    fitted = time.perf_counter()
    on_test = macro_scores(model.transform(test), label, "prediction").first()
    scored = time.perf_counter()
    on_train = macro_scores(model.transform(train), label, "prediction").first()
    report = [
        (
            float(on_train["accuracy"]), float(on_test["accuracy"]), *map(float, on_test),
            fitted - started, scored - fitted,
        )
    ]
    return model, train.sparkSession.createDataFrame(
        report,
        "train_score double, test_score double, accuracy double, precision double,"
        " recall double, f1 double, wall_clock_fit double, wall_clock_pred double",
    )
