import math

import pytest
from pyspark.sql import functions as F

from sigframe.operators import metrics, profile


@pytest.fixture
def files(frame):
    rows = [("train_audio/a/1.ogg", 60.0), ("train_audio/a/2.ogg", 30.0), ("train_audio/b/3.ogg", 3600.0),
            ("train_soundscapes/x.ogg", 7200.0)]
    return frame(rows, "path string, duration double")


def test_durations(files):
    assert profile.total_hours(files, "%soundscape%").first()[0] == 2.0
    by = {r["dataset"]: (r["count"], r["duration_hours"]) for r in profile.durations_by_dataset(files).collect()}
    assert by == {"train_audio": (3, 1.03), "train_soundscapes": (1, 2.0)}
    by = {r["primary_label"]: (r["count"], r["duration_minutes"]) for r in profile.durations_by_class(files).collect()}
    assert by == {"a": (2, 1.5), "b": (1, 60.0)}


def test_histogram_edges(frame):
    df = frame([(float(v),) for v in [0, 1, 2, 3, 4, 10]] + [(None,), (float("nan"),)], "v double")
    rows = profile.histogram(df, "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 2, 1, 0, 1]
    assert [r["edge"] for r in rows] == [0.0, 2.0, 4.0, 6.0, 8.0]


def test_histogram_of_one_value_and_of_nothing(frame):
    rows = profile.histogram(frame([(3.0,), (3.0,)], "v double"), "v", 2).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 0]
    assert profile.histogram(frame([], "v double"), "v", 2).count() == 0


def test_value_counts_and_summary(frame):
    df = frame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "k string, v int")
    assert [r["k"] for r in profile.value_counts(df, ["k"]).collect()] == ["b", "a", "c"]
    row = profile.summary(df).first()
    assert (row["column"], row["count"], row["mean"], row["p50"], row["max"]) == ("v", 4, 2.5, 2.0, 4.0)
    assert math.isclose(row["stddev"], math.sqrt(5 / 3))


def test_cluster_measures(frame):
    df = frame([(0, 1.0), (0, 1.0), (1, 2.0), (1, 0.0)], "token int, distance double")
    assert profile.cluster_objective(df).first()[0] == 4.0
    assert profile.cluster_imbalance(df).first()[0] == 1.0
    assert profile.cluster_imbalance(df, k=4).first()[0] == 2.0


def test_explained_variance(frame):
    df = frame([([3.0, 0.0],), ([0.0, 4.0],), (None,)], "embedding array<double>")
    rows = profile.explained_variance(df).orderBy("pos").collect()
    assert [(round(r["share"], 9), round(r["cumulative"], 9)) for r in rows] == [(0.36, 0.36), (0.64, 1.0)]


def test_union_tagged_and_difference(frame):
    means = frame([("f2", [1.0]), ("f1", [2.0])], "file string, embedding array<double>")
    protos = frame([("c", [3.0])], "class string, embedding array<double>")
    rows = profile.union_tagged(means, protos).collect()
    assert [(r["id"], r["is_soundscape"]) for r in rows] == [("c", 0), ("f1", 1), ("f2", 1)]
    a, b = frame([("x",), ("x",), ("y",)], "k string"), frame([("y",)], "k string")
    assert [r[0] for r in profile.set_difference(a, b, "k").collect()] == ["x"]


def test_class_report_with_class_never_in_truth(frame):
    df = frame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")], "t string, p string")
    rows = {r["label"]: (r["precision"], r["recall"], round(r["f1"], 6), r["support"])
            for r in metrics.class_report(df, "t", "p").collect()}
    assert rows == {"a": (1.0, 0.5, 0.666667, 2), "b": (0.5, 1.0, 0.666667, 1), "c": (0.0, 0.0, 0.0, 1), "d": (0.0, 0.0, 0.0, 0)}
    macro = metrics.macro_scores(df, "t", "p").first()
    assert tuple(macro) == (0.5, 0.375, 0.375, 0.333)
    assert metrics.accuracy(df, "t", "p").first()[0] == 0.5


def test_cross_entropy(frame):
    df = frame([([0.0, 0.0], 1), ([1000.0, 0.0], 0)], "z array<double>, y int")
    assert math.isclose(metrics.cross_entropy(df, "z", "y").first()[0], math.log(2) / 2)


def test_best_run(frame):
    df = frame([("a", 0.9), ("b", 0.7), ("c", None), ("d", float("nan")), ("aa", 0.7)], "run string, loss double")
    assert tuple(metrics.best_run(df, "loss").first()) == (0.7, "aa")
    assert metrics.best_run(df, "loss", "max").first()["run"] == "a"


def stop(frame, losses, **options):
    df = frame([("r", i, v) for i, v in enumerate(losses)], "run string, epoch int, val_loss double")
    row = metrics.early_stop_epoch(df, **options).first()
    return row["stop_epoch"], row["best_epoch"], row["best_loss"]


def test_early_stop(frame):
    assert stop(frame, [3.0, 2.0, 2.5, 2.4, 2.3, 2.2, 2.1, 1.0]) == (6, 1, 2.0)
    assert stop(frame, [3.0, 2.0, 1.0]) == (2, 2, 1.0)
    assert stop(frame, [3.0, 2.0, 2.0, 2.0], patience=2) == (3, 1, 2.0)
    assert stop(frame, [float(60 - i) for i in range(60)]) == (49, 49, 11.0)


def test_timings(frame):
    df = frame([("m", 3600.0), ("m", 7200.0)], "model string, elapsed double")
    assert tuple(profile.summarize_timings(df, ["model"]).first()) == ("m", 3.0, 5400.0, 2)
    assert df.agg(F.sum("elapsed")).first()[0] == 10800.0


def test_metrics_refuse_what_makes_no_sense(frame):
    runs = frame([("a", 1.0)], "run string, loss double")
    with pytest.raises(ValueError, match="mode"):
        metrics.best_run(runs, "loss", "lowest")
    with pytest.raises(Exception, match="no logit for label 2"):
        metrics.cross_entropy(frame([([0.0, 1.0], 2)], "z array<double>, y int"), "z", "y").collect()
