import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.operators import vectors


@pytest.fixture
def clips(frame):
    rows = [("a", 1, [1.0, 2.0]), ("a", 2, [3.0, 6.0]), ("a", 3, None), ("b", 4, [5.0, 5.0]), ("c", 5, None)]
    return frame(rows, "file string, i int, embedding array<float>")


def test_pack_keeps_schema_order(frame):
    df = frame([("f", 0.0, 5.0, 1.0, 2.0, 3.0)], "file string, start_time double, end_time double, `1` float, `0` float, `x.y` float")
    packed = vectors.pack_vector(df, size=3)
    assert packed.first()["embedding"] == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        vectors.pack_vector(df, size=2)


def test_unpack_orders_by_index(frame):
    df = frame([("r", [0.1, 0.9])], "row_id string, p array<double>")
    wide = vectors.unpack_predictions(df, "p", {"z": 0, "a": 1, "beyond": 7}, ["row_id"])
    assert wide.columns == ["row_id", "z", "a", "beyond"]
    assert tuple(wide.first()) == ("r", 0.1, 0.9, None)


def test_mean_vector_skips_and_counts_nulls(clips):
    means = {r["file"]: (r["embedding"], r["n"]) for r in vectors.mean_vector(clips, ["file"]).collect()}
    assert means == {"a": ([2.0, 4.0], 2), "b": ([5.0, 5.0], 1)}
    missing = {r["file"]: (r["n_rows"], r["n_missing"]) for r in vectors.missing_vectors(clips, ["file"]).collect()}
    assert missing == {"a": (3, 1), "b": (1, 0), "c": (1, 1)}


def test_ragged_vectors_raise(frame):
    df = frame([("a", [1.0]), ("a", [1.0, 2.0])], "file string, embedding array<float>")
    with pytest.raises(Exception):
        vectors.mean_vector(df, ["file"]).collect()


def test_a_stated_width_is_checked(frame):
    df = frame([("a", [1.0]), ("a", [1.0, 2.0])], "file string, embedding array<float>")
    for width in (1, 2):
        with pytest.raises(Exception, match="expected vectors of"):
            vectors.mean_vector(df, ["file"], width=width).collect()
    missing = frame([("a", [1.0, None])], "file string, embedding array<float>")
    for width in (None, 2):
        with pytest.raises(Exception, match="null element"):
            vectors.mean_vector(missing, ["file"], width=width).collect()
    same = df.where("size(embedding) = 2")
    assert vectors.mean_vector(same, ["file"], width=2).first()["embedding"] == [1.0, 2.0]


@pytest.mark.parametrize("width", [None, 2])
def test_mean_std_is_population(clips, width):
    df = clips.where("embedding IS NOT NULL").groupBy("file").agg(
        vectors.mean_std_columns("embedding", width).alias("stats")
    )
    stats = {r["file"]: r["stats"] for r in df.collect()}
    assert stats["a"] == pytest.approx([2.0, 4.0, 1.0, 2.0])
    assert stats["b"] == pytest.approx([5.0, 5.0, 0.0, 0.0])


def test_vector_mean_std_matches_numpy(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(200, 40)).astype("float32")
    df = spark.createDataFrame([(i % 3, row.tolist()) for i, row in enumerate(data)], "k int, embedding array<float>")
    for row in vectors.vector_mean_std(df, ["k"]).collect():
        part = data[row["k"] :: 3].astype("float64")
        assert row["stats"] == pytest.approx(np.concatenate([part.mean(0), part.std(0)]).tolist(), abs=1e-9)
        assert row["n"] == len(part)


def test_standardize_uses_the_fitted_part(frame):
    rows = [(1, [0.0, 7.0]), (2, [2.0, 7.0]), (3, [10.0, 8.0])]
    df = frame(rows, "i int, embedding array<float>")
    out = vectors.standardize(df, "embedding", fit_on=df.where("i < 3")).orderBy("i").collect()
    assert [r["embedding"] for r in out] == [[-1.0, 0.0], [1.0, 0.0], [9.0, 1.0]]


def test_linear_and_null_rows(frame):
    df = frame([([1.0, 2.0],), (None,)], "v array<float>")
    out = vectors.linear(df, "v", np.array([[1.0, 0.0, 2.0], [0.0, 1.0, 1.0]]), np.array([0.0, 10.0, 0.0]))
    assert [r["logits"] for r in out.collect()] == [[1.0, 12.0, 4.0], None]


def test_linear_rejects_other_widths(frame):
    df = frame([([1.0, 2.0, 3.0],)], "v array<float>")
    with pytest.raises(Exception, match="expected vectors of 2 values"):
        vectors.linear(df, "v", np.eye(2), np.zeros(2)).collect()


def test_only_the_vector_reaches_python(clips):
    plan = vectors.linear(clips, "embedding", np.eye(2), np.zeros(2))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in text and "MapInArrow" not in text


def test_long_form(clips):
    rows = vectors.long_form(clips.where("i = 1"), ["file"], "embedding").orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [("a", 0, 1.0), ("a", 1, 2.0)]
    assert clips.where(F.size("embedding") == 2).count() == 3
