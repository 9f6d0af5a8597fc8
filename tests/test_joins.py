import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.functions import kernels
from sigframe.functions.kernels import nearest_rows
from sigframe.operators import joins


def test_lookup_map_strict_and_lenient(frame):
    df = frame([("a",), ("b",), ("zz",)], "label string")
    codes = frame([("a", 0), ("b", 1)], "label string, idx int")
    lenient = {r["label"]: r["idx"] for r in joins.lookup_map(df, "label", codes, strict=False).collect()}
    assert lenient == {"a": 0, "b": 1, "zz": None}
    with pytest.raises(Exception, match="no code for zz"):
        joins.lookup_map(df, "label", codes).collect()


def test_join_dimension_drops_unmatched(frame):
    facts = frame([("x", 1), ("y", 2)], "class string, v int")
    dim = frame([("x", "Aves")], "primary_label string, class_name string")
    assert [tuple(r) for r in joins.join_dimension(facts, dim, "class", "primary_label").collect()] == [("x", 1, "Aves")]


def test_first_clip(frame):
    df = frame([("a", 5.0, 1), ("a", 0.0, 2), ("b", 10.0, 3)], "file string, start_time double, v int")
    rows = {r["file"]: (r["start_time"], r["v"]) for r in joins.first_clip_per_file(df).collect()}
    assert rows == {"a": (0.0, 2), "b": (10.0, 3)}


def test_missing_classes(frame):
    have = frame([("a",), ("a",)], "c string")
    expected = frame([("a",), ("b",), ("b",), ("c",)], "c string")
    assert sorted(r["c"] for r in joins.missing_classes(have, expected, "c").collect()) == ["b", "c"]


def test_time_bucket_join_beyond_100_seconds(frame):
    frames = frame([("f", t, i) for i, t in enumerate([0.1, 4.9, 5.0, 104.0, -1.0, None])], "file string, timestamp double, i int")
    clips = frame([("f", 0.0, "x"), ("f", 5.0, "y"), ("f", 100.0, "z")], "file string, start_time float, e string")
    rows = joins.time_bucket_join(frames, clips).collect()
    assert sorted((r["i"], r["e"], r["start_time"]) for r in rows) == [(0, "x", 0), (1, "x", 0), (2, "y", 5), (3, "z", 100)]


@pytest.fixture
def points(spark):
    rng = np.random.default_rng(5)
    return rng.normal(size=(300, 6)), rng.normal(size=(41, 6))


def brute(data, centroids):
    return ((data[:, None, :] - centroids[None]) ** 2).sum(2).argmin(1)


def test_nearest_whole_and_in_blocks(spark, points):
    data, centroids = points
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(data)], "i int, v array<double>")
    book = spark.createDataFrame([(100 + i, c.tolist()) for i, c in enumerate(centroids)], "token int, centroid array<double>")
    want = {i: 100 + int(t) for i, t in enumerate(brute(data, centroids))}
    for limit in (10**6, 16 * 56, 400):
        found = joins.nearest_centroid(df, "v", book, distance="d", block_bytes=limit).collect()
        assert {r["i"]: r["token"] for r in found} == want
        assert all(r["d"] >= 0 for r in found)


def test_nearest_ties_take_the_lowest_token(frame):
    df = frame([(1, [0.0]), (2, [10.0]), (3, None), (4, [float("nan")]), (5, [None])], "i int, v array<float>")
    book = frame([(9, [1.0]), (4, [-1.0]), (7, [-1.0]), (8, [1e6])], "token int, centroid array<double>")
    for limit in (1000, 16):
        found = {r["i"]: r["token"] for r in joins.nearest_centroid(df, "v", book, block_bytes=limit).collect()}
        assert found == {1: 4, 2: 9, 3: None, 4: None, 5: None}


def test_nearest_rows_far_from_origin():
    # Close centroids far out, where a plain matrix product cannot tell them apart.
    centroids = np.array([[1e8, 0.0], [1e8, 1e-3], [1e8, 2e-3]])
    rows = np.array([[1e8, 0.0011], [1e8, 0.0019], [1e8, -5.0]])
    assert nearest_rows(rows, centroids)[0].tolist() == [1, 2, 0]


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e18, 1e25])
def test_nearest_rows_at_any_scale(scale):
    rng = np.random.default_rng(11)
    centroids = rng.normal(size=(200, 7)) * scale
    centroids[150] = centroids[20]
    centroids[199] *= 1e4
    rows = np.vstack([rng.normal(size=(150, 7)) * scale, centroids[[20, 150, 3]]])
    want = ((rows[:, None] / scale - centroids[None] / scale) ** 2).sum(2).argmin(1)
    found, distance = nearest_rows(rows, centroids)
    assert found.tolist() == want.tolist()
    assert found[150:].tolist() == [20, 20, 3] and distance[150] == 0.0


def test_empty_codebook_raises(frame):
    with pytest.raises(ValueError):
        joins.nearest_centroid(frame([([1.0],)], "v array<double>"), "v", frame([], "token int, centroid array<double>"))


def test_hot_key_lookup_keeps_all_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 10).alias("token"))
    vectors = spark.createDataFrame([(7, [1.0])], "token long, word_vector array<double>")
    found = joins.lookup_word_vector(df, vectors)
    assert found.count() == 3000
    assert found.where("word_vector IS NOT NULL").count() == 1000


@pytest.mark.parametrize("kind", ["even", "lattice", "copies", "outliers", "line"])
def test_pruned_search_is_that_of_all_centroids(kind):
    rng = np.random.default_rng(7)
    centroids, rows = rng.normal(size=(700, 3)), rng.normal(size=(3000, 3))
    if kind == "lattice":  # many ties
        centroids, rows = rng.integers(0, 9, (700, 3)).astype(float), rng.integers(0, 18, (3000, 3)) / 2.0
    elif kind == "copies":
        centroids[300:] = centroids[5]
        rows[1000:] = rows[3]
    elif kind == "outliers":
        centroids[::50] *= 1e9
        rows[::70] *= 1e8
    elif kind == "line":
        centroids[:, 1:], rows[:, 1:] = 1e6, 1e6
    want, far = kernels.nearest_rows(rows, centroids)
    leaves = kernels.leaves_of(centroids, 1)
    found, distance = kernels.nearest_rows(rows, centroids, leaves)
    assert (found == want).all() and (distance == far).all()
    order = kernels.near_order(rows, 64)
    assert sorted(order) == list(range(3000))
    for per in (0.01, 4.0, 1e6):
        assert (kernels.nearest_rows(rows[order], centroids, leaves, per)[0] == want[order]).all()
    # A row without a distance keeps its place.
    rows[7] = [np.nan, 1.0, np.inf]
    found, distance = kernels.nearest_rows(rows, centroids, leaves)
    assert not np.isfinite(distance[7]) and (np.delete(found, 7) == np.delete(want, 7)).all()


def test_pruned_search_compares_few(monkeypatch):
    rng = np.random.default_rng(8)
    centroids, rows, cells = rng.random((4096, 3)), rng.random((40_000, 3)), []
    rank = kernels._rank
    monkeypatch.setattr(kernels, "_rank", lambda x, c, most: cells.append(len(x) * c.shape[1]) or rank(x, c, most))
    kernels.nearest_rows(rows, centroids, kernels.leaves_of(centroids, kernels.LARGE_BOOK))
    assert sum(cells) < 0.2 * len(rows) * len(centroids)


def test_search_with_a_large_codebook_keeps_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(kernels, "LARGE_BOOK", 16)
    rng = np.random.default_rng(9)
    centroids = rng.normal(size=(50, 2))
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 2)))]
    odd = [(900, None), (901, [float("nan"), 1.0]), (902, [None, 1.0]), (903, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows + odd, "id int, v array<double>").repartition(3)
    book = spark.createDataFrame([(k + 10, c.tolist()) for k, c in enumerate(centroids)], "token bigint, centroid array<double>")
    found = {r["id"]: r["token"] for r in joins.nearest_centroid(df, "v", book).collect()}
    want = 10 + kernels.nearest_rows(np.array([v for _, v in rows]), centroids)[0]
    assert [found[i] for i in range(900)] == want.tolist() and [found[i] for i in range(900, 904)] == [None] * 4
