import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.plans import boosting


def brute(x, y, w, trees, depth, rate=0.3, l2=1.0, least=1.0, bins=256):
    """The same trees by plain loops over rows, features and cuts."""
    n, d = x.shape
    classes, bins = y.max() + 1, min(bins, n // 3)
    unit = w.max() / boosting.UNITS
    f = np.zeros((n, classes))
    losses = []
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="inverted_cdf")) for j in range(d)]
    for _ in range(trees):
        p = boosting.softmax(f)
        losses.append(-(w * np.log(p[np.arange(n), y])).sum() / w.sum())
        g_all, h_all = p.copy(), 2 * p * (1 - p)
        g_all[np.arange(n), y] -= 1
        g_all, h_all = (np.rint(v * w[:, None] / unit) * unit for v in (g_all, h_all))
        for c in range(classes):
            groups = [np.arange(n)]
            for _ in range(depth):
                after = []
                for rows in groups:
                    g, h = g_all[rows, c], h_all[rows, c]
                    best = (1e-9, None)
                    for j in range(d):
                        for cut in cuts[j]:
                            left = x[rows, j] <= cut
                            gl, hl = g[left].sum(), h[left].sum()
                            gr, hr = g.sum() - gl, h.sum() - hl
                            if hl < least or hr < least:
                                continue
                            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g.sum() ** 2 / (h.sum() + l2)
                            if gain > best[0] + 1e-12:
                                best = (gain, left)
                    after += [rows] if best[1] is None else [rows[best[1]], rows[~best[1]]]
                groups = after
            for rows in groups:
                f[rows, c] -= rate * g_all[rows, c].sum() / (h_all[rows, c].sum() + l2)
    return f, losses


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(150, 4)), 2)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] + 0.3 * rng.normal(size=150) > 0.5)
    w = rng.choice([0.5, 1.0, 2.0], 150)
    rows = [(i, a.tolist(), int(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "id long, v array<double>, label int, weight double"), x, y, w


def test_trees_are_those_of_plain_loops(spark, labelled):
    df, x, y, w = labelled
    model = boosting.train_boosted_trees(df, "v", "label", trees=6, depth=3, weight="weight", keep_every=2)
    f, losses = brute(x, y, w, 6, 3)
    assert np.allclose(model.losses, losses, atol=1e-9)
    got = {r["id"]: r["probability"] for r in model.transform(df).collect()}
    assert np.allclose([got[i] for i in range(150)], boosting.softmax(f), atol=1e-9)


def test_partitions_and_slices_change_nothing(spark, labelled, monkeypatch):
    df, *_ = labelled
    one = boosting.train_boosted_trees(df, "v", "label", trees=4, weight="weight")
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 16)  # many tasks, so histograms are shuffled
    monkeypatch.setattr(boosting, "SLICE_CELLS", 1)  # a slice for every feature
    two = boosting.train_boosted_trees(df.repartition(5), "v", "label", trees=4, weight="weight", keep_every=3)
    assert (one.features == two.features).all() and (one.thresholds == two.thresholds).all()
    assert np.allclose(one.leaves, two.leaves, atol=1e-12)


def test_loss_falls_and_classes_are_learned(labelled):
    df, *_ = labelled
    model = boosting.train_boosted_trees(df, "v", "label", trees=30)
    assert all(a > b for a, b in zip(model.losses, model.losses[1:]))
    assert model.transform(df).where("prediction = label").count() > 140


def test_ends_when_nothing_can_be_split(spark):
    df = spark.createDataFrame([([1.0], 0), ([1.0], 1)] * 20, "v array<double>, label int")
    model = boosting.train_boosted_trees(df, "v", "label", trees=50)
    assert model.leaves.shape[0] == 0
    assert {tuple(r["probability"]) for r in model.transform(df).collect()} == {(0.5, 0.5)}


def test_rows_that_cannot_be_used(spark, labelled):
    df, *_ = labelled
    nan = float("nan")
    odd = [(1, None, 0, 1.0), (2, [nan] * 4, 1, 1.0), (3, [1.0, None, 1.0, 1.0], 1, 1.0), (4, [1.0] * 4, None, 1.0), (5, [1.0] * 4, 1, None)]
    both = df.unionByName(spark.createDataFrame(odd, df.schema))
    one = boosting.train_boosted_trees(df, "v", "label", trees=2, weight="weight")
    two = boosting.train_boosted_trees(both, "v", "label", trees=2, weight="weight")
    assert (one.thresholds == two.thresholds).all()
    scored = two.transform(spark.createDataFrame(odd, df.schema)).orderBy("id").collect()
    assert [r["prediction"] is None for r in scored] == [True, True, True, False, False]
    with pytest.raises(ValueError):
        boosting.train_boosted_trees(df.limit(0), "v", "label", trees=2)


def test_saved_trees_predict_the_same(spark, labelled, tmp_path):
    df, *_ = labelled
    model = boosting.train_boosted_trees(df, "v", "label", trees=3)
    model.save(str(tmp_path / "m"))
    again = boosting.BoostedTrees.load(spark, str(tmp_path / "m"))
    assert again.losses == model.losses
    assert again.transform(df).orderBy("id").collect() == model.transform(df).orderBy("id").collect()


def test_feature_cuts_are_quantiles(spark):
    df = spark.createDataFrame([([float(i), 1.0],) for i in range(100)], "v array<double>")
    cuts = boosting.feature_cuts(df, "v", 4)
    assert cuts[0].tolist() == [24.0, 49.0, 74.0] and cuts[1].tolist() == [1.0]
    assert df.select(F.size("v")).distinct().count() == 1


@pytest.mark.parametrize("level", [0, 1, 2])
def test_a_round_reads_held_scores_and_adds_up_every_cell(level):
    rng = np.random.default_rng(4)
    n, d, classes, bins, unit = 40, 3, 2, 8, 1 / boosting.UNITS
    x, y, w = rng.integers(0, bins, (n, d)).astype(np.uint8), rng.integers(0, classes, n).astype(np.int32), rng.random(n)
    f = rng.normal(size=(n, classes))
    features, steps = rng.integers(0, d, (2, classes, 7)).astype(np.int32), rng.integers(0, bins, (2, classes, 7))
    leaves = rng.normal(size=(2, classes, 8))
    row = (n, x.tobytes(), y.tobytes(), w.tobytes(), f.tobytes())
    held = boosting._advanced(row, (features[:1], steps[:1], leaves[:1]))
    f = f + boosting._scores(x, features[:1], steps[:1], leaves[:1])
    assert held[:4] == row[:4] and np.allclose(np.frombuffer(held[4]).reshape(n, classes), f)
    slices = [(0, 2), (2, 3)]
    found = dict(boosting._histograms([held], level, (features[1], steps[1]), unit, slices, bins))
    p = boosting.softmax(f)
    own = np.arange(classes) == y[:, None]
    node = boosting._places(x, features[1], steps[1], level)
    for k, (low, high) in enumerate(slices):
        want = np.zeros((2, classes, 2**level, high - low, bins), np.int64)
        for i in range(n):
            for c in range(classes):
                for j in range(low, high):
                    want[0, c, node[i, c], j - low, x[i, j]] += np.rint((p[i, c] - own[i, c]) * w[i] / unit)
                    want[1, c, node[i, c], j - low, x[i, j]] += np.rint(2 * p[i, c] * (1 - p[i, c]) * w[i] / unit)
        sums, loss, total = found[k]
        assert (sums.reshape(want.shape) == want).all()
        assert loss == pytest.approx(-(w * np.log(p[own])).sum()) and total == pytest.approx(w.sum())


def test_nothing_stays_held(spark, labelled):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    boosting.train_boosted_trees(labelled[0], "v", "label", trees=5, depth=2, keep_every=3)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
