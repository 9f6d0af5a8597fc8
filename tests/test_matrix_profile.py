import numpy as np
import pytest

from sigframe.operators.matrix_profile import matrix_profile


def brute(values, m):
    zone = -(-m // 4)
    windows = [np.array(values[i : i + m]) for i in range(len(values) - m + 1)]
    bad = [not np.isfinite(w).all() for w in windows]
    flat = [w.max() == w.min() for w in windows]
    scaled = [w if b else (w - w.mean()) / (1.0 if f else w.std()) for w, f, b in zip(windows, flat, bad)]
    best = {}
    for i in range(len(windows)):
        options = []
        for j in range(len(windows)):
            if abs(i - j) > zone and not bad[i] and not bad[j]:
                if flat[i] or flat[j]:
                    d = 0.0 if flat[i] and flat[j] else m**0.5
                else:
                    d = float(np.linalg.norm(scaled[i] - scaled[j]))
                options.append((d, j))
        best[i] = min(options) if options else (None, None)
    return best


def check(spark, series, m, block):
    rows = [(name, float(i), float(v)) for name, values in series.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "file string, t double, v double").repartition(5)
    found = {}
    for r in matrix_profile(df, ["file"], ["t"], "v", m, block).collect():
        found.setdefault(r["file"], {})[r["pos"]] = (r["distance"], r["neighbor"])
    for name, values in series.items():
        if len(values) < m:
            assert name not in found
            continue
        want = brute(values, m)
        assert found[name].keys() == want.keys()
        for pos, (d, _) in want.items():
            if d is None:
                assert found[name][pos] == (None, None)
            else:
                assert found[name][pos][0] == pytest.approx(d, abs=1e-5)
                # The partner must be one at the smallest distance.
                assert abs(found[name][pos][1] - pos) > -(-m // 4)


@pytest.mark.parametrize("m, block", [(8, 8), (8, 16), (8, 1000), (5, 7), (12, 20)])
def test_random_series_match_brute_force(spark, m, block):
    rng = np.random.default_rng(m * 100 + block)
    check(spark, {"walk": rng.normal(size=90).cumsum(), "noise": rng.normal(size=61), "short": rng.normal(size=4)}, m, block)


def test_smooth_series_where_blocks_are_skipped(spark):
    t = np.arange(160)
    check(spark, {"drift": np.where(t < 80, np.sin(t / 3.0), (t / 20.0) ** 3), "sine": np.sin(t[:70] / 5.0)}, 8, 16)


def test_constant_parts(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([np.ones(20), rng.normal(size=30), np.zeros(20)])
    check(spark, {"steps": values, "all_equal": np.ones(25)}, 6, 10)


@pytest.mark.parametrize("block", [8, 16, 200])
def test_missing_values(spark, block):
    rng = np.random.default_rng(6)
    values = rng.normal(size=120)
    values[[3, 40, 41, 90]] = np.nan
    values[70] = np.inf
    check(spark, {"gaps": values, "none": np.full(30, np.nan), "whole": rng.normal(size=50)}, 8, block)


def test_null_is_a_missing_value(spark):
    values = [float(v) for v in np.random.default_rng(7).normal(size=60)]
    rows = [(float(i), None if i == 20 else v) for i, v in enumerate(values)]
    found = matrix_profile(spark.createDataFrame(rows, "t double, v double"), [], ["t"], "v", 8, 16).collect()
    assert {r["pos"] for r in found if r["distance"] is None} == set(range(13, 21))


def test_planted_motif_is_found(spark):
    rng = np.random.default_rng(9)
    values = rng.normal(size=200)
    values[150:170] = values[20:40] * 3 + 5
    rows = [(float(i), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "t double, v double")
    found = {r["pos"]: r for r in matrix_profile(df, [], ["t"], "v", 20, 32).collect()}
    assert found[20]["neighbor"] == 150 and found[150]["neighbor"] == 20
    assert found[20]["distance"] == pytest.approx(0.0, abs=1e-5)


def test_too_short_window_raises(frame):
    with pytest.raises(ValueError):
        matrix_profile(frame([], "t double, v double"), [], ["t"], "v", 2)
