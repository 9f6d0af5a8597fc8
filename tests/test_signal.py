import math

import numpy as np
import pytest

from sigframe.operators import signal


@pytest.mark.parametrize(
    "duration, length, step, n",
    [(60.0, 3000, 3000, 20), (60.0, 5000, 5000, 12), (60.0, 2000, 2000, 30), (60.0, 960, 480, 124),
     (10.0, 5000, 5000, 2), (4.0, 5000, 5000, 0), (5.0, 5000, 5000, 1), (12.5, 5000, 5000, 2), (0.0, 960, 480, 0)],
)
def test_clip_counts(frame, duration, length, step, n):
    df = frame([("f", duration)], "file string, duration double")
    rows = signal.clip_windows(df, length, step).orderBy("clip").collect()
    assert len(rows) == n
    for i, r in enumerate(rows):
        assert (r["clip"], r["start_time"], r["end_time"]) == (i, i * step / 1000, (i * step + length) / 1000)


@pytest.fixture
def tone(spark):
    rate, seconds = 8000, 2
    t = np.arange(rate * seconds) / rate
    rows = [("tone", rate, np.sin(2 * math.pi * 1000 * t).astype("float32").tolist()), ("short", rate, [0.5] * 10)]
    return spark.createDataFrame(rows, "file string, sample_rate int, samples array<float>")


def test_durations(tone):
    got = {r[0]: r[1] for r in tone.select("file", signal.series_duration()).collect()}
    assert got == {"tone": 2.0, "short": 10 / 8000}


def test_cut_clips(tone):
    rows = signal.cut_clips(tone, 500, 500).orderBy("clip").collect()
    assert [(r["file"], r["start_time"], len(r["samples"])) for r in rows] == [("tone", i * 0.5, 4000) for i in range(4)]
    whole = tone.where("file = 'tone'").first()["samples"]
    assert rows[3]["samples"] == whole[12000:]


def test_frames_overlap_by_half(tone):
    rows = signal.frame(tone, 2000, 1000).orderBy("index").collect()
    assert len(rows) == 15 and {r["file"] for r in rows} == {"tone"}
    assert [r["timestamp"] for r in rows][:3] == [0.125, 0.25, 0.375]
    assert rows[1]["samples"][:1000] == rows[0]["samples"][1000:]


def test_tone_lands_in_its_mel_band(tone):
    frames = signal.frame(tone, 2000, 1000)
    bands = signal.mel_spectrogram(frames, rate=8000, size=2000, n_fft=2048, n_mels=32)
    bank = signal.mel_bank(8000, 2048, 32)
    want = int(bank[:, round(1000 / (8000 / 2048))].argmax())
    assert {int(np.argmax(r["bands"])) for r in bands.collect()} == {want}


def test_power_of_a_sine_is_half(spark):
    from sigframe.functions.kernels import power_bands_udf

    n = 64
    wave = np.sin(2 * math.pi * 8 * np.arange(n) / n)
    df = spark.createDataFrame([(wave.tolist(),), (None,)], "x array<double>")
    kernel = power_bands_udf(spark, n, np.ones(n), np.eye(n // 2 + 1))
    power, none = [r[0] for r in df.select(kernel("x")).collect()]
    assert none is None and power[8] == pytest.approx(0.5) and sum(power) == pytest.approx(0.5)


def test_mel_bank_shape_and_area():
    bank = signal.mel_bank(32000, 8192, 128)
    assert bank.shape == (128, 4097) and (bank >= 0).all() and (bank.sum(1) > 0).all()
    assert (bank.sum(1) * 32000 / 8192)[40:] == pytest.approx(1.0, rel=0.05)


def test_cosine_matrix_is_orthonormal():
    full = signal.cosine_matrix(20, 20)
    assert np.allclose(full.T @ full, np.eye(20))


def test_mfcc(frame):
    df = frame([([1.0] * 16,)], "bands array<double>")
    row = signal.mfcc(df, 16, 5).first()["mfcc"]
    assert row == pytest.approx([4.0, 0, 0, 0, 0], abs=1e-9)


def test_resample_fills_gaps_across_chunks(frame):
    rows = [("a", 0.1, 1.0), ("a", 0.9, 3.0), ("a", 3.5, 7.0), ("a", 40.2, 9.0), ("b", 5.0, 5.0),
            ("b", None, 6.0), ("b", 6.0, None), (None, 1.0, 4.0), (None, 3.0, 8.0)]
    df = frame(rows, "file string, t double, v double")
    found = signal.resample(df, ["file"], "t", "v", 1.0, chunk=4).collect()
    want = {("a", i): 2.0 if i < 3 else 7.0 if i < 40 else 9.0 for i in range(41)}
    want |= {("b", 5): 5.0, (None, 1): 4.0, (None, 2): 4.0, (None, 3): 8.0}
    assert {(r["file"], r["step"]): r["value"] for r in found} == want
    assert len(found) == len(want)


def test_resample_negative_times_and_fractions(frame):
    df = frame([(-0.6, 1.0), (0.6, 2.0)], "t double, v double")
    found = sorted((r["step"], r["t"], r["value"]) for r in signal.resample(df, [], "t", "v", 0.5, chunk=2).collect())
    assert found == [(-2, -1.0, 1.0), (-1, -0.5, 1.0), (0, 0.0, 1.0), (1, 0.5, 2.0)]


def test_embed_clips_loads_once_per_task(spark):
    def load():
        calls = [0]

        def model(batch):
            calls[0] += 1
            return batch.assign(v=calls[0] * 0.0 + batch["id"] * 2.0)[["id", "v"]]

        return model

    found = signal.embed_clips(spark.range(10), load, "id long, v double")
    assert sorted((r["id"], r["v"]) for r in found.collect()) == [(i, 2.0 * i) for i in range(10)]


def test_group_map_counts_hot_group_whole(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, 'hot', IF(id % 50 = 1, NULL, concat('k', id % 50))) AS k", "id AS v")

    def partial(rows):
        return rows.groupby("k", as_index=False, dropna=False).agg(n=("v", "size"), s=("v", "sum"))

    def merge(states):
        return states.groupby("k", as_index=False, dropna=False).sum()

    def finish(states):
        return states.assign(mean=states["s"] / states["n"])[["k", "n", "mean"]]

    found = {r["k"]: (r["n"], r["mean"]) for r in signal.group_map(
        df, ["k"], partial, merge, finish, "k string, n long, s long", "k string, n long, mean double", salts=4
    ).collect()}
    want = {r["k"]: (r["n"], r["mean"]) for r in df.groupBy("k").agg({"v": "avg", "*": "count"}).toDF("k", "mean", "n").collect()}
    assert found.keys() == want.keys()
    assert all(found[k][0] == want[k][0] and found[k][1] == pytest.approx(want[k][1]) for k in want)


def test_resample_leaves_wide_gaps_open(frame):
    rows = [("a", -1e9, 5.0), ("a", 0.0, 1.0), ("a", 3.0, 2.0), ("a", 50.0, 3.0)]
    df = frame(rows, "file string, t double, v double")
    found = signal.resample(df, ["file"], "t", "v", 1.0, max_gap=10.0).collect()
    steps = {r["step"]: r["value"] for r in found}
    assert steps == {-(10**9): 5.0, 0: 1.0, 1: 1.0, 2: 1.0, 3: 2.0, 50: 3.0}
