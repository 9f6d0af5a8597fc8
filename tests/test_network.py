import inspect

import numpy as np
import pytest

from sigframe.plans import network, scoring


@pytest.fixture(scope="module")
def rings(spark):
    """Two classes that no line parts."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    rows = [(i, v.tolist(), int(np.hypot(*v) > 1.1)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int")


def test_defaults():
    got = {k: p.default for k, p in inspect.signature(network.train_relu_classifier).parameters.items()}
    assert (got["hidden"], got["epochs"], got["rate"], got["batch"], got["patience"]) == (512, 50, 1e-3, 64, 5)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    weights = network.first_weights(3, 5, 4, 1)
    x, y = rng.normal(size=(7, 3)), rng.integers(0, 4, 7)
    slopes, loss = network.gradient(weights, x, y)
    for w, g in zip(weights, slopes):
        for at in np.ndindex(*w.shape):
            w[at] += 1e-6
            assert g[at] == pytest.approx((network.gradient(weights, x, y)[1] - loss) / 1e-6, abs=1e-4)
            w[at] -= 1e-6


def test_adam_step():
    w, moments = [np.array([1.0, -2.0])], [np.zeros(2), np.zeros(2)]
    network.adam(w, moments, [np.array([0.5, -4.0])], 1, 0.1)
    assert w[0] == pytest.approx([0.9, -1.9], abs=1e-6)  # the first step is the rate, whatever the slope
    m, v = 0.1 * 0.5 * 0.9 + 0.1 * 1.5, 0.001 * 0.25 * 0.999 + 0.001 * 2.25
    network.adam(w, moments, [np.array([1.5, 0.0])], 2, 0.1)
    assert w[0][0] == pytest.approx(0.9 - 0.1 * (m / (1 - 0.81)) / np.sqrt(v / (1 - 0.999**2)), abs=1e-6)


def local_run(x, y, weights, epochs, size, seed, rate):
    """The same steps in one process."""
    moments, steps, count = [np.zeros_like(w) for w in weights * 2], -(-len(y) // size), 0
    for epoch in range(epochs):
        order = np.random.default_rng([seed, epoch, 0]).permutation(len(y))
        for step in range(steps):
            mine = order[step * size : (step + 1) * size]
            slopes, _ = network.gradient(weights, x[mine], y[mine])
            count += 1
            network.adam(weights, moments, [g / len(mine) for g in slopes], count, rate)
    return weights


def test_steps_are_those_of_one_process(spark, rings):
    found = network.train_relu_classifier(rings, "v", "label", hidden=6, epochs=2, rate=0.01, held_out=rings.limit(0), seed=3)
    mixed = "xxhash64(v, label, 3)"
    rows = rings.selectExpr("v", "label", f"{mixed} AS h").orderBy("h", "label").collect()
    x = np.array([r["v"] for r in rows], np.float32).astype(float)
    y = np.array([r["label"] for r in rows])
    want = local_run(x, y, network.first_weights(2, 6, 2, 3), 1 + found.best, 64, 3, 0.01)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(found.weights, want))


def test_learns_what_no_line_parts(rings):
    model = network.train_relu_classifier(rings, "v", "label", hidden=32, epochs=40, rate=0.02)
    assert model.transform(rings).where("prediction = label").count() > 270
    first, last = model.losses[0], model.losses[model.best]
    assert last[1] < first[1] and last[1] == min(v for _, v in model.losses)
    scored = scoring.score_clips(model.transform(rings), "v", model.layers).limit(20).collect()
    assert all(r["predictions"] == pytest.approx(r["probability"], abs=1e-9) for r in scored)


def test_stops_when_the_held_out_loss_stalls(spark, rings):
    noise = spark.createDataFrame([([float(i % 7), 1.0], (i * 7919) % 2) for i in range(60)], "v array<double>, label int")
    model = network.train_relu_classifier(rings, "v", "label", hidden=8, epochs=30, rate=0.05, patience=2, held_out=noise)
    judged = [v for _, v in model.losses]
    assert len(judged) < 30 and model.best == judged.index(min(judged)) == len(judged) - 3


def test_a_stopped_run_goes_on_to_the_same_weights(rings, tmp_path):
    sizes = {"hidden": 5, "rate": 0.01, "patience": 50}
    whole = network.train_relu_classifier(rings, "v", "label", epochs=5, **sizes)
    path = f"file://{tmp_path}/run"
    network.train_relu_classifier(rings, "v", "label", epochs=2, path=path, **sizes)
    went_on = network.train_relu_classifier(rings, "v", "label", epochs=5, path=path, **sizes)
    assert all((a == b).all() for a, b in zip(whole.weights, went_on.weights)) and whole.losses == went_on.losses


def test_many_tasks(rings, monkeypatch):
    monkeypatch.setattr(network, "TASK_ROWS", 50)
    model = network.train_relu_classifier(rings, "v", "label", hidden=16, epochs=20, rate=0.02)
    assert model.transform(rings).where("prediction = label").count() > 240


def test_odd_rows(spark, rings, tmp_path):
    odd = spark.createDataFrame(
        [(1, None, 0), (2, [float("nan"), 1.0], 1), (3, [None, 1.0], 1), (4, [1.0, 1.0], None)], rings.schema
    )
    one = network.train_relu_classifier(rings, "v", "label", hidden=4, epochs=1)
    two = network.train_relu_classifier(rings.unionByName(odd), "v", "label", hidden=4, epochs=1)
    assert all((a == b).all() for a, b in zip(one.weights, two.weights))
    assert [r["prediction"] is None for r in two.transform(odd).orderBy("id").collect()] == [True, True, True, False]
    with pytest.raises(ValueError):
        network.train_relu_classifier(odd.where("id < 4"), "v", "label")
    two.save(str(tmp_path / "net"))
    again = network.ReluClassifier.load(spark, str(tmp_path / "net"))
    assert again.best == two.best and all((a == b).all() for a, b in zip(again.weights, two.weights))


def test_an_epoch_over_many_partitions_makes_whole_mini_batches(spark, rings, monkeypatch):
    monkeypatch.setattr(network, "TASK_ROWS", 30)
    seen, jobs, step = [], [], network.adam

    def counted(context, *args, run=type(spark.sparkContext).runJob):
        jobs.append(1)
        return run(context, *args)

    def told(weights, moments, slopes, count, rate):
        seen.append(count)
        step(weights, moments, slopes, count, rate)

    monkeypatch.setattr(network, "adam", told)
    sizes = {"hidden": 6, "rate": 0.01, "held_out": rings.limit(0), "seed": 3, "batch": 4, "epochs": 2}
    monkeypatch.setattr(type(spark.sparkContext), "runJob", counted)
    found = network.train_relu_classifier(rings, "v", "label", **sizes)
    # 75 steps of an epoch in as many jobs as there are partitions, none of them by the driver.
    assert 2 * 2 <= len(jobs) <= 2 * 10 and not seen
    assert found.losses[1][0] < found.losses[0][0]


def test_rows_that_do_not_fill_a_mini_batch_go_on(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(50, 3)).astype(np.float32), rng.integers(0, 2, 50).astype(np.int32)
    weights = network.first_weights(3, 5, 2, 1)
    want = [w.copy() for w in weights]
    state, losses = (weights, [np.zeros_like(w) for w in weights * 2], 0, (x[:0], y[:0])), 0.0
    first = [w.copy() for w in weights]
    order = []
    for part, (low, high) in enumerate([(0, 21), (21, 24), (24, 50)]):
        shared = type("Shared", (), {"value": state})
        (state, loss), = network._visit(part, [(x[low:high], y[low:high])], shared, [7, 0], 8, 0.01, high == 50)
        losses += loss
        order += [low + k for k in np.random.default_rng([7, 0, part]).permutation(high - low)]
    moments = [np.zeros_like(w) for w in want * 2]
    for step, begin in enumerate(range(0, 50, 8)):
        mine = order[begin : begin + 8]
        slopes, loss = network.gradient(want, x[mine], y[mine])
        network.adam(want, moments, [g / len(mine) for g in slopes], step + 1, 0.01)
        losses -= loss
    assert state[2] == 7 and not len(state[3][1]) and abs(losses) < 1e-9
    assert all((a == b).all() for a, b in zip(state[0], want))
    assert all((a == b).all() for a, b in zip(weights, first))  # what was shared stays as it was


def test_held_out_rows_judge_the_best_epoch_over_many_partitions(rings, monkeypatch):
    monkeypatch.setattr(network, "TASK_ROWS", 60)
    train, aside = rings.where("id >= 60"), rings.where("id < 60")
    model = network.train_relu_classifier(train, "v", "label", hidden=8, epochs=4, rate=0.02, held_out=aside)
    own = "avg(-ln(probability[label]))"
    judged = model.transform(aside).selectExpr(f"{own} AS loss").first()["loss"]
    assert judged == pytest.approx(model.losses[model.best][1], abs=1e-9)
    assert model.losses[-1][0] < model.losses[0][0]
    # 240 rows in mini-batches of 64: four steps an epoch, whatever the partitions.
    calls, visit = [], network._visit
    monkeypatch.setattr(network, "partial", lambda f, **kept: calls.append(kept.get("last")) or __import__("functools").partial(f, **kept))
    network.train_relu_classifier(train, "v", "label", hidden=8, epochs=1, rate=0.02, held_out=aside)
    assert visit is network._visit and calls.count(True) == 1 and 1 <= calls.count(False) <= 3
