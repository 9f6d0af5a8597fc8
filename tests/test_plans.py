import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.operators import profile, vectors
from sigframe.plans import classifier, quantizer, scoring, sequence_embedding


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 0], [0, 0, 10.0]])
    rows = [(i, i % 4, (centres[i % 4] + rng.normal(scale=0.5, size=3)).tolist()) for i in range(240)]
    return spark.createDataFrame(rows, "id long, label int, v array<double>").cache()


def objective(df):
    return profile.cluster_objective(df).first()[0]


def test_tokenizer_finds_the_blobs(spark, blobs):
    tokenizer = quantizer.build_tokenizer(blobs, "v", k=4, seed=1, restarts=2)
    assert len({tuple(r["centroid"]) for r in tokenizer.codebook.collect()}) == 4
    found = quantizer.tokenize(blobs, tokenizer, "v", distance="distance")
    assert found.groupBy("label").agg(F.countDistinct("token").alias("n")).where("n > 1").count() == 0
    random_book = spark.createDataFrame([(i, r["v"]) for i, r in enumerate(blobs.limit(4).collect())], quantizer.CODEBOOK_SCHEMA)
    other = quantizer.tokenize(blobs, quantizer.Tokenizer(random_book), "v", distance="distance")
    assert objective(found) <= objective(other)


def test_tokenizer_repeats(blobs):
    books = [quantizer.build_tokenizer(blobs, "v", k=4, seed=1).codebook.orderBy("token").collect() for _ in range(2)]
    for one, two in zip(*books):
        assert one["centroid"] == pytest.approx(two["centroid"], abs=1e-9)


def lloyd(data, centroids, rounds):
    for _ in range(rounds):
        nearest = ((data[:, None] - centroids[None]) ** 2).sum(2).argmin(1)
        centroids = np.array([data[nearest == j].mean(0) if (nearest == j).any() else c for j, c in enumerate(centroids)])
    return centroids


def test_large_kmeans_is_lloyds_algorithm(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(400, 3))
    df = spark.createDataFrame([(r.tolist(),) for r in data], "v array<double>").repartition(5)
    seeds = quantizer._seeds(df, "v", 6, 42)
    found, cost = quantizer.fit_kmeans(df, "v", 6, iters=7, seed=42)
    assert np.allclose(found, lloyd(data, seeds, 7), atol=1e-9)
    again, _ = quantizer.fit_kmeans(df.repartition(3), "v", 6, iters=7, seed=42)
    assert np.allclose(found, again, atol=1e-9)
    before = ((data[:, None] - seeds[None]) ** 2).sum(2).min(1).sum()
    assert 0 < cost < before


def test_large_kmeans_with_many_copies(spark):
    # A third of the rows are one vector, and another third has no vector at all.
    rows = [([1.0, 1.0],)] * 300 + [(None,)] * 300 + [([float(i), float(i % 7)],) for i in range(300)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(6)
    seeds = quantizer._seeds(df.where("v IS NOT NULL"), "v", 40, 1)
    assert len({tuple(s) for s in seeds}) == 40
    found, _ = quantizer.fit_kmeans(df, "v", 40, iters=5)
    assert len({tuple(c) for c in found}) == 40
    few, cost = quantizer.fit_kmeans(df.where("v[0] = 1.0"), "v", 40, iters=3)
    assert len(few) <= 2 and cost < 1e-9


def test_large_kmeans_refills_empty_clusters(spark, monkeypatch):
    data = np.concatenate([np.zeros((50, 2)), np.ones((50, 2)), np.full((50, 2), 5.0)])
    data += np.random.default_rng(0).normal(scale=0.01, size=data.shape)
    df = spark.createDataFrame([(r.tolist(),) for r in data], "v array<double>")
    far = np.array([[0.5, 0.5], [5.0, 5.0], [1e6, 1e6]])
    monkeypatch.setattr(quantizer, "_seeds", lambda *args: far)
    found, cost = quantizer.fit_kmeans(df, "v", 3, iters=25)
    assert sorted(round(c[0]) for c in found) == [0, 1, 5] and cost < 1


def test_kmeans_leaves_out_what_is_not_finite(spark):
    rng = np.random.default_rng(2)
    good = [(r.tolist(),) for r in rng.normal(size=(300, 2))]
    nan, inf = float("nan"), float("inf")
    bad = [([nan, 0.0],), ([inf, 0.0],), ([-inf, nan],), ([None, 1.0],), (None,)]
    df = spark.createDataFrame(good + bad, "v array<double>")
    clean = spark.createDataFrame(good, "v array<double>")
    found, _ = quantizer.fit_kmeans(df, "v", 5, iters=4)
    assert np.isfinite(found).all() and np.allclose(found, quantizer.fit_kmeans(clean, "v", 5, iters=4)[0])
    assert quantizer.unusable_vectors(df, "v").first().asDict() == {"n_rows": 305, "n_unusable": 5}
    tokens = quantizer.tokenize(df, quantizer.build_tokenizer(df, "v", 5, 4), "v")
    assert tokens.where("token IS NULL").count() == 5


def test_rotation_is_orthonormal_and_centred(blobs):
    model = quantizer.fit_rotation(blobs, "v")
    components = model.stages[1].pc.toArray()
    assert np.allclose(components.T @ components, np.eye(3), atol=1e-9)
    turned = vectors.rotate(blobs, "v", model)
    stats = vectors.mean_vector(turned, [], "rotated").first()["rotated"]
    assert np.allclose(stats, 0, atol=1e-9)
    shares = [r["share"] for r in profile.explained_variance(turned, "rotated").orderBy("pos").collect()]
    assert shares == sorted(shares, reverse=True)


def test_pca_tokenizer_round_trip(spark, blobs, tmp_path):
    tokenizer = quantizer.build_pca_tokenizer(blobs, "v", k=4, seed=3)
    tokenizer.save(str(tmp_path / "tok"))
    loaded = quantizer.Tokenizer.load(spark, str(tmp_path / "tok"), rotated=True)
    one = {r["id"]: r["token"] for r in quantizer.tokenize(blobs, tokenizer, "v").collect()}
    two = {r["id"]: r["token"] for r in quantizer.tokenize(blobs, loaded, "v").collect()}
    assert one == two and len(set(one.values())) == 4


def test_cluster_embeddings(blobs):
    found = quantizer.cluster_embeddings(blobs, "v", k=4, seed=0)
    assert sorted(r["count"] for r in profile.value_counts(found, ["cluster"]).collect()) == [60] * 4


def test_word2vec_chain(spark):
    rng = np.random.default_rng(2)
    rows = [(f"f{i // 80}", (i % 80) / 8.0, rng.normal(size=4).tolist()) for i in range(320)]
    frames = spark.createDataFrame(rows, "file string, timestamp double, mfcc array<double>")
    tokenizer = quantizer.build_tokenizer(frames, "mfcc", k=5, iters=5)
    model = sequence_embedding.train_frame_vectors(frames, tokenizer, size=8, window=3)
    words = sequence_embedding.word_vectors(model)
    assert words.count() == 5 and {len(r["word_vector"]) for r in words.collect()} == {8}
    found = sequence_embedding.embed_word2vec(frames, tokenizer, model).collect()
    assert {(r["file"], r["start_time"]) for r in found} == {(f"f{i}", s) for i in range(4) for s in (0, 5)}
    assert all(len(r["mfcc_stats"]) == 8 and len(r["word_vector"]) == 8 and r["n_unknown"] == 0 for r in found)
    drawn = sequence_embedding.train_frame_skipgrams(frames, tokenizer, size=6, window=3, epochs=10)
    found = sequence_embedding.embed_word2vec(frames, tokenizer, drawn).collect()
    assert len(found) == 8 and all(len(r["word_vector"]) == 6 and r["n_unknown"] == 0 for r in found)


def test_label_codes(frame):
    df = frame([("b",), ("a",), ("c",), ("a",)], "label string")
    assert {r["label"]: r["idx"] for r in classifier.label_encode(df, "label").collect()} == {"a": 0, "b": 1, "c": 2}
    train = df.where("label <> 'b'")
    with pytest.raises(Exception, match="no code for b"):
        classifier.label_encode(df, "label", fit_on=train).collect()
    lenient = classifier.label_encode(df, "label", fit_on=train, strict=False)
    assert {r["label"]: r["idx"] for r in lenient.collect()} == {"a": 0, "b": None, "c": 1}


def test_balanced_weights(frame):
    df = frame([("a",), ("a",), ("a",), ("b",)], "label string")
    weights = {r["label"]: r["weight"] for r in classifier.balanced_weights(df, "label").collect()}
    assert weights == pytest.approx({"a": 4 / 6, "b": 2.0})


def test_network_learns_and_layers_repeat_it(blobs):
    model, report = classifier.evaluate(
        blobs, blobs, lambda d: classifier.train_classifier(d, "v", "label", hidden=8, max_iter=60, seed=5), "label"
    )
    row = report.first()
    assert row["accuracy"] > 0.95 and row["f1"] > 0.95 and row["wall_clock_fit"] > 0
    scored = scoring.score_clips(model.transform(blobs), "v", scoring.network_layers(model.model), hidden="sigmoid")
    for r in scored.limit(20).collect():
        assert r["predictions"] == pytest.approx(r["probability"].toArray().tolist(), abs=1e-9)


def test_boosted_trees_learn(blobs):
    weighted = classifier.balanced_weights(blobs, "label")
    model = classifier.train_boosted_trees(weighted, "v", "label", trees=3, depth=3, weight="weight")
    assert model.transform(blobs).where("prediction = label").count() > 220


def test_search_prefers_the_better_point(blobs):
    def build(train, max_iter):
        return classifier.train_classifier(train, "v", "label", hidden=6, max_iter=max_iter, seed=5)

    scores, best = classifier.search_params(blobs, build, {"max_iter": [1, 60]}, "id", "label", folds=2)
    assert scores.count() == 4 and best == {"max_iter": 60}


def test_param_points():
    grid = {"depth": [3, 4, 5], "trees": [400]}
    assert len(classifier.param_points(grid)) == 3
    assert len(classifier.param_points(grid, "random", draws=5)) == 3
    with pytest.raises(ValueError):
        classifier.param_points(grid, "bayesian")


def test_submission(frame):
    df = frame([("d/x.ogg", 10.0, [1.0, 0.0]), ("d/x.ogg", 5.0, [0.0, 1.0])], "file string, end_time double, v array<double>")
    scored = scoring.score_clips(df, "v", [(np.eye(2), np.zeros(2))])
    rows = scoring.submission(scored, {"b": 1, "a": 0}).collect()
    assert [r["row_id"] for r in rows] == ["x_10", "x_5"]
    assert rows[0].asDict().keys() == {"row_id", "a", "b"}
    assert rows[0]["a"] == pytest.approx(np.e / (np.e + 1))


def test_models_round_trip(spark, blobs, tmp_path):
    from sigframe.sources import sinks

    model = quantizer.fit_rotation(blobs, "v")
    sinks.save_model(model, str(tmp_path / "rotation"))
    again = sinks.load_model(spark, str(tmp_path / "rotation"))
    assert np.allclose(again.stages[1].pc.toArray(), model.stages[1].pc.toArray())
    fitted = classifier.train_classifier(blobs, "v", "label", hidden=4, max_iter=5)
    sinks.save_model(fitted.model, str(tmp_path / "net"))
    fitted.save(str(tmp_path / "both"))
    assert classifier.FittedClassifier.load(spark, str(tmp_path / "both")).vec == "v"
    again = classifier.FittedClassifier(sinks.load_model(spark, str(tmp_path / "net")), "v")
    assert again.transform(blobs).select("id", "prediction").collect() == fitted.transform(blobs).select("id", "prediction").collect()


def test_kmeans_over_placed_rows_is_lloyds_algorithm(spark):
    # Enough centroids for rows to be placed by the space; a quarter of the rows are one vector.
    rng = np.random.default_rng(6)
    data = np.vstack([rng.normal(size=(1500, 2)), np.full((500, 2), 0.25)])
    df = spark.createDataFrame([(r.tolist(),) for r in data] + [(None,), ([float("nan"), 0.0],)], "v array<double>").repartition(5)
    seeds = quantizer._seeds(df.where(quantizer.finite("v")), "v", 300, 42)
    found, cost = quantizer.fit_kmeans(df, "v", 300, iters=4, seed=42)
    assert len(seeds) == 300 and np.allclose(found, lloyd(data, seeds, 4), atol=1e-9)
    last = lloyd(data, seeds, 3)
    assert cost == pytest.approx(((data[:, None] - last[None]) ** 2).sum(2).min(1).sum())


def test_a_round_of_kmeans_sends_slices(spark, monkeypatch):
    monkeypatch.setattr(quantizer, "SLICE_CELLS", 12)
    data = np.random.default_rng(7).normal(size=(300, 3))
    df = spark.createDataFrame([(r.tolist(),) for r in data], "v array<double>").repartition(4)
    seeds = quantizer._seeds(df, "v", 11, 42)
    assert np.allclose(quantizer.fit_kmeans(df, "v", 11, iters=3)[0], lloyd(data, seeds, 3), atol=1e-9)


def test_frames_are_tokenized_once_for_training(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"f{i // 30}", i / 8.0, rng.normal(size=4).tolist()) for i in range(60)] + [("f0", None, None)]
    frames = spark.createDataFrame(rows, "file string, timestamp double, mfcc array<double>")
    tokenizer = quantizer.build_tokenizer(frames, "mfcc", k=5, iters=2)
    got = []
    monkeypatch.setattr(sequence_embedding, "train_token_vectors", lambda df, *args: got.append(df))
    sequence_embedding.train_frame_vectors(frames, tokenizer, sample=1e-1)
    assert "ArrowEvalPython" not in got[0]._jdf.queryExecution().executedPlan().toString()
    sequence_embedding.train_frame_vectors(frames, tokenizer)
    want = quantizer.tokenize(frames, tokenizer).select("file", "timestamp", "token").collect()
    assert sorted(got[1].collect(), key=str) == sorted(want, key=str)


def test_a_saved_rotated_tokenizer_of_placed_rows_gives_the_same_tokens(spark, tmp_path, monkeypatch):
    from sigframe.functions import kernels

    monkeypatch.setattr(kernels, "LARGE_BOOK", 64)
    data = np.random.default_rng(8).normal(size=(1200, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(data)], "id long, v array<double>").repartition(4)
    built = quantizer.build_pca_tokenizer(df, "v", k=300, iters=2)
    built.save(str(tmp_path / "tok"))
    loaded = quantizer.Tokenizer.load(spark, str(tmp_path / "tok"), rotated=True)
    one, two = ({r["id"]: r["token"] for r in quantizer.tokenize(df, t, "v").collect()} for t in (built, loaded))
    assert one == two and len(set(one.values())) == 300 and kernels.leaves_of(np.eye(3), 3) is not None
