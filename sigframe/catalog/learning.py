"""Tokenizers, sequence embeddings, classifiers and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigframe.catalog.registry import CLIPS, FRAMES, clips, frames, query, rounded, table
from sigframe.catalog.projections import SPREAD
from sigframe.functions.arrays import argmax, dot, l2_normalize
from sigframe.operators import sampling, vectors
from sigframe.plans import classifier, network, quantizer, scoring, sequence_embedding, skipgram
from sigframe.runtime import scratch_path
from sigframe.sources import scans, sinks


def _codebook_facts(spark, tokenizer, train, k):
    """What does not depend on the seeds: tokens, widths, and that training helped."""
    space, vec = train, "mfcc"
    if tokenizer.rotation is not None:
        space, vec = vectors.rotate(train, "mfcc", tokenizer.rotation, "_turned"), "_turned"
    first = space.groupBy(vec).agg(F.lit(1)).orderBy(F.xxhash64(vec)).limit(k).select(vec)
    plain = quantizer.codebook_of(spark, [np.array(r[vec]) for r in first.collect()])

    def cost(book):
        found = quantizer.tokenize(space, quantizer.Tokenizer(book, None), vec, distance="d")
        return found.agg(F.sum("d")).first()[0]

    better = cost(tokenizer.codebook) <= cost(plain)
    usable = quantizer.finite("centroid")
    return tokenizer.codebook.select(
        "token", F.size("centroid").alias("width"), usable.alias("usable"), F.lit(better).alias("better")
    )


TOKENS_OF = """SELECT token, 4 AS width, TRUE AS usable, TRUE AS better
FROM range(least({k}, (SELECT count(DISTINCT (l_quantity, l_extendedprice, l_discount, l_tax))
                       FROM lineitem WHERE l_orderkey % 100 < 80))) AS t(token)"""


@query("build_tokenizer", TOKENS_OF.format(k=32))
def build_tokenizer(spark, sf):
    train, _ = sampling.train_holdout_by_part(frames(spark, sf))
    return _codebook_facts(spark, quantizer.build_tokenizer(train, "mfcc", k=32), train, 32)


@query("build_large_tokenizer", TOKENS_OF.format(k=1023))
def build_large_tokenizer(spark, sf):
    train, _ = sampling.train_holdout_by_part(frames(spark, sf))
    return _codebook_facts(spark, quantizer.build_tokenizer(train, "mfcc", k=1023), train, 1023)


@query("build_pca_tokenizer", TOKENS_OF.format(k=32))
def build_pca_tokenizer(spark, sf):
    train, _ = sampling.train_holdout_by_part(frames(spark, sf))
    return _codebook_facts(spark, quantizer.build_pca_tokenizer(train, "mfcc", k=32), train, 32)


# The queries named _full leave every size to the functions; the SQL of the others states
# a smaller one.
@query("build_tokenizer_full", TOKENS_OF.format(k=16383))
def build_tokenizer_full(spark, sf):
    train, _ = sampling.train_holdout_by_part(frames(spark, sf))
    return _codebook_facts(spark, quantizer.build_tokenizer(train, "mfcc"), train, 16383)


@query("build_pca_tokenizer_full", TOKENS_OF.format(k=16383))
def build_pca_tokenizer_full(spark, sf):
    train, _ = sampling.train_holdout_by_part(frames(spark, sf))
    return _codebook_facts(spark, quantizer.build_pca_tokenizer(train, "mfcc"), train, 16383)


# The signs of components are arbitrary, but a rotation keeps distances to the centre.
@query("rotate", """WITH centre AS (
  SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) AS t(i) GROUP BY i)
SELECT vec_id, 64 AS width, round(sum(pow(embedding[i]::DOUBLE - m, 2)), 6) AS squared_norm
FROM embeddings, centre GROUP BY vec_id""")
def rotate(spark, sf):
    data = table(spark, sf, "embeddings").select("vec_id", "embedding")
    model = quantizer.fit_rotation(data, "embedding")
    turned = vectors.rotate(data, "embedding", model)
    return turned.select(
        "vec_id", F.size("rotated").alias("width"),
        F.round(dot("rotated", "rotated"), 6).alias("squared_norm"),
    )


@query("tokenize", f"""WITH {FRAMES}
SELECT file, count(*) AS n, TRUE AS in_range FROM frames GROUP BY file""")
def tokenize(spark, sf):
    data = frames(spark, sf)
    train, _ = sampling.train_holdout_by_part(data)
    found = quantizer.tokenize(data, quantizer.build_tokenizer(train, "mfcc"))
    return found.groupBy("file").agg(
        F.count("*").alias("n"), F.bool_and(F.col("token").between(0, 16382)).alias("in_range")
    )


@query("cluster_embeddings", f"""WITH {CLIPS}
SELECT DISTINCT file, TRUE AS in_range FROM clips""")
def cluster_embeddings(spark, sf):
    means = vectors.mean_vector(clips(spark, sf), ["file"])
    found = quantizer.cluster_embeddings(means, "embedding", k=5, seed=0)
    return found.select("file", F.col("cluster").between(0, 4).alias("in_range"))


def _word_sizes(spark, sf, **sizes):
    from sigframe.catalog.registry import tokens

    model = skipgram.train_skipgram(tokens(spark, sf), ["file"], ["ts", "event_id"], "token", **sizes)
    start, *_, end = model.losses
    falling = end < 0.9 * start and sum(model.losses[-5:]) < sum(model.losses[1:6])
    return model.vectors.select(
        F.col("token").alias("word"), F.size("word_vector").alias("size"), F.lit(falling).alias("falling")
    )


WORDS = "SELECT DISTINCT event_type AS word, {size} AS size, TRUE AS falling FROM events"


@query("train_word2vec", WORDS.format(size=16))
def train_word2vec(spark, sf):
    return _word_sizes(spark, sf, size=16)


@query("train_word2vec_full", WORDS.format(size=256))
def train_word2vec_full(spark, sf):
    return _word_sizes(spark, sf)


# Series of one kind of event hold two tokens in turn, so the two occur together and with no
# others: each must be the other's nearest token.
@query("word2vec_neighbours", """SELECT DISTINCT concat(event_type, '_', event_id % 2) AS word,
  concat(event_type, '_', 1 - event_id % 2) AS nearest FROM events""")
def word2vec_neighbours(spark, sf):
    from sigframe.catalog.registry import tokens

    kinds = tokens(spark, sf).withColumn("kind", F.col("token"))
    series = kinds.withColumn("token", F.concat_ws("_", "token", F.col("event_id") % 2))
    vectors = skipgram.train_skipgram(series, ["file", "kind"], ["ts", "event_id"]).vectors
    unit = vectors.select("token", l2_normalize("word_vector").alias("v"))
    pairs = unit.join(unit.select(F.col("token").alias("other"), F.col("v").alias("w")), F.col("token") != F.col("other"))
    best = F.max_by("other", F.struct(dot("v", "w"), "other"))
    return pairs.groupBy(F.col("token").alias("word")).agg(best.alias("nearest"))


# The vectors are learned; which buckets exist and their frame statistics are not.
EMBEDDED = f"""WITH {FRAMES}, bucketed AS (
  SELECT file, CASE WHEN timestamp < 100 THEN (floor(timestamp / 5) * 5)::INTEGER ELSE -1 END AS start_time, mfcc
  FROM frames)
SELECT file, start_time, count(*) AS n, round(avg(mfcc[1]), 5) AS first_mean, round(stddev_pop(mfcc[4]), 5) + 0e0 AS last_std,
       {{size}} AS width FROM bucketed GROUP BY file, start_time"""


def _embedded(frames, tokenizer, model):
    found = sequence_embedding.embed_word2vec(frames, tokenizer, model)
    return found.select(
        "file", "start_time", "n",
        F.round(F.get("mfcc_stats", F.lit(0)), 5).alias("first_mean"),
        rounded(F.get("mfcc_stats", F.lit(7)), 5).alias("last_std"),
        F.size("word_vector").alias("width"),
    )


@query("embed_word2vec", EMBEDDED.format(size=16))
def embed_word2vec(spark, sf):
    data = frames(spark, sf)
    train, _ = sampling.train_holdout_by_part(data)
    tokenizer = quantizer.build_tokenizer(train, "mfcc", k=1023)
    model = sequence_embedding.train_frame_skipgrams(train, tokenizer, size=16)
    return _embedded(data, tokenizer, model)


# Hierarchical softmax, one pass: 100 passes with noise words take about an hour of CPU here.
@query("embed_word2vec_full", EMBEDDED.format(size=256))
def embed_word2vec_full(spark, sf):
    data = frames(spark, sf)
    train, _ = sampling.train_holdout_by_part(data)
    tokenizer = quantizer.build_tokenizer(train, "mfcc")
    return _embedded(data, tokenizer, sequence_embedding.train_frame_vectors(train, tokenizer, sample=1e-1))


def _labelled(spark, sf):
    data = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return sampling.stratified_split(data, "label", "vec_id", 0.2, 42)


# Rows of the test side; every prediction must be a class, and the rows of the training
# side be told apart better than by naming the largest class.
TEST_SIDE = f"""WITH ranked AS (
  SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n,
         row_number() OVER (PARTITION BY label
           ORDER BY {SPREAD.format(id="vec_id", seed=42)}, vec_id) - 1 AS pos
  FROM embeddings)
SELECT vec_id, label, TRUE AS known FROM ranked
WHERE pos < least(greatest(1, floor(n * 2e-1 + 5e-1)), n - 1)"""


def _learned(model, train):
    """Whether more training rows are right than the largest class has."""
    hits = F.count_if(F.col("prediction") == F.col("label"))
    right = model.transform(train).agg(hits).first()[0]
    return right > train.groupBy("label").count().agg(F.max("count")).first()[0]


def _predicted(model, train, test, classes=10):
    known = F.col("prediction").isin(*[float(i) for i in range(classes)])
    known = known & F.lit(_learned(model, train))
    return model.transform(test).select("vec_id", "label", known.alias("known"))


@query("train_classifier", TEST_SIDE)
def train_classifier(spark, sf):
    train, test = _labelled(spark, sf)
    model = network.train_relu_classifier(train, "embedding", "label", held_out=test)
    return _predicted(model, train, test)


# A class that can be learned: which of the first four elements is the largest.  The best
# epoch's loss on rows held out is below that of the first weights and of the class shares.
@query("train_classifier_held_out", f"""{TEST_SIDE.split("SELECT vec_id, label, TRUE")[0]},
large AS (SELECT vec_id, list_max(embedding[1:4]) AS top, embedding[1:4] AS head FROM embeddings)
SELECT vec_id, list_position(head, top) - 1 AS class, TRUE AS beats_start, TRUE AS beats_shares, TRUE AS best_kept
FROM ranked JOIN large USING (vec_id)
WHERE pos < least(greatest(1, floor(n * 2e-1 + 5e-1)), n - 1)""")
def train_classifier_held_out(spark, sf):
    sides = [
        some.withColumn("class", argmax(F.slice("embedding", 1, 4))) for some in _labelled(spark, sf)
    ]
    model = network.train_relu_classifier(sides[0], "embedding", "class", held_out=sides[1])
    scored = model.transform(sides[1])
    own = -F.log(F.get("probability", F.col("class")))
    shares = sides[0].groupBy("class").count().withColumn("share", F.col("count") / F.sum("count").over(W.partitionBy()))
    prior = sides[1].join(shares, "class").agg(F.avg(-F.log("share"))).first()[0]
    loss = scored.agg(F.avg(own)).first()[0]
    least = min(judged for _, judged in model.losses)
    facts = {"beats_start": loss < np.log(4), "beats_shares": loss < prior, "best_kept": abs(loss - least) < 1e-6}
    return scored.select("vec_id", "class", *[F.lit(bool(v)).alias(k) for k, v in facts.items()])


# Besides: the loss falls in every tenth round, and probabilities sum to one.
@query("train_boosted_trees", TEST_SIDE.replace("TRUE AS known", "TRUE AS known, TRUE AS falling, TRUE AS sums_to_one"))
def train_boosted_trees(spark, sf):
    train, test = _labelled(spark, sf)
    weighted = classifier.balanced_weights(train, "label")
    model = classifier.train_boosted_trees(weighted, "embedding", "label", weight="weight")
    tenth = model.losses[::10]
    falling = all(a > b for a, b in zip(tenth, tenth[1:]))
    whole = F.abs(F.aggregate("probability", F.lit(0.0), lambda a, p: a + p) - 1) < 1e-9
    known = F.col("prediction").between(0, 9) & F.lit(_learned(model, train))
    return model.transform(test).select(
        "vec_id", "label", known.alias("known"), F.lit(falling).alias("falling"), whole.alias("sums_to_one")
    )


SEARCHED = """SELECT concat('{{"hidden": ', h, '}}') AS params, fold::INTEGER AS fold, TRUE AS sound
FROM (VALUES {points}) AS p(h), range({folds}) AS f(fold)"""


def _searched(spark, sf, hidden, **search):
    data = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")

    def build(train, hidden):
        return classifier.train_classifier(train, "embedding", "label", hidden)

    scores, _ = classifier.search_params(
        data, build, {"hidden": hidden}, "vec_id", "label", **search
    )
    sound = F.lit(True)
    for c in ("accuracy", "precision", "recall", "f1"):
        sound = sound & F.col(c).between(0, 1)
    return scores.select("params", "fold", sound.alias("sound"))


@query("search_params", SEARCHED.format(points="(8), (16)", folds=3))
def search_params(spark, sf):
    return _searched(spark, sf, [8, 16], folds=3)


@query("search_params_full", SEARCHED.format(points="(256), (512)", folds=5))
def search_params_full(spark, sf):
    return _searched(spark, sf, [256, 512])


@query("evaluate", "SELECT TRUE AS sound, TRUE AS timed, (SELECT count(*) > 0 FROM embeddings) AS learned")
def evaluate(spark, sf):
    train, test = _labelled(spark, sf)

    def build(rows):
        return classifier.train_classifier(rows, "embedding", "label")

    _, report = classifier.evaluate(train, test, build, "label")
    scores = ("train_score", "test_score", "accuracy", "precision", "recall", "f1")
    sound = F.lit(True)
    for c in scores:
        sound = sound & F.col(c).between(0, 1)
    timed = (F.col("wall_clock_fit") > 0) & (F.col("wall_clock_pred") > 0)
    # Ten even classes: better than a guess on the rows it was trained on.
    return report.select(
        sound.alias("sound"), timed.alias("timed"), (F.col("train_score") > 0.2).alias("learned")
    )


def _layers():
    """A fixed 64 -> 8 -> 5 network, as a formula the SQL check can repeat."""
    first = ((np.arange(64)[:, None] * 5 + np.arange(8)[None, :] * 3) % 13 - 6) / 6.0
    second = ((np.arange(8)[:, None] * 7 + np.arange(5)[None, :] * 2) % 9 - 4) / 4.0
    return [(first, np.arange(8) / 8.0), (second, np.arange(5) / 10.0)]


SCORED = """hidden AS (
  SELECT file, end_time, vec_id, list_transform(range(8), lambda h: greatest(0, h / 8e0 + list_sum(list_transform(range(64),
    lambda i: embedding[i + 1] * (((i * 5 + h * 3) % 13 - 6) / 6e0))))) AS x FROM clips),
logits AS (
  SELECT file, end_time, vec_id, list_transform(range(5), lambda c: c / 1e1 + list_sum(list_transform(range(8),
    lambda h: x[h + 1] * (((h * 7 + c * 2) % 9 - 4) / 4e0)))) AS z FROM hidden),
scored AS (
  SELECT file, end_time, vec_id, list_transform(z, lambda v: exp(v - list_max(z)) /
    list_sum(list_transform(z, lambda w: exp(w - list_max(z))))) AS p FROM logits)"""


@query("score_clips", f"""WITH {CLIPS}, {SCORED}
SELECT vec_id, (list_position(p, list_max(p)) - 1)::INTEGER AS best, round(p[1], 6) AS p0, round(p[2], 6) AS p1,
       round(p[3], 6) AS p2, round(p[4], 6) AS p3, round(p[5], 6) AS p4 FROM scored""")
def score_clips(spark, sf):
    scored = scoring.score_clips(clips(spark, sf), "embedding", _layers())
    return scored.select(
        "vec_id", argmax("predictions").alias("best"),
        *[rounded(F.get("predictions", F.lit(i))).alias(f"p{i}") for i in range(5)],
    )


@query("submission", f"""WITH {CLIPS}, {SCORED}
SELECT concat(regexp_replace(string_split(file, '/')[-1], '\\.ogg$', ''), '_', end_time::INTEGER) AS row_id,
       round(p[1], 6) AS label_0, round(p[2], 6) AS label_1, round(p[3], 6) AS label_2,
       round(p[4], 6) AS label_3, round(p[5], 6) AS label_4 FROM scored ORDER BY row_id""")
def submission(spark, sf):
    labels = {"label_4": 4, "label_0": 0, "label_2": 2, "label_1": 1, "label_3": 3}
    scored = scoring.score_clips(clips(spark, sf), "embedding", _layers())
    wide = scoring.submission(scored, labels)
    return wide.select("row_id", *[F.round(c, 6).alias(c) for c in wide.columns[1:]])


# Clips to probabilities to the wide table to CSV files, read back.
@query("submission_csv", f"""WITH {CLIPS}, {SCORED}
SELECT concat(regexp_replace(string_split(file, '/')[-1], '\\.ogg$', ''), '_', end_time::INTEGER) AS row_id,
       round(p[1], 6) AS label_0, round(p[2], 6) AS label_1, round(p[3], 6) AS label_2,
       round(p[4], 6) AS label_3, round(p[5], 6) AS label_4 FROM scored""")
def submission_csv(spark, sf):
    scored = scoring.score_clips(clips(spark, sf), "embedding", _layers())
    wide = scoring.submission(scored, {f"label_{i}": i for i in range(5)})
    path = scratch_path(spark, "submission")
    sinks.write_submission(wide, path)
    found = scans.scan_csv(spark, path, ", ".join(["row_id string", *[f"{c} double" for c in wide.columns[1:]]]))
    return found.select("row_id", *[F.round(c, 6).alias(c) for c in wide.columns[1:]])
