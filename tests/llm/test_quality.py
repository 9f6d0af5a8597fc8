import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigframe.llm import quality


def corpus(prose, n=400):
    docs, labels = [], []
    for k in range(n):
        words = prose(k, 20 + k % 60)
        bad = k % 6 == 0
        if bad:
            words = [w.upper() + "!!" if k % 12 else w + " |" for w in words]
        docs.append((k, " ".join(words)))
        if k % 2 == 0:
            labels.append((k, 0 if bad else 1, k % 2))
    return docs, labels


def test_held_out_accuracy(frame, prose):
    docs, labels = corpus(prose)
    rows = quality.classify(
        frame(docs, "doc_id long, text string"), frame(labels, "doc_id long, quality int, toxic int")
    ).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d, _ in docs if zlib.crc32(str(d).encode()) % 5 == 0}
    wrong = [r for r in held if r.predicted != (r.doc_id % 6 != 0)]
    assert len(held) > 50 and len(wrong) <= 0.03 * len(held)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_do_not_matter(frame, prose):
    docs, labels = corpus(prose, 150)
    table = frame(docs, "doc_id long, text string")
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    a, b = (
        sorted(map(tuple, quality.classify(table, frame(x, "doc_id long, quality int, toxic int")).collect()))
        for x in (labels, flipped)
    )
    assert a == b


def test_weights_minimise_the_pairwise_loss():
    draw = np.random.default_rng(1)
    truth = np.array([1.5, -2.0, 0.0, 0.5])
    rows = draw.normal(size=(600, 4))
    good = draw.random(600) < 1 / (1 + np.exp(-rows @ truth))
    model = quality.fit_ranking(rows, good)
    assert np.corrcoef(model.weights * 1.0, truth)[0, 1] > 0.98
    # The order of scores is that of the utilities, and the limit has score 0.3.
    scores = model.score(rows)
    assert (np.argsort(scores, kind="stable") == np.argsort(model.utility(rows), kind="stable")).all()
    assert np.isclose(1 / (1 + np.exp(-np.log(3 / 7))), 0.3)


def test_repeats():
    texts = pa.array(["a b a a", "", "x\nx\ny", None, "one"])
    found = quality.text_features(texts)
    words, lines = found[:, -3], found[:, -2]
    assert words.tolist() == [0.5, 0, 1 / 3, 0, 0]
    assert lines[0] == 0 and lines[2] == 1 / 3
    assert (found[1] == found[3]).all()


def test_repeats_against_brute_force():
    draw = random.Random(5)
    offsets = np.cumsum([0] + [draw.randint(0, 9) for _ in range(50)])
    hashes = np.array([draw.randrange(6) for _ in range(offsets[-1])], np.uint64)
    expected = [
        b - a - len(set(hashes[a:b].tolist())) for a, b in zip(offsets[:-1], offsets[1:])
    ]
    assert quality._repeats(hashes, offsets).tolist() == expected


def test_odd_rows(odd_docs, no_docs, frame):
    labels = frame(
        [(1, 1, 0), (1, 0, 0), (9, 0, 0), (7, 1, None), (3, None, 1), (None, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    found = quality.classify(odd_docs, labels).collect()
    assert len(found) == 13 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (3, 4)}) == 1
    assert quality.classify(no_docs, labels).count() == 0
    same = quality.classify(odd_docs, labels.limit(0)).collect()
    assert {round(r.score, 12) for r in same} == {0.3} and {r.predicted for r in same} <= {0, 1}


def test_labels_of_any_number_count(spark):
    """Bad texts that come last in the order of hashed ids, after 20,000 good ones."""
    ids = spark.range(27_000).select(F.col("id").alias("doc_id")).filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rank = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = ids.select("doc_id", (rank <= 20_000).cast("int").alias("quality"))
    text = F.when(F.col("quality") == 1, F.concat(F.lit("ba ko li "), "doc_id")).otherwise(F.concat(F.lit("!!! | "), "doc_id"))
    found = quality.classify(rows.select("doc_id", text.alias("text")), rows).join(rows, "doc_id")
    counts = {(r.quality, r.predicted): r["count"] for r in found.groupBy("quality", "predicted").count().collect()}
    assert set(counts) == {(0, 0), (1, 1)} and counts[1, 1] == 20_000 and counts[0, 0] > 1_000


def labelled(spark, n, share_good, seed=3):
    """Rows of features, of which the first three tell good from bad, and some are equal."""
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, quality.N_CLASSES + 7)), 1).astype(np.float32) + np.float32(0)
    x[: n // 10] = x[0]
    order = x[:, :3] @ [2.0, -1.0, 0.5] + draw.logistic(size=n)
    good = order > np.quantile(order, 1 - share_good)
    rows = [(bool(g), r.tolist()) for g, r in zip(good, x)]
    return spark.createDataFrame(rows, "good boolean, features array<float>"), x, good


def test_blocks_hold_every_row_and_both_classes(spark):
    table, x, good = labelled(spark, 2_000, 0.005)
    train = table.groupBy("good", "features").agg(F.count("*").alias("n"))
    sizes = {True: int(good.sum()), False: int((~good).sum())}
    blocks = quality.dealt_blocks(train, sizes, block_rows=100, partners=5).collect()
    assert len(blocks) == 20 and max(len(g) for _, _, g, _ in blocks) < 200
    seen = {}
    for k, rows, kinds, copies in blocks:
        assert kinds.any() and not kinds.all()
        better, worse = quality.drawn_pairs(kinds, copies, k, 8)
        for part in (better, worse):
            times = np.bincount(part, minlength=len(kinds))
            chosen = np.unique(part)
            assert (times[chosen] >= 8 * copies[chosen]).all()
        assert set(better) == set(np.flatnonzero(kinds)) and set(worse) == set(np.flatnonzero(~kinds))
        for row, kind, n in zip(rows, kinds, copies):
            key = (bool(kind), row.tobytes())
            seen[key] = seen.get(key, 0) + int(n)
    times = {True: min(20, -(-100 // sizes[True])), False: 1}
    expected = {}
    for row, kind in zip(x, good):
        key = (bool(kind), row.tobytes())
        expected[key] = expected.get(key, 0) + times[bool(kind)]
    assert seen == expected


def test_fit_in_blocks_is_that_of_one_block(spark):
    table, x, good = labelled(spark, 3_000, 0.3)
    whole = quality.fit_ranking(x, good)
    one = quality.fit_labelled(table)
    assert np.allclose(one.centre, x.mean(axis=0, dtype=float)) and np.allclose(one.scale, x.std(axis=0, dtype=float))
    many = quality.fit_labelled(table.repartition(5), block_rows=200)
    again = quality.fit_labelled(table.repartition(3), block_rows=200)
    assert (many.weights == again.weights).all() and many.limit == again.limit
    for model in (one, many):
        assert np.corrcoef(model.utility(x), whole.utility(x))[0, 1] > 0.99
        # The limit is the best of all scores, counted one by one.
        u = model.utility(x)
        scores = np.unique(u)
        up, down = int(good.sum()), int((~good).sum())
        gains = [int((u[~good] < s).sum()) * up - int((u[good] < s).sum()) * down for s in scores]
        best = int(np.argmax(gains))
        assert 0 < best and model.limit == (scores[best] + scores[best - 1]) / 2
