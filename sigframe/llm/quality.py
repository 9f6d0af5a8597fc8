"""Quality classifier: Bradley-Terry ranking of documents by preference pairs.

A document's score is a linear function of features of its whole text (how bytes fall
into classes, lengths of words, repeated words and lines).  In every pair one document is labelled good
and one bad; the weights minimise the logistic loss of the difference of their scores.
The threshold is a quantile of the scores of the labelled documents: of all of them the
one that separates the classes best.  Scores are shifted so that the threshold becomes 0.3.

One pass over the texts writes the features.  The fit uses every labelled row that is not
held out: rows are dealt to blocks of bounded size, pairs are drawn within each, and each
Newton step adds up slopes and curvatures of all blocks.  The driver gets one such sum per
task, and one row per task for the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.llm.text import column_bytes, pieces, range_hashes, split_words, sums_by
from sigframe.runtime import durable, shuffle_width

# Labelled rows of the larger class in a block; of the smaller one at least about PARTNERS
# rows, or all there are.
BLOCK_ROWS = 4_000
PARTNERS = 500
PAIRS_EACH = 8
THRESHOLD = 0.3

# A class for each byte: 0 lower case, 1 capital, 2 digit, 3 blank, 4 line end, 5 beyond
# ASCII, 6 control; every punctuation sign has one of its own.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[128:] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 32]], _CLASS[[10, 13]] = 3, 4
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_SIGNS] = 7 + np.arange(len(_SIGNS))
N_CLASSES = 7 + len(_SIGNS)


def _repeats(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, how many of its items equal an earlier one of the same text."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, text))
    again = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        again[1:] = (hashes[a] == hashes[b]) & (text[a] == text[b])
    return sums_by(again, offsets)


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of features per text; an empty or null text has zeros."""
    body, offsets = column_bytes(texts)
    size = np.maximum(np.diff(offsets), 1)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    cells = np.bincount(text * N_CLASSES + _CLASS[body], minlength=len(texts) * N_CLASSES)
    shares = cells.reshape(-1, N_CLASSES) / size[:, None]
    words = split_words(body, offsets)
    n_words = np.diff(words.offsets)
    at_least_one = np.maximum(n_words, 1)
    length = words.ends - words.starts
    is_end = body == 10
    cuts = np.flatnonzero(is_end) + 1
    starts = np.unique(np.concatenate([offsets[:-1], cuts[cuts < len(body)]]))
    starts = starts[starts < len(body)]
    ends = np.append(starts[1:], len(body)) if len(starts) else starts
    lines = np.searchsorted(starts, offsets)
    line_hashes = range_hashes(body.astype(np.uint64) + np.uint64(1), starts, ends)
    n_lines = np.maximum(np.diff(lines), 1)
    more = np.stack([
        np.log1p(n_words),
        sums_by(length, words.offsets) / at_least_one,
        sums_by((length > 12).astype(np.int64), words.offsets) / at_least_one,
        sums_by((length < 4).astype(np.int64), words.offsets) / at_least_one,
        _repeats(words.hashes, words.offsets) / at_least_one,
        _repeats(line_hashes, lines) / n_lines,
        np.log1p(n_lines),
    ], axis=1)
    return np.concatenate([np.sqrt(shares), more], axis=1)


def featured(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, held_out, text``) with ``features`` in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            matrix = text_features(batch["text"]).astype(np.float32)
            flat = pa.array(matrix.ravel())
            bounds = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.ListArray.from_arrays(bounds, flat)],
                names=["doc_id", "held_out", "features"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, features array<float>"
    )


class Ranking:
    """Weights of standardised features and the score that counts as good."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, limit: float):
        self.centre, self.scale, self.weights, self.limit = centre, scale, weights, limit

    def utility(self, features: np.ndarray) -> np.ndarray:
        # Summed row by row: equal rows get equal scores whatever lies beside them.
        return (_standardised(features, self.centre, self.scale) * self.weights).sum(axis=1)

    def score(self, features: np.ndarray) -> np.ndarray:
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        margin = np.clip(self.utility(features) - self.limit, -500, 500)
        return 1 / (1 + np.exp(-(margin + shift)))


def _standardised(features: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    # Clipped so that one odd feature of an odd text can't outweigh all others.
    return np.clip((features - centre) / scale, -8, 8)


# The number of a block, its features, whether a row is good, and how many rows it stands for.
Block = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def drawn_pairs(good: np.ndarray, copies: np.ndarray, seed: int, pairs_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the good and of the bad one of each pair; every row is in ``pairs_each``
    pairs or more for each of its copies, unless it has no counterpart."""
    up, down = (np.repeat(rows, copies[rows]) for rows in (np.flatnonzero(good), np.flatnonzero(~good)))
    if not len(up) or not len(down):
        return up[:0], down[:0]
    draw = np.random.default_rng([11, seed])
    n = pairs_each * max(len(up), len(down))
    better = np.resize(draw.permutation(up), n)
    worse = np.resize(draw.permutation(down), n)
    return better, worse[draw.permutation(n)]


def _class_moments(blocks: Iterable[Block]) -> Iterator[dict[bool, tuple]]:
    """Per class: rows, mean and summed squared deviation of the features."""
    total: dict[bool, tuple] = {}
    for _, x, good, copies in blocks:
        for kind in (False, True):
            n = copies[good == kind]
            if len(n):
                rows = x[good == kind].astype(np.float64)
                mean = n @ rows / n.sum()
                total[kind] = _merged(total.get(kind), (int(n.sum()), mean, n @ (rows - mean) ** 2))
    if total:
        yield total


def _merged(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return b if a is None else a
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap**2 * (a[0] * b[0] / n)


def _pair_sums(
    blocks: Iterable[Block], centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, pairs_each: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slope and curvature of the loss, summed over the pairs of all given blocks."""
    slope, curve = np.zeros(len(weights)), np.zeros((len(weights), len(weights)))
    for k, x, good, copies in blocks:
        rows = _standardised(x, centre, scale)
        better, worse = drawn_pairs(good, copies, k, pairs_each)
        gap = rows[better] - rows[worse]
        p = 1 / (1 + np.exp(np.clip(gap @ weights, -500, 500)))
        slope += gap.T @ p
        curve += (gap * (p * (1 - p))[:, None]).T @ gap
    yield slope, curve


def _fit_weights(
    fold: Callable[[Callable], list], sizes: dict[bool, int], width: int, pairs_each: int, ridge: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights.  ``fold`` applies a function to the blocks of each task
    and gives all results in the order of tasks."""
    classes: dict[bool, tuple | None] = {False: None, True: None}
    for found in fold(_class_moments):
        classes = {kind: _merged(before, found.get(kind)) for kind, before in classes.items()}
    # A class may have been dealt several times over, all its rows equally often.
    both = None
    for kind in (False, True):
        n, mean, spread = classes[kind]
        both = _merged(both, (sizes[kind], mean, spread * (sizes[kind] / n)))
    scale = np.sqrt(both[2] / both[0])
    centre, scale = both[1], np.where(scale > 1e-6, scale, 1.0)
    weights = np.zeros(width)
    for _ in range(25):
        slope, curve = -ridge * weights, ridge * np.eye(width)
        sums = partial(_pair_sums, centre=centre, scale=scale, weights=weights, pairs_each=pairs_each)
        for a, b in fold(sums):
            slope, curve = slope + a, curve + b
        step = np.linalg.solve(curve, slope)
        weights = weights + step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, weights


def _no_ranking(width: int) -> Ranking:
    """Without two classes every document has the score of the threshold."""
    return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)


def fit_ranking(
    features: np.ndarray, good: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = 1.0
) -> Ranking:
    """The fit of ``fit_labelled`` for an array of rows: one block, held whole.

    Without two classes all weights are 0 and every document has the score of the threshold.
    """
    width, sizes = features.shape[1], {True: int(good.sum()), False: int((~good).sum())}
    if not all(sizes.values()):
        return _no_ranking(width)
    order = np.lexsort((*features.T, good))
    block = (0, features[order], good[order], np.ones(len(good), np.int64))
    model = Ranking(*_fit_weights(lambda f: list(f([block])), sizes, width, pairs_each, ridge), 0.0)
    utility, place = np.unique(model.utility(features), return_inverse=True)
    batch = pa.RecordBatch.from_pydict({
        "u": utility, "up": np.bincount(place, good).astype(np.int64),
        "down": np.bincount(place, ~good).astype(np.int64),
    })
    model.limit = _joined_limit(list(_best_limits([batch], sizes)), sizes)
    return model


def _best_limits(batches: Iterable[pa.RecordBatch], sizes: dict[bool, int]) -> Iterator[dict]:
    """The score of a run of rising distinct scores ``u`` (with how many good rows, ``up``,
    and bad ones, ``down``, have it) that separates the classes best if the run is all.

    What lies before the run changes the gain of all its scores alike.
    """
    run = None
    for batch in batches:
        if not batch.num_rows:
            continue
        u, up, down = (batch[c].to_numpy() for c in ("u", "up", "down"))
        if run is None:
            run = {"first": float(u[0]), "last": None, "up": 0, "down": 0, "gain": None}
        # Rows kept wrongly and rightly at each limit, classes counting alike: in whole numbers.
        gain = (run["down"] + np.cumsum(down) - down) * sizes[True] - (run["up"] + np.cumsum(up) - up) * sizes[False]
        k = int(np.argmax(gain))
        if run["gain"] is None or gain[k] > run["gain"]:
            run |= {"gain": int(gain[k]), "best": float(u[k]), "below": float(u[k - 1]) if k else run["last"]}
        run |= {"last": float(u[-1]), "up": run["up"] + int(up.sum()), "down": run["down"] + int(down.sum())}
    if run is not None:
        yield run


def _joined_limit(runs: list[dict], sizes: dict[bool, int]) -> float:
    """The limit that classifies the labelled rows best, both classes counting alike; of
    equals the lowest, which keeps most."""
    up = down = 0
    gain = best = below = last = None
    for run in sorted(runs, key=lambda r: r["first"]):
        here = run["gain"] + down * sizes[True] - up * sizes[False]
        if gain is None or here > gain:
            gain, best, below = here, run["best"], last if run["below"] is None else run["below"]
        up, down, last = up + run["up"], down + run["down"], run["last"]
    # Halfway to the next lower score, as far from either class.
    return best if below is None else (best + below) / 2


def _packed(table: pa.Table) -> pa.Table:
    x = _matrix(table["features"]).astype(np.float32)
    good, copies = (table[c].to_numpy() for c in ("good", "copies"))
    order = np.lexsort((*x.T, copies, good))
    return pa.table({
        "block": table["block"][:1], "x": [x[order].tobytes()],
        "good": [good[order].astype(bool).tobytes()], "copies": [copies[order].tobytes()],
    })


def _opened(row) -> Block:
    good = np.frombuffer(row["good"], bool)
    return row["block"], np.frombuffer(row["x"], np.float32).reshape(len(good), -1), good, np.frombuffer(row["copies"], np.int64)


def dealt_blocks(train: DataFrame, sizes: dict[bool, int], block_rows: int = BLOCK_ROWS, partners: int = PARTNERS) -> RDD:
    """Rows of ``train`` (``good, features, n``) in blocks, by a hash of their content.

    The larger class is dealt once, and a class too small to give each block ``partners``
    rows as often as that takes, at most once to each block.  Copies of a row go to one
    block after the other.
    """
    n_blocks = max(1, -(-max(sizes.values()) // block_rows))
    often = {kind: min(n_blocks, -(-n_blocks * partners // n)) if n < n_blocks * partners else 1 for kind, n in sizes.items()}
    total = F.col("n") * F.when(F.col("good"), often[True]).otherwise(often[False])
    places = F.sequence(F.lit(0), (F.least(F.col("total"), F.lit(n_blocks)) - 1).cast("int"))
    first = F.pmod(F.xxhash64("good", "features"), F.lit(n_blocks))
    rows = train.withColumn("total", total).select("good", "features", "total", F.explode(places).alias("j")).select(
        F.pmod(first + F.col("j"), F.lit(n_blocks)).alias("block"), "good", "features",
        F.expr(f"(total - 1 - j) DIV {n_blocks} + 1").alias("copies"),
    )
    tasks = min(shuffle_width(train.sparkSession), n_blocks)
    packed = rows.repartition(tasks, "block").groupBy("block").applyInArrow(
        _packed, "block long, x binary, good binary, copies binary"
    )
    return packed.rdd.map(_opened)


def fit_labelled(
    labelled: DataFrame, pairs_each: int = PAIRS_EACH, ridge: float = 1.0, block_rows: int = BLOCK_ROWS
) -> Ranking:
    """Bradley-Terry weights and limit from all rows of ``labelled`` (``good, features``).

    Every row is in about ``pairs_each`` pairs or more, each of a good and a bad row.  Equal
    rows are counted and count as often.  Without two classes all weights are 0 and every
    document has the score of the threshold.
    """
    width = N_CLASSES + 7
    train = durable(labelled.groupBy("good", "features").agg(F.count(F.lit(1)).alias("n")), "train")
    sizes = {True: 0, False: 0} | {r["good"]: r["n"] for r in train.groupBy("good").agg(F.sum("n").alias("n")).collect()}
    if not all(sizes.values()):
        return _no_ranking(width)
    blocks = dealt_blocks(train, sizes, block_rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = _fit_weights(lambda f: blocks.mapPartitions(f).collect(), sizes, width, pairs_each, ridge)
    finally:
        blocks.unpersist()
    model = Ranking(*found, 0.0)
    model.limit = best_limit(train, model, sizes)
    return model


def best_limit(train: DataFrame, model: Ranking, sizes: dict[bool, int]) -> float:
    """Of the scores of all rows of ``train`` (``good, features, n``) the best limit.

    Scores are sorted over all tasks; each gives the best of its range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            utility = pa.array(model.utility(_matrix(batch["features"])))
            yield pa.RecordBatch.from_arrays([utility, batch["good"], batch["n"]], names=["u", "good", "n"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _best_limits(batches, sizes):
            yield pa.RecordBatch.from_pylist([found], schema=schema)

    kinds = {"first": pa.float64(), "last": pa.float64(), "best": pa.float64(), "below": pa.float64(),
             "gain": pa.int64(), "up": pa.int64(), "down": pa.int64()}
    schema = pa.schema(list(kinds.items()))
    scores = train.mapInArrow(run, "u double, good boolean, n long").groupBy("u").agg(
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("up"),
        F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("down"),
    )
    ranges = scores.repartitionByRange(shuffle_width(train.sparkSession), "u").sortWithinPartitions("u")
    runs = ranges.mapInArrow(best, "first double, last double, best double, below double, gain long, up long, down long")
    return _joined_limit([r.asDict() for r in runs.collect()], sizes)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Reads ``doc_id, text`` and ``doc_id, quality`` of ``labels``; other columns are
    ignored.  Labels of rows for which ``held_out`` holds are not used (default: crc32
    of the id is divisible by 5; a null id is not held out and has no label); all others
    are.  Null labels are left out; a document labelled twice counts twice.  Null and empty texts
    have zero features and get a score like any other.  Without labels all score 0.3.
    """
    out = held_out if held_out is not None else F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    table = durable(
        featured(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                F.coalesce(out, F.lit(False)).alias("held_out"),
                "text",
            )
        ),
        "features",
    )
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality") == 1)
    marked = marked.toDF("doc_id", "good").filter("good IS NOT NULL")
    model = fit_labelled(table.filter("NOT held_out").join(marked, "doc_id").select("good", "features"))
    return scored(table, model)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0) if flat.num_chunks else pa.array([], pa.list_(pa.float32()))
    width = N_CLASSES + 7
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def scored(table: DataFrame, model: Ranking) -> DataFrame:
    """Scores of a feature table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch["features"]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(score),
                 pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return table.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
