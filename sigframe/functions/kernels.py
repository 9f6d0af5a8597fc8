"""Arrow kernels: dense linear algebra over array columns.

Each factory returns a scalar Arrow UDF, so only the vector column crosses into
Python, in record batches, while the other columns stay in the JVM.  Matrices
travel as broadcast variables: once per executor, not once per task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Ship these helpers inside the UDF so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells of a block of intermediate results a task holds at a time (32 MB).
BLOCK_CELLS = 4_000_000

# Largest network a task may hold.  The widest known one, 2,048 inputs to 10,932
# classes through 512 units, is 53 MB.
MAX_NETWORK_BYTES = 1 << 30

# Cells of a block of the centroid search; it is read three times, so it should stay
# in the processor's cache.
SEARCH_CELLS = 1_000_000

# The pruned centroid search: leaves that give a run of rows its first bound, centroids of a
# leaf, the most elements of a vector for which boxes keep centroids apart, and the cells that
# a run costs besides its own.
NEAR_LEAVES, LEAF_CENTROIDS, MOST_SIDES, RUN_CELLS = 4, 32, 64, 40_000

# Smallest codebooks for which it pays, for rows in the order of :func:`near_order` and for
# those that have to be put into it, and rows that are put into it at a time.
ORDERED_BOOK, LARGE_BOOK, POOL_ROWS = 256, 2048, 1 << 16


def rows_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense matrix of the non-null vectors, and the mask of rows that have one."""
    present = np.array(column.is_valid())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.drop_null().value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise ValueError(f"expected vectors of {width} values, got {sorted(set(lengths))}")
    return flat.astype(np.float64).reshape(-1, width), present


def arrays_from(matrix: np.ndarray, present: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List array with one row of ``matrix`` per present row and null elsewhere."""
    width = matrix.shape[1]
    ends = np.concatenate([[0], np.cumsum(present) * width]).astype(np.int32)
    offsets = pa.array(ends, mask=np.append(~present, False))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1), type=kind))


def nearest_rows(
    points: np.ndarray, centroids: np.ndarray, leaves: tuple | None = None, per: float | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centroid, lowest index on ties.

    With the :func:`leaves_of` the centroids, those too far from a run of rows that lie
    together are not compared with them, which changes no result.  With ``per``, the rows that
    come to a centroid around here, they are finite and in the order of :func:`near_order`.
    """
    if leaves is None:
        best = _searched(points, centroids)
    elif per is not None:
        best = _pruned(points, centroids, leaves, _run_rows(per))
    else:
        best = np.zeros(len(points), dtype=np.int64)
        sound = np.flatnonzero(np.isfinite(points).all(axis=1))
        size = _run_rows(len(sound) / len(centroids))
        sound = sound[near_order(points[sound], size)]
        best[sound] = _pruned(points[sound], centroids, leaves, size)
    gap = points - centroids[best]
    return best, (gap * gap).sum(axis=1)


def leaves_of(centroids: np.ndarray, smallest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Numbers of centroids that lie together (leaves x numbers), and the lower and upper
    corners of the leaves; None for a codebook below ``smallest`` or of too wide vectors."""
    if len(centroids) < smallest or centroids.shape[1] > MOST_SIDES or not np.isfinite(centroids).all():
        return None
    members = near_order(centroids, LEAF_CENTROIDS)
    members = members[_cut(len(members), LEAF_CENTROIDS)]
    held = centroids[members]
    return members, held.min(axis=1), held.max(axis=1)


def near_order(points: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which runs of ``size`` lie together, by halving along the
    longest side until no part is larger."""
    # Parts of one depth have one length, so they are halved at once; the places that this
    # takes beyond the last row hold numbers that are dropped at the end.
    n, columns = len(points), np.ascontiguousarray(points.T)
    parts = 1 << max(0, -(-n // size) - 1).bit_length()
    order = np.arange(-(-n // parts) * parts)[None]
    place = np.minimum(order, n - 1)
    while len(order) < parts:
        half, held = order.shape[1] // 2, columns[:, place]
        side = (held.max(axis=2) - held.min(axis=2)).argmax(axis=0)
        along = held[side, np.arange(len(order))].argpartition(half, axis=1)
        order, place = (np.take_along_axis(a, along, axis=1).reshape(-1, half) for a in (order, place))
    order = order.ravel()
    return order[order < n]


def _cut(n: int, size: int) -> np.ndarray:
    """The numbers below ``n`` in runs of one length, about ``size``; the last is repeated."""
    runs = max(1, -(-n // size))
    length = -(-n // runs)
    return np.minimum(np.arange(runs * length), n - 1).reshape(runs, length)


def _run_rows(per: float) -> int:
    """Rows of a run: many share its cost, few have a small box and so few centroids."""
    return int(np.clip(np.sqrt(RUN_CELLS * per), 128, 2048))


def near_cuts(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Side and value of the halvings of :func:`near_order`, as a tree of ``depth`` levels."""
    sides, values, parts = [], [], [points]
    for _ in range(depth):
        halves = []
        for x in parts:
            side = int((x.max(axis=0) - x.min(axis=0)).argmax())
            x = x[x[:, side].argsort(kind="stable")]
            half = len(x) // 2
            sides.append(side)
            values.append(x[half, side])
            halves += [x[:half], x[half:]] if half else [x, x]
        parts = halves
    return np.array(sides, dtype=np.int64), np.array(values)


def near_place_udf(spark: SparkSession, cuts: tuple[np.ndarray, np.ndarray]):
    """UDF: vector, not null and finite -> its part by :func:`near_cuts`; near numbers lie together."""
    shared = spark.sparkContext.broadcast(cuts)

    def place(vectors: pa.Array) -> pa.Array:
        sides, values = shared.value
        points = rows_of(vectors, len(vectors.flatten()) // max(1, len(vectors)))[0]
        node, rows = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
        while len(rows) and node[0] < len(sides):
            node = 2 * node + 1 + (points[rows, sides[node]] >= values[node])
        return pa.array(node, type=pa.int64())

    return F.arrow_udf(place, "bigint")


def _pruned(points: np.ndarray, centroids: np.ndarray, leaves: tuple, size: int) -> np.ndarray:
    """Index of the nearest centroid of each row, which are finite and in near order.

    The distance to the centroids of the nearest leaves bounds that of the nearest one, so
    only centroids that near to the box of a run of rows can be it.
    """
    members, low, high = leaves
    best = np.empty(len(points), dtype=np.int64)
    runs = _cut(len(points), size) if len(points) else []
    step, some = max(1, SEARCH_CELLS // len(members)), min(NEAR_LEAVES, len(members))
    for start in range(0, len(runs), step):
        block = runs[start : start + step]
        held = np.ascontiguousarray(points[block].transpose(2, 0, 1))
        bottom, top = held.min(axis=2).T, held.max(axis=2).T
        apart, between = np.zeros((2, len(block), len(members)))
        for j in range(points.shape[1]):
            gap = np.maximum(low[:, j] - top[:, j, None], bottom[:, j, None] - high[:, j])
            apart += np.maximum(gap, 0.0) ** 2
            between += (low[:, j] + high[:, j] - (bottom + top)[:, j, None]) ** 2
        first = between.argpartition(some - 1, axis=1)[:, :some]
        for r, rows in enumerate(block):
            mine = points[rows]
            centre = (bottom[r] + top[r]) / 2.0
            guess, moved = centroids[members[first[r]].ravel()] - centre, mine - centre
            squares, norms = _squares(guess), _squares(moved)
            reach = (_lifted(moved) @ np.vstack([-2.0 * guess.T, squares])).min(axis=1) + norms
            reach = reach.max() + 1e-9 * (norms.max() + squares.max())
            options = members[~(apart[r] > reach)].ravel()
            if 2 * len(options) > len(centroids):
                best[rows] = _searched(mine, centroids)
                continue
            near = centroids[options]
            gap = np.maximum(np.maximum(near - top[r], bottom[r] - near), 0.0)
            wanted = np.zeros(len(centroids), dtype=bool)
            wanted[options[~(_squares(gap) > reach)]] = True
            ids = np.flatnonzero(wanted)
            best[rows] = ids[_searched(mine, centroids[ids])]
    return best


def _squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


def _lifted(rows: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """The rows with a constant element, by which a product with centroids adds their squares."""
    out = np.ones((rows.shape[0], rows.shape[1] + 1), kind)
    out[:, :-1] = rows
    return out


def _searched(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest of all centroids, lowest index on ties.

    One single-precision matrix product per block ranks the centroids.  Rows whose
    two best scores lie within the rounding error of that product are ranked again
    in double precision, and what is still too close by plain differences.
    """
    # Moving the origin into the codebook keeps the products, and their errors, small.
    centre = centroids.mean(axis=0)
    near, moved = centroids - centre, points - centre
    squares = _squares(near)
    # |c|^2 - 2 x.c as one product: the vectors get a constant element.
    lifted = np.vstack([-2.0 * near.T, squares])
    small = max(_squares(moved).max(initial=0.0), squares.max()) < 1e30
    single = lifted.astype(np.float32) if small else lifted
    best = np.empty(len(points), dtype=np.int64)
    step = max(1, SEARCH_CELLS // len(centroids))
    for start in range(0, len(points), step):
        block = moved[start : start + step]
        pick, low, error, unsure, _ = _rank(block, single, squares.max())
        if len(unsure):
            again, low, error, tied, scores = _rank(block[unsure], lifted, squares.max())
            for r in tied:
                options = np.flatnonzero(scores[r] <= low[r] + error[r])
                apart = ((block[unsure[r]] - near[options]) ** 2).sum(axis=1)
                again[r] = options[apart.argmin()]
            pick[unsure] = again
        best[start : start + step] = pick
    return best


def _rank(
    points: np.ndarray, lifted: np.ndarray, largest: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best centroid per row, its score, the error bound, and the rows left unsure."""
    kind = lifted.dtype.type
    scores = _lifted(points, kind) @ lifted
    rows = np.arange(len(points))
    pick = scores.argmin(axis=1)
    low = scores[rows, pick]
    scores[rows, pick] = np.inf
    # Bound on the error of two inner products of this length.
    norms = _squares(points)
    error = 2.0 * (points.shape[1] + 4) * np.finfo(kind).eps * (norms + 2.0 * largest)
    unsure = np.flatnonzero(scores.min(axis=1) <= low + error)
    scores[rows, pick] = low
    return pick, low, error, unsure, scores


def nearest_udf(spark: SparkSession, tokens: np.ndarray, centroids: np.ndarray):
    """UDF: vector -> struct(distance, token) of the nearest centroid."""
    matrix = np.asarray(centroids, dtype=np.float64)
    leaves = leaves_of(matrix, LARGE_BOOK)
    shared = spark.sparkContext.broadcast((np.asarray(tokens, dtype=np.int64), matrix, leaves))

    def found(vectors: pa.Array) -> pa.Array:
        ids, matrix, leaves = shared.value
        points, present = rows_of(vectors, matrix.shape[1])
        index, distance = nearest_rows(points, matrix, leaves)
        # A vector with a missing or NaN element is near to nothing.
        finite = np.isfinite(distance)
        present[present] = finite
        index, distance = index[finite], distance[finite]
        token = np.zeros(len(present), dtype=np.int64)
        gap = np.zeros(len(present), dtype=np.float64)
        token[present], gap[present] = ids[index], distance
        return pa.StructArray.from_arrays(
            [pa.array(gap, type=pa.float64()), pa.array(token, type=pa.int64())],
            names=["distance", "token"],
            mask=pa.array(~present),
        )

    def nearest(vectors: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # Rows of several batches are put in near order together.
        most = POOL_ROWS if leaves is not None else 1
        held: list[pa.Array] = []
        for batch in vectors:
            held.append(batch)
            if sum(map(len, held)) >= most:
                yield found(pa.concat_arrays(held))
                held = []
        if held:
            yield found(pa.concat_arrays(held))

    return F.arrow_udf(nearest, "struct<distance:double,token:bigint>")


def dense_udf(
    spark: SparkSession,
    layers: list[tuple[np.ndarray, np.ndarray]],
    final: str = "none",
    hidden: str = "relu",
):
    """UDF: vector -> output of a stack of dense layers ``x @ W + b``.

    ``hidden`` is applied between layers (``relu`` or ``sigmoid``), ``final``
    after the last one (``none``, ``relu`` or ``softmax``).
    """
    size = sum(8 * (np.size(w) + np.size(b)) for w, b in layers)
    if size > MAX_NETWORK_BYTES:
        raise ValueError(f"layers of {size} bytes are too large to hold in every task")
    shared = spark.sparkContext.broadcast(
        [(np.asarray(w, dtype=np.float64), np.asarray(b, dtype=np.float64)) for w, b in layers]
    )

    def activate(x: np.ndarray, kind: str) -> np.ndarray:
        if kind == "relu":
            return np.maximum(x, 0.0)
        if kind == "sigmoid":
            return 1.0 / (1.0 + np.exp(-x))
        if kind == "softmax":
            x = np.exp(x - x.max(axis=1, keepdims=True))
            return x / x.sum(axis=1, keepdims=True)
        return x

    def forward(vectors: pa.Array) -> pa.Array:
        stack = shared.value
        points, present = rows_of(vectors, stack[0][0].shape[0])
        out = np.empty((len(points), stack[-1][0].shape[1]))
        step = max(1, BLOCK_CELLS // max(w.shape[1] for w, _ in stack))
        for start in range(0, len(points), step):
            x = points[start : start + step]
            for i, (weight, bias) in enumerate(stack):
                x = activate(x @ weight + bias, final if i == len(stack) - 1 else hidden)
            out[start : start + step] = x
        return arrays_from(out, present, pa.float64())

    return F.arrow_udf(forward, "array<double>")


def ordered_blocks(part: Iterator[np.ndarray], cells: int = BLOCK_CELLS // 2) -> Iterator[np.ndarray]:
    """The rows of matrices as larger ones in near order, of about ``cells`` cells."""
    held: list[np.ndarray] = []
    for rows in part:
        held.append(rows)
        if sum(x.size for x in held) >= cells:
            yield _in_order(held)
            held = []
    if held:
        yield _in_order(held)


def _in_order(held: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(held)
    return rows[near_order(rows, 64)] if rows.shape[1] <= MOST_SIDES else rows


def cluster_sums(
    part: Iterator[np.ndarray], shared, cells: int, per: float
) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, float]]]:
    """``(slice, (n, sums, cost))``: sizes and sums of vectors of the clusters of a slice of
    the centroids, of ``cells`` cells, and the squared distances to them.

    ``shared`` holds centroids and their leaves, the matrices are those of
    :func:`ordered_blocks`.  A task adds up its rows, so it returns a number and a vector
    per centroid at most.
    """
    centres, leaves = shared.value
    k, d = centres.shape
    n, cost, sums = np.zeros(k, dtype=np.int64), np.zeros(k), np.zeros((k, d))
    for points in part:
        index, distance = nearest_rows(points, centres, leaves, per)
        n += np.bincount(index, minlength=k)
        cost += np.bincount(index, weights=distance, minlength=k)
        for j in range(d):
            sums[:, j] += np.bincount(index, weights=points[:, j], minlength=k)
    step = max(1, cells // d)
    for begin in range(0, k, step):
        mine = slice(begin, begin + step)
        if n[mine].any():
            yield begin // step, (n[mine], sums[mine], float(cost[mine].sum()))


def added(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def power_bands_udf(spark: SparkSession, n_fft: int, window: np.ndarray, bank: np.ndarray):
    """UDF: frame of samples -> power in each band of ``bank`` (bands x bins).

    The frame is centred, windowed, padded to ``n_fft`` and transformed; the
    one-sided power spectrum is scaled by the squared sum of the window.
    """
    shared = spark.sparkContext.broadcast((window, bank))

    def bands(frames: pa.Array) -> pa.Array:
        taper, weights = shared.value
        x, present = rows_of(frames, len(taper))
        out = np.empty((len(x), weights.shape[0]))
        step = max(1, BLOCK_CELLS // n_fft)
        for start in range(0, len(x), step):
            block = x[start : start + step]
            block = (block - block.mean(axis=1, keepdims=True)) * taper
            power = np.abs(np.fft.rfft(block, n=n_fft, axis=1)) ** 2 / taper.sum() ** 2
            power[:, 1 : (-1 if n_fft % 2 == 0 else None)] *= 2.0
            out[start : start + step] = power @ weights.T
        return arrays_from(out, present, pa.float64())

    return F.arrow_udf(bands, "array<double>")
