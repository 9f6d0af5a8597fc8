"""Whitening of embeddings by the exact characteristic polynomial of their scatter matrix.

Entries become integers, so counts, sums and the scatter matrix ``M = n * sum(x x') - S S'``
are exact whatever the order of addition.  M's characteristic polynomial is computed modulo
many primes, each by reduction to Hessenberg form in a task of its own, and put together by
Chinese remaindering.  Its roots are the eigenvalues: as all are real, the number of roots
above a point is the number of sign changes of the polynomial's Taylor coefficients there,
which isolates each root between two integers of 256 bits.  Components come from the null
space of ``M - root`` by inverse iteration in decimal arithmetic of 110 digits.

What passes the driver is a matrix of the vectors' width and numbers per component; the
width is checked against ``MAX_WIDTH``.
"""

from __future__ import annotations

import decimal
import itertools
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.runtime import durable, shuffle_width

MAX_WIDTH = 1024
ROOT_BITS, DIGITS = 256, 110
LIMB, SLICE = 20, 4096  # products of two limbs, summed over a slice, stay below 2**53
LONG = 2**63


# --- exact sums ---------------------------------------------------------------------


def _rows(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Digits of ``x`` to the base 2**LIMB as exact floats, the last one signed."""
    bits = max(int(x.max(initial=0)), -int(x.min(initial=0))).bit_length()
    out = []
    for _ in range(bits // LIMB):
        out.append((x & (2**LIMB - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def gram(x: np.ndarray) -> np.ndarray:
    """``x' x`` as Python integers."""
    total = np.zeros((x.shape[1],) * 2, dtype=object)
    for begin in range(0, len(x), SLICE):
        parts = _limbs(x[begin : begin + SLICE])
        for (i, a), (j, b) in itertools.product(enumerate(parts), repeat=2):
            total += (a.T @ b).astype(np.int64).astype(object) * 2 ** (LIMB * (i + j))
    return total


def _sums(fit: DataFrame, width: int) -> np.ndarray:
    """Gram matrix of the vectors with a one put behind each: products, sums and the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1,) * 2, dtype=object)
        for batch in batches:
            x = _rows(batch.column(0), width)
            total += gram(np.column_stack([x, np.ones(len(x), np.int64)]))
        # In digits of 32 bits, whose sums over all tasks fit a long.
        cells = [(i * (width + 1) + j, total[i, j]) for i in range(width + 1) for j in range(i, width + 1)]
        for k in itertools.count():
            last = all(-(2**31) <= v < 2**31 for _, v in cells)
            yield pa.RecordBatch.from_pydict(
                {"cell": [c for c, _ in cells], "k": [k] * len(cells),
                 "v": [v if last else v & (2**32 - 1) for _, v in cells]},
                schema=pa.schema([("cell", pa.int64()), ("k", pa.int32()), ("v", pa.int64())]),
            )
            if last:
                break
            cells = [(c, v >> 32) for c, v in cells]

    found = np.zeros((width + 1,) * 2, dtype=object)
    parts = fit.mapInArrow(run, "cell long, k int, v long").groupBy("cell", "k").agg(F.sum("v").alias("v"))
    for r in parts.collect():
        i, j = divmod(r["cell"], width + 1)
        found[i, j] += r["v"] << (32 * r["k"])
        found[j, i] = found[i, j]
    return found


# --- characteristic polynomial ------------------------------------------------------


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 2**32."""
    if n < 2 or any(n % q == 0 for q in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_above(bound: int) -> list[int]:
    """The largest primes of 31 bits whose product exceeds ``bound``."""
    found, product, n = [], 1, 2**31 - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of ``det(t - matrix)`` modulo a prime below 2**31, lowest power first."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        at = k + int(below[0])
        h[[k, at]] = h[[at, k]]
        h[:, [k, at]] = h[:, [at, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k]) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor % p).sum(axis=1)) % p
    # minors[k] is the polynomial of the leading k x k part.
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        weights = np.zeros(k, np.int64)
        product = 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * product % p
            product = product * int(h[i, i - 1]) % p if i else 0
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - (minors[:k] * weights[:, None] % p).sum(axis=0)) % p
    return minors[d]


def characteristic_polynomial(fit: DataFrame, scatter: np.ndarray) -> list[int]:
    """Exact coefficients of ``det(t - scatter)``, lowest power first; one prime a row.

    ``scatter`` has no negative eigenvalue, so the k-th elementary symmetric function of
    them is at most that of k equal ones, which bounds the coefficients.
    """
    d, trace = len(scatter), int(np.trace(scatter))
    bound = max(math.comb(d, k) * trace**k // d**k for k in range(d + 1)) + 1
    primes = primes_above(bound)
    spark = fit.sparkSession
    width = max(1, min(len(primes), 4 * shuffle_width(spark)))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(width, "p")
    shared = spark.sparkContext.broadcast(scatter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"p": [p], "c": [polynomial_mod(shared.value, p).tolist()]})

    total = [0] * (d + 1)
    product = math.prod(primes)
    for r in rows.mapInArrow(run, "p long, c array<long>").collect():
        rest = product // r["p"]
        unit = rest * pow(rest, -1, r["p"])
        for k, c in enumerate(r["c"]):
            # Signs alternate: e_k is the coefficient of t**(d-k) times (-1)**k.
            total[k] += unit * (c if (d - k) % 2 == 0 else -c)
    return [(v % product) * (-1) ** (d - k) for k, v in enumerate(total)]


# --- roots --------------------------------------------------------------------------


def roots_above(poly: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only lie above ``at``, exactly."""
    shifted = list(poly)
    d = len(poly) - 1
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            shifted[k] += at * shifted[k + 1]
    signs = [v > 0 for v in shifted if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(poly: list[int], at: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * at + c
    return out


def largest_roots(poly: list[int], count: int) -> tuple[list[int], int]:
    """The ``count`` largest roots times ``2**shift``, each rounded up, and ``shift``.

    No root is negative.  ``shift`` gives the largest possible root ROOT_BITS bits.
    """
    d = len(poly) - 1
    top = -poly[d - 1]
    shift = max(0, ROOT_BITS - top.bit_length())
    scaled = [c << (shift * (d - k)) for k, c in enumerate(poly)]
    known = {-1: d, top << shift: 0}

    def above(at: int) -> int:
        if at not in known:
            known[at] = roots_above(scaled, at)
        return known[at]

    roots = []
    for j in range(1, count + 1):
        low = max(a for a, n in known.items() if n >= j)
        high = min(a for a, n in known.items() if n < j)
        while high - low > 1 and above(low) - above(high) > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if above(middle) >= j else (low, middle)
        # One root is left between them, so signs tell the sides.
        right = _value(scaled, high)
        if right == 0:
            roots.append(high)
            continue
        while high - low > 1:
            middle = (low + high) // 2
            now = _value(scaled, middle)
            low, high = (low, middle) if now == 0 or (now > 0) == (right > 0) else (middle, high)
        roots.append(high)
    return roots, shift


# --- components ---------------------------------------------------------------------


def _factored(matrix: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """LU factors with row exchanges; a pivot of zero counts as the smallest step."""
    a = matrix.copy()
    order = list(range(len(a)))
    tiny = max(abs(v) for v in a.ravel()).scaleb(10 - DIGITS) or Decimal(1)
    for k in range(len(a)):
        at = k + max(range(len(a) - k), key=lambda i: abs(a[k + i, k]))
        if at != k:
            a[[k, at]] = a[[at, k]]
            order[k], order[at] = order[at], order[k]
        if not a[k, k]:
            a[k, k] = tiny
        for i in range(k + 1, len(a)):
            if a[i, k]:
                a[i, k] /= a[k, k]
                a[i, k + 1 :] -= a[i, k] * a[k, k + 1 :]
    return a, order


def _solved(factors: tuple[np.ndarray, list[int]], b: np.ndarray) -> np.ndarray:
    a, order = factors
    x = b[order]
    for i in range(1, len(a)):
        x[i] -= (a[i, :i] * x[:i]).sum()
    for i in range(len(a) - 1, -1, -1):
        x[i] = (x[i] - (a[i, i + 1 :] * x[i + 1 :]).sum()) / a[i, i]
    return x


def null_vectors(scatter: np.ndarray, root: Decimal, n: int) -> list[np.ndarray]:
    """``n`` orthonormal vectors that ``scatter - root`` takes to almost nothing."""
    d = len(scatter)
    moved = np.array([[Decimal(int(v)) for v in row] for row in scatter], dtype=object).reshape(d, d)
    moved[np.arange(d), np.arange(d)] -= root
    factors = _factored(moved)
    draw = np.random.default_rng(11)
    basis = [np.array([Decimal(int(v)) for v in draw.integers(1, 1000, d)], dtype=object) for _ in range(n)]
    for _ in range(6):
        for i in range(n):
            x = _solved(factors, basis[i])
            x = x / max(abs(v) for v in x)
            for other in basis[:i]:
                x = x - other * (other * x).sum()
            basis[i] = x / (x * x).sum().sqrt()
    return [v if max(v, key=abs) > 0 else -v for v in basis]


def principal_components(scatter: np.ndarray, poly: list[int], count: int) -> list[tuple[np.ndarray, float, float]]:
    """``(component, root of its eigenvalue, share of the trace)`` by falling eigenvalue.

    Eigenvalues within 2**-200 of the largest one count as equal; theirs are then any
    orthonormal vectors of the joint space.  An eigenvalue of zero has no component: None.
    """
    rank = len(poly) - 1 - next(k for k, c in enumerate(poly) if c)
    trace = int(np.trace(scatter))
    roots, shift = largest_roots(poly, min(count, rank)) if rank else ([], 0)
    found: list = []
    with decimal.localcontext() as context:
        context.prec, context.Emax, context.Emin = DIGITS, decimal.MAX_EMAX, decimal.MIN_EMIN
        same = max(1, (roots[0] if roots else 0) >> 200)
        for _, group in itertools.groupby(range(len(roots)), lambda i: sum(a - b > same for a, b in zip(roots[:i], roots[1 : i + 1]))):
            members = list(group)
            root = Decimal(roots[members[0]]) / 2**shift
            for v in null_vectors(scatter, root, len(members)):
                found.append((v.astype(np.float64), float(root.sqrt()), float(root / trace)))
    return found + [(None, 0.0, 0.0)] * (count - len(found))


# --- the operator -------------------------------------------------------------------


def integer_vectors(vectors: DataFrame, id_col: str, vec: str, scale: int) -> DataFrame:
    """``id, x`` of rows whose vector has neither null nor an entry that is not finite."""
    entry: Column = F.col(vec)
    sound = F.forall(entry, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")))
    return vectors.filter(entry.isNotNull()).filter(sound).select(
        F.col(id_col), F.transform(entry, lambda c: F.floor(c.cast("double") * float(scale))).alias("x")
    )


def whiten(
    vectors: DataFrame, count: int = 4, scale: int = 256, id_col: str = "vec_id", vec: str = "embedding"
) -> DataFrame:
    """Each vector on the first ``count`` components of all distinct ones, with unit variance.

    Returns ``id, component, n, deviation, whitened, explained, identity_error`` for every
    row with a sound vector; repeated rows and rows without an id are rows like others, but
    equal vectors count once in n, sums and variances.  Other columns are ignored.

    Vectors of another length than the most frequent one (of equally frequent ones the
    longest) are left out, as are vectors without entries.  Entries past the range of long
    count as its ends.  There are never more components than entries.  A component whose
    eigenvalue is zero (fewer independent vectors than components) has ``whitened`` null and
    ``explained`` 0, ``identity_error`` covers the others and is null if there are none.
    ``deviation`` is null if it is beyond a long.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = f"{id_col} {dict(vectors.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = integer_vectors(vectors, id_col, vec, scale)
    size = F.size("x")
    first = usable.filter(size > 0).groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    width = first["d"]
    if width > MAX_WIDTH:
        raise ValueError(f"vectors of {width} entries; a matrix of at most {MAX_WIDTH} may pass the driver")
    usable = usable.filter(size == width)
    fit = durable(usable.select("x").distinct(), "fit")
    sums = _sums(fit, width)
    n, centre = int(sums[width, width]), sums[:width, width]
    scatter = n * sums[:width, :width] - np.outer(centre, centre)
    count = min(count, width)
    poly = characteristic_polynomial(fit, scatter)
    parts = principal_components(scatter, poly, count)
    project = _projection(fit, n, centre, parts)
    error = _identity_error(fit.select(project("x").alias("w")), [v is not None for v, _, _ in parts])
    shares = F.array(*[F.lit(share) for _, _, share in parts])
    projected = usable.withColumn("_w", project("x")).select(
        id_col, F.col("_w.deviation").alias("deviation"), F.posexplode("_w.whitened").alias("at", "whitened")
    )
    return projected.select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def _projection(fit: DataFrame, n: int, centre: np.ndarray, parts: list):
    """UDF: x -> struct(deviation, whitened)."""
    matrix = np.column_stack([v if v is not None else np.zeros(len(centre)) for v, _, _ in parts])
    scales = np.array([root if v is not None else np.nan for v, root, _ in parts])
    shared = fit.sparkSession.sparkContext.broadcast((matrix, scales, centre))

    def run(column: pa.Array) -> pa.Array:
        matrix, scales, centre = shared.value
        x = _rows(column, len(centre))
        largest = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(abs(int(s)) for s in centre)
        if largest * largest * len(centre) < LONG:
            moved = n * x - centre.astype(np.int64)
            deviation = (moved * moved).sum(axis=1).tolist()
        else:
            moved = n * x.astype(object) - centre
            deviation = [v if v < LONG else None for v in (moved * moved).sum(axis=1)]
        # M's eigenvalue is n * n times that of the covariance, and moved is n * (x - S / n).
        white = moved.astype(np.float64) @ matrix / scales
        offsets = np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]
        values = pa.array(white.ravel(), mask=np.isnan(white.ravel()))
        lists = pa.ListArray.from_arrays(pa.array(offsets), values)
        return pa.StructArray.from_arrays([pa.array(deviation, pa.int64()), lists], names=["deviation", "whitened"])

    return F.arrow_udf(run, "struct<deviation:bigint,whitened:array<double>>")


def _identity_error(white: DataFrame, present: list[bool]) -> float | None:
    """Largest distance of the whitened vectors' covariance from the identity."""
    at = [k for k, p in enumerate(present) if p]
    pairs = list(itertools.combinations_with_replacement(at, 2))
    if not pairs:
        return None
    entry = [F.get("w.whitened", F.lit(k)) for k in range(len(present))]
    found = white.agg(*[F.covar_pop(entry[i], entry[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))
