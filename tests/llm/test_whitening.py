import itertools
import math

import numpy as np
import pytest

from sigframe.llm import queries, whitening


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, 1.0, 2) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double, n int")


def expected(vectors, count=4):
    """By numpy: n, deviations, eigenvalues and components over distinct integer vectors."""
    x = np.floor(256 * np.array(vectors, float)).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    moved = fit - fit.mean(axis=0)
    values, parts = np.linalg.eigh(moved.T @ moved / n)
    order = np.argsort(values)[::-1][:count]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    white = (x - fit.mean(axis=0)) @ parts[:, order] / np.sqrt(values[order])
    return n, deviation, values[order] / values.sum(), white


def check(spark, vectors):
    found = whitening.whiten(table(spark, vectors)).collect()
    n, deviation, shares, white = expected(vectors)
    assert len(found) == len(vectors) * len(shares)
    signs = {}
    for r in found:
        want = white[r.vec_id, r.component - 1]
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
        if abs(want) > 1e-6:
            signs.setdefault(r.component, set()).add(math.copysign(1, want * r.whitened))
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-7)
    assert all(len(s) == 1 for s in signs.values())


def test_like_numpy(spark):
    rng = np.random.default_rng(1)
    check(spark, (rng.normal(size=(60, 7)) * [5, 4, 3, 2, 1, 1, 1]).tolist())


def test_fewer_entries_than_components(spark):
    check(spark, np.random.default_rng(2).normal(size=(20, 3)).tolist())


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    found = queries.op11_whitening(spark, sf).collect()
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(rows)
    n, deviation, shares, white = expected([rows[i] for i in ids])
    assert len(found) == 4 * len(ids) and len({r.identity_error for r in found}) == 1
    at = {i: k for k, i in enumerate(ids)}
    for r in found:
        assert (r.n, r.deviation) == (n, deviation[at[r.vec_id]])
        assert abs(r.whitened) == pytest.approx(abs(white[at[r.vec_id], r.component - 1]), abs=1e-9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], [2.0, 1.0], [0.5, -1.0], None, [nan, 1.0], [inf, 0.0], [None, 1.0], [1.0], [], [1.0, 2.0], [-0.0, 0.0]]
    ids = [1, 2, None, 4, 5, 6, 7, 8, 9, 1, None]
    found = whitening.whiten(table(spark, vectors, ids)).collect()
    assert sorted(str(r.vec_id) for r in found) == sorted(["1", "1", "2", "None", "None"] * 2)
    assert {r.n for r in found} == {4}
    assert whitening.whiten(table(spark, vectors).limit(0)).count() == 0
    same = whitening.whiten(table(spark, [[1.0, 2.0]] * 3)).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, 0.0, None)}


def test_fewer_dimensions_than_components(spark):
    """All vectors on a line: one component, the others have no whitened value."""
    found = whitening.whiten(table(spark, [[float(i), 2.0 * i, -1.0 * i] for i in range(5)])).collect()
    assert {r.component for r in found if r.whitened is None} == {2, 3}
    first = sorted(r.whitened for r in found if r.component == 1)
    assert first == pytest.approx([-math.sqrt(2), -math.sqrt(0.5), 0, math.sqrt(0.5), math.sqrt(2)])
    assert all(r.identity_error < 1e-12 for r in found)


def test_equal_eigenvalues(spark):
    corners = [list(map(float, c)) for c in itertools.product((-1, 1), repeat=3)]
    found = whitening.whiten(table(spark, corners)).collect()
    assert {round(r.explained, 12) for r in found} == {round(1 / 3, 12)} and found[0].identity_error < 1e-12
    for i in range(8):
        assert sum(r.whitened**2 for r in found if r.vec_id == i) == pytest.approx(3)


def test_very_large_entries(spark):
    vectors = (np.random.default_rng(4).normal(size=(12, 3)) * 1e15).tolist()
    found = whitening.whiten(table(spark, vectors)).collect()
    assert {r.deviation for r in found} == {None} and found[0].identity_error < 1e-9
    beyond = whitening.whiten(table(spark, [[1e308, 0.0], [-1e308, 1.0], [0.0, 2.0]])).collect()
    assert len(beyond) == 6 and beyond[0].identity_error < 1e-9


def test_sums_are_exact():
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**62), 2**62, (50, 3))
    x[0] = [-(2**63), 2**63 - 1, 0]
    assert (whitening.gram(x) == x.astype(object).T @ x.astype(object)).all()


def test_polynomial(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(-9, 9, (6, 6)).astype(object)
    a[:, 3] = 0
    scatter = a @ a.T
    poly = whitening.characteristic_polynomial(spark.range(1), scatter)
    for t in range(-3, 4):
        m = [[int(t * (i == j) - scatter[i][j]) for j in range(6)] for i in range(6)]
        det = sum(
            (-1) ** sum(p[i] > p[j] for i in range(6) for j in range(i + 1, 6)) * math.prod(m[i][p[i]] for i in range(6))
            for p in itertools.permutations(range(6))
        )
        assert sum(c * t**k for k, c in enumerate(poly)) == det
    assert poly[0] == 0 and poly[1] != 0


def test_roots_of_known_polynomials():
    poly = [1]
    for root in (9, 4, 4, 1, 0):
        poly = [(poly[k - 1] if k else 0) - root * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    assert [whitening.roots_above(poly, a) for a in (-1, 0, 1, 3, 4, 8, 9)] == [5, 4, 3, 3, 1, 1, 0]
    roots, shift = whitening.largest_roots(poly, 4)
    assert all(abs(r - x * 2**shift) <= 1 for r, x in zip(roots, (9, 4, 4, 1))) and len(roots) == 4
    assert all(whitening._is_prime(p) for p in whitening.primes_above(10**60)) and not whitening._is_prime(2**31 - 3)
