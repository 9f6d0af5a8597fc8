"""Expressions over array columns and time values.  All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Inside the function of a ``transform`` an outer expression would be computed
    again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(v: Column | str) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance; null when the lengths differ."""
    squares = F.zip_with(
        _col(a), _col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)
    )
    return array_sum(squares)


def dot(a: Column | str, b: Column | str) -> Column:
    return array_sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y))


def l2_normalize(v: Column | str) -> Column:
    """``v`` scaled to length one; a zero vector stays as it is."""
    v = _col(v)

    def scaled(norm: Column) -> Column:
        return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))

    return let(F.sqrt(dot(v, v)), scaled)


def _exponentials(v: Column, top: Column) -> Column:
    return F.transform(v, lambda x: F.exp(x.cast("double") - top))


def softmax(v: Column | str) -> Column:
    """Softmax, shifted by the maximum so that no exponential overflows."""
    v = _col(v)

    def shares(powers: Column) -> Column:
        return let(array_sum(powers), lambda total: F.transform(powers, lambda e: e / total))

    return let(F.array_max(v), lambda top: let(_exponentials(v, top), shares))


def log_sum_exp(v: Column | str) -> Column:
    v = _col(v)
    return let(
        F.array_max(v).cast("double"), lambda top: top + F.log(array_sum(_exponentials(v, top)))
    )


def argmax(v: Column | str) -> Column:
    """Index of the maximum, the lowest one on ties; null for null or empty arrays."""
    v = _col(v)
    return F.nullif(F.array_position(v, F.array_max(v)) - 1, F.lit(-1)).cast("int")


def relu(v: Column | str) -> Column:
    return F.transform(_col(v), lambda x: F.greatest(x, F.lit(0).cast("float")))


def time_bucket(
    t: Column | str, seconds: int = 5, max_seconds: int | None = 100
) -> Column:
    """Lower edge of the ``seconds`` wide bucket of ``t``, as an integer.

    Negative, NaN and null times, and those past the last bucket that starts
    before ``max_seconds``, fall into bucket -1.  ``max_seconds=None`` lifts the
    upper bound.
    """
    t = _col(t).cast("double")
    inside = (t >= 0) & ~F.isnan(t)
    if max_seconds is not None:
        inside = inside & (t < -(-max_seconds // seconds) * seconds)
    edge = (F.floor(t / seconds) * seconds).cast("int")
    return F.when(inside, edge).otherwise(F.lit(-1))
