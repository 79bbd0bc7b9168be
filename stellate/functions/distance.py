"""Vector functions as column expressions; sums are taken in double.

Vectors are ``array<float>`` or ``array<double>``. A null vector gives null; unequal
dimensions give NaN; a zero vector has no cosine distance (NaN).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2_squared", "l2", "cosine", "inner_product", "l1")
NAN = float("nan")


def vector(values: Sequence[float]) -> Column:
    """A constant vector; Catalyst folds it."""
    return F.array(*[F.lit(float(v)) for v in values])


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else vector(v)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _pairs(a: Column, b: Column, f) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def _checked(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) == F.size(b), value + F.lit(0.0)).otherwise(F.lit(NAN))


def l2_squared(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _checked(a, b, _pairs(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a, b) -> Column:
    return F.sqrt(l2_squared(a, b))


def raw_inner_product(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _checked(a, b, _pairs(a, b, lambda x, y: x * y))


def inner_product(a, b) -> Column:
    """As a distance: negated."""
    return -raw_inner_product(a, b) + F.lit(0.0)


def l1(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _checked(a, b, _pairs(a, b, lambda x, y: F.abs(x - y)))


def cosine(a, b) -> Column:
    """1 - cos, the cosine clamped to [-1, 1]; NaN for a zero vector."""
    a, b = _col(a), _col(b)
    dot, den = _pairs(a, b, lambda x, y: x * y), F.sqrt(_pairs(a, a, lambda x, y: x * y) * _pairs(b, b, lambda x, y: x * y))
    safe = F.when(den == 0, F.lit(1.0)).otherwise(den)
    return _checked(a, b, F.when((den == 0) | F.isnan(den), F.lit(NAN)).otherwise(F.lit(1.0) - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / safe))))


def distance(a, b, metric: str) -> Column:
    """One of METRICS; an unknown metric is an error when the plan is built."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    return {"l2_squared": l2_squared, "l2": l2, "cosine": cosine, "inner_product": inner_product, "l1": l1}[metric](a, b)


def norm(v) -> Column:
    v = _col(v)
    return F.sqrt(_pairs(v, v, lambda x, y: x * y))


def normalize(v) -> Column:
    """v / |v|; a zero vector is returned as it is."""
    v = _col(v)
    n = norm(v)
    n = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.get(F.transform(F.array(n), lambda m: F.transform(v, lambda x: x.cast("double") / m)), 0)
