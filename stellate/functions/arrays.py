"""Array container functions: 0-based, out of range gives null or leaves the array as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def size(a) -> Column:
    """Null counts as empty."""
    return F.greatest(F.coalesce(F.size(_col(a)), F.lit(0)), F.lit(0))


def empty(a) -> Column:
    return F.coalesce(F.size(_col(a)) <= 0, F.lit(True))


def push_back(a, x) -> Column:
    return F.array_append(_col(a), _lit(x))


def pop_back(a) -> Column:
    """Without the last element; an empty array stays empty."""
    a = _col(a)
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def get(a, i) -> Column:
    return F.get(_col(a), _lit(i))


def set_at(a, i, x) -> Column:
    i, x = _lit(i), _lit(x)
    return F.transform(_col(a), lambda v, j: F.when(j == i, x).otherwise(v))


def front(a) -> Column:
    return F.get(_col(a), 0)


def back(a) -> Column:
    return F.try_element_at(_col(a), F.lit(-1))


def clear(a) -> Column:
    return F.slice(_col(a), 1, 0)


def resize(a, n, default) -> Column:
    """Grows with ``default`` or truncates to ``n`` elements."""
    a, n = _col(a), _lit(n)
    return F.concat(F.slice(a, F.lit(1), n), F.array_repeat(_lit(default), F.greatest(n - F.size(a), F.lit(0))))


def insert(a, i, x) -> Column:
    """Before position ``i`` of 0..size; any other position changes nothing."""
    a, i = _col(a), _lit(i)
    ok = (i >= 0) & (i <= F.size(a))
    return F.when(ok, F.array_insert(a, F.when(ok, i + 1).otherwise(F.lit(1)), _lit(x))).otherwise(a)


def erase(a, i) -> Column:
    i = _lit(i)
    return F.filter(_col(a), lambda v, j: j != i)


def find(a, x, equal=None) -> Column:
    """Position of the first element equal to ``x`` (or for which equal(element, x) holds), else -1."""
    a, x = _col(a), _lit(x)
    if equal is None:
        return F.coalesce(F.array_position(a, x) - 1, F.lit(-1)).cast("int")
    at = F.transform(a, lambda v, j: F.when(equal(v, x), j))
    return F.coalesce(F.array_min(at), F.lit(-1))


def gather(a, selection, offset: int = 0, count: int | None = None) -> Column:
    """a[selection[k]] for k in [offset, offset + count); without a selection, a[k]."""
    a = _col(a)
    if selection is None:
        return copy_slice(a, offset, count)
    return F.transform(copy_slice(selection, offset, count), lambda i: F.get(a, i))


def gather_masked(a, selection, mask, offset: int = 0, count: int | None = None) -> Column:
    """gather() with 0 where ``mask`` (by position in the source) is true; no mask: gather()."""
    if mask is None:
        return gather(a, selection, offset, count)
    a, mask = _col(a), _col(mask)
    clean = F.zip_with(a, mask, lambda x, m: F.when(m, F.lit(0).cast("double")).otherwise(x.cast("double")))
    return gather(clean, selection, offset, count)


def copy_slice(a, offset: int = 0, count: int | None = None) -> Column:
    """``count`` elements from ``offset``; 0 or None takes all the rest."""
    a = _col(a)
    n = F.lit(count) if count else F.greatest(F.size(a) - offset, F.lit(0))
    return F.slice(a, F.lit(offset + 1), n)
