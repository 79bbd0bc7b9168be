"""Map container functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def upsert(m, key, value) -> Column:
    """The last value of a key wins."""
    return F.map_concat(delete(m, key), F.create_map(_lit(key), _lit(value)))


def get(m, key) -> Column:
    """Missing: null."""
    return F.try_element_at(_col(m), _lit(key))


def delete(m, key) -> Column:
    key = _lit(key)
    return F.map_filter(_col(m), lambda k, v: k != key)


def contains(m, key) -> Column:
    return F.map_contains_key(_col(m), _lit(key))


def size(m) -> Column:
    return F.greatest(F.coalesce(F.size(_col(m)), F.lit(0)), F.lit(0))


def entries(df: DataFrame, m: str, key: str = "key", value: str = "value") -> DataFrame:
    """One row per entry, in no order."""
    return df.select(*[c for c in df.columns if c != m], F.explode(m).alias(key, value))
