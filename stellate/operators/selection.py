"""Projection and row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import scratch


def project(df: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """Columns by ordinal: a subset, in any order; none given: all. The scan reads only these."""
    return df if ids is None else df.select(*[F.col(f"`{df.columns[i]}`") for i in ids])


def visible(df: DataFrame, xmax: str | None = None, embedding: str | None = None) -> DataFrame:
    """Rows that no transaction has ended (``xmax`` null or 0), and that have an embedding, as far as columns are named."""
    out = df.where(F.coalesce(F.col(xmax), F.lit(0)) == 0) if xmax else df
    return out.where(F.col(embedding).isNotNull()) if embedding else out


def replace_column(df: DataFrame, i: int, value: Column) -> DataFrame:
    """The column at ordinal ``i`` with new values, under its name."""
    return df.withColumn(df.columns[i], value)


def cleared(df: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return df.limit(0)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the numbers of its rows from 0, in the order in which it hands them on.

    Rows are written in one run, each with its partition and place in it: another run
    may deal a sort to other partitions, as these are merged by the bytes of the columns
    that it reads.
    """
    path = scratch(df.sparkSession, "numbered")
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = df.sparkSession.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # one a partition
    nr = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(parts), "_part").select(*[f"`{c}`" for c in df.columns], nr.cast("long").alias(name))
