"""Connected components over links of unbounded number, without a driver-side graph.

Links are first thinned where they lie: every task replaces blocks of its links by a
spanning forest of them (a star on each tree's smallest node), so a node with very
many links, or a group that is linked many times over, sends little on. Then the
large-star and small-star steps alternate: one partial aggregate (smallest
neighbour) and one join back on the node. The smallest neighbours are written
before they are joined, so both sides of the join come straight from a shuffle and
the adaptive skew join can split a node that still has many links. Every round is
written to the shared folder, so no lineage grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize

#: Links that a task holds at once.
BLOCK = 1 << 18


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (u, v), node numbers: each node but the smallest of a tree, with that one."""
    n = int(max(u.max(initial=-1), v.max(initial=-1))) + 1
    lab = np.arange(n)
    while True:
        a, b = lab[u], lab[v]
        ne = a != b
        if not ne.any():
            break
        np.minimum.at(lab, np.maximum(a, b)[ne], np.minimum(a, b)[ne])
        while not np.array_equal(up := lab[lab], lab):
            lab = up
    far = np.flatnonzero(lab != np.arange(n))
    return far, lab[far]


def _thinned(edges: DataFrame) -> DataFrame:
    """Links (u, v), u > v, with the same components: forests of blocks of a partition's links."""
    binary = edges.schema["u"].dataType.simpleString() == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            both = pa.Table.from_batches(held)
            names = pa.chunked_array([*both["u"].chunks, *both["v"].chunks])
            x = np.array(names.to_pylist(), object) if binary else names.to_numpy()
            known, at = np.unique(x, return_inverse=True)
            a, b = forest(at[: both.num_rows], at[both.num_rows :])
            return pa.RecordBatch.from_arrays([pa.array(known[i], type=names.type) for i in (a, b)], names=["u", "v"])

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK:
                yield star(held)
                held, rows = [], 0
        if rows:
            yield star(held)

    return edges.mapInArrow(run, edges.schema)


def _smallest(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "smallest")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest(both)
    return both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges: u > v."""
    low = _smallest(edges)
    kept = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(low.where("u <> m").select("u", F.col("m").alias("v"))), low


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links``.

    Where one end of most links is the middle of a star, it should be ``a``. Nulls and self-links are ignored; repeated links and cycles are allowed; no
    links give no rows. Nodes are numbers or binary; their order is the type's.
    """
    e = links.where(F.col(a) != F.col(b)).repartition(b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = materialize(_thinned(e), "links")
    state = None
    while True:
        if state is None and e.count() <= BLOCK:
            e = materialize(_thinned(e.repartition(1)), "links")
            break
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            break
        state = now
        large, low = _large_star(e)
        large = materialize(large.distinct(), "links")
        small, low2 = _small_star(large)
        new = materialize(small.distinct(), "links")
        drop_materialized(e, low, large, low2)
        e = new
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
