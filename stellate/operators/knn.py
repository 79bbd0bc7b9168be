"""Exact top-k nearest neighbours, single and batched, and vector indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distance import METRICS, distance
from ..sources.storage import scratch

#: Numbers (8 bytes each) that a task holds for the queries which one pass over the table answers: their vectors, broadcast, and k rows of each.
BLOCK = 1 << 20
#: What a query's own arrays take beside these.
_OWN = 32
#: Distances that a task holds at once, and numbers in the vectors of the rows that they are of.
_PAIRS, _TILE = 1 << 18, 1 << 17
#: Rows of a task's result that leave it at once.
_OUT = 1 << 16
#: Numbers in a block's vectors from which on a table of too few partitions for the cores is dealt out anew.
_SPREAD = 1 << 16
#: Digits that distances are rounded to before ties are broken by id.
DIGITS = 6


#: A top-k keeps k rows in each task and merges them in one; over this, rows are cut by distance first.
TOP = 10_000


@dataclass(frozen=True)
class VectorQuery:
    query: Sequence[float]
    metric: str = "l2"


def _dim(df: DataFrame, vec: str) -> int | None:
    return (df.schema[vec].metadata or {}).get("dim")


def _check(df: DataFrame, vec: str, query: Sequence[float], metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    if (d := _dim(df, vec)) is not None and d != len(query):
        raise ValueError(f"query has {len(query)} dimensions, {vec} has {d}")


def knn(df: DataFrame, query: VectorQuery | Sequence[float], k: int, metric: str = "l2", vec: str = "embedding", id_col: str = "vec_id", labels: Sequence | None = None, label_col: str = "label") -> DataFrame:
    """The k nearest rows with all their columns and ``distance``, by (distance, id).

    Rows without a vector are left out; NaN sorts last; k = 0 gives no rows, k over
    the number of rows all. ``labels`` keeps rows with any of them, before the
    search. The plan is one scan with a top-k per task (TakeOrderedAndProject).
    """
    if isinstance(query, VectorQuery):
        query, metric = query.query, query.metric
    _check(df, vec, query, metric)
    rows = df.where(F.col(vec).isNotNull())
    if labels is not None:
        is_array = isinstance(df.schema[label_col].dataType, T.ArrayType)
        rows = rows.where(F.arrays_overlap(label_col, F.array(*map(F.lit, labels))) if is_array else F.col(label_col).isin(list(labels)))
    near = rows.withColumn("distance", F.round(distance(F.col(vec), query, metric), DIGITS) + F.lit(0.0))
    return near.orderBy("distance", id_col).limit(k) if k <= TOP else _many(near, k, id_col)


def _many(near: DataFrame, k: int, id_col: str) -> DataFrame:
    """The first k rows by (distance, id) for a large k: all rows surely before the k-th, and a top-k among those about it only."""
    n = near.count()
    if k >= n:
        return near.orderBy("distance", id_col)
    share = [max(0.0, k / n - 0.002), min(1.0, k / n + 0.002)]
    low, high = near.select(F.percentile_approx("distance", share, 10_000)).first()[0]
    below, within = near.agg(F.count_if(F.col("distance") < low), F.count_if(F.col("distance") <= high)).first()
    if not below <= k <= within:  # estimates that missed: every row may be the k-th
        below, at = 0, F.lit(True)
        sure = near.limit(0)
    else:
        at, sure = F.col("distance").between(low, high), near.where(F.col("distance") < low)
    return sure.unionByName(near.where(at).orderBy("distance", id_col).limit(k - below)).orderBy("distance", id_col)


def pairwise(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of q to all rows of x, in double."""
    if metric == "l1":
        return np.stack([np.abs(x - r).sum(1) for r in q])
    if metric in ("l2", "l2_squared"):
        d = np.stack([((x - r) ** 2).sum(1) for r in q])
        return np.sqrt(d) if metric == "l2" else d
    dot = q @ x.T
    if metric == "inner_product":
        return -dot + 0.0
    den = np.sqrt((q**2).sum(1)[:, None] * (x**2).sum(1)[None])
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(den == 0, np.nan, 1 - np.clip(dot / den, -1, 1))


def _placed(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as an index files them: for cosine on the unit sphere, a zero vector as it is."""
    if metric != "cosine" or not len(x):
        return x
    n = np.sqrt((x**2).sum(1, keepdims=True))
    return x / np.where(n == 0, 1, n)


class _Best:
    """The k nearest rows so far of each query, by (distance, id)."""

    def __init__(self, n: int, k: int):
        self.k, self.d, self.ids = k, [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n
        self.last = np.full(n, np.nan)  # the k-th distance; NaN: every row is nearer or ties

    def add(self, queries: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """Rows ``ids``, at (queries, rows) distances ``d``."""
        near = ~(d > self.last[queries, None])  # NaN sorts last, and ties of the k-th stay in
        for j in np.flatnonzero(near.any(1)):
            self._add(queries[j], d[j, near[j]], ids[near[j]])

    def _add(self, i: int, d: np.ndarray, ids: np.ndarray) -> None:
        if len(d) > self.k:
            keep = ~(d > np.partition(d, self.k - 1)[self.k - 1])
            d, ids = d[keep], ids[keep]
        d, ids = np.concatenate([self.d[i], d]), np.concatenate([self.ids[i], ids])
        order = np.lexsort((ids, d))[: self.k]
        self.d[i], self.ids[i] = d[order], ids[order]
        if len(order) == self.k:
            self.last[i] = self.d[i][-1]


def _tiles(at: np.ndarray, dim: int) -> Iterator[np.ndarray]:
    """Row numbers in pieces whose vectors have about ``_TILE`` numbers."""
    step = max(1, _TILE // max(1, dim))
    for lo in range(0, len(at), step):
        yield at[lo : lo + step]


def knn_batch(df: DataFrame, queries: DataFrame, k: int, metric: str = "l2", vec: str = "embedding", id_col: str = "vec_id", query_id: str = "query_id", query_vec: str = "query", probe: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest rows of each query.

    Queries are broadcast in blocks, which with their results have ``BLOCK`` numbers
    at most (or one query), one pass over the table each; the driver holds one block,
    and if there are more, a block's result is written before the next. A task holds
    a block, ``_TILE`` numbers of rows and ``_PAIRS`` distances, whatever the number
    of rows and queries. It yields at most k rows a query, so what is shuffled follows
    tasks, not pairs. ``probe`` gives (queries, cells) true where a query looks into a
    cell of column ``_cell``.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    spark = df.sparkSession
    none = spark.createDataFrame([], f"{query_id} long, {id_col} long, distance double, rank int")
    if k <= 0:
        return none
    rows = df.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), F.col(vec).alias("v"), *(["_cell"] if probe else []))
    if k > TOP:
        k = max(1, min(k, rows.count()))
    schema = T._parse_datatype_string(f"{query_id} long, {id_col} long, distance double")
    cores = spark.sparkContext.defaultParallelism

    def near(held: list[tuple[int, np.ndarray]]) -> tuple[DataFrame, Broadcast]:
        ids, q = np.array([i for i, _ in held]), np.stack([v for _, v in held])
        shared = spark.sparkContext.broadcast((ids, q, probe(q) if probe else None))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, looks = shared.value
            best = _Best(len(q), k)
            for b in batches:
                own, v = b[id_col].to_numpy(), b["v"].to_numpy()
                cells = np.zeros(len(own), int) if looks is None else b["_cell"].to_numpy()
                for c in np.unique(cells):
                    by = np.arange(len(q)) if looks is None else np.flatnonzero(looks[:, c])
                    for at in _tiles(np.flatnonzero(cells == c), q.shape[1]):
                        x = np.stack(v[at]).astype(np.float64)
                        step = max(1, _PAIRS // len(at))
                        for lo in range(0, len(by), step):
                            some = by[lo : lo + step]
                            best.add(some, np.round(pairwise(q[some], x, metric), DIGITS) + 0.0, own[at])
            step = max(1, _OUT // k)
            for lo in range(0, len(ids), step):
                d, rows = best.d[lo : lo + step], best.ids[lo : lo + step]
                yield pd.DataFrame({query_id: np.repeat(ids[lo : lo + step], [len(x) for x in d]), id_col: np.concatenate(rows), "distance": np.concatenate(d)})

        dealt = rows.repartition(cores, id_col) if q.size >= _SPREAD and rows.rdd.getNumPartitions() < cores else rows
        rank = F.row_number().over(Window.partitionBy(query_id).orderBy("distance", id_col))
        return dealt.mapInPandas(run, schema).withColumn("rank", rank).where(F.col("rank") <= k), shared

    held, numbers, path = [], 0, None
    for r in queries.select(F.col(query_id).cast("long"), query_vec).where(F.col(query_vec).isNotNull()).toLocalIterator():
        own = len(r[1]) + 2 * k + _OWN
        if held and numbers + own > BLOCK:
            path = path or scratch(spark, "nearest")
            found, shared = near(held)
            found.write.mode("append").parquet(path)
            shared.destroy()
            held, numbers = [], 0
        held.append((r[0], np.array(r[1], np.float64)))
        numbers += own
    if not held:
        return none
    last, _ = near(held)
    return last if path is None else spark.read.schema(last.schema).parquet(path).unionByName(last)


class VectorIndex:
    """Flat (exact) or IVF (approximate) index over a table of vectors.

    IVF: centroids by k-means on a bounded sample (``SAMPLE`` rows); every row is
    filed in its nearest cell. A search reads the ``nprobe`` nearest cells only,
    nearest under the index's metric (for cosine, cells are those of unit vectors);
    the defaults are set by the recall measured on embeddings without clear clusters.
    Graph kinds (hnsw, diskann) search exactly: their graphs approximate just that,
    and have no form in Spark.
    """

    SAMPLE = 20_000

    def __init__(self, kind: str = "flat", metric: str = "l2", cells: int = 16, nprobe: int = 12, vec: str = "embedding", id_col: str = "vec_id"):
        if kind not in ("flat", "ivf", "hnsw", "diskann"):
            raise ValueError(f"unknown index kind {kind!r}")
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
        self.kind, self.metric, self.cells, self.nprobe, self.vec, self.id_col = kind, metric, cells, nprobe, vec, id_col
        self.rows: DataFrame | None = None
        self.centroids: np.ndarray | None = None

    def build(self, df: DataFrame, rounds: int = 12) -> VectorIndex:
        rows = df.where(F.col(self.vec).isNotNull())
        if self.kind == "ivf":
            some = rows.orderBy(F.xxhash64(self.id_col)).limit(self.SAMPLE).select(self.vec).collect()
            x = _placed(np.array([list(r[0]) for r in some], np.float64), self.metric)
            self.centroids = self._means(x, rounds) if len(x) else np.zeros((0, 0))
            rows = self._file(rows)
        self.rows = rows
        return self

    def _means(self, x: np.ndarray, rounds: int) -> np.ndarray:
        rng = np.random.default_rng(3)
        c = x[rng.choice(len(x), min(self.cells, len(x)), replace=False)]
        for _ in range(rounds):
            at = pairwise(c, x, "l2_squared").argmin(0)
            c = np.stack([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
        return c

    def _file(self, rows: DataFrame) -> DataFrame:
        c, metric = self.centroids, self.metric

        @F.pandas_udf("int")
        def cell(v: pd.Series) -> pd.Series:
            v = v.to_numpy()
            near = [pairwise(c, _placed(np.stack(v[at]).astype(np.float64), metric), "l2_squared").argmin(0) for at in _tiles(np.arange(len(v)), c.shape[1])]
            return pd.Series(np.concatenate(near) if near else [])

        return rows.withColumn("_cell", cell(self.vec))

    def insert(self, df: DataFrame) -> VectorIndex:
        new = df.where(F.col(self.vec).isNotNull())
        self.rows = self.rows.unionByName(self._file(new) if self.kind == "ivf" else new)
        return self

    def remove(self, ids: DataFrame) -> VectorIndex:
        self.rows = self.rows.join(ids.select(self.id_col), self.id_col, "left_anti")
        return self

    def search(self, query: Sequence[float], k: int, labels: Sequence | None = None, label_col: str = "label") -> DataFrame:
        rows = self.rows
        if self.kind == "ivf" and len(self.centroids):
            near = np.flatnonzero(self._probe(np.array([query], np.float64))[0])
            rows = rows.where(F.col("_cell").isin([int(i) for i in near]))
        return knn(rows, query, k, self.metric, self.vec, self.id_col, labels, label_col).drop("_cell")

    def _probe(self, q: np.ndarray) -> np.ndarray:
        """(queries, cells): true for the ``nprobe`` nearest cells."""
        out = np.zeros((len(q), len(self.centroids)), bool)
        metric = self.metric if self.metric in ("inner_product", "l1") else "l2_squared"
        np.put_along_axis(out, pairwise(_placed(q, self.metric), self.centroids, metric).argsort(1)[:, : self.nprobe], True, 1)
        return out

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, distance, rank) as of knn_batch, for queries (query_id, query)."""
        probe = self._probe if self.kind == "ivf" and len(self.centroids) else None
        return knn_batch(self.rows, queries, k, self.metric, self.vec, self.id_col, probe=probe)

    def save(self, path: str) -> None:
        """Rows partitioned by cell, so a search prunes files; centroids beside them."""
        spark = self.rows.sparkSession
        w = self.rows.write.mode("overwrite")
        (w.partitionBy("_cell") if self.kind == "ivf" else w).parquet(f"{path}/rows")
        c = [] if self.centroids is None else self.centroids.tolist()
        spark.createDataFrame([(self.kind, self.metric, self.cells, self.nprobe, self.vec, self.id_col, c)], "kind string, metric string, cells int, nprobe int, vec string, id_col string, centroids array<array<double>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> VectorIndex:
        m = spark.read.parquet(f"{path}/meta").first()
        out = cls(m.kind, m.metric, m.cells, m.nprobe, m.vec, m.id_col)
        out.rows, out.centroids = spark.read.parquet(f"{path}/rows"), np.array(m.centroids) if m.kind == "ivf" else None
        return out
