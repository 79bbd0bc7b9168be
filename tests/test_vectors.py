import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stellate.functions import distance as D
from stellate.operators import knn as knn_module
from stellate.operators.knn import VectorIndex, VectorQuery, knn, knn_batch, pairwise


def frame(spark, rows, dim=None):
    df = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    return df.withColumn("embedding", F.col("embedding").alias("embedding", metadata={"dim": dim})) if dim else df


def test_order_and_limit(spark):
    df = frame(spark, [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [-1.0, 0.0]])
    got = [(r.vec_id, r.distance) for r in knn(df, [1.0, 0.0], 4).collect()]
    assert [g[0] for g in got] == [0, 2, 1, 3]
    assert [g[1] for g in got] == pytest.approx([0, 1, math.sqrt(2), 2], abs=1e-6)
    assert [r.vec_id for r in knn(df, [1.0, 0.0], 2).collect()] == [0, 2]
    assert knn(df, [1.0, 0.0], 0).count() == 0
    assert knn(df, [1.0, 0.0], 10**9).count() == 4


@pytest.mark.parametrize("k", [11, 37, 150, 399, 400])
def test_many_neighbours(spark, monkeypatch, k):
    monkeypatch.setattr(knn_module, "TOP", 10)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 2)) * 2)  # few distances, many ties
    x[:5] = np.nan
    got = [r.vec_id for r in knn(frame(spark, x.tolist()).repartition(4), [0.0, 0.0], k).collect()]
    d = np.round(np.sqrt((x**2).sum(1)), 6)
    assert got == np.lexsort((np.arange(400), d))[:k].tolist()


@pytest.mark.parametrize("metric,want", [("cosine", 0), ("inner_product", 0), ("l1", 0), ("l2_squared", 0)])
def test_metrics(spark, metric, want):
    df = frame(spark, [[1.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    assert knn(df, VectorQuery([1.0, 1.0, 0.0], metric), 1).first().vec_id == want


def test_ties_nulls_nan_and_dimensions(spark):
    df = frame(spark, [[1.0, 0.0], [1.0, 0.0], None, [0.0, 0.0], []])
    assert [r.vec_id for r in knn(df, [1.0, 0.0], 5, "cosine").collect()][:2] == [0, 1]
    assert math.isnan(knn(df, [1.0, 0.0], 5, "cosine").collect()[-1].distance)
    assert knn(df, [1.0, 0.0], 5).count() == 4
    with pytest.raises(ValueError):
        knn(frame(spark, [[1.0, 0.0]], 2), [1.0], 1)
    with pytest.raises(ValueError):
        knn(df, [1.0, 0.0], 1, "hamming")
    row = df.where("vec_id = 0").select(D.l2("embedding", [1.0, 2.0, 3.0]).alias("x"), D.norm(F.lit(None).cast("array<float>")).alias("n")).first()
    assert math.isnan(row.x) and row.n is None


def test_normalize(spark):
    df = frame(spark, [[3.0, 4.0], [0.0, 0.0]])
    got = [r[0] for r in df.orderBy("vec_id").select(D.normalize("embedding")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_labels_and_batches(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    df = frame(spark, x.tolist()).repartition(3)
    assert {r.label for r in knn(df, x[0].tolist(), 20, labels=[1]).collect()} == {1}
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "query_id long, query array<float>")
    for metric in ("l2", "l1", "cosine", "inner_product", "l2_squared"):
        got = {}
        for r in knn_batch(df, q, 4, metric).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        d = np.round(pairwise(x[:5].astype(float), x.astype(float), metric), 6)
        assert got == {i: np.lexsort((np.arange(300), d[i]))[:4].tolist() for i in range(5)}
    assert knn_batch(df, q.limit(0), 4).count() == 0 and knn_batch(df, q, 0).count() == 0


def test_indexes(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(600, 8)) + rng.integers(0, 4, (600, 1)) * 2).astype(np.float32)
    df = frame(spark, x.tolist())
    ivf = VectorIndex("ivf", cells=8, nprobe=4).build(df)
    ivf.save(str(tmp_path / "ivf"))
    ivf = VectorIndex.load(spark, str(tmp_path / "ivf"))
    flat = VectorIndex("flat").build(df)
    hit = 0
    for i in range(0, 600, 60):
        want = {r.vec_id for r in flat.search(x[i].tolist(), 10).collect()}
        hit += len(want & {r.vec_id for r in ivf.search(x[i].tolist(), 10).collect()})
    assert hit >= 0.9 * 100
    assert flat.remove(df.where("vec_id = 0")).search(x[0].tolist(), 1).first().vec_id != 0
    graph = VectorIndex("diskann").build(df).remove(df.where("vec_id = 0")).insert(df.where("vec_id = 0"))
    assert [r.vec_id for r in graph.search(x[0].tolist(), 10, labels=[1, 2]).collect()] == [r.vec_id for r in flat.search(x[0].tolist(), 10, labels=[1, 2]).collect()]
    with pytest.raises(ValueError):
        VectorIndex("tree")


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product", "l1"])
def test_cells_follow_the_metric(spark, sf, metric):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    e = e.withColumn("embedding", F.transform("embedding", lambda x: (x * (1 + F.col("vec_id") % 7)).cast("float")))  # lengths differ
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got, want = ({(r.query_id, r.vec_id) for r in VectorIndex(kind, metric).build(e).search_batch(q, 10).collect()} for kind in ("ivf", "flat"))
    assert len(want & got) >= 0.9 * len(want)


def test_query_blocks_and_small_batches(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(200, 4)), 1).astype(np.float32)  # with ties
    x[7] = np.nan
    df = frame(spark, x.tolist()).repartition(3)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(30)], "query_id long, query array<float>").orderBy("query_id")
    want = knn_batch(df, q, 6).collect()
    monkeypatch.setattr(knn_module, "BLOCK", 4 * 7)
    monkeypatch.setattr(knn_module, "_PAIRS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        rows = knn_batch(df, q, 6)
        assert sorted(map(repr, rows.collect())) == sorted(map(repr, want)) and len(want) == 180
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("kind", ["flat", "ivf"])
def test_batch_memory_of_a_task(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(10_000, 32)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(10_000), "embedding": list(x)}))
    q = df.where("vec_id < 1000").selectExpr("vec_id AS query_id", "embedding AS query")
    index, tasks, original = VectorIndex(kind, cells=2, nprobe=2).build(df), [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, fn, schema: tasks.append(fn) or original(self, fn, schema))
    index.search_batch(q, 5)
    (run,) = tasks
    batch = pd.DataFrame({"vec_id": np.arange(10_000), "v": list(x), "_cell": np.arange(10_000) % 2})
    tracemalloc.start()
    try:
        out = pd.concat(run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20e6
    d = np.round(pairwise(x[:50].astype(float), x.astype(float), "l2"), 6)
    want = {i: np.lexsort((np.arange(10_000), d[i]))[:5].tolist() for i in range(50)}
    assert {i: out[out.query_id == i].sort_values(["distance", "vec_id"]).vec_id.tolist() for i in range(50)} == want


def test_batch_of_many_neighbours_and_spread_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(120, 3)), 1).astype(np.float32)  # with ties
    x[7] = np.nan
    df = frame(spark, x.tolist()).coalesce(1)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(20)], "query_id long, query array<float>")
    want = {k: sorted(map(repr, knn_batch(df, q, k).collect())) for k in (7, 120)}
    assert len(want[7]) == 140 and len(want[120]) == 2400
    for name, value in (("TOP", 50), ("BLOCK", 2000), ("_SPREAD", 1), ("_TILE", 20), ("_PAIRS", 16), ("_OUT", 9)):
        monkeypatch.setattr(knn_module, name, value)
    assert sorted(map(repr, knn_batch(df, q, 7).collect())) == want[7]
    assert sorted(map(repr, knn_batch(df, q, 10**9).collect())) == want[120]
