"""The registered IVF query on the supplied embeddings against the exact answer."""

import pytest

from stellate.operators.knn import VectorIndex
from stellate.plans.queries import QUERIES, emb


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_recall(spark, sf, size):
    at = sf.replace("sf0.001", size)
    want, got = ({(r.query_id, r.vec_id) for r in QUERIES[q](spark, at).collect()} for q in ("knn_batch", "ivf_index"))
    assert len(got) == len(want) == 10 * emb(spark, at).where("vec_id % 20 = 0").count()
    print(size, len(want & got) / len(want))
    assert len(want & got) >= 0.9 * len(want)


def test_batch_gives_what_single_searches_give(spark, sf):
    e = emb(spark, sf)
    index = VectorIndex("ivf", nprobe=3).build(e)
    q = e.where("vec_id % 100 = 0")
    batch = {}
    for r in index.search_batch(q.selectExpr("vec_id AS query_id", "embedding AS query"), 10).orderBy("query_id", "rank").collect():
        batch.setdefault(r.query_id, []).append((r.vec_id, r.distance))
    assert batch == {r.vec_id: [(x.vec_id, x.distance) for x in index.search(list(r.embedding), 10).collect()] for r in q.collect()}
