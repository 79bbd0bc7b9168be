"""Registered queries of the vector, table and container operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import distance as D
from ..functions import hashing as H
from ..functions import maps as M
from ..operators import knn as K
from ..operators.selection import cleared, numbered, project, replace_column
from ..sources.catalog import AlreadyExists, Catalog, NotFound, Protected
from ..sources.storage import scratch
from ..sources.table import Table
from ..sources.types import Column as Col
from ..sources.types import schema_of
from ..streaming.append import append_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None, fn: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings")


def query_vector(spark: SparkSession, sf: str, i: int = 0) -> list[float]:
    return list(emb(spark, sf).where(F.col("vec_id") == i).first()["embedding"])


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


# -- distances and nearest neighbours -----------------------------------------
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_E = "embedding::DOUBLE[]"
_DIST = {
    "l2": f"list_distance({_E}, {_Q})",
    "l2_squared": f"pow(list_distance({_E}, {_Q}), 2)",
    "cosine": f"list_cosine_distance({_E}, {_Q})",
    "inner_product": f"list_negative_inner_product({_E}, {_Q})",
    "l1": f"list_sum(list_transform(list_zip({_E}, {_Q}), lambda p: abs(p[1] - p[2])))",
}


def knn_sql(metric: str, k: int = 10, where: str = "true", cols: str = "vec_id, label") -> str:
    return f"SELECT {cols}, distance FROM (SELECT vec_id, label, round({_DIST[metric]}, 6) + 0.0::DOUBLE AS distance FROM embeddings WHERE {where}) ORDER BY distance, vec_id LIMIT {k}"


def nearest(metric: str, k: int = 10, prepare=lambda e: e, cols=("vec_id", "label"), **kw):
    def run(spark, sf):
        return K.knn(prepare(emb(spark, sf)), query_vector(spark, sf), k, metric, **kw).select(*cols, "distance")

    return run


for _name, _metric in (("l2", "l2"), ("l2sq", "l2_squared"), ("cosine", "cosine"), ("ip", "inner_product"), ("l1", "l1")):
    _add(f"knn_{_name}", knn_sql(_metric), nearest(_metric))
    _add(f"distance_{_name}", f"SELECT vec_id, round({_DIST[_metric]}, 6) + 0.0::DOUBLE AS distance FROM embeddings", (lambda m: lambda spark, sf: emb(spark, sf).select("vec_id", r6(D.distance("embedding", query_vector(spark, sf), m)).alias("distance")))(_metric))
_add("inner_product_raw", f"SELECT vec_id, round(list_inner_product({_E}, {_Q}), 6) + 0.0::DOUBLE AS product FROM embeddings", lambda s, d: emb(s, d).select("vec_id", r6(D.raw_inner_product("embedding", query_vector(s, d))).alias("product")))
_add("knn_k_exceeds_rows", knn_sql("l2", 1_000_000_000), nearest("l2", 1_000_000_000))
_add("knn_k_zero", knn_sql("l2", 0), nearest("l2", 0))
_add("knn_no_payload", knn_sql("l2", 10, cols="vec_id"), nearest("l2", 10, lambda e: e.select("vec_id", "embedding"), ("vec_id",)))
_add("knn_two_batches", knn_sql("l2"), nearest("l2", 10, lambda e: e.where("vec_id % 2 = 0").unionByName(e.where("vec_id % 2 = 1"))))
_add("knn_skip_null_embedding", knn_sql("l2", 10, "vec_id % 5 <> 0 OR vec_id = 0"), nearest("l2", 10, lambda e: e.withColumn("embedding", F.when((F.col("vec_id") % 5 != 0) | (F.col("vec_id") == 0), F.col("embedding")))))
_add("knn_label_filter", knn_sql("l2", 10, "label IN (1, 3)"), nearest("l2", 10, labels=(1, 3)))
_add("flat_index", knn_sql("cosine", 10), lambda s, d: K.VectorIndex("flat", "cosine").build(emb(s, d)).search(query_vector(s, d), 10).select("vec_id", "label", "distance"))

_add("graph_index", knn_sql("inner_product", 10, "label IN (1, 3)"), lambda s, d: K.VectorIndex("diskann", "inner_product").build(emb(s, d)).search(query_vector(s, d), 10, labels=(1, 3)).select("vec_id", "label", "distance"))


def _skip_deleted(spark, sf):
    t = Table(spark, scratch(spark, "skip-deleted"), schema_of([Col("vec_id", "BIGINT"), Col("embedding", "VECTOR", 64), Col("label", "INTEGER")]), "embedding")
    t.append(emb(spark, sf))
    t.delete(t.current(system=True).where("vec_id % 7 = 0 AND vec_id > 0"))
    return t.knn(query_vector(spark, sf), 10).select("vec_id", "label", "distance")


_add("knn_skip_deleted", knn_sql("l2", 10, "NOT (vec_id % 7 = 0 AND vec_id > 0)"), _skip_deleted)


def _query_vectors(spark, sf):
    return emb(spark, sf).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _batch(spark, sf):
    return K.knn_batch(emb(spark, sf), _query_vectors(spark, sf), 10).select("query_id", "vec_id", "distance", "rank")


_add(
    "knn_batch",
    """SELECT query_id, vec_id, distance, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) + 0.0::DOUBLE AS distance
    FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 10""",
    _batch,
)
_add("ivf_index", None, lambda s, d: K.VectorIndex("ivf").build(emb(s, d)).search_batch(_query_vectors(s, d), 10).select("query_id", "vec_id", "distance", "rank"))
_add("vec_norm", f"SELECT vec_id, round(sqrt(list_inner_product({_E}, {_E})), 6) AS norm FROM embeddings", lambda s, d: emb(s, d).select("vec_id", r6(D.norm("embedding")).alias("norm")))
_add(
    "vec_normalize",
    f"SELECT vec_id, i::INTEGER AS i, round(u[i + 1], 6) + 0.0::DOUBLE AS x FROM (SELECT vec_id, unnest(range(64)) AS i, list_transform({_E}, lambda x: x / sqrt(list_inner_product({_E}, {_E}))) AS u FROM embeddings)",
    lambda s, d: emb(s, d).select("vec_id", F.posexplode(D.normalize("embedding")).alias("i", "x")).select("vec_id", "i", r6(F.col("x")).alias("x")),
)
_add("vec_dim_mismatch", "SELECT vec_id, true AS is_nan FROM embeddings", lambda s, d: emb(s, d).select("vec_id", F.isnan(D.l2("embedding", F.slice("embedding", 1, 32))).alias("is_nan")))
_add("vec_zero_cosine", "SELECT vec_id, true AS is_nan FROM embeddings", lambda s, d: emb(s, d).select("vec_id", F.isnan(D.cosine("embedding", F.transform("embedding", lambda x: x * 0))).alias("is_nan")))

# -- projections and scans ------------------------------------------------------
_add("project_subset", "SELECT c_custkey, c_acctbal FROM customer", lambda s, d: project(load(s, d, "customer"), [0, 3]))
_add("project_reverse", "SELECT c_mktsegment, c_acctbal, c_nationkey, c_name, c_custkey FROM customer", lambda s, d: project(load(s, d, "customer"), [4, 3, 2, 1, 0]))
_add("scan_all", "SELECT * FROM lineitem", lambda s, d: project(load(s, d, "lineitem")))
_add("column_replace", "SELECT c_custkey, c_name, c_nationkey, -c_acctbal AS c_acctbal, c_mktsegment FROM customer", lambda s, d: replace_column(load(s, d, "customer"), 3, -F.col("c_acctbal")))
_add("batch_clear", "SELECT * FROM customer WHERE false", lambda s, d: cleared(load(s, d, "customer")))
_add("point_lookup", "SELECT * FROM customer WHERE c_custkey = 42", lambda s, d: load(s, d, "customer").where("c_custkey = 42"))

# -- arrays ---------------------------------------------------------------------
_A = "(embedding[1:8])::DOUBLE[]"


def _arr(name: str, sql: str, fn) -> None:
    """fn gives named columns over ``a``, the first eight components as doubles."""

    def run(spark, sf):
        e = emb(spark, sf).select("vec_id", F.slice("embedding", 1, 8).cast("array<double>").alias("a"))
        return e.select("vec_id", *[c.alias(n) for n, c in fn(F.col("a")).items()])

    _add(name, f"SELECT vec_id, {sql} FROM (SELECT vec_id, {_A} AS a FROM embeddings)", run)


def flat(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.round(x * 1000000).cast("long").cast("string")), ",", "null")


def flat_sql(a: str) -> str:
    return f"array_to_string(list_transform({a}, lambda x: coalesce(round(x * 1000000)::BIGINT::VARCHAR, 'null')), ',')"


_arr("arr_push", f"{flat_sql('list_append(a, 1.5)')} AS r", lambda a: {"r": flat(A.push_back(a, 1.5))})
_arr("arr_pop", f"{flat_sql('a[1:7]')} AS r, round(a[8], 6) AS popped", lambda a: {"r": flat(A.pop_back(a)), "popped": F.round(A.back(a), 6)})
_arr("arr_get", "round(a[3], 6) AS r, a[9] AS oob", lambda a: {"r": F.round(A.get(a, 2), 6), "oob": A.get(a, 8)})
_arr("arr_set", f"{flat_sql('list_transform(a, lambda x, i: CASE WHEN i = 4 THEN 9.0 ELSE x END)')} AS r, {flat_sql('a')} AS oob", lambda a: {"r": flat(A.set_at(a, 3, 9.0)), "oob": flat(A.set_at(a, 8, 9.0))})
_arr("arr_size", "8::INTEGER AS n, false AS is_empty", lambda a: {"n": A.size(a), "is_empty": A.empty(a)})
_arr("arr_insert", f"{flat_sql('a[1:2] || [7.0] || a[3:8]')} AS mid, {flat_sql('a || [7.0]')} AS last, {flat_sql('a')} AS oob", lambda a: {"mid": flat(A.insert(a, 2, 7.0)), "last": flat(A.insert(a, 8, 7.0)), "oob": flat(A.insert(a, 9, 7.0))})
_arr("arr_erase", f"{flat_sql('a[1:2] || a[4:8]')} AS r, {flat_sql('a')} AS oob", lambda a: {"r": flat(A.erase(a, 2)), "oob": flat(A.erase(a, 8))})
_arr("arr_find", "coalesce(list_position(a, a[5]) - 1, -1)::INTEGER AS hit, (-1)::INTEGER AS miss, coalesce(list_position(list_transform(a, lambda x: x > 0), true) - 1, -1)::INTEGER AS positive", lambda a: {"hit": A.find(a, F.get(a, 4)), "miss": A.find(a, 5.0), "positive": A.find(a, 0.0, lambda v, x: v > x)})
_arr("arr_front_back", "round(a[1], 6) AS f, round(a[8], 6) AS b", lambda a: {"f": F.round(A.front(a), 6), "b": F.round(A.back(a), 6)})
_arr("arr_resize", f"{flat_sql('a || [2.0, 2.0]')} AS grown, {flat_sql('a[1:3]')} AS cut", lambda a: {"grown": flat(A.resize(a, 10, 2.0)), "cut": flat(A.resize(a, 3, 2.0))})
_arr("arr_clear", "0::INTEGER AS n", lambda a: {"n": A.size(A.clear(a))})
_arr("gather_sel", f"{flat_sql('[a[7], a[1], a[1], a[4]]')} AS r, {flat_sql('[a[1], a[1]]')} AS part", lambda a: {"r": flat(A.gather(a, F.array(*map(F.lit, (6, 0, 0, 3))))), "part": flat(A.gather(a, F.array(*map(F.lit, (6, 0, 0, 3))), 1, 2))})
_arr("gather_nullmask", f"{flat_sql('list_transform(a, lambda x, i: CASE WHEN x < 0 THEN 0.0 ELSE x END)')} AS r", lambda a: {"r": flat(A.gather_masked(a, None, F.transform(a, lambda x: x < 0)))})
_arr("slice_copy", f"{flat_sql('a[3:5]')} AS r, {flat_sql('a')} AS whole", lambda a: {"r": flat(A.copy_slice(a, 2, 3)), "whole": flat(A.copy_slice(a))})
_add("arr_iter", f"SELECT vec_id, i::INTEGER AS i, round(a[i + 1] * 2, 6) AS x FROM (SELECT vec_id, {_A} AS a, unnest(range(8)) AS i FROM embeddings)", lambda s, d: emb(s, d).select("vec_id", F.posexplode(F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 2)).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x")))

# -- maps -------------------------------------------------------------------------
_MAPS = "(SELECT o_custkey, map_from_entries(list((o_orderkey, o_totalprice))) AS m, min(o_orderkey) AS k FROM orders GROUP BY o_custkey)"


def _map(name: str, sql: str, fn) -> None:
    def run(spark, sf):
        o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("m"), F.min("o_orderkey").alias("k"))
        return o.select("o_custkey", *[c.alias(n) for n, c in fn(F.col("m"), F.col("k")).items()])

    _add(name, f"SELECT o_custkey, {sql} FROM {_MAPS}", run)


_map("map_upsert", "-1.0::DOUBLE AS old_key, cardinality(m)::INTEGER AS n_old, cardinality(m)::INTEGER + 1 AS n_new", lambda m, k: {"old_key": M.get(M.upsert(m, k, -1.0), k), "n_old": M.size(M.upsert(m, k, -1.0)), "n_new": M.size(M.upsert(m, F.lit(-5).cast("long"), -1.0))})
_map("map_get", "m[k] AS hit, m[-5] AS miss", lambda m, k: {"hit": M.get(m, k), "miss": M.get(m, F.lit(-5).cast("long"))})
_map("map_delete", "cardinality(m)::INTEGER - 1 AS n, false AS still", lambda m, k: {"n": M.size(M.delete(m, k)), "still": M.contains(M.delete(m, k), k)})
_map("map_contains", "true AS hit, false AS miss", lambda m, k: {"hit": M.contains(m, k), "miss": M.contains(m, F.lit(-5).cast("long"))})
_map("map_size", "cardinality(m)::INTEGER AS n", lambda m, k: {"n": M.size(m)})
_add("map_iter", "SELECT o_custkey, o_orderkey AS key, o_totalprice AS value FROM orders", lambda s, d: M.entries(load(s, d, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("m")), "m"))

# -- hashes -----------------------------------------------------------------------
_add(
    "hash_murmur32",
    """WITH a AS (SELECT c_custkey, (c_custkey & 4294967295)::UHUGEINT AS h FROM customer),
b AS (SELECT c_custkey, xor(h, h >> 16) AS h FROM a), c AS (SELECT c_custkey, (h * 2246822507) % 4294967296 AS h FROM b),
d AS (SELECT c_custkey, xor(h, h >> 13) AS h FROM c), e AS (SELECT c_custkey, (h * 3266489909) % 4294967296 AS h FROM d)
SELECT c_custkey, xor(h, h >> 16)::BIGINT AS h FROM e""",
    lambda s, d: load(s, d, "customer").select("c_custkey", H.murmur32("c_custkey").alias("h")),
)
_add(
    "hash_djb2",
    "SELECT c_custkey, list_reduce(list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT), lambda h, b: (h * 33 + b) % 4294967296, 5381::BIGINT) AS h FROM customer",
    lambda s, d: load(s, d, "customer").select("c_custkey", H.djb2("c_name").alias("h")),
)
#: CTEs: x is the finaliser of h, a column of a.
_MURMUR = """b AS (SELECT *, xor(h, h >> 16) AS x FROM a), c AS (SELECT * EXCLUDE (x), (x * 2246822507) % 4294967296 AS x FROM b),
d AS (SELECT * EXCLUDE (x), xor(x, x >> 13) AS x FROM c), e AS (SELECT * EXCLUDE (x), (x * 3266489909) % 4294967296 AS x FROM d),
f AS (SELECT * EXCLUDE (x), xor(x, x >> 16)::BIGINT AS x FROM e)"""
_add(
    "hash_block_checksum",
    f"WITH a AS (SELECT c_nationkey, (c_custkey & 4294967295)::UHUGEINT AS h FROM customer), {_MURMUR} SELECT c_nationkey, xor(5381, bit_xor(x)) AS checksum FROM f GROUP BY c_nationkey",
    lambda s, d: load(s, d, "customer").groupBy("c_nationkey").agg(H.block_checksum_agg("c_custkey").alias("checksum")),
)
_add(
    "hash_buffer_checksum",
    f"""WITH w AS (SELECT c_custkey, c_name, unnest(range(0, length(c_name) // 8)) * 8 AS i FROM customer),
a AS (SELECT c_custkey, (ascii(c_name[i + 1]) + 256 * ascii(c_name[i + 2]) + 65536 * ascii(c_name[i + 3]) + 16777216 * ascii(c_name[i + 4])::BIGINT)::UHUGEINT AS h FROM w), {_MURMUR},
t AS (SELECT c_custkey, c_name[length(c_name) // 8 * 8 + 1:] AS rest FROM customer),
u AS (SELECT c_custkey, CASE WHEN rest = '' THEN 0 ELSE list_reduce(list_transform(string_split(rest, ''), lambda c: ascii(c)::BIGINT), lambda h, b: h * 33 + b, 5381::BIGINT) END AS tail FROM t)
SELECT c_custkey, xor(xor(5381, bit_xor(x)), any_value(tail)) AS checksum FROM f JOIN u USING (c_custkey) GROUP BY c_custkey""",
    lambda s, d: load(s, d, "customer").select("c_custkey", H.buffer_checksum("c_name").alias("checksum")),
)
_add(
    "hash_murmur64",
    """WITH a AS (SELECT c_custkey, ((c_custkey::HUGEINT * 1000003000017 % 18446744073709551616)::UHUGEINT) AS h FROM customer),
b AS (SELECT c_custkey, (xor(h, h >> 30) * 13787848793156543929) % 18446744073709551616 AS h FROM a),
c AS (SELECT c_custkey, (xor(h, h >> 27) * 10723151780598845931) % 18446744073709551616 AS h FROM b),
d AS (SELECT c_custkey, xor(h, h >> 31) AS h FROM c)
SELECT c_custkey, CASE WHEN h >= 9223372036854775808 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END AS h FROM d""",
    lambda s, d: load(s, d, "customer").select("c_custkey", H.murmur64(F.col("c_custkey") * 1000003000017).alias("h")),
)
_add(
    "key_equals",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END IS NOT DISTINCT FROM CASE WHEN c_custkey % 2 <> 0 THEN 7 END AS same FROM customer",
    lambda s, d: load(s, d, "customer").select("c_custkey", H.key_equals(F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")), F.when(F.col("c_custkey") % 2 != 0, F.lit(7))).alias("same")),
)

# -- versions, payloads, catalog ---------------------------------------------------
_ORDERS = [Col("o_orderkey", "BIGINT"), Col("o_custkey", "BIGINT"), Col("o_totalprice", "DOUBLE")]
_FIVE, _SEVEN = "o_orderkey % 5 = 0", "o_orderkey % 7 = 0"


def versioned(spark, sf) -> Table:
    """orders; then every 5th key gets a new price, then every 7th is deleted."""
    t = Table(spark, scratch(spark, "versions"), schema_of(_ORDERS))
    t.append(load(spark, sf, "orders").select(*[c.name for c in _ORDERS]))
    t.update(t.current(system=True).where(_FIVE).select("_batch", "_pos", (F.col("o_totalprice") + 1).alias("o_totalprice")))
    t.delete(t.current(system=True).where(_SEVEN))
    return t


_PRICE = f"CASE WHEN {_FIVE} THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice"
_add("mvcc_current", f"SELECT o_orderkey, o_custkey, {_PRICE} FROM orders WHERE NOT {_SEVEN}", lambda s, d: versioned(s, d).current())
_add(
    "mvcc_history",
    f"""SELECT o_orderkey, 1::BIGINT AS xmin, (CASE WHEN {_FIVE} THEN 2 WHEN {_SEVEN} THEN 3 ELSE 0 END)::BIGINT AS xmax, o_totalprice FROM orders
UNION ALL SELECT o_orderkey, 2::BIGINT, (CASE WHEN {_SEVEN} THEN 3 ELSE 0 END)::BIGINT, o_totalprice + 1 FROM orders WHERE {_FIVE}""",
    lambda s, d: versioned(s, d).history().where("NOT _deleted").select("o_orderkey", F.col("_xmin").alias("xmin"), F.col("_xmax").cast("long").alias("xmax"), "o_totalprice"),
)


def _get(spark, sf):
    """The latest versions of three rows, one of which is deleted, each by its name."""
    t = versioned(spark, sf)
    names = t.versions().where("_xmin = 1 AND o_orderkey IN (5, 6, 7)").select("_batch", "_pos").collect()
    found = [t.get(r._batch, r._pos).select("o_orderkey", "o_totalprice") for r in names]
    return found[0].unionByName(found[1]).unionByName(found[2])


_add("mvcc_get", f"SELECT o_orderkey, {_PRICE} FROM orders WHERE o_orderkey IN (5, 6) AND NOT {_SEVEN}", _get)


def _get_version(spark, sf):
    t = versioned(spark, sf)
    r = t.versions().where("_xmin = 1 AND o_orderkey = 5").first()
    return t.get_version(r._batch, r._pos, 1).unionByName(t.get_version(r._batch, r._pos, 2)).select("o_orderkey", F.col("_xmin").alias("xmin"), "o_totalprice")


_add("mvcc_get_version", "SELECT o_orderkey, 1::BIGINT AS xmin, o_totalprice FROM orders WHERE o_orderkey = 5 UNION ALL SELECT o_orderkey, 2::BIGINT, o_totalprice + 1 FROM orders WHERE o_orderkey = 5", _get_version)


def _vacuum(spark, sf):
    t = versioned(spark, sf)
    before = t.slot_count()
    t.compact()
    return t.scan().withColumn("freed", F.lit(before - t.slot_count()).cast("long"))


_add("vacuum", f"SELECT o_orderkey, o_custkey, {_PRICE}, (SELECT count(*) FILTER (WHERE {_FIVE}) + count(*) FILTER (WHERE {_SEVEN}) FROM orders) AS freed FROM orders WHERE NOT {_SEVEN}", _vacuum)
_add("slot_count", f"SELECT count(*) + count(*) FILTER (WHERE {_FIVE}) AS n FROM orders", lambda s, d: s.createDataFrame([(versioned(s, d).slot_count(),)], "n long"))

_add(
    "transactions",
    f"SELECT 1::BIGINT AS txn, 'append' AS kind, count(*) AS n FROM orders UNION ALL SELECT 2, 'update', count(*) FROM orders WHERE {_FIVE} UNION ALL SELECT 3, 'delete', count(*) FROM orders WHERE {_SEVEN}",
    lambda s, d: s.createDataFrame([(r["txn"], r["kind"], r["rows"]) for r in versioned(s, d).records()], "txn long, kind string, n long"),
)


def _embedding_get(spark, sf):
    """One row of an embedding table by its name."""
    t = Table(spark, scratch(spark, "by-name"), schema_of([Col("vec_id", "BIGINT"), Col("embedding", "VECTOR", 64)]), "embedding")
    t.append(emb(spark, sf).select("vec_id", "embedding"))
    r = t.current(system=True).where("vec_id = 7").select("_batch", "_pos").first()
    return t.get(r._batch, r._pos).select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", r6(F.col("x").cast("double")).alias("x"))


_add("embedding_get", "SELECT vec_id, i::INTEGER AS i, round(embedding[i + 1]::DOUBLE, 6) + 0.0::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings WHERE vec_id = 7)", _embedding_get)


def _cast(spark, sf):
    """Values are cast to the declared types."""
    t = Table(spark, scratch(spark, "cast"), schema_of([Col("k", "INTEGER"), Col("d", "DOUBLE"), Col("t", "VARCHAR"), Col("s", "SMALLINT")]), "column")
    c = load(spark, sf, "customer")
    t.append(c.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("d"), F.col("c_custkey").alias("t"), F.col("c_nationkey").alias("s")))
    return t.scan()


_add("append_casts", "SELECT c_custkey::INTEGER AS k, c_nationkey::DOUBLE AS d, c_custkey::VARCHAR AS t, c_nationkey::SMALLINT AS s FROM customer", _cast)


def _streamed(spark, sf):
    """A stream of files, appended twice from one checkpoint: the second time finds nothing new."""
    rows = load(spark, sf, "events").select("event_id", "user_id")
    t = Table(spark, scratch(spark, "streamed"), schema_of([Col("event_id", "BIGINT"), Col("user_id", "BIGINT")]))
    source, checkpoint = scratch(spark, "stream-source"), scratch(spark, "stream-checkpoint")
    rows.write.parquet(source)
    for _ in range(2):
        append_stream(spark.readStream.schema(rows.schema).parquet(source), t, checkpoint).awaitTermination()
    return t.scan()


_add("stream_append", "SELECT event_id::BIGINT AS event_id, user_id::BIGINT AS user_id FROM events", _streamed)

_PAYLOAD = [Col("k", "BIGINT"), Col("b", "BOOLEAN"), Col("i", "INTEGER"), Col("f", "FLOAT"), Col("d", "DOUBLE"), Col("t", "VARCHAR")]


def _payload(spark, sf):
    t = Table(spark, scratch(spark, "payload"), schema_of(_PAYLOAD))
    c = load(spark, sf, "customer")
    odd = F.col("c_custkey") % 3 != 0
    t.append(c.select(F.col("c_custkey").alias("k"), F.when(odd, F.col("c_acctbal") > 0).alias("b"), F.when(odd, F.col("c_nationkey")).alias("i"), F.when(odd, (F.col("c_custkey") / 4).cast("float")).alias("f"), F.when(odd, F.col("c_acctbal")).alias("d"), F.when(odd, F.col("c_name")).alias("t")))
    return t.scan()


_add("payload_types", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal > 0 END AS b, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS i, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey / 4)::FLOAT END AS f, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS d, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS t FROM customer", _payload)
_add("json_payload", "SELECT event_id, (props->>'$.k')::VARCHAR AS k FROM events", lambda s, d: load(s, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "string").alias("k")))
_add("missing_payload_null", "SELECT c_custkey AS k, NULL::DOUBLE AS d FROM customer", lambda s, d: (lambda t: (t.append(load(s, d, "customer").select(F.col("c_custkey").alias("k"))), t.scan([0, 1]))[1])(Table(s, scratch(s, "missing"), schema_of([Col("k", "BIGINT"), Col("d", "DOUBLE")]))))


def _customers(spark, sf) -> Table:
    """Two batches, each in the order of c_custkey: the even keys, then the odd ones."""
    t, c = Table(spark, scratch(spark, "ordered"), schema_of([Col("c_custkey", "BIGINT"), Col("c_acctbal", "DOUBLE")])), load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    for rest in (0, 1):
        t.append(c.where(F.col("c_custkey") % 2 == rest).orderBy("c_custkey"))
    return t


_NUMBERED = "SELECT c_custkey, c_acctbal, (row_number() OVER (ORDER BY c_custkey % 2, c_custkey) - 1)::BIGINT AS nr FROM customer"


def _ordered(spark, sf):
    """Numbers the rows in the order in which the scan hands them on."""
    return numbered(_customers(spark, sf).scan([0], ordered=True), "nr")


def _in_batches(spark, sf):
    at, rows = 0, []
    for b in _customers(spark, sf).batches([0]):
        rows.append((at, b.num_rows, b.column(0)[0].as_py(), b.column(0)[-1].as_py()))
        at += 1
    return spark.createDataFrame(rows, "batch long, n long, first long, last long")


_add("ordered_scan", f"SELECT c_custkey, nr FROM ({_NUMBERED})", _ordered)
_add("batch_scan", f"SELECT nr // 50 AS batch, count(*)::BIGINT AS n, arg_min(c_custkey, nr) AS first, arg_max(c_custkey, nr) AS last FROM ({_NUMBERED}) GROUP BY nr // 50", _in_batches)
_add("row_range", f"SELECT c_custkey, c_acctbal FROM ({_NUMBERED}) WHERE nr BETWEEN 70 AND 79", lambda s, d: _customers(s, d).row_range(70, 10))


def catalog(spark) -> Catalog:
    c = Catalog(spark, scratch(spark, "catalog"))
    c.create_schema("main")
    c.create_schema("public")
    c.create_table("main", "region", [Col("r_regionkey", "INTEGER"), Col("r_name", "VARCHAR")])
    c.create_table("public", "products", [Col("id", "BIGINT"), Col("price", "FLOAT"), Col("count", "INTEGER")])
    c.create_table("public", "gone", [Col("x", "INTEGER")])
    c.drop_table("public", "gone")
    return c


_add(
    "catalog_history",
    "SELECT * FROM (VALUES ('schema', '', 'main', 1, false), ('schema', '', 'public', 1, false), ('table', 'main', 'region', 1, false), ('table', 'public', 'products', 1, false), ('table', 'public', 'gone', 1, false), ('table', 'public', 'gone', 2, true)) AS t(kind, schema, name, version, deleted)",
    lambda s, d: catalog(s).history(),
)
_add("catalog_types", "SELECT * FROM (VALUES (0, 'BIGINT'), (1, 'FLOAT'), (2, 'INTEGER')) AS t(i, type)", lambda s, d: s.createDataFrame(list(enumerate(catalog(s).types("public", "products"))), "i int, type string"))


def _roundtrip(spark, sf):
    c = catalog(spark)
    c.table("main", "region").append(load(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name"))
    c.checkpoint()
    return Catalog.load(spark, c.root).table("main", "region").scan()


_add("checkpoint_roundtrip", "SELECT r_regionkey::INTEGER AS r_regionkey, r_name FROM region", _roundtrip)


def _codes(spark, sf):
    """What each catalog call answers: its number or the error's code."""

    def code(call) -> int:
        try:
            return int(call())
        except (AlreadyExists, NotFound, Protected) as e:
            return e.code

    c, x = catalog(spark), [Col("x", "INTEGER")]
    calls = {
        "create_schema": lambda: c.create_schema("more"),
        "create_schema again": lambda: c.create_schema("more"),
        "create_schema if_not_exists": lambda: c.create_schema("more", if_not_exists=True),
        "has_schema": lambda: c.has_schema("more"),
        "has_schema missing": lambda: c.has_schema("never"),
        "create_table": lambda: c.create_table("more", "region", x),
        "create_table again": lambda: c.create_table("more", "region", x),
        "create_table if_not_exists": lambda: c.create_table("more", "region", x, if_not_exists=True),
        "create_table no schema": lambda: c.create_table("never", "region", x),
        "get_table": lambda: c.table("more", "region") is not None,
        "get_table of the same name": lambda: c.types("main", "region") != c.types("more", "region"),
        "get_table missing": lambda: c.table("more", "never") is not None,
        "drop_table": lambda: c.drop_table("more", "region"),
        "get_table dropped": lambda: c.table("more", "region") is not None,
        "drop_schema": lambda: c.drop_schema("more"),
        "drop_schema missing": lambda: c.drop_schema("never"),
        "drop_schema default": lambda: c.drop_schema("main"),
        "has_schema dropped": lambda: c.has_schema("more"),
        "tables": lambda: c.count("table", "public"),
    }
    return spark.createDataFrame([(k, code(f)) for k, f in calls.items()], "call string, code int")


_add(
    "catalog_codes",
    """SELECT * FROM (VALUES ('create_schema', 0), ('create_schema again', -2), ('create_schema if_not_exists', 0), ('has_schema', 1), ('has_schema missing', 0),
('create_table', 0), ('create_table again', -2), ('create_table if_not_exists', 0), ('create_table no schema', -1), ('get_table', 1), ('get_table of the same name', 1),
('get_table missing', 0), ('drop_table', 1), ('get_table dropped', 0), ('drop_schema', 0), ('drop_schema missing', 0), ('drop_schema default', -1), ('has_schema dropped', 0), ('tables', 1)) AS t(call, code)""",
    _codes,
)


def _two_cycles(spark, sf):
    """Write, checkpoint, load; write, checkpoint, load: on one root. What comes after a checkpoint is lost with its catalog."""
    region = load(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")
    c = catalog(spark)
    c.table("main", "region").append(region.where("r_regionkey < 2"))
    c.checkpoint()
    c.table("main", "region").append(region.where("r_regionkey = 2"))
    c = Catalog.load(spark, c.root)
    c.table("main", "region").append(region.where("r_regionkey > 2"))
    c.checkpoint()
    return Catalog.load(spark, c.root).table("main", "region").scan()


_add("checkpoint_two_cycles", "SELECT r_regionkey::INTEGER AS r_regionkey, r_name FROM region WHERE r_regionkey <> 2", _two_cycles)
