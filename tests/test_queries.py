"""Every core query with SQL against DuckDB, and the plans of the headline ones."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from stellate.functions import arrays as A
from stellate.functions import hashing as H
from stellate.functions import maps as M
from stellate.plans.queries import QUERIES, SQL


def rows(cursor):
    return sorted(tuple("NaN" if isinstance(x, float) and x != x else repr(x) for x in r) for r in cursor)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(map(tuple, got.select(*names).collect())) == rows(want.fetchall())


def test_ordered_scan_over_partitions(spark, sf, duck):
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}  # as of larger tables, whose partitions are merged by bytes
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = QUERIES["ordered_scan"](spark, sf)
        assert rows(map(tuple, got.collect())) == rows(duck.execute(SQL["ordered_scan"]).fetchall())
        assert sorted(r.nr for r in got.select("nr").collect()) == list(range(got.count()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_plans(spark, sf):
    plan = QUERIES["project_subset"](spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,42)]" in QUERIES["point_lookup"](spark, sf)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in QUERIES["knn_l2"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_container_edges(spark):
    one = spark.range(1).select(F.array().cast("array<int>").alias("e"), F.array(F.lit(1), F.lit(2)).alias("a"), F.lit(None).cast("array<int>").alias("n"), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    r = one.select(
        A.pop_back("e").alias("pop"), A.front("e").alias("front"), A.back("e").alias("back"), A.size("n").alias("size"), A.empty("n").alias("empty"), A.insert("a", 3, 9).alias("ins"),
        A.resize("a", 0, 5).alias("cut"), A.get("a", -1).alias("neg"), M.get("m", "x").alias("miss"), M.upsert("m", "k", 2).alias("up"), H.djb2(F.lit("")).alias("h0"),
        A.copy_slice("e").alias("none"), A.gather("a", F.array(F.lit(5))).alias("oob"),
    ).first()
    assert (r.pop, r.front, r.back, r["size"], r.empty, r.ins, r.cut, r.neg, r.miss, r.up, r.h0, r.none, r.oob) == ([], None, None, 0, True, [1, 2], [], None, None, {"k": 2}, 5381, [], [None])


def test_checksum_sees_changes(spark):
    base = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "k int, v string")
    sums = [d.agg(H.content_checksum("k", "v")).first()[0] for d in (base, base.orderBy(F.desc("k")), base.withColumn("v", F.when(F.col("k") == 7, "x").otherwise(F.col("v"))))]
    assert sums[0] == sums[1] != sums[2]
