import pytest
from pyspark.sql import functions as F

from stellate.sources import storage
from stellate.sources import table as table_module
from stellate.sources.catalog import AlreadyExists, Catalog, NotFound, Protected
from stellate.sources.table import Table
from stellate.sources.types import Column, schema_of, width
from stellate.streaming.append import append_stream


def ints(spark, tmp_path, n, name="t"):
    t = Table(spark, str(tmp_path / name), schema_of([Column("c0", "INTEGER")]))
    t.append(spark.range(n).select(F.col("id").cast("int").alias("c0")).coalesce(1))
    return t


@pytest.mark.parametrize("n", [0, 1, 49, 50, 51, 250, 1025])
def test_sizes_and_order(spark, tmp_path, n):
    t = ints(spark, tmp_path, n)
    sizes = [b.num_rows for b in t.batches()]
    assert sizes == [50] * (n // 50) + ([n % 50] if n % 50 else [])
    assert [r.c0 for r in t.scan(ordered=True).collect()] == list(range(n)) == [r.c0 for r in t.scan(ordered=True).collect()]


def test_versions(spark, tmp_path):
    t = ints(spark, tmp_path, 10)
    t.append(spark.range(10, 12).select(F.col("id").cast("int").alias("c0")).coalesce(1))
    at = lambda c: t.current(system=True).where(f"c0 = {c}").select("_batch", "_pos")
    row = at(3).first()
    t.update(at(3).withColumn("c0", F.lit(33)))
    t.delete(at(4))
    t.delete(t.versions().where("c0 = 4").select("_batch", "_pos"))  # dead already
    assert sorted(r.c0 for r in t.scan().collect()) == [0, 1, 2, 5, 6, 7, 8, 9, 10, 11, 33]
    assert t.slot_count() == 13
    assert t.get(row._batch, row._pos).first().c0 == 33
    assert t.get_version(row._batch, row._pos, 1).first().c0 == 3
    h = {(r.c0, r._xmin): r._xmax for r in t.history().collect() if not r._deleted}
    assert h[(3, 1)] == 3 and h[(33, 3)] == 0 and h[(4, 1)] == 4
    t.compact()
    assert t.slot_count() == 11


def test_nulls_and_unknown_columns(spark, tmp_path):
    t = Table(spark, str(tmp_path / "n"), schema_of([Column("a", "BIGINT"), Column("t", "VARCHAR"), Column("v", "VECTOR", 2)]))
    t.append(spark.createDataFrame([(1,)], "a long"))
    t.insert((2, "x", [1.0, 2.0]))
    assert [(r.a, r.t, r.v) for r in t.scan(ordered=True).collect()] == [(1, None, None), (2, "x", [1.0, 2.0])]
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(1,)], "zzz long"))
    with pytest.raises(Exception, match="dimensions"):
        t.insert((3, "y", [1.0]))


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    assert c.create_schema("main") == 0
    with pytest.raises(AlreadyExists) as e:
        c.create_schema("main")
    assert e.value.code == -2 and c.create_schema("main", if_not_exists=True) == 0
    with pytest.raises(NotFound):
        c.create_table("nowhere", "t", [])
    with pytest.raises(Protected):
        c.drop_schema("main")
    c.create_schema("other")
    for s in ("main", "other"):
        c.create_table(s, "t1", [Column("x", "INTEGER")])
    c.create_index("other", "t1")
    assert c.drop_schema("other") == 0 and c.drop_schema("never") == 0 and c.table("other", "t1") is None
    assert c.table("main", "t1") is not None and c.table("main", "t2") is None
    assert c.drop_table("main", "t1") and c.drop_table("main", "t1") and not c.drop_table("main", "zz")
    assert c.count("table", "main") == 0 and len(c.entries("table", "main", live=False)) == 1
    c.create_table("main", "t1", [Column("y", "DOUBLE")])
    assert c.types("main", "t1") == ["DOUBLE"]
    for i in range(100):
        c.create_table("main", f"table_{i:03d}", [Column("id", "BIGINT"), Column("val", "DOUBLE")])
    assert c.count("table", "main") == 101
    assert width("BIGINT") == 8 and width("VECTOR", 4) == 16 and width("nope") == 0


def test_checkpoint(spark, tmp_path):
    root = str(tmp_path / "db")
    assert Catalog.load(spark, root).count("schema") == 0
    c = Catalog(spark, root)
    c.create_schema("main")
    c.create_table("main", "t", [Column("a", "INTEGER"), Column("b", "INTEGER")])
    c.create_table("main", "empty_tbl", [Column("x", "INTEGER")])
    t = c.table("main", "t")
    t.append(spark.range(100).select((F.col("id") * 10).cast("int").alias("a"), (F.col("id") * 10 + 1).cast("int").alias("b")))
    assert (c.checkpoint(), c.active()) == (1, "v1")
    t.append(spark.createDataFrame([(7, 8)], "a int, b int"))
    again = Catalog.load(spark, root)
    assert again.table("main", "t").scan().count() == 100 and again.table("main", "empty_tbl").scan().count() == 0
    assert (c.checkpoint(), c.active()) == (2, "v2")
    assert Catalog.load(spark, root).table("main", "t").scan().count() == 101


def values(c):
    return sorted(r.x for r in c.table("main", "t").scan().collect())


def fresh(spark, root):
    c = Catalog(spark, root)
    c.create_schema("main")
    c.create_table("main", "t", [Column("x", "INTEGER")])
    return c


def put(spark, c, *xs):
    c.table("main", "t").append(spark.createDataFrame([(x,) for x in xs], "x int"))


def test_cycles_on_one_root(spark, tmp_path):
    root, want = str(tmp_path / "db"), []
    c = fresh(spark, root)
    for i in range(4):  # write, change, checkpoint, load again
        put(spark, c, 10 * i, 10 * i + 1)
        t = c.table("main", "t")
        t.delete(t.current(system=True).where(f"x = {10 * i}"))
        want.append(10 * i + 1)
        if i == 2:
            t.compact()
        c.checkpoint()
        c = Catalog.load(spark, root)
        assert values(c) == want and c.root == root
    c.drop_table("main", "t")
    c.create_table("main", "t", [Column("x", "INTEGER")])
    assert values(c) == []
    c.checkpoint()
    assert values(Catalog.load(spark, root)) == []


def test_loads_do_not_disturb_each_other(spark, tmp_path):
    root = str(tmp_path / "db")
    c = fresh(spark, root)
    put(spark, c, 1)
    c.checkpoint()
    a, b = Catalog.load(spark, root), Catalog.load(spark, root)
    put(spark, a, 2)
    put(spark, b, 3)
    assert (values(a), values(b), values(Catalog.load(spark, root))) == ([1, 2], [1, 3], [1])
    a.checkpoint()
    assert (values(a), values(b), values(Catalog.load(spark, root))) == ([1, 2], [1, 3], [1, 2])
    b.checkpoint()
    assert values(Catalog.load(spark, root)) == [1, 3]


def test_a_checkpoint_that_broke_off(spark, tmp_path):
    root = str(tmp_path / "db")
    c = fresh(spark, root)
    put(spark, c, 1)
    c.checkpoint()
    (tmp_path / "db" / "snapshots" / "v2").write_text('{"entries": [')
    assert Catalog.load(spark, root).active() == "v1" and values(Catalog.load(spark, root)) == [1]
    put(spark, c, 2)
    assert c.checkpoint() == 3 and values(Catalog.load(spark, root)) == [1, 2]


def test_one_writer_takes_a_transaction(spark, tmp_path):
    a, b = (ints(spark, tmp_path, 2) if k else Table(spark, str(tmp_path / "t"), schema_of([Column("c0", "INTEGER")])) for k in (1, 0))
    taken = b._next()
    b._next = lambda: taken  # as if it had looked before the other one wrote
    a.append(spark.createDataFrame([(8,)], "c0 int"))
    with pytest.raises(RuntimeError):
        b.append(spark.createDataFrame([(9,)], "c0 int"))
    assert sorted(r.c0 for r in a.scan().collect()) == sorted(r.c0 for r in b.scan().collect()) == [0, 1, 8]
    (tmp_path / "t" / "log" / f"{3:012d}").write_text("")  # its writer died
    assert a.append(spark.createDataFrame([(7,)], "c0 int")) == 4 and a.scan().count() == 4


def test_compaction_keeps_one_generation(spark, tmp_path):
    t = ints(spark, tmp_path, 5)
    t.delete(t.current(system=True).where("c0 = 0"))
    reader = t.scan()
    t.compact()
    assert reader.count() == 4 and t.slot_count() == 4
    t.insert((9,))
    t.compact()
    t.compact()
    assert sorted(r.c0 for r in t.scan().collect()) == [1, 2, 3, 4, 9] and len(t.records()) == 1
    assert t.append(spark.createDataFrame([(5,)], "c0 int"), once=("s", 3)) and not t.append(spark.createDataFrame([(5,)], "c0 int"), once=("s", 3))
    t.compact()
    assert not t.append(spark.createDataFrame([(5,)], "c0 int"), once=("s", 2)) and t.slot_count() == 6


@pytest.mark.parametrize("names", [0, 10**6])
def test_current_view_sorts_nothing_wide(spark, tmp_path, monkeypatch, names):
    monkeypatch.setattr(table_module, "NAMES", names)
    t = ints(spark, tmp_path, 20)
    assert "Exchange" not in t.scan()._jdf.queryExecution().executedPlan().toString()
    at = t.current(system=True)
    t.update(at.where("c0 < 5").unionByName(at.where("c0 < 5")).select("_batch", "_pos", (F.col("c0") + 100).alias("c0")))
    t.update(t.current(system=True).where("c0 = 100").select("_batch", "_pos", F.lit(200).alias("c0")))
    t.delete(t.current(system=True).where("c0 IN (101, 19)"))
    assert sorted(r.c0 for r in t.scan().collect()) == [*range(5, 19), 102, 103, 104, 200]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = t.scan()._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortAggregate" not in plan and ("BroadcastHashJoin" in plan) == (names > 0)
    ends = {(r.c0, r._xmin): r._xmax for r in t.history().where("NOT _deleted").collect()}
    assert (ends[0, 1], ends[100, 2], ends[200, 3], ends[101, 2], ends[19, 1], ends[7, 1]) == (2, 3, 0, 4, 4, 0)


def test_row_range(spark, tmp_path):
    t = ints(spark, tmp_path, 30)
    t.append(spark.range(30, 60).repartition(3).select(F.col("id").cast("int").alias("c0")))
    t.delete(t.current(system=True).where("c0 < 4"))
    every = [r.c0 for r in t.scan(ordered=True).collect()]
    for start, n in ((0, 1), (3, 5), (20, 30), (50, 10), (56, 1), (0, 0), (0, 100)):
        assert [r.c0 for r in t.row_range(start, n).collect()] == every[start : start + n]


def stream(spark, src, t, checkpoint):
    append_stream(spark.readStream.schema("c0 int").parquet(src), t, checkpoint).awaitTermination(120)


def test_stream(spark, tmp_path):
    src, checkpoint = str(tmp_path / "src"), str(tmp_path / "ck")
    rows = spark.range(20).select(F.col("id").cast("int").alias("c0"))
    rows.write.parquet(src)
    t = Table(spark, str(tmp_path / "s"), schema_of([Column("c0", "INTEGER")]))
    stream(spark, src, t, checkpoint)
    assert sorted(r.c0 for r in t.scan().collect()) == list(range(20))
    for f in (tmp_path / "ck" / "commits").iterdir():  # as if the stream had died after the table's commit, before its own
        f.unlink()
    stream(spark, src, t, checkpoint)
    assert sorted(r.c0 for r in t.scan().collect()) == list(range(20))
    rows.limit(1).write.mode("append").parquet(src)
    stream(spark, src, t, checkpoint)
    assert t.scan().count() == 21


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.scratch(Session, "x")
