"""Tables: append, ordered scan, point lookup, versioned update and delete.

A table is a log of row versions in Parquet. A commit writes a data folder of its
own and then takes the next transaction number by creating a small record, which
only one writer can; what has no record is never read. A row is named by the
transaction and position of its first version. Update and delete append versions;
nothing is rewritten.

Only updates and deletes end versions, so the current view is the log without those
versions that a later one of their transactions names: an anti-join with their row
names, which is a scan where there are none, and broadcasts them up to ``NAMES``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import knn as search
from ..operators.selection import project, visible
from . import storage

SYSTEM = "_batch long, _pos long, _xmin long, _deleted boolean"
BATCH = 50
#: Versions of updates and deletes whose names (24 bytes each) may be broadcast; more are joined by a shuffle.
NAMES = 500_000
#: Positions of one task's rows of a commit.
_TASK = 1 << 33


class Table:
    """kind: row, column or embedding; only metadata, all are Parquet.

    ``log`` names the folder of records under ``path``; ``base`` are records that
    come before them, as a checkpoint has them. Data of a ``shared`` table may be
    named by checkpoints and is never deleted here.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, kind: str = "row", log: str = "log", base: Sequence[dict] = (), shared: bool = False):
        if kind not in ("row", "column", "embedding"):
            raise ValueError(f"unknown table kind {kind!r}")
        self.spark, self.path, self.schema, self.kind, self.log, self.base, self.shared = spark, path.rstrip("/"), schema, kind, log, list(base), shared
        self.stored = T.StructType([*T._parse_datatype_string(SYSTEM).fields, *schema.fields])
        self._known: dict[str, dict] = {}

    # -- versions -------------------------------------------------------------
    def _numbers(self) -> list[str]:
        return [n for n in storage.names(self.spark, f"{self.path}/{self.log}") if n.isdigit()]

    def records(self) -> list[dict]:
        """Committed transactions from the last compaction on: txn, kind, data, rows, once."""
        for n in self._numbers():
            if n not in self._known and (r := storage.read(self.spark, f"{self.path}/{self.log}/{n}")):
                self._known[n] = r
        out = sorted([*self.base, *self._known.values()], key=lambda r: r["txn"])
        folded = max((i for i, r in enumerate(out) if r["kind"] == "compact"), default=0)
        return out[folded:]

    def _next(self) -> int:
        return max([0, *(r["txn"] for r in self.base), *map(int, self._numbers())]) + 1

    def _commit(self, rows: DataFrame, txn: int, kind: str, **more) -> int:
        data, seen = f"data-{uuid.uuid4().hex}", Observation()
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in self.stored])
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{data}")
        record = {"txn": txn, "kind": kind, "data": data, "rows": seen.get["n"], **more}
        if not storage.create(self.spark, f"{self.path}/{self.log}/{txn:012d}", record):
            storage.delete(self.spark, f"{self.path}/{data}")
            raise RuntimeError(f"transaction {txn} was committed by another writer")
        self._known[f"{txn:012d}"] = record
        return txn

    def _read(self, records: list[dict]) -> DataFrame:
        if not records:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*[f"{self.path}/{r['data']}" for r in records])

    def versions(self) -> DataFrame:
        """All versions since the last compaction, live or dead."""
        return self._read(self.records())

    def _ends(self) -> tuple[DataFrame | None, int]:
        """Row names and transactions of updates and deletes, and their number."""
        ends = [r for r in self.records() if r["kind"] in ("update", "delete")]
        n = sum(r["rows"] for r in ends)
        return (self._read(ends).select("_batch", "_pos", F.col("_xmin").alias("_end")) if n else None), n

    def history(self) -> DataFrame:
        """All versions with _xmax, the transaction that ended each (0: none)."""
        ends, n = self._ends()
        if ends is None:
            return self.versions().withColumn("_xmax", F.lit(0).cast("long"))
        ends = ends.groupBy("_batch", "_pos").agg(F.sort_array(F.collect_list("_end")).alias("_ends"))  # at most one a transaction
        rows = self.versions().join(F.broadcast(ends) if n <= NAMES else ends, ["_batch", "_pos"], "left")
        later = F.get(F.filter("_ends", lambda e: e > F.col("_xmin")), 0)
        return rows.withColumn("_xmax", F.coalesce(later, F.when(F.col("_deleted"), F.col("_xmin")), F.lit(0))).drop("_ends").select(*self.stored.names, "_xmax")

    def current(self, system: bool = False) -> DataFrame:
        ends, n = self._ends()
        rows = self.versions()
        if ends is not None:
            last = ends.groupBy("_batch", "_pos").agg(F.max("_end").alias("_end")).withColumnsRenamed({"_batch": "_b", "_pos": "_p"})
            later = (F.col("_batch") == F.col("_b")) & (F.col("_pos") == F.col("_p")) & (F.col("_xmin") < F.col("_end"))
            rows = rows.join(F.broadcast(last) if n <= NAMES else last, later, "left_anti").where("NOT _deleted")
        return rows.drop("_deleted") if system else rows.select(*[f"`{c}`" for c in self.schema.names])

    def slot_count(self) -> int:
        """Versions that hold a row; known from the records."""
        return sum(r["rows"] for r in self.records() if r["kind"] != "delete")

    def get(self, batch: int, pos: int) -> DataFrame:
        """The latest version of a row; none if it is deleted or unknown. The row name is a filter of the scan."""
        return self.current(system=True).where((F.col("_batch") == batch) & (F.col("_pos") == pos))

    def get_version(self, batch: int, pos: int, txn: int) -> DataFrame:
        return self.versions().where((F.col("_batch") == batch) & (F.col("_pos") == pos) & (F.col("_xmin") == txn) & ~F.col("_deleted"))

    def row_range(self, start: int, n: int = 1) -> DataFrame:
        """Current rows number ``start`` to ``start + n - 1`` in insertion order, from 0.

        Rows are counted by the task that wrote them; only rows of tasks in the
        range are read and sorted.
        """
        rows = self.current(system=True)
        counts = rows.groupBy("_batch", F.floor(F.col("_pos") / _TASK).cast("long").alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("_batch", "task").collect()  # one a file written
        at, first, want = 0, None, F.lit(False)
        for r in counts:
            if at < start + n and start < at + r.n:
                first = at if first is None else first
                want = want | ((F.col("_batch") == r._batch) & F.col("_pos").between(r.task * _TASK, (r.task + 1) * _TASK - 1))
            at += r.n
        some = rows.where(want).orderBy("_batch", "_pos")
        return some.offset(max(0, start - (first or 0))).limit(n if first is not None else 0).select(*[f"`{c}`" for c in self.schema.names])

    # -- writes ---------------------------------------------------------------
    def _seen(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for r in self.records():
            for k, v in r.get("once", {}).items():
                out[k] = max(v, out.get(k, v))
        return out

    def append(self, df: DataFrame, once: tuple[str, int] | None = None) -> int:
        """One batch, in the order of ``df``; missing columns become null, unknown ones are an error.

        ``once``: a stream's name and batch number; a number that the stream has
        already reached appends nothing and gives 0.
        """
        if once and self._seen().get(once[0], -1) >= once[1]:
            return 0
        if extra := set(df.columns) - set(self.schema.names):
            raise ValueError(f"unknown columns {sorted(extra)}")
        for f in self.schema:
            dim = (f.metadata or {}).get("dim")
            if dim and f.name in df.columns:
                df = df.withColumn(f.name, F.when(F.col(f.name).isNull() | (F.size(f.name) == dim), F.col(f.name)).otherwise(F.raise_error(F.lit(f"{f.name} must have {dim} dimensions")).cast(f.dataType)))
        txn = self._next()
        full = df.select(*[F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        rows = full.withColumns({"_batch": F.lit(txn), "_pos": F.monotonically_increasing_id(), "_xmin": F.lit(txn), "_deleted": F.lit(False)})
        return self._commit(rows, txn, "append", **({"once": {once[0]: once[1]}} if once else {}))

    def insert(self, row: Sequence) -> int:
        return self.append(self.spark.createDataFrame([tuple(row)], self.schema))

    def update(self, df: DataFrame) -> int:
        """New versions: (_batch, _pos, columns to set). Rows that aren't current are ignored; of a name given twice one counts."""
        cur, txn = self.current(system=True), self._next()
        new = df.select("_batch", "_pos", *[F.col(c).alias(f"_new_{c}") for c in df.columns if c in self.schema.names]).dropDuplicates(["_batch", "_pos"])
        rows = cur.join(new, ["_batch", "_pos"])
        rows = rows.select("_batch", "_pos", F.lit(txn).alias("_xmin"), F.lit(False).alias("_deleted"), *[F.col(f"_new_{c}" if f"_new_{c}" in new.columns else c).alias(c) for c in self.schema.names])
        return self._commit(rows, txn, "update")

    def delete(self, rows: DataFrame) -> int:
        """Ends the rows (_batch, _pos); dead and unknown ones are ignored."""
        txn = self._next()
        gone = self.current(system=True).join(rows.select("_batch", "_pos").distinct(), ["_batch", "_pos"], "left_semi")
        return self._commit(gone.withColumns({"_xmin": F.lit(txn), "_deleted": F.lit(True)}), txn, "delete")

    # -- scans ----------------------------------------------------------------
    def scan(self, ids: Sequence[int] | None = None, ordered: bool = False) -> DataFrame:
        """Current rows, projected by ordinal; ``ordered``: by insertion."""
        rows = self.current(system=True)
        if ordered:
            rows = rows.orderBy("_batch", "_pos")
        return project(rows.select(*[f"`{c}`" for c in self.schema.names]), ids)

    def batches(self, ids: Sequence[int] | None = None, size: int = BATCH) -> Iterator[pa.RecordBatch]:
        """Ordered scan in Arrow batches of at most ``size`` rows, a partition at a time."""
        held: list = []
        rows = self.scan(ids, ordered=True)
        for r in rows.toLocalIterator():
            held.append(r)
            if len(held) == size:
                yield self._arrow(rows, held)
                held = []
        if held:
            yield self._arrow(rows, held)

    @staticmethod
    def _arrow(rows: DataFrame, held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: [r[i] for r in held] for i, c in enumerate(rows.columns)})

    def knn(self, query: Sequence[float], k: int, metric: str = "l2", vec: str = "embedding") -> DataFrame:
        """Nearest current rows with their row name, payload, vector and distance."""
        rows = visible(self.current(system=True), embedding=vec).withColumn("_ctid", F.struct("_batch", "_pos"))
        f = self.schema[vec]
        return search.knn(rows.withColumn(vec, F.col(vec).alias(vec, metadata=f.metadata)), query, k, metric, vec, "_ctid")

    def compact(self) -> int:
        """Rewrites the current rows as one transaction, from which on the log is read.

        Its record makes the switch, so a crash before or after changes no view. What
        the log held before the compaction before this one is deleted, so running
        readers keep their files.
        """
        before, txn = self.records(), self._next()
        self._commit(self.current(system=True).withColumn("_deleted", F.lit(False)), txn, "compact", once=self._seen())
        if before and not self.shared:
            for n, r in list(self._known.items()):
                if r["txn"] < before[0]["txn"]:
                    storage.delete(self.spark, f"{self.path}/{r['data']}")
                    storage.delete(self.spark, f"{self.path}/{self.log}/{n}")
                    del self._known[n]
        return txn

    def describe(self) -> str:
        return json.dumps({"kind": self.kind, "schema": json.loads(self.schema.json())})
