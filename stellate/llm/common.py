"""What the training-data operators share: table access, shared storage, text batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes of an Arrow batch that are Python objects at once; Spark itself bounds a batch by bytes (64 MB).
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); it is deleted when the driver ends.

    Only where that is unset and the master is local is a local folder used; on a
    cluster an unset folder is an error, as executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@atexit.register
def _clear() -> None:
    """Deletes what shared_dir() has named, as far as the driver's JVM still runs."""
    if SparkContext._gateway is None:
        return
    jvm, context = SparkContext._gateway.jvm, SparkContext._active_spark_context
    for path in _MADE:
        with contextlib.suppress(Exception):  # the store or the JVM may already be gone
            conf = context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    This cuts the lineage, so a lost executor costs at most the running job. The
    files live until drop_materialized() or the driver's end.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stellate_path = path
    return out


def drop_materialized(*frames: DataFrame) -> None:
    """Deletes the files behind frames of materialize() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_stellate_path", None):
            remove(df.sparkSession, path)
            _MADE.remove(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of at most ``rows`` rows and about BATCH_BYTES bytes; empty ones are left out."""
    for b in batches:
        step = max(1, min(rows, BATCH_BYTES * b.num_rows // max(1, b.nbytes)))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def arrow_map(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list] | None], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with column lists in and out, a piece of an Arrow batch at a time."""
    target = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows):
            out = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def arrow_rows(schema: str):
    """(Spark schema, function from column lists to a RecordBatch)."""
    target = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def pack(cols: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return target, pack


__all__ = ["BATCH_ROWS", "arrow_map", "arrow_rows", "ascii_lower", "drop_materialized", "materialize", "remove", "shared_dir", "slices", "table"]
