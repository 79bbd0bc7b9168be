"""Small files and folders through Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); without one, a local folder, but only on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def create(spark: SparkSession, path: str, record: dict) -> bool:
    """Writes a record as a new file; False if the name is taken. Of several writers, the store lets one through."""
    fs, p = _fs(spark, path)
    text = bytearray(json.dumps(record).encode())
    if fs.getScheme() == "file":
        files, options = spark.sparkContext._jvm.java.nio.file.Files, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.nio.file.OpenOption, 2)
        options[0], options[1] = spark.sparkContext._jvm.java.nio.file.StandardOpenOption.CREATE_NEW, spark.sparkContext._jvm.java.nio.file.StandardOpenOption.WRITE
        fs.mkdirs(p.getParent())
        try:
            files.write(spark.sparkContext._jvm.java.io.File(p.toUri().getPath()).toPath(), text, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True
    try:
        out = fs.create(p, False)
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise
    out.write(text)
    out.close()
    return True


def read(spark: SparkSession, path: str) -> dict | None:
    """A record of create(); None while it is being written, and for good if its writer died over it."""
    fs, p = _fs(spark, path)
    s = fs.open(p)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(s)).decode())
    except ValueError:
        return None
    finally:
        s.close()
