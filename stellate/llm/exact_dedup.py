"""10. Exact dedup: groups by a 128-bit content hash, bytes compared inside groups.

Grouping is by (hash, text): Spark compares the text's bytes for equal hashes, so
two texts that collide stay apart, and map-side aggregation folds a large group of
copies before anything is shuffled. Rows find their class by (hash, SHA-256) and
carry no text through that join; a very large class is a skewed key of it, which
the adaptive skew join splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table


def _keyed(docs: DataFrame) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).select("doc_id", F.unhex(F.md5("norm")).alias("h"), "norm")


def exact_duplicates(docs: DataFrame, keep: str = "min") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    ``keep`` names the stable id that stays: the group's "min" or "max" doc_id.
    Rows with a null doc_id count in group_size; they stay (keep_id null) only if
    no row of the group has an id. Rows that repeat the id that stays are all
    marked kept. Other columns are not read.
    """
    best = {"min": F.min, "max": F.max}[keep]("doc_id")
    keyed = _keyed(docs)
    classes = keyed.groupBy("h", "norm").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = classes.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    rows = keyed.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.join(classes, ["h", "sha"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _row_key(doc_id: str, sha: Column) -> Column:
    """One value for an id, which may be null, and a text."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("none")), sha)


def drop_exact_duplicates(docs: DataFrame, keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one row of each group of equal texts.

    Rows are judged by (doc_id, text), so an id may be null or shared by several
    texts. Of rows of a group that repeat the id that stays, or of a group without
    ids, the first by its columns stays.
    """
    stays = exact_duplicates(docs, keep).where("kept").select(_row_key("doc_id", F.col("text_sha256")).alias("_key")).distinct()
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumn("_key", _row_key("doc_id", F.sha2(norm, 256))).join(stays, "_key", "left_semi")
    order = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    first = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return rows.withColumn("_nth", first).where("_nth = 1").select(*docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


OP10_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
