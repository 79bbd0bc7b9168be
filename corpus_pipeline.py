"""The corpus pipeline: STAGES, applied in order to ``documents``.

Each stage takes (spark, docs, sf_dir) and calls one operator of stellate.llm; all
but the last return the columns of their input. What goes is decided by row, under
(doc_id, hash of text): ids may be null or shared by several texts. ORACLE_SQL is
None, as neither the classifier nor SimHash can be written in SQL;
tests/llm/test_pipeline.py holds each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.llm import decontaminate as decontamination
from stellate.llm import exact_dedup, near_copies, packing, toxicity
from stellate.llm.common import drop_materialized, materialize, table

#: Rows that go (16 bytes each) up to which number they are broadcast.
GONE = 500_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash of text), both null-safe, is not in ``gone`` (doc_id, text_hash).

    What goes is written and counted first: up to ``GONE`` names are broadcast, more
    are joined by a shuffle that can split an id and text of very many rows.
    """
    gone = materialize(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= GONE else gone
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model is fitted on labelled rows of ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _without(docs, toxicity.score(docs, model, by_text=True).where("predicted = 1"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z, one row with the largest doc_id stays, or one without an id if none has any."""
    return exact_dedup.drop_exact_duplicates(docs, keep="max").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a five-word shingle similarity of 0.8 or more (SimHash candidates by pivot tables, verified), the smallest doc_id stays; judged by row, ids may be null or repeated."""
    return _without(docs, near_copies.near_copies(docs).where("NOT kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which a window of eight words of one benchmark item occurs, or windows (also whole shorter items) of two or more."""
    return _without(docs, decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), by_text=True).where("leaked"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; every stage's result is written and read again before the next, the one before it is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-")), docs
        drop_materialized(before)
    return STAGES[-1][1](spark, docs, sf_dir)
