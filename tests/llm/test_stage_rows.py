"""The pipeline's stages decide by row where ids are null, repeated or shared by two texts."""

import corpus_pipeline
import pytest
from stellate.llm import exact_dedup, toxicity

BAD = "some bad text of the benchmark item that was leaked as a whole"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string").repartition(3)


def left(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_one_row_of_each_group(spark, keep):
    rows = [
        (None, "alone", "a"),
        (None, "Twice", "b"), (None, "twice", "a"),
        (5, "again", "a"), (5, "again", "a"), (5, "Again", "b"),
        (7, "shared", "a"), (7, "other", "a"), (1, "other", "a"), (9, "other", "a"), (None, "other", "a"),
        (1, "", "a"), (2, None, "a"), (None, None, "a"),
    ]
    got = left(exact_dedup.drop_exact_duplicates(frame(spark, rows), keep))
    other, blank = ((1, "other", "a"), (1, "", "a")) if keep == "min" else ((9, "other", "a"), (2, None, "a"))
    assert got == sorted([(None, "alone", "a"), (None, "Twice", "b"), (5, "Again", "b"), (7, "shared", "a"), other, blank], key=str)


ROWS = [(None, BAD, "a"), (None, "a clean text", "a"), (4, BAD, "a"), (4, "clean with the same id", "a"), (None, None, "a")]
CLEAN = sorted([(4, "clean with the same id", "a"), (None, "a clean text", "a"), (None, None, "a")], key=str)


def test_leaks_go_by_row(spark, tmp_path):
    spark.createDataFrame([(1, BAD), (2, BAD)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert left(corpus_pipeline.drop_leaks(spark, frame(spark, ROWS), str(tmp_path))) == CLEAN


def test_toxic_rows_go_by_row(spark, tmp_path, monkeypatch):
    rows = [(i, BAD if i % 2 else "a clean text", i % 2) for i in range(200)]
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.train(frame(spark, [(i, t, "a") for i, t, _ in rows]), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: model)
    got = left(corpus_pipeline.drop_toxic(spark, frame(spark, ROWS), str(tmp_path)))
    assert (None, "a clean text", "a") in got and not any(t == BAD for _, t, _ in got)
    wanted = {t for t, s in zip((r[1] for r in ROWS), model.score([r[1] for r in ROWS])) if s < 0.5}
    assert got == sorted((r for r in ROWS if r[1] in wanted), key=str)
