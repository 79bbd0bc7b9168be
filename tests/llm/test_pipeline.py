"""The whole pipeline, stage by stage, against brute force on a small corpus with planted cases."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from stellate.llm import toxicity

WORDS = [f"w{i}" for i in range(4000)]
BENCH = [(i, " ".join(f"b{i}x{j}" for j in range(n))) for i, n in enumerate((40, 9, 8, 5, 3, 30))] + [(6, None), (7, "short thing")]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    """(doc_id, text, lang, source, n_chars); ids may be null or repeated."""
    rng, rows = random.Random(9), []
    add = lambda i, t: rows.append((i, t, "en", rng.choice(["a", "b", None]), len(t or "")))
    for i in range(120):
        ws = rng.choices(WORDS, k=rng.choice([3, 30, 200]))
        if i % 10 == 1:  # a passage of one item, whole or in part
            b = BENCH[rng.choice([0, 1, 2, 5])][1].split()
            lo = rng.randrange(len(b) - 7)
            ws[3:3] = b[lo : lo + rng.choice([8, 12])] if len(b) > 8 else b
        if i % 10 == 2:  # seven words of an item, or a short item: no leak
            ws[2:2] = rng.choice([BENCH[0][1].split()[4:11], BENCH[3][1].split(), ["short", "thing"]])
        if i % 10 == 3:  # two short items: a leak
            ws[2:2] = [*BENCH[3][1].split(), "and", *BENCH[4][1].split()]
        if i % 10 == 4:
            ws[1:1] = ["you", "vileword", "VileWord"]
        add(i, " ".join(ws))
        if i % 10 in (5, 6):  # a copy, exact but for case, or near
            other = list(ws)
            if i % 10 == 6 and len(ws) > 100:
                for k in range(2):
                    other[40 + 60 * k] = f"new{i}x{k}"
            add(rng.choice([1000 + i, 3, None]), " ".join(other).upper() if i % 10 == 5 else " ".join(other))
    for i, t in ((7, None), (None, None), (8, ""), (None, " \t"), (None, "alone"), (5, "alone too")):
        add(i, t)
    return rows


def grams(t):
    ws = (t or "").translate(LOW).split()
    k = min(5, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()


def without_copies(rows):
    best = {}
    for r in rows:
        k = (r[1] or "").translate(LOW)
        old = best.get(k)
        order = (r[0] is not None, r[0] or 0)
        if old is None or order > (old[0] is not None, old[0] or 0):
            best[k] = r
    return {(r[0], k) for k, r in best.items()}


def without_near_copies(rows):
    sets, label = [grams(r[1]) for r in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if (x == y or len(x & y) * 5 >= 4 * len(x | y)) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if c == b else c for c in label]
    first = {}
    for r, c in zip(rows, label):
        k = (r[0] is None, r[0] or 0)
        if c not in first or k < first[c][0]:
            first[c] = (k, r)
    return [r for _, r in first.values()]


def leaked(text):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    ws, items, whole = cut(text), set(), False
    for item, b in BENCH:
        bs = cut(b)
        k = min(8, len(bs))
        wins = {tuple(bs[j : j + k]) for j in range(len(bs) - k + 1)} if bs else set()
        if any(tuple(ws[j : j + k]) in wins for j in range(len(ws) - k + 1)):
            items.add(item)
            whole |= k == 8
    return whole or len(items) >= 2


def fitted():
    """A model of the corpus itself, so that the stage's decisions are known."""
    texts = [r[1] for r in corpus()]
    lex = ({"vileword": 3.0}, {})
    y = np.array([float("vileword" in (t or "").lower()) for t in texts])
    x = np.array([toxicity.features(t, lex) for t in texts])
    model = toxicity.Model(lex, np.tile(x, (20, 1)), np.tile(y, 20), np.arange(20 * len(y)) // len(y) % toxicity.FOLDS)
    assert ((model.score(texts) >= 0.5) == y).all() and 0 < y.sum() < len(y)
    return model


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, sf_dir, monkeypatch):
    model = fitted()
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: model)
    rows, docs = corpus(), spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    def run(name):
        got = stages[name](spark, docs, sf_dir)
        assert got.columns == docs.columns
        return [tuple(r) for r in got.collect()]

    got = run("toxicity")
    assert sorted(map(repr, got)) == sorted(repr(r) for r in rows if "vileword" not in (r[1] or "").lower()) and len(got) < len(rows)
    got = run("exact dedup")
    assert len(got) == len(without_copies(rows)) < len(rows) and {(r[0], (r[1] or "").translate(LOW)) for r in got} == without_copies(rows)
    got = run("near dedup")
    want = without_near_copies(rows)
    assert {(r[0], *sorted(grams(r[1]))[:1]) for r in got} == {(r[0], *sorted(grams(r[1]))[:1]) for r in want}
    got = run("decontamination")
    assert sorted(map(repr, got)) == sorted(repr(r) for r in rows if not leaked(r[1]))
    assert sum(leaked(r[1]) for r in rows) >= 24


def test_run(spark, sf_dir, monkeypatch):
    model = fitted()
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: model)
    rows = [r for r in corpus() if "vileword" not in (r[1] or "").lower()]
    ids = {}
    for r in rows:
        ids.setdefault((r[0], (r[1] or "").translate(LOW)), r)
    left = [r for r in without_near_copies([ids[k] for k in without_copies(rows)]) if not leaked(r[1])]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    tokens = {}
    for r in got:
        tokens.setdefault(r.doc_id, []).append(r.n_tokens)
    want = {}
    for r in left:
        want.setdefault(r[0], []).append(len((r[1] or "").split()))
    assert {k: sorted(v) for k, v in tokens.items()} == {k: sorted(v) for k, v in want.items()}


def test_odd_rows(spark, sf_dir):
    """Every stage on an empty table, and on rows of nulls with other columns beside."""
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    odd = spark.createDataFrame([(None, None, None, None, None, "z", 1), (None, None, None, None, None, "z", 1), (1, "x " * 50_000, "en", "s", 2, None, 2)], "doc_id long, text string, lang string, source string, n_chars long, text_hash string, node int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        got = stage(spark, odd, sf_dir)
        if name == "packing":
            assert sum(r.n_tokens for r in got.collect()) == 50_000
        else:
            assert got.columns == odd.columns
            n = got.count()
            assert n == (2 if "dedup" in name else 3) or name == "near dedup" and n == 3
