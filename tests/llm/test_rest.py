"""Operators 3, 5-9 and the pipeline."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stellate.llm import langid, packing, pii, rollups, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, n string, cluster string, copy string, sha string, host string, score double"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, 1, *["z"] * 6, 0.5) for r in rows], DOCS).repartition(3)


# -- packing ---------------------------------------------------------------------
def plain_best_fit(items, capacity):
    """(size, source, cluster) in order -> bin of each, by scanning all bins."""
    bins, out = [], []
    for n, s, c in items:
        fit = [(capacity - b[0], i) for i, b in enumerate(bins) if b[0] + n <= capacity and (s is None or s not in b[1]) and (c is None or c not in b[2])]
        i = min(fit)[1] if fit else len(bins)
        if i == len(bins):
            bins.append([0, set(), set()])
        bins[i][0] += n
        bins[i][1].add(s)
        bins[i][2].add(c)
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit(seed):
    rng = random.Random(seed)
    items = [(rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c", "d", None]), rng.choice([None, 1, 2, 3])) for _ in range(300)]
    bins = packing.Bins(50)
    assert [bins.add(*x)[0] for x in items] == plain_best_fit(items, 50)


def test_packing(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 250])) + (f" {i}" if rng.random() < 0.7 else ""), "en", rng.choice(["a", "a", "b", None])) for i in range(200)]
    rows += [(200, None, None, None), (3, rows[3][1], "en", "b"), (None, "x", "en", "c")]
    got = packing.pack(docs(spark, rows), capacity=100, shard=64).collect()
    n = {}
    for r in got:
        n[r.doc_id] = n.get(r.doc_id, 0) + r.n_tokens
    want = {}
    for i, t, *_ in rows:
        want[i] = want.get(i, 0) + len((t or "").split())
    assert n == want
    by = {}
    for r in got:
        by.setdefault(r.bin_id, []).append(r)
    low = {i: (t or "").lower() for i, t, *_ in rows}
    for b in by.values():
        assert sum(r.n_tokens for r in b) <= 100
        sources = [r.source for r in b if r.source]
        texts = [low[r.doc_id] for r in b if low[r.doc_id]]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)
        at = 0
        for r in sorted(b, key=lambda r: r.slot):
            assert r.bin_offset == at
            at += r.n_tokens
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


# -- language ---------------------------------------------------------------------
def test_language(spark, sf):
    d, p = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages"))
    model = langid.train(d)
    got = langid.identify(langid.rows_of(d, p), model)
    doc = got.where("kind = 'document'").join(d.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    held = doc.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert got.count() == d.count() + p.count()
    assert held.where("lang = truth").count() >= 0.95 * held.count()
    odd = docs(spark, [(1, None, None, None), (2, "", "fr", "s"), (2, "", "fr", "s"), (None, "x", None, "s")])
    pages = spark.createDataFrame([(1, None, None), (2, "not a url", "<p>"), (3, "https://a.example.de/x", '<html class="x" lang="DE-at"><p>')], "page_id long, url string, html string")
    rows = langid.identify(langid.rows_of(odd, pages), model).collect()
    assert len(rows) == 7 and next(r for r in rows if r.page_id == 3).lang == "de"
    empty = langid.train(spark.createDataFrame([], DOCS))
    assert [r.lang for r in langid.identify(langid.rows_of(odd, None), empty).collect()] == [None] * 4


# -- personal data -----------------------------------------------------------------
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.2@+- (0)b5\né%", max_size=60))
def test_base_spans(t):
    assert pii.base_spans(t) == plain_spans(t)


@pytest.fixture(scope="module")
def crf():
    return pii.CRF(pii.labelled())


def test_crf(spark, crf):
    lines = pii.labelled()
    got = crf.decode([ws for ws, _ in lines])
    assert sum(a == b for (_, x), g in zip(lines, got) for a, b in zip(x, g)) >= 0.98 * sum(len(x) for _, x in lines)
    text = "please call (017) 555-7713 today or 4111111111111111 and é 10.0.0.1"
    rows = [(1, text, None, None), (1, text, None, None), (2, None, None, None), (3, "", None, None), (None, "+1 (017) 555-7713", None, None), (4, "1" * 30_000, None, None), (5, "a@" * 9000, None, None)]
    out = pii.personal_data(docs(spark, rows), crf).collect()
    assert len(out) == 7
    one = next(r for r in out if r.doc_id == 1)
    assert (one.n_card, one.n_ip, one.n_phone) == (1, 1, 0) and "phone:12:26" in one.spans.split(",")
    assert one.base_sha256 == hashlib.sha256(pii.listed(plain_spans(text)).encode()).hexdigest()
    assert next(r for r in out if r.doc_id == 2).spans == ""


def test_viterbi(crf):
    """Against the best of all label paths."""
    import itertools

    line = ["call", "(017)", "555-7713"]
    e = crf.w[crf._pad([pii._features(line)], 3)].sum(2)[0]
    k = range(len(pii.LABELS))
    best = max(itertools.product(k, k, k), key=lambda p: sum(e[i, j] for i, j in enumerate(p)) + crf.a[p[0], p[1]] + crf.a[p[1], p[2]])
    assert crf.decode([line])[0] == [pii.LABELS[j] for j in best]


# -- token counts --------------------------------------------------------------------
def test_rollups(spark, tmp_path):
    rows = [(i, f" word {i % 7} naïve  text\n" * (i % 5), "en" if i % 2 else None, "s") for i in range(60)] + [(60, None, "fr", None), (1, " word 1 naïve  text\n", "en", "s"), (61, " " * 70_000 + "x", "en", "s")]
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollups.maintained(docs(spark, rows), str(tmp_path / "r")).collect()}
    v = open(rollups.VOCABULARY, "rb").read()
    first, want = {}, {}
    for i, t, *_ in rows:
        first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang, source in rows:
        if first[t or ""] == i:
            for name, n in ((rollups.VERSION, len(rollups._encoding(v).encode_ordinary((t or "").strip()))), (rollups.WORDS, len((t or "").split()))):
                a = want.setdefault((source, lang, name), [0, 0])
                a[0] += 1
                a[1] += n
    assert got == {k: tuple(x) for k, x in want.items()}
    roll = rollups.Rollup(spark, str(tmp_path / "q"))
    change = spark.createDataFrame([("a", "en", "t", 1, 5)], "source string, lang string, tokenizer string, docs long, tokens long")
    assert roll.commit("b1", change) and not roll.commit("b1", change) and roll.commit("b2", change)
    assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "t", 2, 10)]
    with pytest.raises(ValueError):
        roll.commit("../x", change)


def test_pieces_count_alike():
    v = open(rollups.VOCABULARY, "rb").read()
    text = ("some words, and  spaces\n\n" * 9000)[:150_000]
    assert rollups.count_tokens(text, v) == len(rollups._encoding(v).encode_ordinary(text))


# -- toxicity -------------------------------------------------------------------------
def test_toxicity(spark, sf):
    d, labels = (spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(d, labels)
    got = toxicity.score(d, model).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert right >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = toxicity.score(docs(spark, [(1, None, None, None), (1, None, None, None), (None, "", None, None), (5, "A" * 60_000, None, None)]), model).collect()
    assert len(odd) == 4 and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in odd)
    none = toxicity.train(d, labels.limit(0))
    assert {r.score for r in toxicity.score(d, none).collect()} == {0.0}


def test_isotonic():
    xs, ys = toxicity.isotonic(np.array([0.0, 1, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1, 0]))
    assert (np.diff(ys) >= 0).all() and np.interp(1.5, xs, ys) == pytest.approx(0.5)


# -- archives ---------------------------------------------------------------------------
def test_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i} %\n", f"<p>é{i % 9}</p>" * (i % 9 + 1), "z") for i in range(50)] + [(50, None, None, "z"), (51, "u", "", "z"), (None, "u", "", "z"), (None, "u", "alone", "z"), (0, "again", "<p>é0</p>", "z"), (60, "u", "x" * 300_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(4)
    path = f"file://{tmp_path}/warc"
    index = warc.write(warc.plan(pages), path)
    back = warc.read(index, path).collect()
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, u, h, _ in rows:
        f, b = first.get(h or ""), (h or "").encode()
        revisit = f is not None and f != i
        want.append((i, u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None, None if revisit else b))
    got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in back]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    some = warc.read(index.where("page_id % 7 = 0"), path).collect()
    assert sorted(r.page_id for r in some) == sorted(i for i, *_ in rows if i is not None and i % 7 == 0)
    assert warc.archive(pages.limit(0)).count() == 0
    big = warc.archive(pages, least=10_000).collect()
    assert {r.record_type for r in big} == {"response"}


def test_ranges():
    assert warc.coalesce_ranges([(0, 10), (10, 5), (500, 10)], read=1000, gap=100) == [[(0, 10), (10, 5)], [(500, 10)]]
    with pytest.raises(ValueError):
        warc.decode(warc.encode(1, "u", b"abc", "WRONG", None, False))


# -- pipeline ----------------------------------------------------------------------------
def test_pipeline(spark, sf):
    """On the supplied documents; stages are held against brute force in test_pipeline.py."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert 0 < len(left) < d.count() and left <= {r.doc_id for r in d.select("doc_id").collect()}
    copies = d.groupBy(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("t")).agg(F.collect_set("doc_id").alias("ids")).collect()
    assert all(len(left & set(r.ids)) <= 1 for r in copies)
