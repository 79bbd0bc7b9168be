"""Bounds: repeated and missing ids, long runs of signs, large payloads, empty tables; and slow, plain versions of models."""

import collections
import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellate.llm import common
from stellate.llm import components as comp
from stellate.llm import langid, packing, pii, rollups, substring_dedup, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


# -- 1 ---------------------------------------------------------------------------
@pytest.mark.parametrize("binary", [False, True])
def test_components_of_many_links(spark, monkeypatch, binary):
    monkeypatch.setattr(comp, "BLOCK", 50)
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 400)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(300)] * 3 + [(i, i + 1) for i in range(1000, 1080)]
    edges = [(a, b) for a, b in edges if a != b]
    lab = {x: x for e in edges for x in e}
    find = lambda x: x if lab[x] == x else find(lab[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        lab[b] = a
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    if binary:
        df = df.select(*[F.lpad(F.col(c).cast("string"), 5, "0").cast("binary").alias(c) for c in "ab"])
    got = {int(r.node): int(r.component) for r in comp.components(df).collect()}
    assert got == {x: find(x) for x in lab}


def test_forest():
    rng = np.random.default_rng(0)
    u, v = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    a, b = comp.forest(u, v)
    assert len(set(a.tolist())) == len(a) <= 200 and (b < a).all() and [len(x) for x in comp.forest(u[:0], v[:0])] == [0, 0]


# -- 2 ---------------------------------------------------------------------------
def test_null_ids_do_not_multiply(spark, monkeypatch):
    rng, passage = random.Random(2), " ".join(f"p{i}" for i in range(60))
    rows = [(None, " ".join(f"w{rng.randrange(9999)}" for _ in range(20)) + " " + passage, "en", "s") for _ in range(300)] + [(None, passage, "en", "s")] * 200 + [(9, passage + " tail", "en", "s")]
    made, real = {}, substring_dedup.materialize

    def counted(df, label):
        out = real(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(substring_dedup, "materialize", counted)
    got = substring_dedup.substring_dedup(docs(spark, rows)).collect()
    assert made["texts"] == 302 and len(got) == 501
    empty = hashlib.sha256(b"").hexdigest()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in got) == {(None, 80, 60): 300, (None, 60, 60): 200, (9, 61, 0): 1}
    assert {r.kept_sha256 for r in got if r.n_words == 60} == {empty}


# -- 3 ---------------------------------------------------------------------------
@pytest.mark.parametrize("i", [None, 5])
def test_shards_are_bounded_for_one_id(spark, i):
    got = packing.pack(docs(spark, [(i, "a b c", "en", "s")] * 600), shard=50).collect()
    sizes = collections.Counter(r.bin_id[:6] for r in got)
    assert len(got) == 600 and len(sizes) == 12 and max(sizes.values()) <= 100


def test_texts_without_spaces_have_tokens(spark):
    assert [packing.tokens(t) for t in (None, b"", b" \n", b"a bc", b"x" * 33, "語".encode() * 1000)] == [0, 0, 0, 2, 3, 188]
    got = packing.pack(docs(spark, [(1, "語" * 3000, "ja", "s")]), capacity=100).collect()
    assert sorted(r.n_tokens for r in got) == [63, 100, 100, 100, 100, 100]


def test_fill_against_one_global_best_fit(spark, sf):
    d = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    bins = [packing.pack(d, shard=s).select("bin_id").distinct().count() for s in (100, 1 << 20)]
    print("bins of shards of 100 rows, of one global best fit:", bins)
    assert bins[0] <= 1.6 * bins[1]


# -- 5 ---------------------------------------------------------------------------
def plain_identify(rows, model):
    """rows: (key, kind, host, domain, suffix, path, declared, content) -> (lang, confidence), by loops."""
    langs, seen = model.langs, []
    for key, kind, host, domain, suffix, path, declared, content in rows:
        ev = dict(zip(langs, model.loglik(langid.visible(content) if kind == "page" else content)))
        for name, said in (("markup", declared), ("suffix", langid.SUFFIXES.get(suffix)), ("path", path)):
            if said in langs:
                for x in langs:
                    ev[x] += np.log(1 - langid.WRONG[name] if x == said else langid.WRONG[name] / max(1, len(langs) - 1))
        top = max(ev.values())
        whole = sum(np.exp(v - top) for v in ev.values())
        seen.append((key, kind, host, domain, ev, {x: np.exp(ev[x] - top) / whole for x in langs}))
    out = {}
    for key, kind, host, domain, ev, own in seen:
        every = {x: sum(s[5][x] for s in seen) for x in langs}
        prior = {x: (every[x] + 1) / (sum(every.values()) + len(langs)) for x in langs}
        for same in (lambda s: (s[1], s[3]) == (kind, domain), lambda s: (s[1], s[2], s[3]) == (kind, host, domain)):
            if domain is None or host is None:
                continue
            n = {x: max(0, sum(s[5][x] for s in seen if same(s)) - own[x]) for x in langs}
            prior = {x: (n[x] + langid.KAPPA * prior[x]) / (langid.KAPPA + sum(n.values())) for x in langs}
        post = {x: ev[x] + np.log(max(prior[x], 1e-9)) for x in langs}
        best = max(langs, key=lambda x: post[x])
        out[key] = (best, round(1 / sum(np.exp(v - post[best]) for v in post.values()), 6))
    return out


@pytest.mark.parametrize("hosts", [0, 10**6])
def test_language_against_loops(spark, monkeypatch, hosts):
    monkeypatch.setattr(langid, "HOSTS", hosts)
    texts = {"en": "the cat and the dog went with that thing over there", "de": "der hund und die katze sind nicht mit uns gegangen", "fr": "le chien et la chatte ne sont pas avec nous dans la rue"}
    model = langid.TextModel([(t, x) for x, t in texts.items()])
    rng = random.Random(3)
    d = [(i, rng.choice([None, "", *texts.values(), "xyz"]), None, rng.choice(["s1", "s1", "s2", None])) for i in range(40)]
    p = [(i, rng.choice(["https://a.x.de/q", "http://b.x.de/fr/q", "https://c.uk/", None]), rng.choice([None, "<p>", f"<html lang=fr><p>{texts['en']}", texts["de"]])) for i in range(40)]
    rows = langid.rows_of(docs(spark, d), spark.createDataFrame(p, "page_id long, url string, html string"))
    plain = [((r.kind, r.doc_id, r.page_id), r.kind, r.host, r.domain, r.suffix, r.path, langid.declared_language(r.content) if r.kind == "page" else None, r.content) for r in rows.collect()]
    want = plain_identify(plain, model)
    got = {(r.kind, r.doc_id, r.page_id): (r.lang, r.confidence) for r in langid.identify(rows, model).collect()}
    assert len(got) == 80 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)


def test_language_sample_is_bounded(spark):
    rows = [(1, "the same text", "en", "s")] * 500 + [(i, f"text {i}", "de", "s") for i in range(2, 60)]
    read = []
    real = langid.TextModel
    langid.TextModel = lambda x: read.extend(x) or real(read)
    try:
        langid.train(docs(spark, rows), sample=20)
    finally:
        langid.TextModel = real
    assert len(read) <= 20


# -- 6 ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def crf():
    return pii.CRF(pii.labelled())


def test_crf_on_lines_it_has_not_seen(crf):
    lines = pii.labelled(seed=77)
    got = crf.decode([ws for ws, _ in lines])
    inside = [(a, b) for (_, x), g in zip(lines, got) for a, b in zip(x, g) if a != "O" or b != "O"]
    right = sum(a == b for a, b in inside)
    print("labels that are not O on both sides, right:", right / len(inside))
    assert right >= 0.93 * len(inside)


def test_added_spans_against_whole_decode(crf):
    rng = np.random.default_rng(4)
    lines = [ws for ws, _ in pii.labelled(seed=78)]
    texts = [" ".join(w for i in rng.integers(0, 480, n) for w in lines[i]) for n in (1, 3, 40, 200)] + [None, "", "1 " * 3000, "\n", "4 " * 9]
    base = [pii.base_spans(t) for t in texts]
    want = []
    for t, b in zip(texts, base):
        out, words = [], [(m.group(), m.start(), m.end()) for m in pii._TOKEN.finditer(t or "")]
        labels, j = crf.decode([[w for w, *_ in words]])[0], 0
        while j < len(words):
            if labels[j] == "O":
                j += 1
                continue
            kind, k = labels[j][2:], j + 1
            while k < len(words) and labels[k] == f"I-{kind}":
                k += 1
            lo, hi = words[j][1], words[k - 1][2]
            while hi > lo and not t[hi - 1].isalnum():
                hi -= 1
            while lo < hi and t[lo] in "\"'[<,;":
                lo += 1
            if lo < hi and all(y <= lo or hi <= x for x, _, y in b):
                out.append((lo, pii.KINDS.index(kind), hi))
            j = k
        want.append(out)
    assert pii.added_spans(texts, base, crf) == want and sum(map(len, want)) > 20


# -- 7 ---------------------------------------------------------------------------
def test_compaction(spark, tmp_path):
    change = lambda *rows: spark.createDataFrame(rows, "source string, lang string, tokenizer string, docs long, tokens long")
    roll = rollups.Rollup(spark, str(tmp_path / "r"))
    total = lambda: sorted((tuple(r) for r in roll.totals().collect()), key=repr)
    assert total() == [] and roll.compact() == 0
    assert roll.commit("b1", change(("a", "en", "t", 2, 9), (None, None, "t", 1, 1)))
    assert roll.commit("b2", change(("a", "en", "t", -1, -4)))
    assert roll.compact() == 2 and total() == [("a", "en", "t", 1, 5), (None, None, "t", 1, 1)]
    assert not roll.commit("b1", change(("a", "en", "t", 7, 7)))
    assert roll.commit("b3", change((None, None, "t", -1, -1)))
    assert total() == [("a", "en", "t", 1, 5)]
    assert roll.compact() == 1 and total() == [("a", "en", "t", 1, 5)]
    assert [n for n in (tmp_path / "r").iterdir() if n.name.startswith("batch-")] == [tmp_path / "r" / "batch-b3"]
    assert not any(roll.commit(b, change(("x", "x", "t", 1, 1))) for b in ("b1", "b2", "b3")) and total() == [("a", "en", "t", 1, 5)]
    other = rollups.Rollup(spark, roll.path)
    other.committed = lambda b: False  # as if it had looked before the other writer
    assert roll.commit("b4", change(("a", "en", "t", 1, 1))) and not other.commit("b4", change(("a", "en", "t", 1, 1)))
    assert total() == [("a", "en", "t", 2, 6)]


# -- 8 ---------------------------------------------------------------------------
@pytest.mark.parametrize("part", ["*", "1", "a*", "é$", "a1", "ha ", "A"])
def test_signs_are_read_once(part):
    began = time.perf_counter()
    toxicity.features(part * (1_000_000 // len(part)), ({"ha": 3.0}, {}))
    assert time.perf_counter() - began < 10
    began = time.perf_counter()
    toxicity._hidden(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 2


def plain_features(text, lex):
    """By one pass over words and characters each."""
    text, words, stems = text or "", *lex
    raw = toxicity._WORD.findall(text)
    ws = [w.lower() for w in raw]
    n, chars = max(1, len(ws)), max(1, len(text))
    lead = [next((w[:k] for k in toxicity.STEMS if len(w) > k and w[:k] in stems), None) for w in ws]
    told = [i for i, w in enumerate(ws) if w in words or lead[i]]
    second = [i for i, w in enumerate(ws) if w in toxicity.SECOND]
    hit = [w for w in ws if w in words]
    led = [x for x in lead if x]
    best = max([0.0, *(words[w] for w in hit), *(stems[x] for x in led)])
    near = sum(any(abs(i - j) <= 5 for j in second) for i in told)
    return [np.log1p(len(ws)), len(hit) / n, len(set(hit)), len(led) / n, len(set(led)), best, near, len(second) / n, sum(bool(toxicity._UPPER.match(c)) for c in text) / chars, sum(len(w) > 2 and w.isupper() for w in raw) / n, sum(c in "!?.,;:\"'()*#$%&@" for c in text) / chars, sum(c == "!" for c in text) / chars, toxicity._hidden(text) / n]


def plain_score(model, x):
    """One row through every tree, by its edges."""
    f = model.trees.base
    b = [int(sum(v >= e for e in edges)) for v, edges in zip(x, model.trees.edges)]
    for feature, cut, value in model.trees.forest:
        k = 1
        while feature[k] >= 0 and 2 * k < len(feature):
            k = 2 * k + int(b[feature[k]] > cut[k])
        f += model.trees.rate * value[k]
    p = float(np.interp(f, *model.knots))
    return min(1, max(0, 0.999 * p + 0.001 / (1 + np.exp(-f))))


def test_toxicity_against_loops(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["vile", "vilest", "you", "dog", "cat", "b@d", "h4te", "SHOUT!", "a.b.c.d", "soooo", "fine"] if i % 3 == 0 else ["dog", "cat", "fine", "day", "rain", "you"]) for _ in range(rng.randrange(1, 60))) for i in range(300)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(300, None, None, None), (None, "", "en", "s"), (301, "x " * 100_000, "en", "s")]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(301, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, rows), labels)
    assert model.trees is not None
    got = {(r.doc_id, r.score, r.predicted) for r in toxicity.score(docs(spark, rows), model).collect()}
    for i, t, *_ in rows:
        x = plain_features(t, model.lex)
        assert toxicity.features(t, model.lex) == pytest.approx(x)
        want = plain_score(model, x)
        assert any(j == i and s == pytest.approx(want, abs=1e-9) and p == (s >= 0.5) for j, s, p in got)


def test_a_very_long_labelled_text_is_fitted_on(spark):
    rows = [(i, "vile you vile" if i % 2 else "fine day", "en", "s") for i in range(60)] + [(60, "rain " * 6_000_000, "en", "s")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(61)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, rows), labels)
    assert model.trees is not None and model.score(["vile you vile"])[0] > 0.5 > model.score(["fine day"])[0]


# -- 9 ---------------------------------------------------------------------------
def test_archives_are_read_by_bytes(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h/{i}", f"{i} " * 400_000) for i in range(12)] + [(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 400) for i in range(12, 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = f"file://{tmp_path}/warc"
    monkeypatch.setattr(warc, "READ", 1 << 12)
    index = warc.write(warc.plan(pages), path)
    back = warc.read(index, path)
    n = index.agg(F.sum("length")).first()[0]
    assert back.rdd.getNumPartitions() == -(-n // (1 << 12)) > 3
    assert {r.page_id: bytes(r.payload) for r in back.collect()} == {i: h.encode() for i, _, h in rows}


@pytest.mark.parametrize("known", [0, 10**6])
def test_revisits_either_way(spark, monkeypatch, known):
    monkeypatch.setattr(warc, "KNOWN", known)
    pages = spark.createDataFrame([(5, "u", "same"), (3, "u", "same"), (None, "u", "same"), (3, "v", "same"), (7, "u", "own"), (None, "u", "none"), (8, None, None), (9, None, "")], "page_id long, url string, html string").repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(pages).collect()), key=repr)
    want = [(5, 4, "revisit", 3), (3, 4, "response", None), (None, 4, "revisit", 3), (3, 4, "response", None), (7, 3, "response", None), (None, 4, "response", None), (8, 0, "response", None), (9, 0, "revisit", 8)]
    assert got == sorted(want, key=repr)


# -- all -------------------------------------------------------------------------
def test_empty_tables(spark, tmp_path):
    none, labels = docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = langid.TextModel([("the", "en"), ("der", "de")])
    assert langid.identify(langid.rows_of(none, pages), model).count() == 0
    assert langid.identify(langid.rows_of(none, pages), langid.train(none)).count() == 0
    assert pii.personal_data(none).count() == 0
    assert rollups.maintained(none, str(tmp_path / "r")).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert warc.archive(pages).count() == 0


def test_session_settings_stay(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    pii.personal_data(docs(spark, [(1, "a", "en", "s")])).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "local-cluster[3,2,3000]"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session, "x")
