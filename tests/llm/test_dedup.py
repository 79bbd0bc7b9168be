"""Operators 1, 2, 4 and 10 against brute force, on odd rows, too."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from stellate.llm import decontaminate, exact_dedup, simhash, substring_dedup
from stellate.llm.components import components

WS = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, cls string, norm string, key string, row long, h string, component string, rep long, node string, ws string"


def corpus(spark, n=120, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(70)]
    texts = []
    for _ in range(n):
        ws = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 7, 30, 120]))]
        if rng.random() < 0.4:
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = passage[: rng.choice([49, 50, 70])] * rng.choice([1, 1, 2])
        if texts and rng.random() < 0.3:
            ws = list(texts[rng.randrange(len(texts))])
            if ws and rng.random() < 0.6:
                ws[rng.randrange(len(ws))] = "changed"
        texts.append(ws)
    rows = [(i, rng.choice([" ", "\n", "  "]).join(t).upper() if rng.random() < 0.1 else " ".join(t)) for i, t in enumerate(texts)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\x0b"), (n + 3, "É x é"), (3, rows[3][1]), (n + 4, "x" * 50_000), (n + 5, "lang word " * 4000)]
    return frame(spark, rows), rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, *["z"] * 4, 1, "z", "z", 1, "z", "z") for i, t in rows], SCHEMA).repartition(3)


def brute_fingerprint(text):
    ws = WS.findall((text or "").encode().lower())
    if not ws:
        return 0
    k = min(4, len(ws))
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + k]), 42) for i in range(len(ws) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    label = {x: x for x in nodes}
    find = lambda x: x if label[x] == x else find(label[x])
    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_simhash(spark, group=simhash.GROUP):
    df, rows = corpus(spark)
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(set(fps), lambda a, b: (a ^ b).bit_count() <= 4)
    best = {}
    for (i, _), f in zip(rows, fps):
        best[comp[f]] = min(best.get(comp[f], i), i)
    want = sorted((i, f"{f:016x}", best[comp[f]]) for (i, _), f in zip(rows, fps))
    got = simhash.near_duplicates(df, group=group)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == want


@pytest.mark.parametrize("group", [simhash.GROUP, 40])
def test_pivot_links_lose_nothing(spark, group):
    """Clusters of near fingerprints, one of them large, against all pairs."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 30, dtype=np.int64).view(np.uint64)
    fps = set(base.tolist())
    for b in [*base.tolist(), *[int(base[0])] * 60]:
        for _ in range(3):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 8), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = [simhash._signed(x) for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), group=group).collect()
    want = brute_components(set(signed), lambda a, b: ((a ^ b) % 2**64).bit_count() <= 4)
    edges = {(r.a, r.b) for r in found} | {(r.b, r.a) for r in found}
    assert brute_components(set(signed), lambda a, b: (a, b) in edges) == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    both = set(edges) | {(b, a) for a, b in edges}
    assert got == brute_components(nodes, lambda a, b: (a, b) in both)


@pytest.mark.parametrize("group", [substring_dedup.GROUP, 3])
def test_substring(spark, group):
    df, rows = corpus(spark)
    words = [WS.findall((t or "").encode()) for _, t in rows]
    first = {}
    for (i, _), ws in zip(rows, words):
        for k in range(len(ws) - 49):
            w = tuple(ws[k : k + 50])
            first[w] = min(first.get(w, i), i)
    want = []
    for (i, _), ws in zip(rows, words):
        gone = {j for k in range(len(ws) - 49) if first[tuple(ws[k : k + 50])] < i for j in range(k, k + 50)}
        want.append((i, len(ws), len(gone), hashlib.sha256(b" ".join(w for j, w in enumerate(ws) if j not in gone)).hexdigest()))
    got = [tuple(r) for r in substring_dedup.substring_dedup(df, group=group).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 500


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(spark, keep):
    df, rows = corpus(spark)
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    pick = {"min": min, "max": max}[keep]
    want = sorted((i, pick(groups[lower(t)]), len(groups[lower(t)]), i == pick(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)
    assert sorted(tuple(r) for r in exact_dedup.exact_duplicates(df, keep).collect()) == want


def brute_contamination(rows, bench):
    cut = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    out = []
    for i, t in rows:
        ws, hit, items = cut(t), set(), set()
        for item, b in bench:
            bs = cut(b)
            k = min(8, len(bs))
            wins = {tuple(bs[j : j + k]) for j in range(len(bs) - k + 1)} if bs else set()
            for j in range(len(ws) - k + 1):
                if wins and tuple(ws[j : j + k]) in wins:
                    hit |= set(range(j, j + k))
                    items.add(str(item))
        out.append((i, len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2))
    return out


def test_contamination(spark, monkeypatch):
    df, rows = corpus(spark)
    bench = [(1, " ".join(f"p{i}" for i in range(5, 30))), (2, "p10 P11, p12! p13 p14 p15 p16 p17"), (10, "changed"), (11, "É x é"), (12, None), (13, "..."), (14, "w1 w2"), (14, " ".join(f"P{i}" for i in range(20, 40)))]
    b = spark.createDataFrame([(i, t, "z") for i, t in bench], "item_id long, text string, fp string")
    want = sorted(brute_contamination(rows, bench))
    assert sorted(tuple(r) for r in decontaminate.contamination(df, b).collect()) == want and any(w[5] for w in want)
    monkeypatch.setattr(decontaminate, "SLOTS", (32, 64))
    assert sorted(tuple(r) for r in decontaminate.contamination(df, b).collect()) == want
    assert not any(r.n_hit for r in decontaminate.contamination(df, b.limit(0)).collect())


def test_decontamination_is_native(spark):
    df, _ = corpus(spark, 5)
    b = spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(20)))], "item_id long, text string")
    assert not re.search("Python|Pandas|Arrow", decontaminate.contamination(df, b)._jdf.queryExecution().toString())


def test_empty_and_null_ids(spark):
    b = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    ops = [simhash.near_duplicates, substring_dedup.substring_dedup, exact_dedup.exact_duplicates, lambda d: decontaminate.contamination(d, b)]
    empty = spark.createDataFrame([], SCHEMA)
    for op in ops:
        assert op(empty).count() == 0
    odd = frame(spark, [(None, "a b c d e f g h"), (None, None), (7, "a b c d e f g h"), (8, None)])
    got = [op(odd).collect() for op in ops]
    assert [len(g) for g in got] == [4] * 4
    assert {(r.doc_id, r.component_id) for r in got[0]} == {(None, 7), (7, 7), (None, 8), (8, 8)}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got[2]} == {(None, 7, 2, False), (7, 7, 2, True), (None, 8, 2, False), (8, 8, 2, True)}
    assert all(r.n_hit == r.n_words for r in got[3])
