"""The pipeline's near-dedup stage against brute force over exact shingle sets."""

import random

import corpus_pipeline
import numpy as np
from stellate.llm import near_copies


def grams(t):
    ws = (t or "").lower().split()
    k = min(5, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()


def alike(x, y):
    return x == y or len(x & y) * 5 >= 4 * len(x | y)


def brute(texts):
    """Component (smallest index) of every text."""
    sets, label = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)


def corpus(n=60, seed=4):
    """Texts and copies with a few words changed, so that similarities lie on both sides of 0.8; one group is large."""
    rng = random.Random(seed)
    texts = [None, "", " \t", "a b", "A b", "a c"]
    for g in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 200, 600]))]
        texts.append(" ".join(base))
        for _ in range(80 if g == 0 else rng.choice([0, 1, 3])):
            ws = list(base)
            for _ in range(max(1, round(len(ws) * rng.choice([0.005, 0.015, 0.02, 0.025, 0.05])))):
                ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(ws))
    return texts


def test_components_are_those_of_all_pairs(spark):
    texts = corpus()
    want = brute(texts)
    got = {r.doc_id: (r.component, r.kept) for r in near_copies.near_copies(frame(spark, list(enumerate(texts)))).collect()}
    first = {}
    for i, c in enumerate(want):
        assert first.setdefault(got[i][0], c) == c
        assert got[i][1] == (i == c)
    assert len(first) == len(set(want)) < len(texts) - 50


def test_stage_drops_a_copy_at_0_83(spark):
    ws = [f"w{i}" for i in range(214)]
    other = [*ws[:50], "x", *ws[51:120], "y", *ws[121:170], "z", *ws[171:]]
    assert 0.8 < len(grams(" ".join(ws)) & grams(" ".join(other))) / len(grams(" ".join(ws)) | grams(" ".join(other))) < 0.9
    d = frame(spark, [(2, " ".join(ws)), (1, " ".join(other)), (3, "other words that stay here for good"), (None, "alone and without an id"), (3, "the same id but another text")])
    got = corpus_pipeline.drop_near_copies(spark, d, "").collect()
    assert sorted((str(r.doc_id), r.text[:5]) for r in got) == [("1", "w0 w1"), ("3", "other"), ("3", "the s"), ("None", "alone")]


def test_method_is_simhash_with_pivot_tables():
    """Links of planted fingerprints by groups, distance tables and bits; every near row is in a star, and others() gives the pairs of brute force once."""
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (40, near_copies.WIDTH), dtype=np.uint8)
    bits = np.concatenate([bits, *[np.where(rng.random(bits[:8].shape) < r, 1 - bits[:8], bits[:8]) for r in (0.02, 0.1, 0.14)]])
    fp = np.packbits(bits, axis=1).view(np.uint64)
    keys = near_copies.group_keys(fp.view(np.int64))
    differ = np.bitwise_count(fp[:, None] ^ fp[None]).astype(int)
    near = (differ.sum(2) <= near_copies.FAR) & (differ[:, :, :2].sum(2) <= near_copies.NEAR) & (keys[:, None] == keys[None]).any(2)
    key, row = np.array(sorted((k, i) for i, ks in enumerate(keys) for k in ks)).T
    groups = near_copies.Groups(key, [fp[row, w] for w in range(fp.shape[1])])
    stars = [(row[i], row[j]) for x, y in groups.stars() for i, j in zip(x, y)]
    want = {(i, j) for i in range(len(fp)) for j in range(i) if near[i, j]}
    assert {i for p in want for i in p} <= {i for p in stars for i in p} and len(want) >= 30
    got = [(row[i], row[j]) for x, y in groups.others(row, np.full(len(row), 50)) for i, j in zip(x, y)]
    assert sorted(tuple(sorted(p, reverse=True)) for p in got) == sorted(want)


def test_fingerprints_agree_as_the_angle_says():
    rng = random.Random(2)
    differ, alone = [], 0
    for _ in range(60):
        x = [rng.randrange(2**64) for _ in range(110)]
        a, b = (near_copies.fingerprint(np.unique(np.array(v, np.uint64))) for v in (x[:99], x[11:]))  # 88 of 110: 0.8
        differ.append(int(np.bitwise_count((a ^ b).view(np.uint64)).sum()))
        alone += not (near_copies.group_keys(a[None]) == near_copies.group_keys(b[None])).any()
    assert abs(np.mean(differ) / near_copies.WIDTH - np.arccos(8 / 9) / np.pi) < 0.01 and max(differ) <= near_copies.FAR and not alone


def test_four_shingles_within_five(spark):
    texts = [" ".join(f"s{i}x{j}" for j in range(n)) for i in range(40) for n in (8, 9)]
    got = {r.doc_id: r.component for r in near_copies.near_copies(frame(spark, list(enumerate(texts)))).collect()}
    assert len(set(got.values())) == 40 and all(got[2 * i] == got[2 * i + 1] for i in range(40))


def test_parity_sketches_differ_by_no_more_than_the_sets():
    rng = random.Random(6)
    for n, m in ((1, 2), (150, 10), (150, 40), (600, 200), (5000, 3000)):
        x = [rng.randrange(2**64) for _ in range(n + m)]
        a, b = (np.unique(np.array(v, np.uint64)) for v in (x[:n], x[m // 2 : n + m]))
        differ = int(np.bitwise_count((near_copies.parity(a) ^ near_copies.parity(b)).view(np.uint64)).sum())
        lacking = len(np.setxor1d(a, b))
        assert differ <= lacking and (lacking - differ) % 2 == 0
        assert lacking > 60 or differ >= lacking - 8


def star(m, seed=8):
    """A text of 150 words and copies with two to four words changed: those with four are at 0.76 to it, two copies at 0.57 to 0.76 where their changes lie apart."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for i in range(m):
        ws = list(base)
        for at in rng.sample(range(5, 145), 2 + i % 3):
            ws[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(ws))
    return texts


def test_pairs_of_a_large_group_of_near_copies_do_not_grow_with_its_square(spark, monkeypatch):
    joined, candidates, verified = [], near_copies._candidates, near_copies._verified
    monkeypatch.setattr(near_copies, "_candidates", lambda pairs, *a: joined.append(pairs.count()) or candidates(pairs, *a))
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *a: joined.append(pairs.count()) or verified(pairs, *a))
    texts = star(600)
    got = {r.doc_id: (r.component, r.kept) for r in near_copies.near_copies(frame(spark, list(enumerate(texts)))).collect()}
    want, first = brute(texts), {}
    for i, c in enumerate(want):
        assert first.setdefault(got[i][0], c) == c and got[i][1] == (i == c)
    assert len(first) == len(set(want)) > 100
    assert sum(joined) <= 15 * len(texts), joined
