"""8. Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled rows (``SAMPLE``, the smallest by a hash of doc_id) is
fitted on. Lexicon entries are whole words and word beginnings whose document
frequency, counted by the executors, tells toxic from clean rows. Training rows get
their lexicon features from lexicons fitted without them (folds), and the
calibration uses scores of trees fitted without them. The driver gets counts of
terms that some toxic rows share and a row of features per training row, never a
text, so texts of any length can be fitted on. Scoring is one pass over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, drop_materialized, materialize, table

#: Labelled rows that may be fitted on.
SAMPLE = 4000
FOLDS, TREES, DEPTH, RATE, LEAF, EDGES = 3, 60, 3, 0.15, 8, 32
STEMS = range(4, 8)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
#: A run is tried at its start only, so a long one is read once.
_SIGNS, _DIGITS = re.compile(r"(?<![*@$!#])[*@$!#]++\w"), re.compile(r"(?<!\d)\d++[A-Za-z]")
_SPACED, _STRETCHED = re.compile(r"\b\w[ .\-]\w[ .\-]\w[ .\-]\w\b"), re.compile(r"([a-z])\1\1\1")
FEATURES = ("log_words", "lex_density", "lex_distinct", "stem_density", "stem_distinct", "max_weight", "near_second", "second_density", "capitals", "shouted", "punctuation", "exclaims", "hidden")


def _hidden(text: str) -> int:
    """Words with signs or digits inside, spelt-out words and stretched letters."""
    n = sum(1 for m in _SIGNS.finditer(text) if m.start() and text[m.start() - 1].isalnum())
    n += sum(1 for m in _DIGITS.finditer(text) if m.start() and text[m.start() - 1].isalpha())
    return n + sum(1 for _ in _SPACED.finditer(text)) + sum(1 for _ in _STRETCHED.finditer(text))


def terms(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text or "")]


def _stems(w: str) -> list[str]:
    return [w[:k] for k in STEMS if len(w) > k]


def term_counts(rows: Iterable[tuple[str | None, int, int]]) -> Counter:
    """rows: (text, label, fold). Rows that have a term, by (kind, term, label, fold); kind 0 are words, 1 word beginnings."""
    out: Counter = Counter()
    for text, y, fold in rows:
        ws = set(terms(text))
        out.update((0, w, y, fold) for w in ws)
        out.update((1, x, y, fold) for x in {x for w in ws for x in _stems(w)})
    return out


def lexicon(counts: dict[tuple[int, str], np.ndarray], n: np.ndarray) -> tuple[dict[str, float], dict[str, float]]:
    """Weights (log odds of document frequency) of telling words and of telling word beginnings. counts: rows of (kind, term) by label; n: rows by label."""
    out: tuple[dict[str, float], dict[str, float]] = ({}, {})
    for (kind, x), (clean, toxic) in counts.items():
        if toxic >= max(3, n[1] // 100):
            v = float(np.log((toxic + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1)))
            if v > 2.5:
                out[kind][x] = v
    return out


def features(text: str | None, lex: tuple[dict[str, float], dict[str, float]]) -> list[float]:
    """Dense features of a whole text; an empty one gives zeros."""
    text = text or ""
    raw, chars = _WORD.findall(text), max(1, len(text))
    ws = [w.lower() for w in raw]
    n, words, stems = max(1, len(ws)), lex[0], lex[1]
    found, lead, at, best = Counter(), Counter(), [], 0.0
    told: dict[str, str | None] = {}
    for w, k in Counter(ws).items():
        x = next((x for x in _stems(w) if x in stems), None)
        if w in words or x is not None:
            told[w] = x
            best = max(best, words.get(w, 0.0), stems.get(x, 0.0))
            if w in words:
                found[w] = k
            if x is not None:
                lead[x] += k
    if told:
        at = [i for i, w in enumerate(ws) if w in told]
    second = [i for i, w in enumerate(ws) if w in SECOND]
    near = 0
    if at and second:
        a, b = np.array(at), np.array(second)
        j = np.searchsorted(b, a)
        near = int((np.minimum(np.abs(a - b[np.maximum(j - 1, 0)]), np.abs(b[np.minimum(j, len(b) - 1)] - a)) <= 5).sum())
    upper = sum(1 for _ in _UPPER.finditer(text))
    shouted = sum(1 for w in raw if len(w) > 2 and w.isupper())
    punct = sum(text.count(c) for c in "!?.,;:\"'()*#$%&@")
    hidden = _hidden(text)
    return [np.log1p(len(ws)), sum(found.values()) / n, len(found), sum(lead.values()) / n, len(lead), best, near, len(second) / n, upper / chars, shouted / n, punct / chars, text.count("!") / chars, hidden / n]


class Boosted:
    """Logistic gradient-boosted regression trees on binned features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, leaf: int = LEAF):
        self.trees, self.depth, self.rate, self.leaf = trees, depth, rate, leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, EDGES + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.forest = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, y - q, q * (1 - q))
            self.forest.append(tree)
            f += self.rate * self._leaf(tree, binned)
        return self

    def _grow(self, x, g, h):
        """Nodes 1..2^(depth+1)-1: (feature, bin) of splits, value of leaves."""
        nodes: dict[int, tuple] = {}
        todo = [(1, np.arange(len(g)), 0)]
        while todo:
            k, rows, d = todo.pop()
            gs, hs = g[rows], h[rows]
            total, best = gs.sum() ** 2 / (hs.sum() + 1), (1e-3, None)
            if d < self.depth and len(rows) >= 2 * self.leaf:
                for j in range(x.shape[1]):
                    b = x[rows, j]
                    m = len(self.edges[j]) + 1
                    n, sg, sh = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (None, gs, hs))
                    gain = sg**2 / (sh + 1) + (gs.sum() - sg) ** 2 / (hs.sum() - sh + 1) - total
                    gain[(n < self.leaf) | (len(rows) - n < self.leaf)] = -1
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), (j, int(gain.argmax())))
            if best[1] is None:
                nodes[k] = (-1, 0, float(gs.sum() / (hs.sum() + 1)))
            else:
                j, cut = best[1]
                nodes[k] = (j, cut, 0.0)
                low = x[rows, j] <= cut
                todo += [(2 * k, rows[low], d + 1), (2 * k + 1, rows[~low], d + 1)]
        size = 2 ** (self.depth + 1)
        tree = (np.full(size, -1), np.zeros(size, int), np.zeros(size))
        for k, v in nodes.items():
            for a, z in zip(tree, v, strict=True):
                a[k] = z
        return tree

    def _leaf(self, tree, x):
        feature, cut, value = tree
        k = np.ones(len(x), int)
        for _ in range(self.depth):
            j = feature[k]
            k = np.where(j < 0, k, 2 * k + (x[np.arange(len(x)), np.maximum(j, 0)] > cut[k]))
        return value[k]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        return self.base + self.rate * sum(self._leaf(t, binned) for t in self.forest)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: knots (score, probability), non-decreasing."""
    order = np.argsort(score, kind="stable")
    s, blocks = score[order], []
    for x, v in zip(s, y[order].astype(float), strict=True):
        blocks.append([v, 1.0, x, x])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            v2, w2, _, hi = blocks.pop()
            v1, w1, lo, _ = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    xs = np.array([e for b in blocks for e in (b[2], b[3])])
    ys = np.array([b[0] for b in blocks for _ in (0, 1)])
    keep = np.concatenate(([True], xs[1:] > xs[:-1]))
    return xs[keep], ys[keep]


class Model:
    """lexicon, trees and calibration; scores lists of whole texts."""

    def __init__(self, lex: tuple[dict[str, float], dict[str, float]], x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        """x: features of the training rows, with lexicons fitted without their folds."""
        self.lex, self.trees, self.knots = lex, None, None
        if not len(y) or y.min() == y.max():  # nothing to tell apart
            self.constant = float(y.mean()) if len(y) else 0.0
            return
        out = np.zeros(len(y))
        for k in range(FOLDS):
            if (fold == k).any() and len(set(y[fold != k])) == 2:
                out[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
        self.trees, self.knots = Boosted().fit(x, y), isotonic(out, y)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if self.trees is None:
            return np.full(len(texts), self.constant)
        m = self.trees.margin(np.array([features(t, self.lex) for t in texts]))
        p = np.interp(m, *self.knots)
        return np.clip(0.999 * p + 0.001 / (1 + np.exp(-m)), 0, 1)  # ties of the steps stay ordered


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on labelled rows that aren't held out; at most ``sample`` rows, chosen by a hash of doc_id. Equal rows count once."""
    spark = docs.sparkSession
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id")))
    some = named.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").join(F.broadcast(some), "doc_id")  # at most `sample` ids
    keys = rows.select("doc_id", "h").distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "h").limit(sample)
    rows = rows.join(F.broadcast(keys), ["doc_id", "h"], "left_semi").drop("h").distinct()  # at most `sample` rows
    rows = materialize(rows.withColumn("fold", (F.crc32(F.concat(F.lit("f"), F.col("doc_id")).cast("binary")) % FOLDS).cast("int")).repartition(32), "labelled")

    def count(c):
        k = term_counts(zip(c["text"], c["y"], c["fold"], strict=True))
        return {**dict(zip(("kind", "term", "y", "fold"), map(list, zip(*k)), strict=True)), "n": list(k.values())}

    n = np.zeros((2, FOLDS), int)
    for r in rows.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect():
        n[r.y, r.fold] = r.n
    at = [F.sum(F.when((F.col("y") == y) & (F.col("fold") == k), F.col("n")).otherwise(0)).alias(f"n{y}_{k}") for y in (0, 1) for k in range(FOLDS)]
    counted = arrow_map(rows, count, "kind int, term string, y int, fold int, n long").groupBy("kind", "term").agg(*at)
    counts = {(r[0], r[1]): np.array(r[2:]).reshape(2, FOLDS) for r in counted.where(" + ".join(f"n1_{k}" for k in range(FOLDS)) + " >= 3").collect()}  # terms of three toxic rows of the sample
    lex = lexicon({t: v.sum(1) for t, v in counts.items()}, n.sum(1))
    without = [lexicon({t: v.sum(1) - v[:, k] for t, v in counts.items()}, n.sum(1) - n[:, k]) for k in range(FOLDS)]
    shared = spark.sparkContext.broadcast(without)

    def describe(c):
        return {"doc_id": c["doc_id"], "y": c["y"], "fold": c["fold"], "x": [features(t, shared.value[k]) for t, k in zip(c["text"], c["fold"], strict=True)]}

    got = sorted(map(tuple, arrow_map(rows, describe, "doc_id long, y int, fold int, x array<double>").collect()))  # at most `sample` rows of features
    drop_materialized(rows)
    return Model(lex, np.array([r[3] for r in got]).reshape(-1, len(FEATURES)), np.array([r[1] for r in got], float), np.array([r[2] for r in got], int))


def score(docs: DataFrame, model: Model, by_text: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``; ``by_text`` adds text_hash, xxhash64(text).

    Null texts score as empty ones; a null doc_id is never held out; repeated rows
    score alike. Without labels of both kinds every score is their mean. Other
    columns are not read: a score depends on the text alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    named = ["doc_id", "text_hash"] if by_text else ["doc_id"]

    def run(c):
        s = shared.value.score(c["text"])
        return {**{k: c[k] for k in named}, "held_out": [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in c["doc_id"]], "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *([F.xxhash64("text").alias("text_hash")] if by_text else []), "text")
    return arrow_map(rows, run, ", ".join(f"{k} long" for k in named) + ", held_out boolean, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
