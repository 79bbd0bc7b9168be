"""2. Substring dedup by prefix-partitioned (sparse) suffix trees.

The suffixes of interest start at windows of ``WINDOW`` words. Each window is filed
under its anchor: the leftmost of its ``GRAM``-grams with the least hash. Equal
windows have equal anchors at equal offsets, so suffixes that meet at a node of
depth ``WINDOW`` always share the anchor's prefix.

1. Texts that are equal word for word form one class; only its smallest doc_id's
   text is searched (in a later copy, every window also starts in that one).
2. Anchors' prefixes are counted over all classes; a prefix of a single text can't
   branch at that depth and is left out.
3. The rest is split by prefix into memory-sized groups. A ``GRAM``-word prefix of
   more than ``GROUP`` anchors is lengthened to ``WINDOW`` words at once, as shorter
   steps don't split a passage that thousands of texts share: its suffixes are first
   dealt to parts by document, each part's trees yield their nodes at depth
   ``WINDOW`` (as 128-bit hashes of the words) once, however many suffixes meet
   there, and the groups of the long prefixes are aggregates of these. Every part
   gets back the smallest doc_id of its own nodes. A document's heavy suffixes are
   in one part, so its adjacent spans are merged there.
4. Each group's tree is built in numpy, level by level: rank at depth 2k from two
   ranks at depth k, on word ids, not hashes. Nodes at depth ``WINDOW`` with two
   texts or more are the deep internal nodes; their suffixes are the repeats, and
   runs of adjacent ones the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, arrow_rows, materialize, table

WINDOW, GRAM = 50, 8
#: Anchors that a prefix group may hold in a task's memory.
GROUP = 4096
#: Class texts whose names may be broadcast to fetch them; more are fetched by a shuffled join.
NAMED = 500_000
_LAST = (1 << 63) - 1  # stands for a null doc_id: after all others
_ODD = [np.uint64(int.from_bytes(hashlib.md5(bytes([j])).digest()[:8], "big") | 1) for j in range(64)]


def _hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def anchors(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(prefix hash, position, first window, last window) of each anchor, in order."""
    n = len(words)
    if n < window:
        return (np.zeros(0, np.int64),) * 4
    wh, m = _hashes(words), n - gram + 1
    g = np.zeros(m, np.uint64)
    for j in range(gram):
        g += wh[j : j + m] * _ODD[j]
    g ^= g >> np.uint64(29)
    g *= _ODD[63]
    g ^= g >> np.uint64(32)
    span, have = window - gram + 1, 1
    low, pos = g, np.arange(m)
    while have < span:  # least of `have` grams -> of more; the left one wins ties
        step = min(have, span - have)
        a, b = low[:-step], low[step:]
        right = b < a
        low, pos = np.where(right, b, a), np.where(right, pos[step:], pos[:-step])
        have += step
    new = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1])))
    last = np.concatenate((new[1:] - 1, [n - window]))
    return g[pos[new]].view(np.int64), pos[new], new, last


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """Per row: the hash of its text, its class, number of words, the digest of all its words, its anchors' prefixes."""

    def run(c):
        out = {"doc_id": c["doc_id"], "h": c["h"], "cls": [], "n_words": [], "sha": [], "prefixes": []}
        for t in c["text"]:
            words = (t or b"").split()
            norm = b" ".join(words)
            sha = hashlib.sha256(norm)
            out["cls"].append(sha.digest()[:16])
            out["n_words"].append(len(words))
            out["sha"].append(sha.hexdigest())
            out["prefixes"].append(anchors(words, window)[0])
        return out

    return arrow_map(docs, run, "doc_id long, h long, cls binary, n_words long, sha string, prefixes array<long>")


def _contexts(rows: DataFrame, window: int, parts: int) -> DataFrame:
    """rows: (rep, cls, text, prefixes array<struct<p, heavy>>) -> the words of each anchor's windows; heavy ones have a part."""

    def run(c):
        out = {k: [] for k in ("p", "part", "rep", "cls", "first", "n", "words")}
        for rep, cls, text, ps in zip(c["rep"], c["cls"], c["text"], c["prefixes"], strict=True):
            words = (text or b"").split()
            if hashlib.sha256(b" ".join(words)).digest()[:16] != cls:  # another row with this doc_id
                continue
            heavy, own = {x["p"]: x["heavy"] for x in ps}, int.from_bytes(cls[:7], "big") % parts
            for p, _, first, last in zip(*(x.tolist() for x in anchors(words, window)), strict=True):
                if (h := heavy.get(p)) is not None:
                    for k, v in (("p", p), ("part", own if h else None), ("rep", rep), ("cls", cls), ("first", first), ("n", last - first + 1), ("words", b" ".join(words[first : last + window]))):
                        out[k].append(v)
        return out

    return arrow_map(rows, run, "p long, part int, rep long, cls binary, first int, n int, words binary")


def deep_nodes(groups: np.ndarray, texts: list[list[bytes]], counts: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Builds the trees of a batch of contexts, top down by doubling the depth.

    Context c has the suffixes 0 .. counts[c]-1 of texts[c]. Returns, for each
    suffix, its context, its start there and its node at ``depth``.
    """
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64)
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1]
    ctx = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(len(ctx)) - np.repeat(np.cumsum(counts) - counts, counts)

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)

    rank, have = flat, 1
    while 2 * have <= depth:
        rank = pair(rank[:-have], rank[have:])  # near a context's end it runs into the next, which no suffix reads
        have *= 2
    where = at[ctx] + start
    node = rank[where] if have == depth else pair(rank[where], rank[where + depth - have])
    return ctx, start, pair(groups[ctx], node)


_SPAN = "cls binary, lo int, hi int"


def _tree(t: pa.Table, window: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and rep of each context; context, start and node of each suffix."""
    texts = [w.split(b" ") for w in t["words"].to_pylist()]
    keys = np.unique(np.array(t["p"].to_pylist(), np.int64), return_inverse=True)[1]
    return texts, np.array(t["rep"].to_pylist(), np.int64), *deep_nodes(keys, texts, np.array(t["n"].to_pylist(), np.int64), window)


def _least(node: np.ndarray, rep: np.ndarray) -> np.ndarray:
    least = np.full(int(node.max(initial=-1)) + 1, _LAST)
    np.minimum.at(least, node, rep)
    return least


def _spans(t: pa.Table, ctx: np.ndarray, start: np.ndarray, hit: np.ndarray, window: int) -> dict[str, list]:
    """Suffixes that are hit, as word spans; overlapping ones of a text are merged."""
    first, cls = np.array(t["first"].to_pylist(), np.int64), t["cls"].to_pylist()
    out: dict[str, list] = {"cls": [], "lo": [], "hi": []}
    at: dict[bytes, list[int]] = {}
    for c, lo in zip(ctx[hit].tolist(), (first[ctx] + start)[hit].tolist(), strict=True):
        at.setdefault(cls[c], []).append(lo)
    for name, starts in at.items():
        x = np.unique(starts)
        new = np.flatnonzero(np.concatenate(([True], x[1:] > x[:-1] + window)))
        out["cls"] += [name] * len(new)
        out["lo"] += x[new].tolist()
        out["hi"] += (x[np.concatenate((new[1:], [len(x)])) - 1] + window).tolist()
    return out


def _by_group(contexts: DataFrame, key: str, fn, schema: str) -> DataFrame:
    """fn over tables of whole groups by ``key``, about ``GROUP`` rows at a time."""
    target, pack = arrow_rows(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= GROUP:  # full groups go; the last may go on in the next batch
                t = pa.Table.from_batches(held)
                k = t[key].to_numpy()
                whole = rows - int((k == k[-1]).sum())
                if whole:
                    yield pack(fn(t.slice(0, whole)))
                held = t.slice(whole).to_batches()
                rows -= whole
        if rows:
            yield pack(fn(pa.Table.from_batches(held)))

    return contexts.repartition(key).sortWithinPartitions(key).mapInArrow(run, target)


def _light_repeats(contexts: DataFrame, window: int) -> DataFrame:
    def fn(t):
        _, rep, ctx, start, node = _tree(t, window)
        return _spans(t, ctx, start, _least(node, rep[ctx])[node] < rep[ctx], window)

    return _by_group(contexts, "p", fn, _SPAN)


def _digests(texts: list[list[bytes]], ctx: np.ndarray, start: np.ndarray, node: np.ndarray, window: int) -> list[bytes]:
    """Of each node: a 128-bit hash of its words."""
    at = np.unique(node, return_index=True)[1]
    return [hashlib.md5(b" ".join(texts[c][s : s + window])).digest() for c, s in zip(ctx[at].tolist(), start[at].tolist(), strict=True)]


def _heavy_repeats(contexts: DataFrame, window: int) -> DataFrame:
    def nodes(t):
        texts, rep, ctx, start, node = _tree(t, window)
        part = t["part"].to_pylist()
        key = np.unique(np.array(part)[ctx] * (int(node.max(initial=0)) + 1) + node, return_inverse=True)[1]  # a node of each part
        at = ctx[np.unique(key, return_index=True)[1]]
        return {"part": [part[i] for i in at], "node": _digests(texts, ctx, start, key, window), "least": _least(key, rep[ctx])}

    of_part = materialize(_by_group(contexts, "part", nodes, "part int, node binary, least long"), "nodes")
    overall = of_part.groupBy("node").agg(F.min("least").alias("overall"))
    known = of_part.join(overall, "node").select("part", "node", "overall")
    target, pack = arrow_rows(_SPAN)

    def mark(t: pa.Table, known: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.Table.from_batches([pack({"cls": [], "lo": [], "hi": []})])
        texts, rep, ctx, start, node = _tree(t, window)
        least = dict(zip(known["node"].to_pylist(), known["overall"].to_pylist(), strict=True))
        best = np.array([least[d] for d in _digests(texts, ctx, start, node, window)], np.int64)
        return pa.Table.from_batches([pack(_spans(t, ctx, start, best[node] < rep[ctx], window))])

    return contexts.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(mark, target)


def _cut(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    keep, at = [], 0
    for lo, hi in sorted(spans):
        keep += words[at:lo] if lo > at else []
        at = max(at, hi)
    return keep + words[at:]


def repeated_spans(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scan of all rows, class texts with repeats, repeated spans by class)."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    scan = materialize(_scan(docs, window), "scan")
    classes = scan.where(F.size("prefixes") > 0).groupBy("cls").agg(F.min_by(F.struct("doc_id", "h", "prefixes"), F.struct("doc_id", "h")).alias("x")).select("cls", F.col("x.doc_id").alias("rep"), F.col("x.h").alias("h"), F.col("x.prefixes").alias("prefixes"))
    classes = materialize(classes, "classes")
    listed = classes.select("cls", "rep", "h", F.explode("prefixes").alias("p"))
    branch = listed.groupBy("p").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("p", "n", (F.col("n") > group).alias("heavy"))
    branch = materialize(branch, "branch")
    parts = -(-(branch.where("heavy").agg(F.sum("n")).first()[0] or 1) // group)
    wanted = listed.distinct().join(branch, "p").groupBy("cls", "rep", "h").agg(F.collect_set(F.struct("p", "heavy")).alias("prefixes"))
    wanted = materialize(wanted, "wanted")
    # a class's text is that of the row (rep, h); rows that repeat both are folded before they are shuffled
    names = wanted.select(F.col("rep").alias("doc_id"), "h")
    some = docs.join(F.broadcast(names), ["doc_id", "h"], "left_semi") if names.count() <= NAMED else docs
    texts = some.groupBy("doc_id", "h").agg(F.first("text").alias("text")).withColumnRenamed("doc_id", "rep").join(wanted, ["rep", "h"]).select("rep", "cls", "text", "prefixes")
    texts = materialize(texts, "texts")
    contexts = materialize(_contexts(texts, window, parts), "contexts")
    spans = _light_repeats(contexts.where("part IS NULL"), window).unionByName(_heavy_repeats(contexts.where("part IS NOT NULL"), window))
    spans = spans.groupBy("cls").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    return scan, texts, spans


def substring_dedup(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``.

    Words are separated by ASCII white space. A word goes if a window of ``window``
    consecutive words that covers it also starts in a document with a smaller
    doc_id; windows are judged on the input. Null and blank texts have no words.
    A null doc_id counts as larger than all others; rows that share a doc_id don't
    remove from each other. Texts under ``window`` words lose nothing. Other
    columns are not read.
    """
    scan, texts, spans = repeated_spans(docs, window, group)

    def cut(c):
        out = {"cls": c["cls"], "removed": [], "kept": []}
        for text, found in zip(c["text"], c["spans"], strict=True):
            words = (text or b"").split()
            keep = _cut(words, [(x["lo"], x["hi"]) for x in found])
            out["removed"].append(len(words) - len(keep))
            out["kept"].append(hashlib.sha256(b" ".join(keep)).hexdigest())
        return out

    own = arrow_map(texts.join(spans, "cls").select("cls", "text", "spans"), cut, "cls binary, removed long, kept string")
    own = own.dropDuplicates(["cls"])
    reps = materialize(scan.groupBy("cls").agg(F.min("doc_id").alias("rep")).join(own, "cls", "left"), "reps")  # written, so that the next join can split a large class
    rows = scan.drop("prefixes", "h").join(reps, "cls")
    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= window)
    return rows.select(
        F.when(F.col("doc_id") < _LAST, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM d WHERE len(ws) >= 50
), g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM win
), least AS (
  SELECT h, min(doc_id) AS m FROM g GROUP BY h
), gone AS (
  SELECT doc_id, list(DISTINCT w) AS ws FROM (SELECT doc_id, unnest(range(i, i + 50)) AS w FROM g JOIN least USING (h) WHERE m < doc_id) GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) d LEFT JOIN (SELECT doc_id, unnest(ws) AS i, true AS x FROM gone) q USING (doc_id, i) WHERE x IS NULL GROUP BY d.doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(len(gone.ws), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
