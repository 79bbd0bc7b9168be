"""1. SimHash near-duplicates, linked through pivot distance tables.

Fingerprints: 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes
(seed 42) of a text's word shingles.

Linking: equal fingerprints form one class first, so copies never meet in pairs.
Each class is dealt to groups whose members agree on some of the fingerprint's
blocks (pigeonhole: of six blocks, at least two hold none of four differing bits).
Within a group, the pivot distance table (Hamming distances to many reference
fingerprints) drops pairs with a coordinate difference over the limit: the group
is ordered by the first pivot's distance, which ends the search for partners, and
the other pivots are looked up for the rest. Survivors are verified. A group gives
the links of a spanning forest, not all its pairs. Groups over ``GROUP`` classes
are dealt anew by blocks of their other bits until none is left, which ends, as
every level fixes more bits.
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, arrow_rows, materialize, table
from .components import components

BITS, SHINGLE, SEED = 64, 4, 42
#: Differing bits that still link.
MAX_DISTANCE = 4
#: Reference fingerprints of the distance table.
PIVOTS = 32
#: Classes that one group may hold in a task's memory.
GROUP = 16384
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text (UTF-8); null, empty and blank texts give zero."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, n)
    total, counts = n - k + 1, np.zeros(BITS, np.int64)
    for lo in range(0, total, _CHUNK):
        hi = min(total, lo + _CHUNK)
        digests = b"".join([xxhash.xxh64_digest(joined[s:e], SEED) for s, e in zip(starts[lo:hi].tolist(), ends[lo + k - 1 : hi + k - 1].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row, ids and texts may be null or repeated."""

    def run(c):
        return {"doc_id": c["doc_id"], "fp": [_signed(fingerprint(t, shingle)) for t in c["text"]]}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), run, "doc_id long, fp long")


def _pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**63, n, dtype=np.int64).view(np.uint64) * np.uint64(2) + (np.arange(n) % 2).astype(np.uint64)


def _blocks(bits: list[int], parts: int) -> list[int]:
    cut = np.array_split(np.array(bits), parts)
    return [sum(1 << int(b) for b in c) for c in cut]


def _masks(fixed: int, distance: int) -> list[int]:
    """Bit masks such that words that agree on ``fixed`` and differ in at most ``distance`` of the other bits agree on one."""
    free = [b for b in range(BITS) if not fixed >> b & 1]
    parts = min(distance + 2, len(free))
    if parts <= distance:  # few bits left: no further cut can be promised
        return []
    blocks = _blocks(free, parts)
    return [fixed | sum(c) for c in itertools.combinations(blocks, parts - distance)]


def _hook(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j; labels stay the smallest index."""
    while len(i):
        a, b = lab[i], lab[j]
        ne = a != b
        if not ne.any():
            return
        i, j, a, b = i[ne], j[ne], a[ne], b[ne]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab[:] = up


def link_batch(group: np.ndarray, fp: np.ndarray, distance: int = MAX_DISTANCE, pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of equal ``group``, as signed longs: of each group a spanning forest, in stars on the least ones."""
    refs = _pivots(pivots)
    order = np.lexsort((np.bitwise_count(fp ^ refs[0]), group))
    group, fp = group[order], fp[order]
    dist = np.stack([np.bitwise_count(fp ^ r).astype(np.int8) for r in refs], axis=1)
    n = len(fp)
    lab, at, step = np.arange(n), np.arange(n), 1
    while True:
        at = at[at + step < n]
        at = at[(group[at] == group[at + step]) & (dist[at + step, 0] - dist[at, 0] <= distance)]
        if not len(at):
            break
        i = at[lab[at] != lab[at + step]]
        for lo in range(1, pivots, 8):
            i = i[(np.abs(dist[i, lo : lo + 8] - dist[i + step, lo : lo + 8]) <= distance).all(axis=1)]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
        _hook(lab, i, i + step)
        step += 1
    near = fp.view(np.int64)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, lab, near)
    far = near != least[lab]
    return least[lab[far]], near[far]


def _deal(fps: DataFrame, fixed: int | None, distance: int) -> DataFrame:
    masks = F.array(*[F.lit(_signed(m)) for m in _masks(fixed or 0, distance)])
    return fps.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _link_groups(dealt: DataFrame, distance: int) -> DataFrame:
    target, pack = arrow_rows("a long, b long")

    def run(batches):
        held: list[np.ndarray] = []

        def flush(x):
            change = np.concatenate(([True], (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])))
            a, b = link_batch(np.cumsum(change), x[:, 2].copy().view(np.uint64), distance)
            return pack({"a": a, "b": b})

        for b in batches:
            if b.num_rows:
                held.append(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1))
            if sum(map(len, held)) < 2 * GROUP:
                continue
            x = np.concatenate(held)
            whole = len(x) - int(((x[:, 0] == x[-1, 0]) & (x[:, 1] == x[-1, 1])).sum())  # the last group may go on
            if whole:
                yield flush(x[:whole])
            held = [x[whole:]]
        if held:
            yield flush(np.concatenate(held))

    return dealt.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(run, target)


def links(fps: DataFrame, distance: int = MAX_DISTANCE, group: int = GROUP) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fps`` (distinct, column fp) within ``distance`` bits."""
    found, level = None, _deal(fps, None, distance)
    while True:
        sizes = level.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("mask", "key")
        hot = materialize(sizes, "hot-groups")
        over = [r[0] for r in hot.select("mask").distinct().collect()]  # bounded: masks come from a fixed cut
        over = [m for m in over if _masks(m % (1 << BITS), distance)]
        hot = hot.where(F.col("mask").isin(over)) if over else None
        part = _link_groups(level if hot is None else level.join(hot, ["mask", "key"], "left_anti"), distance)
        found = part if found is None else found.unionByName(part)
        if hot is None:
            return found
        deeper = level.join(hot, ["mask", "key"], "left_semi")
        cuts = [(m, _signed(s)) for m in over for s in _masks(m % (1 << BITS), distance)]  # at most 15 ** level rows
        cuts = fps.sparkSession.createDataFrame(cuts, "mask long, sub long")
        level = deeper.join(F.broadcast(cuts), "mask").select(F.col("sub").alias("mask"), F.col("fp").bitwiseAND(F.col("sub")).alias("key"), "fp")
        level = materialize(level.distinct(), "dealt-anew")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = MAX_DISTANCE, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: (doc_id, fingerprint hex, component_id, class_size).

    component_id is the smallest doc_id reachable over links of at most
    ``distance`` differing bits; texts without words have fingerprint zero and are
    linked like any other. Null texts count as empty. Rows with a null doc_id take
    part in linking but never name a component, unless no row of it has an id.
    Other columns of ``docs`` are not read.
    """
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size")), "classes")
    comp = components(links(classes.select("fp"), distance, group)).withColumnRenamed("node", "fp")
    labelled = classes.join(comp, "fp", "left").select("fp", "rep", "class_size", F.coalesce("component", "fp").alias("component"))
    labelled = materialize(labelled, "labelled")
    named = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = labelled.join(named, "component").select("fp", "class_size", "component_id")
    return fps.join(of, "fp").select("doc_id", hex64("fp").alias("fingerprint"), "component_id", "class_size")


def hex64(x: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(x)), 16, "0"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
