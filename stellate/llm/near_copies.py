"""1, wider. Near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The method is that of simhash.py: SimHash fingerprints, groups that agree on some of
their bits, pivot distance tables within groups, verified links, components by
stars. What differs is the width. At 0.8 two texts differ in 15 % of their bits
(angle of the sets, 0.8889 its cosine), so 64 bits and blocks that are sure to agree
won't do: a fingerprint has ``WIDTH`` bits, of which ``TABLES`` times ``CUT`` are drawn;
texts that agree on one such draw share a group. A pair at 0.8 shares none with
probability 4e-5. A set of four shingles within one of five is the one case in which
more bits differ (19 %); such pairs are joined exactly, by the subsets of four.

In a group, every member has its distances, over the first ``SHORT`` bits, to
``PIVOTS`` members: pairs with a coordinate difference over ``NEAR`` are dropped by the
triangle inequality, and of the rest those over ``NEAR`` bits (1e-6 at 0.8). Then all
bits are compared (``FAR``; 2e-5 at 0.8). Those leave pairs down to 0.65 or so, of which
a large group of near copies has as many as its square; a parity sketch drops most of
them in the group, and never a link: shingles that both texts hold cancel out, so two
sketches differ in at most as many bits as there are shingles that one text lacks. What
is left is verified on the exact shingle sets.

Every candidate pair that could join two components is verified. First, each member of
a group meets one leader, the weightiest near it, and of all its leaders the ``SOONER``
weightiest are verified. Then members outside a group's largest component meet all
members of other components, each pair in the first group that both share. No pair
that matters is left out; what is compared within a group still grows with its square,
what leaves it does so only by pairs near 0.8 or, over some 1,300 shingles, where the
sketch is full, near 0.7.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, arrow_rows, drop_materialized, materialize, slices
from .components import components

SHINGLE = 5
#: Least similarity that links, as a fraction.
SIMILARITY = (4, 5)
#: Bits of a fingerprint; groups that a text is in; bits that the members of one agree on.
WIDTH, TABLES, CUT = 1024, 96, 13
#: Bits that are compared within groups; differing ones that may still link, of these (5.1 deviations over the mean at 0.8) and of all (4.2).
SHORT, NEAR, FAR = 128, 40, 203
#: Differing bits, of the first ones, up to which a leader covers a row (1.6 deviations over the mean at 0.8); this decides which pairs come first, not which come.
COVER = 26
#: Members of a group that its distance table refers to.
PIVOTS = 4
#: Rows of groups that a task holds at once, unless one group has more; pairs that it returns at once.
GROUP, PAIRS = 1 << 15, 1 << 18
_CHUNK = 8192
#: Bits of a parity sketch.
PARITY = 1024
#: Pairs of a text, with the weightiest of its leaders, that are verified first; this decides which pairs come first, not which come.
SOONER = 8
#: Texts whose hashes may be broadcast to fetch them; more are fetched by a shuffled join.
NAMED = 500_000
#: Tables whose groups are counted to find the middle of a group of near copies.
WEIGHED = 12
#: Sets under so many shingles are linked to equal ones only, as 3 of 4 is under 0.8.
LEAST = 4
_RNG = np.random.default_rng(11)
_MIX, _AGAIN = (_RNG.integers(0, 2**63, WIDTH // 64, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_DRAWN = np.stack([_RNG.choice(WIDTH, CUT, replace=False) for _ in range(TABLES)])
_ODD = _RNG.integers(0, 2**63, SHINGLE + 1, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = [f"w{i}" for i in range(WIDTH // 64)]
_PARITIES = [f"p{i}" for i in range(PARITY // 64)]
_NODE = f"node binary, n int, subsets array<binary>, fp struct<{', '.join(f'{w}: long' for w in _WORDS)}>, parity struct<{', '.join(f'{w}: long' for w in _PARITIES)}>"


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles (64-bit hashes over XXH64 of words lower-cased A-Z, parted by ASCII white space), sorted; a shorter text is one shingle, a blank one none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n, k = len(words), min(shingle, len(words))
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    g = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        g += own[j : j + len(g)] * _ODD[j]
    g ^= g >> np.uint64(29)
    g *= _ODD[-1]
    return np.unique(g ^ g >> np.uint64(32))


def fingerprint(x: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles, as words: a bit is 1 if it is set in over half of them. The empty set gives zeros."""
    counts = np.zeros(WIDTH, np.int64)
    for lo in range(0, len(x), 255):  # counts of a slice fit a byte
        h = x[lo : lo + 255, None] * _MIX
        h ^= h >> np.uint64(32)
        h *= _AGAIN
        h ^= h >> np.uint64(29)
        counts += np.unpackbits(h.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(x)).view(np.int64)


def parity(x: np.ndarray) -> np.ndarray:
    """Parity sketch of a set of shingles, as words: a bit is 1 if an odd number of them falls on it."""
    on = np.bincount((x & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY)
    return np.packbits((on & 1).astype(np.uint8)).view(np.int64)


def group_keys(fp: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """The groups of fingerprints (a row of words each): number of the table, then the bits drawn for it."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1)
    drawn = bits[:, _DRAWN[:tables].ravel()].reshape(len(fp), tables, CUT)
    return (drawn @ (1 << np.arange(CUT))) + (np.arange(tables) << CUT)


def _node(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, n, subsets, fp, parity): equal shingle sets are one node; subsets names those of four of a set of five."""

    def run(c):
        sets = [shingles(t) for t in c["text"]]
        subsets = [[_node(np.delete(x, i)) for i in range(len(x))] if len(x) == LEAST + 1 else [] for x in sets]
        fps = [dict(zip(_WORDS, fingerprint(x).tolist(), strict=True)) for x in sets]
        parities = [dict(zip(_PARITIES, parity(x).tolist(), strict=True)) for x in sets]
        return {"doc_id": c["doc_id"], "text_hash": c["text_hash"], "node": [_node(x) for x in sets], "n": [len(x) for x in sets], "subsets": subsets, "fp": fps, "parity": parities}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return arrow_map(rows, run, f"doc_id long, text_hash long, {_NODE}")


def _sets(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, s): shingle sets of the texts named by hash."""

    def run(c):
        sets = [shingles(t) for t in c["text"]]
        return {"node": [_node(x) for x in sets], "s": [x.view(np.int64) for x in sets]}

    texts = F.broadcast(texts) if texts.count() <= NAMED else texts
    named = docs.select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")).join(texts, "text_hash", "left_semi")
    return arrow_map(named.select("text"), run, "node binary, s array<long>").dropDuplicates(["node"])


def _dealt(nodes: DataFrame, words: list[str], also: list[str], tables: int = TABLES) -> DataFrame:
    """(key, id, words ..., also ...), a row a node and table."""
    target, pack = arrow_rows(", ".join(["key int", *[f"{c} long" for c in ("id", *words, *also)]]))

    def run(batches):
        for b in slices(batches):
            keys = group_keys(np.stack([b[w].to_numpy() for w in _WORDS], axis=1), tables)
            yield pack({"key": keys.ravel().astype(np.int32)} | {c: np.repeat(b[c].to_numpy(), tables) for c in ("id", *words, *also)})

    parities = ["parity.*"] if set(words) & set(_PARITIES) else []
    return nodes.where(F.col("n") >= LEAST).select("id", "fp.*", *parities, *[F.col(c).cast("long").alias(c) for c in also]).mapInArrow(run, target)


def _differ(words: Sequence[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int16) for w in words)


class Groups:
    """Rows of equal ``key`` (sorted) with the first words, or all, of their fingerprints, and the distance table of each group.

    Words are unsigned: of signed ones NumPy counts the bits of the absolute value.
    """

    def __init__(self, key: np.ndarray, words: list[np.ndarray]):
        self.key, self.words, self.short = key, words, words[: SHORT // 64]
        self.new = np.concatenate(([True], key[1:] != key[:-1]))
        self.start, self.of = np.flatnonzero(self.new), np.cumsum(self.new) - 1
        self.size = np.bincount(self.of)
        rows = np.arange(len(key))
        self.table = [_differ(self.short, rows, (self.start + self.size * p // PIVOTS)[self.of]) for p in range(PIVOTS)]

    def near(self, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leader, row, differing bits): other rows near the leaders, one leader a group; the table first, then the bits."""
        many = self.size[self.of[lead]]
        i = np.repeat(lead, many)
        j = np.arange(len(i)) + np.repeat(self.start[self.of[lead]] - np.cumsum(many) + many, many)
        i, j = i[i != j], j[i != j]
        for t in self.table:
            fit = np.abs(t[i] - t[j]) <= NEAR
            i, j = i[fit], j[fit]
        d = _differ(self.short, i, j)
        return i[d <= NEAR], j[d <= NEAR], d[d <= NEAR]

    def stars(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """In the rows' order, each one that no leader before covers becomes a leader, with pairs to the rows that it covers first.

        A leader without any is paired with the nearest row, so whoever is near another row is in a pair.
        """
        free = self.size[self.of] > 1
        while len(at := np.flatnonzero(free)):
            lead = at[np.concatenate(([True], self.of[at][1:] != self.of[at][:-1]))]
            i, j, d = self.near(lead)
            free[lead] = False
            own = free[j] & (d <= COVER)
            order = np.lexsort((d, i))
            nearest = order[np.concatenate(([True], i[order][1:] != i[order][:-1]))] if len(i) else order
            own[nearest[~np.isin(i[nearest], i[own])]] = True
            free[j[own]] = False
            yield i[own], j[own]

    def others(self, component: np.ndarray, n: np.ndarray, parities: Sequence[np.ndarray] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of unlike components (sorted within a group) but those of a group's largest one, by all bits, sizes and parity sketches; each pair in the first table alone that has it."""
        run = np.cumsum(self.new | np.concatenate(([True], component[1:] != component[:-1]))) - 1
        length, of = np.bincount(run), np.zeros(run[-1] + 1, np.int64)
        of[run] = self.of
        order = np.lexsort((length, of))
        main = np.zeros(len(of), bool)
        main[order[np.concatenate((of[order][1:] != of[order][:-1], [True]))]] = True
        main = main[run]
        minor = np.flatnonzero(~main)
        turn = np.arange(len(minor)) - np.searchsorted(self.of[minor], self.of[minor])
        order = np.argsort(turn, kind="stable")
        part, whole = SIMILARITY
        for lead in np.split(minor[order], np.flatnonzero(np.diff(turn[order])) + 1) if len(minor) else []:
            i, j, _ = self.near(lead)
            fit = (component[i] != component[j]) & (main[j] | (i < j)) & (np.minimum(n[i], n[j]) * whole >= np.maximum(n[i], n[j]) * part)
            i, j = i[fit], j[fit]
            fit = _differ(self.words, i, j) <= FAR
            i, j = i[fit], j[fit]
            fit = _differ(parities, i, j) * (part + whole) <= (n[i] + n[j]) * (whole - part)
            i, j = i[fit], j[fit]
            for lo in range(0, len(i), _CHUNK):
                x, y = i[lo : lo + _CHUNK], j[lo : lo + _CHUNK]
                bits = np.unpackbits(np.stack([w[x] ^ w[y] for w in self.words], axis=1).view(np.uint8), axis=1)
                unlike = bits[:, _DRAWN.ravel()].reshape(len(x), TABLES, CUT).any(axis=2)
                once = unlike.argmin(axis=1) == self.key[x] >> CUT
                yield x[once], y[once]


def _linked(dealt: DataFrame, order: Column) -> DataFrame:
    """(a, b), ids of candidates: those of Groups.others() if rows have a component, else of Groups.stars(), where a is the leader, with (weight_a, weight_b)."""
    words, parities = ([c for c in dealt.columns if c in of] for of in (_WORDS, _PARITIES))
    components_known = "component" in dealt.columns
    told = {"id": ("a", "b")} if components_known else {"id": ("a", "b"), "weight": ("weight_a", "weight_b")}
    names = [x for ends in told.values() for x in ends]
    target, pack = arrow_rows(", ".join(f"{x} long" for x in names))

    def pairs(rows: pa.Table):
        c = {n: rows[n].to_numpy() for n in rows.column_names}
        groups = Groups(c["key"], [c[w].view(np.uint64) for w in words])
        held, n = [], 0
        for i, j in groups.others(c["component"], c["n"], [c[w].view(np.uint64) for w in parities]) if components_known else groups.stars():
            held.append([c[x][k] for x in told for k in (i, j)])
            n += len(i)
            if n >= PAIRS:
                yield pack(dict(zip(names, map(np.concatenate, zip(*held)))))
                held, n = [], 0
        if n:
            yield pack(dict(zip(names, map(np.concatenate, zip(*held)))))

    def run(batches):
        held, n, limit = [], 0, GROUP
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n < limit:
                continue
            rows = pa.Table.from_batches(held)
            whole = int(np.searchsorted(rows["key"].to_numpy(), held[-1]["key"][-1].as_py()))  # the last group may go on
            if whole:
                yield from pairs(rows[:whole])
            held, n = rows[whole:].combine_chunks().to_batches(), n - whole
            limit = max(GROUP, 2 * n)
        if n:
            yield from pairs(pa.Table.from_batches(held))

    return dealt.repartition("key").sortWithinPartitions("key", order, "id").mapInArrow(run, target)


def _weighed(nodes: DataFrame) -> DataFrame:
    """nodes with weight: members of their groups in the first tables; the middle of a group of near copies weighs most."""
    filed = _dealt(nodes, [], [], WEIGHED)
    weight = filed.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key"))).groupBy("id").agg(F.sum("m").alias("weight"))
    return nodes.join(weight, "id", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


def _differing(x: str, y: str, words: list[str]) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in words])


def _close(x: str, y: str) -> Column:
    return _differing(x, y, _WORDS) <= FAR


def _parities_fit(x: str, y: str, m: str, n: str) -> Column:
    part, whole = SIMILARITY
    return _differing(x, y, _PARITIES) * (part + whole) <= (F.col(m) + F.col(n)) * (whole - part)


def _sizes_fit(m: str, n: str) -> Column:
    part, whole = SIMILARITY
    return F.least(m, n) * whole >= F.greatest(m, n) * part


def _candidates(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes, whole fingerprints and parity sketches leave a link possible."""
    of = lambda k: nodes.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}{k}") for c in ("n", "fp", "parity")])
    fit = _sizes_fit("na", "nb") & _close("fpa", "fpb") & _parities_fit("paritya", "parityb", "na", "nb")
    return materialize(pairs.join(of("a"), "a").join(of("b"), "b").where(fit).select("a", "b"), "near-candidates")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    named = materialize(ids.join(nodes.select("id", F.col("best.hash").alias("text_hash")), "id").select("text_hash").distinct(), "near-named")
    sets = materialize(_sets(docs, named).join(nodes.select("id", "node"), "node").select("id", "s"), "near-sets")
    part, whole = SIMILARITY
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    out = materialize(both.where(common * (part + whole) >= (F.size("sa") + F.size("sb")) * part).select("a", "b"), "near-links")
    drop_materialized(named, sets)
    return out


def _first_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b, weight): leaders of groups and the members that they cover; a is the weightier of both, with its weight."""
    pairs = _linked(_dealt(_weighed(nodes), _WORDS[: SHORT // 64], ["weight"]), F.desc("weight"))
    x, y = (F.struct(F.col(f"weight_{k}").alias("weight"), F.col(k).alias("id")) for k in "ab")
    pairs = pairs.select(F.greatest(x, y).alias("x"), F.least(x, y).alias("y"))
    return materialize(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.weight").alias("weight")).distinct(), "near-pairs")


def _sooner(met: DataFrame) -> DataFrame:
    """(a, b): the pairs of each b with the SOONER weightiest a; _other_pairs() has those of the others that still matter."""
    turn = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("weight"), F.desc("a")))
    return met.select("a", "b", turn.alias("turn")).where(F.col("turn") <= SOONER).select("a", "b")


def _other_pairs(nodes: DataFrame, met: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): members outside a group's largest component with those of its other ones, but for known pairs. nodes: with component; met: pairs with all ids that are near any."""
    ids = met.select(F.col("a").alias("id")).unionByName(met.select(F.col("b").alias("id"))).distinct()
    rest = _linked(_dealt(nodes.join(ids, "id", "left_semi"), [*_WORDS, *_PARITIES], ["component", "n"]), F.col("component"))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    known = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return materialize(rest.join(known, ["a", "b"], "left_anti"), "near-pairs")


def _subset_links(nodes: DataFrame) -> DataFrame:
    """(a, b): sets of four shingles with those of five that hold them."""
    five = nodes.where(F.col("n") == LEAST + 1).select(F.col("id").alias("b"), F.explode("subsets").alias("node"))
    return five.join(nodes.where(F.col("n") == LEAST).select(F.col("id").alias("a"), "node"), "node").select("a", "b")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return nodes.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, component, kept), one row per row of ``docs``; text_hash is xxhash64(text).

    Components are those of all pairs of similarity SIMILARITY or more. Of each one
    (doc_id, text_hash) is kept: the smallest doc_id, an id before none, then the
    smallest hash. Rows that repeat id and text are judged alike. Null texts count
    as blank; blank texts are copies of each other. An empty table gives no rows.
    Other columns are not read.
    """
    rows = materialize(_sketches(docs), "sketches")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    nodes = rows.groupBy("node").agg(F.min(own).alias("best"), *[F.first(c).alias(c) for c in ("n", "subsets", "fp", "parity")])
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "near-nodes")

    met = _first_pairs(nodes)
    first = _candidates(_sooner(met), nodes)
    near = _verified(first, docs, nodes)
    near = materialize(near.unionByName(_subset_links(nodes)), "near-links")
    rest = _other_pairs(_labelled(nodes, near), met, first)
    more = _verified(rest, docs, nodes)

    labelled = materialize(_labelled(nodes.select("id", "node", "best"), near.unionByName(more)), "near-labelled")
    drop_materialized(nodes, met, first, near, rest, more)
    kept = labelled.groupBy("component").agg(F.min("best").alias("kept"))
    of = labelled.select("node", "component").join(kept, "component")
    return rows.select("doc_id", "text_hash", "node", own.alias("own")).join(of, "node").select("doc_id", "text_hash", "node", "component", (F.col("own") == F.col("kept")).alias("kept"))
