"""3. Conflict-constrained best-fit packing.

Documents fill bins of ``CAPACITY`` tokens. Open bins are ordered by residual
capacity and carry two bitmaps: the sources and the duplicate clusters they hold.
A document goes to the tightest bin that fits and has neither its source nor its
cluster; the successor search walks up the residuals until it finds one. Every
range of residuals keeps the intersection of its bins' source bitmaps, so ranges in
which each bin has the source are passed over at once.

Texts over the capacity give full bins of their own and a remainder that is packed.
Rows are sized and numbered, and dealt by a hash of that number to shards of bounded
size, each packed on its own, longest first: shards are a documented parameter, no
bin crosses them, and a source, an id or a missing one that a third of all rows have
is spread over all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, arrow_rows, ascii_lower, materialize, table

CAPACITY = 2048
#: Bytes of words that count as one token at least, so that a text without white space isn't one token.
TOKEN_BYTES = 16
#: Documents of a shard, on average.
SHARD = 8192


class Bins:
    """Open bins by residual; add() places one piece and returns (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.half = 1 << capacity.bit_length()
        self.all = -1  # every bit set: no bin here
        self.tree = [self.all] * (2 * self.half)
        self.level: dict[int, dict[int, list[int]]] = {}  # residual -> source bitmap -> bins, oldest first
        self.clusters: list[int] = []
        self.bits: dict[str, dict[object, int]] = {"source": {}, "cluster": {}}

    def bit(self, kind: str, name) -> int:
        if name is None:  # an unknown source or cluster conflicts with nothing
            return 0
        known = self.bits[kind]
        return known.setdefault(name, 1 << len(known))

    def _refresh(self, residual: int) -> None:
        i, both = self.half + residual, self.all
        for bitmap in self.level.get(residual, ()):
            both &= bitmap
        self.tree[i] = both
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] & self.tree[2 * i + 1]

    def _levels(self, least: int, source: int) -> Iterator[int]:
        """Residuals from ``least`` on, ascending, with a bin that lacks ``source``."""
        todo = [(1, 0, self.half)]
        while todo:
            node, lo, n = todo.pop()
            both = self.tree[node]
            if lo + n <= least or both == self.all or source and both & source:
                continue
            if n == 1:
                yield lo
            else:
                todo += [(2 * node + 1, lo + n // 2, n // 2), (2 * node, lo, n // 2)]

    def _find(self, size: int, source: int, cluster: int) -> tuple[int, int, int] | None:
        for residual in self._levels(size, source):
            fits = (b for bitmap, ids in self.level[residual].items() if not bitmap & source for b in ids if not self.clusters[b] & cluster)
            if (best := min(fits, default=None)) is not None:
                return residual, next(m for m, ids in self.level[residual].items() if best in ids), best
        return None

    def add(self, size: int, source, cluster) -> tuple[int, int]:
        s, c = self.bit("source", source), self.bit("cluster", cluster)
        if found := self._find(size, s, c):
            residual, bitmap, b = found
            self.level[residual][bitmap].remove(b)
            if not self.level[residual][bitmap]:
                del self.level[residual][bitmap]
            self._refresh(residual)
        else:
            residual, bitmap, b = self.capacity, 0, len(self.clusters)
            self.clusters.append(0)
        self.clusters[b] |= c
        self.level.setdefault(residual - size, {}).setdefault(bitmap | s, []).append(b)
        self._refresh(residual - size)
        return b, self.capacity - residual


def pack_shard(docs: Iterable[tuple], capacity: int = CAPACITY) -> list[tuple]:
    """docs: (key, n_tokens, source, cluster). Returns (key, piece, n, bin, offset) of every piece."""
    out, rest, full = [], [], 0
    for key, n, source, cluster in docs:
        pieces = max(1, -(-n // capacity))
        for k in range(pieces - 1):
            out.append((key, k, capacity, full, 0))
            full += 1
        rest.append((n - capacity * (pieces - 1), key, pieces - 1, source, cluster))
    counts: dict = {}
    for r in rest:
        counts[r[4]] = counts.get(r[4], 0) + 1
    bins = Bins(capacity)
    for n, key, k, source, cluster in sorted(rest, key=lambda r: (-r[0], r[1])):
        b, at = bins.add(n, source, cluster if counts[cluster] > 1 else None)
        out.append((key, k, n, full + b, at))
    return out


def tokens(text: bytes | None) -> int:
    """Words between ASCII white space, or one for each TOKEN_BYTES bytes of them begun, if that is more."""
    words = (text or b"").split()
    return max(len(words), -(-sum(map(len, words)) // TOKEN_BYTES))


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(bin_id, slot, doc_id, piece, start_token, n_tokens, bin_offset, source), one row per piece of each document.

    Tokens are those of tokens(). A duplicate cluster is a set of texts equal after
    lower-casing A-Z. A bin holds at most one document of a known source and one of
    a cluster; pieces of one document are never in one bin. Null and blank texts
    have no tokens and are still placed; a null source or text conflicts with
    nothing. Repeated and null doc_ids are packed row by row. Other columns are not
    read. An empty table gives no rows.
    """

    def count(c):
        return {"at": c["at"], "doc_id": c["doc_id"], "source": c["source"], "cluster": c["cluster"], "n": [tokens(t) for t in c["text"]]}

    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(ascii_lower(F.col("text"))).alias("h"), F.col("text").cast("binary").alias("text"))
    rows = rows.select("at", "doc_id", "source", F.when(F.length("text") > 0, F.col("h")).alias("cluster"), "text")
    sized = materialize(arrow_map(rows, count, "at long, doc_id long, source string, cluster long, n long"), "sized")  # written, so that a row keeps its number
    shards = max(1, -(-sized.count() // shard))
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("at", F.lit(3)), F.lit(shards)).cast("int"))
    target, make = arrow_rows("bin_id string, slot int, doc_id long, piece int, start_token long, n_tokens int, bin_offset int, source string")

    def one(name: int, t: pa.Table) -> pa.RecordBatch:
        rows = sorted(zip(*(t[c].to_pylist() for c in ("doc_id", "n", "source", "cluster")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or 0))
        placed = sorted(((b, at, i, k, n) for i, k, n, b, at in pack_shard([(i, *r[1:]) for i, r in enumerate(rows)], capacity)))
        cols: dict[str, list] = {f.name: [] for f in target}
        slot, before = 0, None
        for b, at, i, k, n in placed:
            slot, before = (slot + 1 if b == before else 0), b
            for c, v in zip(cols, (f"{name:06d}-{b:06d}", slot, rows[i][0], k, k * capacity, n, at, rows[i][2]), strict=True):
                cols[c].append(v)
        return make(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                name, ids = b["shard"][0].as_py(), b["shard"].to_numpy()
                n = int((ids == name).sum())  # sorted: one shard after the other
                if held and held[0]["shard"][0].as_py() != name:
                    yield one(held[0]["shard"][0].as_py(), pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(0, n))
                b = b.slice(n)
        if held:
            yield one(held[0]["shard"][0].as_py(), pa.Table.from_batches(held))

    spark = docs.sparkSession
    tasks = max(1, min(shards, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard").mapInArrow(run, target)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
