"""4. Benchmark decontamination by winnowing, in DataFrame operations only.

Every window of ``WINDOW`` words is represented by the least of its ``GRAM``-gram
hashes; neighbouring windows mostly share it, so a document has far fewer distinct
fingerprints than windows. Equal windows have equal least hashes, so no shared
window can be missed.

Documents are read once and their words never leave their task: the benchmark's
fingerprints are marked in a table of slots, which is bounded whatever the
benchmark's size and goes along with the plan. Only windows whose fingerprint's slot
is marked are kept, with their words. These few are joined with the benchmark's
windows by fingerprint and words, which leaves out chance hits, and are extended to
the words they cover. More benchmark fingerprints than slots would only let more
chance hits get as far as that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, table

WINDOW, GRAM = 8, 5
#: Slots of a table of marks, a byte each: so many a benchmark fingerprint, between these bounds.
PER_PRINT, SLOTS = 64, (1 << 15, 1 << 22)
#: Items that occur in a document from which on it is contaminated.
ITEMS = 2

_OTHER = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    """Words of digits, letters and characters beyond ASCII, A-Z lower-cased; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + _OTHER, LOWER + " " * len(_OTHER))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _slide(a: Column, b: Column, shift: int, f) -> Column:
    """f(a[i], b[i + shift]) for every i that has both."""
    n = F.least(F.size(a), F.size(b) - shift)
    tail = F.when(n > 0, F.slice(b, shift + 1, n)).otherwise(F.slice(b, 1, 0))
    head = F.when(n > 0, F.slice(a, 1, n)).otherwise(F.slice(a, 1, 0))
    return F.zip_with(head, tail, f)


def prints(ws: Column, window: int = WINDOW) -> Column:
    """The least gram hash of every window of ``window`` words, in order."""
    gram = min(GRAM, window)
    hashed = F.transform(ws, lambda w: F.xxhash64(w))

    def grow(have: int, h: Column, one: Column) -> Column:  # hashes of have words -> of gram words
        if have == gram:
            return least(1, h)
        step = min(have, gram - have)
        other = h if step == have else one
        if step not in (have, 1):
            step, other = 1, one
        return _let(_slide(h, other, have, lambda x, y: F.xxhash64(x, y)), lambda g: grow(have + step, g, one))

    def least(have: int, g: Column) -> Column:  # least of have grams -> of all grams of a window
        need = window - gram + 1
        if have == need:
            return g
        step = min(have, need - have)
        return _let(_slide(g, g, step, lambda x, y: F.least(x, y)), lambda m: least(have + step, m))

    return _let(hashed, lambda one: grow(1, one, one))


def _bench_windows(items: DataFrame, window: int, exact: bool) -> DataFrame:
    """Distinct windows: (fp, content, item_ids). exact: only items of just ``window`` words."""
    of = items.where(F.size("ws") == window if exact else F.size("ws") >= window)
    at = of.select("item_id", "ws", F.posexplode(prints(F.col("ws"), window)).alias("i", "fp"))
    at = at.select("fp", "item_id", F.slice("ws", F.col("i") + 1, window).alias("content"))
    return at.groupBy("fp", "content").agg(F.collect_set("item_id").alias("item_ids"))


def _marks(bench: DataFrame) -> tuple[Column, int]:
    """The table of slots as a literal: byte 1 where a fingerprint falls. The driver gets it as bitmaps of 32,768 slots."""
    n = bench.select("fp").distinct().count()
    slots = min(max(SLOTS[0], 1 << (PER_PRINT * max(n, 1)).bit_length()), SLOTS[1])
    slot = F.pmod("fp", F.lit(slots)) + 1  # bit positions count from 1
    maps = bench.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    table = bytearray(slots)
    for k, bits in maps.collect():  # at most SLOTS / 32,768 rows
        for byte, x in enumerate(bits):
            for j in range(8) if x else ():
                if x >> j & 1:
                    table[(k - 1) * 32768 + 8 * byte + j] = 1
    return F.lit(bytes(table)), slots


def _candidates(ws: Column, marks: Column, slots: int, window: int) -> Column:
    """Of each window whose fingerprint is marked: fp, start, len and its words."""
    marked = lambda fp: F.substring(marks, F.pmod(fp, F.lit(slots)) + 1, 1) == F.lit(b"\x01")
    at = lambda p: F.filter(F.transform(p, lambda fp, i: F.when(marked(fp), F.struct(fp.alias("fp"), i.alias("start")))), lambda x: x.isNotNull())
    with_words = lambda x: F.struct(x["fp"].alias("fp"), x["start"].alias("start"), F.lit(window).alias("len"), F.slice(ws, x["start"] + 1, window).alias("content"))
    return F.transform(_let(prints(ws, window), at), with_words)


def contamination(docs: DataFrame, benchmark: DataFrame, by_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A window is ``WINDOW`` consecutive words of a benchmark item, or the whole item
    if it has fewer, but not none. A document's word inside any occurrence of a
    window is hit; n_items counts the items with occurring windows. Null texts have
    no words; rows with a null or repeated doc_id are judged row by row; a null
    item_id is no item. An empty benchmark hits nothing. Other columns are not read.
    ``by_text`` adds text_hash, xxhash64(text), and leaked: contaminated, or a window
    of ``WINDOW`` words occurs.
    """
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id"), words(F.col("text")).alias("ws"))
    lengths = [r[0] for r in items.where(F.size("ws").between(1, WINDOW - 1)).select(F.size("ws").alias("n")).distinct().collect()]  # at most WINDOW - 1
    key = F.struct("doc_id", F.xxhash64("text").alias("t")).alias("key")
    bench, near = None, []
    for window, exact in [(WINDOW, False), *((n, True) for n in sorted(lengths))]:
        of = materialize(_bench_windows(items, window, exact), "bench-windows")
        if of.isEmpty():
            continue
        near.append(_candidates(F.col("ws"), *_marks(of), window))
        bench = of if bench is None else bench.unionByName(of)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(key, words(F.col("text")).alias("ws"))
    none = F.array().cast("array<struct<fp: bigint, start: int, len: int, content: array<string>>>")
    rows = materialize(rows.select("key", F.size("ws").cast("long").alias("n_words"), (F.concat(*near) if near else none).alias("near")), "windows")

    zero, empty = F.lit(0).cast("long"), F.sha2(F.lit(""), 256)
    named = ["key.doc_id", *([F.col("key.t").alias("text_hash")] if by_text else [])]
    cols = [*named, "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_items") >= ITEMS).alias("contaminated")]
    cols += [((F.col("n_items") >= ITEMS) | (F.col("longest") >= WINDOW)).alias("leaked")] if by_text else []
    if bench is None:
        return rows.withColumns({"n_hit": zero, "n_items": zero, "items_sha256": empty, "longest": F.lit(0)}).select(*cols)
    # of rows with one key, that is of one id and text, one stands for all
    some = rows.where(F.size("near") > 0).groupBy("key").agg(F.first("near").alias("near")).select("key", F.explode("near").alias("w")).select("key", "w.*")
    found = materialize(some.join(bench, ["fp", "content"]).select("key", "start", "len", "item_ids"), "occurrences")
    # a document's hit words and items: both bounded by its own length and by what it contains
    spots = found.select("key", "len", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("w")).groupBy("key", "w").agg(F.max("len").alias("len"))
    spots = spots.groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"), F.max("len").alias("longest"))
    ids = found.select("key", F.explode("item_ids").alias("item_id")).distinct().groupBy("key")
    ids = ids.agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("items_sha256"))
    hits = materialize(spots.join(ids, "key"), "hits")
    out = rows.select("key", "n_words").join(hits, "key", "left")
    return out.withColumns({"n_hit": F.coalesce("n_hit", zero), "n_items": F.coalesce("n_items", zero), "items_sha256": F.coalesce("items_sha256", empty), "longest": F.coalesce("longest", F.lit(0))}).select(*cols)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT item_id, least(8, len(ws)) AS k, unnest(list_transform(range(1, greatest(len(ws) - 8, 0) + 2), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g
  FROM b WHERE len(ws) > 0
), ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS i, ws FROM d, ks WHERE len(ws) >= k
), dg AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM dw
), hit AS (
  SELECT DISTINCT doc_id, dg.k, i, item_id FROM dg JOIN bw USING (k, g)
), spots AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS w FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""
