"""7. Token counts as delta-maintained rollups.

A batch is a table of signed changes (inserts, deletes, revised counts), reduced to
additive deltas by source, language and tokenizer version before it is stored. A
batch's deltas are written to a folder of their own and committed under its id by
creating a small marker file that names the folder; of two writers of one id, the
store lets one create it. A batch id that is already there is left alone, so a
repeated or retried commit changes nothing. Totals are the sums of committed deltas;
compact() folds them into a base, which lists the batch ids that it holds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from functools import cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _path, arrow_map, materialize, remove, shared_dir, table

KEYS = ["source", "lang", "tokenizer"]
#: Public vocabulary file and its version name. The file is read on the driver and broadcast (under 1 MB).
VOCABULARY, VERSION = "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_50k@1"
WORDS = "words@1"
#: Longest piece of text that is tokenized at once; cuts are before white space.
PIECE = 1 << 16
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("rollup", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str):
    """The text in pieces cut between a non-space and a space, where the tokenizer's pattern cuts, too."""
    at = 0
    while len(text) - at > PIECE:
        m = re.compile(r"(?<=\S)(?=\s)").search(text, at + PIECE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def count_tokens(text: str | None, vocabulary: bytes) -> int:
    enc = _encoding(vocabulary)
    return sum(len(enc.encode_ordinary(p)) for p in _pieces(text or ""))


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, version: str = VERSION) -> DataFrame:
    """docs with n_words, n_tokens (as they are) and their values for the stripped text; null texts have none."""
    data = docs.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(c):
        v = data.value
        out = {k: c[k] for k in ("doc_id", "source", "lang")}
        n = [count_tokens(t, v) for t in c["text"]]
        bare = [(t or "").strip() for t in c["text"]]
        out["sha"] = [hashlib.sha256((t or "").encode()).digest() for t in c["text"]]
        out |= {"n_words": [len((t or "").split()) for t in c["text"]], "n_tokens": n, "new_tokens": [k if b == (t or "") else count_tokens(b, v) for k, b, t in zip(n, bare, c["text"], strict=True)]}
        return out

    return arrow_map(docs.select("doc_id", "source", "lang", "text"), run, "doc_id long, source string, lang string, sha binary, n_words long, n_tokens long, new_tokens long")


class Rollup:
    """Additive totals under ``path``. Changes have the columns KEYS, docs and tokens (signed).

    One process may compact at a time; commits and totals() may go on meanwhile, as
    folded batches are deleted one compaction later.
    """

    SUMS = "source string, lang string, tokenizer string, docs long, tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, prefix: str) -> list[str]:
        fs, p = _path(self.spark, self.path)
        return sorted(n[len(prefix) :] for x in (fs.listStatus(p) if fs.exists(p) else ()) if (n := x.getPath().getName()).startswith(prefix))

    def _read(self, name: str) -> str:
        fs, p = _path(self.spark, f"{self.path}/{name}")
        f = fs.open(p)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode()
        finally:
            f.close()

    def _create(self, name: str, text: str) -> bool:
        """False if the file is there already."""
        fs, p = _path(self.spark, f"{self.path}/{name}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _base(self) -> str | None:
        """The newest base that was completed."""
        done = self._names("base-")
        return done[-1] if done else None

    def _folded(self, base: str | None) -> DataFrame:
        ids = self.spark.createDataFrame([], "batch string")
        return ids if base is None else self.spark.read.schema("batch string").parquet(f"{self.path}/folded-{base}")

    def committed(self, batch: str) -> bool:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        fs, p = _path(self.spark, f"{self.path}/batch-{batch}")
        return fs.exists(p) or not self._folded(self._base()).where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch; False if it was there already, which changes nothing."""
        if self.committed(batch):
            return False
        deltas = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        data = f"data-{uuid.uuid4().hex}"
        deltas.write.parquet(f"{self.path}/{data}")
        if self._create(f"batch-{batch}", data):
            return True
        remove(self.spark, f"{self.path}/{data}")  # another writer was first
        return False

    def _open(self, base: str | None) -> list[str]:
        """Committed batches that the base doesn't hold."""
        held = {r.batch for r in self._folded(base).where(F.col("batch").isin(names)).collect()} if (names := self._names("batch-")) else set()
        return [n for n in names if n not in held]

    def _deltas(self, base: str | None, batches: list[str]) -> DataFrame:
        paths = [f"{self.path}/{self._read(f'batch-{b}')}" for b in batches] + ([f"{self.path}/sums-{base}"] if base else [])
        return self.spark.read.schema(self.SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], self.SUMS)

    def _sums(self, base: str | None, batches: list[str]) -> DataFrame:
        return self._deltas(base, batches).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens); groups that have come to nothing are left out."""
        base = self._base()
        return self._sums(base, self._open(base))

    def compact(self) -> int:
        """Folds the committed batches into a new base and returns their number; a batch id stays known.

        The base counts from the moment its marker is there, so a crash before
        leaves things as they were. Batches that an earlier base holds are deleted.
        """
        base, every = self._base(), self._names("batch-")
        new = self._open(base)
        name = f"{int(base or 0) + 1:08d}"
        for old in ("sums", "folded"):
            remove(self.spark, f"{self.path}/{old}-{name}")  # of a compaction that broke off
        self._sums(base, new).write.parquet(f"{self.path}/sums-{name}")
        ids = self.spark.createDataFrame([(n,) for n in new], "batch string")
        self._folded(base).unionByName(ids).write.parquet(f"{self.path}/folded-{name}")
        self._create(f"base-{name}", name)
        for n in set(every) - set(new):
            remove(self.spark, f"{self.path}/{self._read(f'batch-{n}')}")
            remove(self.spark, f"{self.path}/batch-{n}")
        return len(new)


def inserts(rows: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("docs"), F.col(tokens).alias("tokens"))


def deletes(rows: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    return inserts(rows, tokenizer, tokens).withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})


def revisions(rows: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("docs"), (F.col(new) - F.col(old)).alias("tokens"))


def maintained(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, version: str = VERSION) -> DataFrame:
    """Totals (source, lang, tokenizer, docs, tokens) after four batches over all of ``docs``.

    "load" inserts every row; "copies" deletes rows whose text another row with a
    smaller doc_id has; "strip" revises the rest to their counts without white space
    around the text; then "load" comes again and changes nothing. Null texts count
    as empty and null sources and languages are groups of their own. Rows that share
    the smallest doc_id of a text all stay.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    c = counted(rows, vocabulary, version)
    c = materialize(c, "counts")
    first = materialize(c.groupBy("sha").agg(F.min("doc_id").alias("first")), "firsts")  # written, so that the join can split a text with many copies
    c = materialize(c.join(first, "sha").withColumn("copy", ~F.col("doc_id").eqNullSafe(F.col("first"))).drop("first", "sha"), "marked")
    roll = Rollup(spark, path or shared_dir(spark, "rollup"))
    both = lambda f, of: f(of, version, "n_tokens").unionByName(f(of, WORDS, "n_words"))
    roll.commit("load", both(inserts, c))
    roll.commit("copies", both(deletes, c.where("copy")))
    roll.commit("strip", revisions(c.where("NOT copy"), version, "n_tokens", "new_tokens"))
    roll.commit("load", both(inserts, c))
    return roll.totals()


def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintained(table(spark, sf_dir, "documents"))
