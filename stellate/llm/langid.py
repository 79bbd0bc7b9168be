"""5. Language identification by Bayesian evidence fusion.

The log posterior of a language is the sum of
  - the text's log likelihood under byte-trigram models, tempered by ``TEMPER`` per
    trigram and bounded, as neighbouring trigrams are far from independent,
  - the declared markup language's, the host suffix's and the address path's log
    likelihood (a known share of declarations is wrong),
  - a host prior, smoothed towards its registered domain's, and that towards the
    whole table's; counts are soft, by grouped aggregation over all rows, and a
    row's own share is taken out of its prior.

Evidence that is missing (null address, no markup) contributes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, table

#: Rows with a known language that the models are fitted on at most.
SAMPLE = 3000
#: Hosts and domains up to which number their counts are broadcast.
HOSTS = 200_000
BUCKETS = 1 << 14
TEMPER, BOUND = 0.02, 40.0
#: Share of wrong declarations; weights of the parent's prior, in rows.
WRONG = {"markup": 0.1, "suffix": 0.2, "path": 0.1}
KAPPA = 5.0
SUFFIXES = {"fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}
_STEP = 1 << 18


def _codes(b: bytes):
    """Trigram buckets of a whole text, in blocks; white space counts as one space, A-Z lower-cased."""
    x = b" ".join(b.lower().split())
    for lo in range(0, max(len(x) - 2, 0), _STEP):
        a = np.frombuffer(x[lo : lo + _STEP + 2], np.uint8).astype(np.uint32)
        h = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
        yield (h * np.uint32(2654435761)) >> np.uint32(18)


_OPEN = re.compile(r"<(?:(script|style)\b|!--)", re.I)
_CLOSE = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style")}
_HTML = re.compile(r"<html(?=\s)", re.I)
_LANG = re.compile(r"\slang\s*=\s*[\"']?([A-Za-z]{2})", re.I)


def _blocks(t: str) -> Iterator[tuple[int, int]]:
    """Scripts, styles and comments that are closed. What isn't closed once isn't closed later either, so the scan is linear."""
    at, dead = 0, set()
    while m := _OPEN.search(t, at):
        kind, at = (m[1] or "").lower(), m.end()
        if kind in dead:
            continue
        if kind:
            start = t.find(">", m.end())
            close = _CLOSE[kind].search(t, start + 1) if start >= 0 else None
            end = close.end() if close else -1
        else:
            found = t.find("-->", m.end())
            end = found + 3 if found >= 0 else -1
        if end < 0:
            dead.add(kind)
        else:
            yield m.start(), end
            at = end


def visible(html: str | None) -> str:
    """Text of a page without scripts, styles, comments and tags, each of which leaves a space."""
    t, out, at = html or "", [], 0
    for lo, hi in _blocks(t):
        out.append(t[at:lo])
        at = hi
    t, out, at = " ".join([*out, t[at:]]), [], 0
    while (lo := t.find("<", at)) >= 0 and (hi := t.find(">", lo)) >= 0:
        out.append(t[at:lo])
        at = hi + 1
    return " ".join([*out, t[at:]])


def declared_language(html: str | None) -> str | None:
    """Of the first html tag with a language, anywhere in the page; an unclosed tag ends at the next one or the page's end."""
    t = html or ""
    starts = [m.start() for m in _HTML.finditer(t)]
    for lo, until in zip(starts, [*starts[1:], len(t)]):
        end = t.find(">", lo, until)
        if m := _LANG.search(t, lo, until if end < 0 else end):
            return m[1].lower()
    return None


class TextModel:
    def __init__(self, rows: Iterable[tuple[str, str]]):
        """rows: (text, language), read once."""
        counts: dict[str, np.ndarray] = {}
        for text, lang in rows:
            own = counts.setdefault(lang, np.zeros(BUCKETS))
            for c in _codes(text.encode()):
                own += np.bincount(c, minlength=BUCKETS)
        self.langs = sorted(counts)
        n = np.stack([counts[x] for x in self.langs]) + 0.5 if counts else np.ones((1, BUCKETS))
        self.logp = np.log(n / n.sum(1, keepdims=True)).astype(np.float32)

    def loglik(self, text: str | None) -> list[float]:
        """Tempered and bounded, the best language at zero; zeros for no text."""
        s = np.zeros(len(self.langs))
        for c in _codes((text or "").encode()):
            s += self.logp @ np.bincount(c, minlength=BUCKETS) if len(c) > BUCKETS else self.logp[:, c].sum(1, dtype=np.float64)
        s = TEMPER * s
        return np.maximum(s - s.max(initial=-np.inf), -BOUND).tolist() if len(s) else []


def train(docs: DataFrame, sample: int = SAMPLE) -> TextModel:
    """On at most ``sample`` different rows with a language, smallest by a hash of doc_id; rows with crc32(doc_id) mod 5 = 0 are held out."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("h"), "text")
    ids = known.select("doc_id", "lang", "h").distinct().orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id", "lang", "h").limit(sample)
    rows = known.join(F.broadcast(ids), ["doc_id", "lang", "h"], "left_semi").distinct()  # at most `sample` rows
    return TextModel((r.text, r.lang) for r in rows.orderBy("doc_id", "lang", "h").toLocalIterator())


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def rows_of(docs: DataFrame | None, pages: DataFrame | None) -> DataFrame:
    """(kind, doc_id, page_id, host, domain, suffix, path, content): both tables in one form. A document's host is its source."""
    parts = []
    null = lambda t: F.lit(None).cast(t)
    if docs is not None:
        source = F.col("source").cast("string")
        parts.append(docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), null("long").alias("page_id"), source.alias("host"), source.alias("domain"), null("string").alias("suffix"), null("string").alias("path"), F.col("text").alias("content")))
    if pages is not None:
        host = F.when(F.length(_host("url")) > 0, _host("url"))
        parts.append(pages.select(F.lit("page").alias("kind"), null("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract(host, r"\.([a-z]+)$", 1).alias("suffix"), F.lower(F.regexp_extract("url", r"://[^/]+/([A-Za-z]{2})(?:/|$)", 1)).alias("path"), F.col("html").alias("content")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """(kind, doc_id, page_id, lang, confidence, text_lang, declared), one row per row of rows_of().

    Null and empty contents rest on the other evidence and the priors; with none,
    the table's most common language wins; ties go to the first name. Without a
    single row of known language the result's lang is null.
    """
    langs = model.langs
    shared = rows.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS

    def run(c):
        m, out = shared.value, {k: c[k] for k in ("kind", "doc_id", "page_id", "host", "domain")}
        out |= {"declared": [declared_language(x) if kind == "page" else None for kind, x in zip(c["kind"], c["content"], strict=True)], "ev": [], "own": [], "text_lang": []}
        for kind, declared, suffix, path, content in zip(c["kind"], out["declared"], c["suffix"], c["path"], c["content"], strict=True):
            if not langs:
                for k in ("ev", "own", "text_lang"):
                    out[k].append(None)
                continue
            text = m.loglik(visible(content) if kind == "page" else content)
            ev = np.array(text)
            for name, said in (("markup", declared), ("suffix", SUFFIXES.get(suffix)), ("path", path)):
                if said in langs:
                    wrong = WRONG[name]
                    ev = ev + np.log([1 - wrong if x == said else wrong / max(1, len(langs) - 1) for x in langs])
            p = np.exp(ev - ev.max())
            out["ev"].append(ev.tolist())
            out["own"].append((p / p.sum()).tolist())
            out["text_lang"].append(langs[int(np.argmax(text))] if any(text) else None)
        return out

    seen = arrow_map(rows, run, "kind string, doc_id long, page_id long, host string, domain string, declared string, ev array<double>, own array<double>, text_lang string")
    if not langs:
        return seen.select("kind", "doc_id", "page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), "text_lang", "declared")
    seen = materialize(seen, "evidence")
    k = range(len(langs))
    sums = lambda by, name: seen.groupBy(*by).agg(F.array(*[F.sum(F.get("own", i)) for i in k]).alias(name))
    everywhere = [float(x or 0) for x in (sums([], "n").first()[0] or [0.0] * len(langs))]  # one number a language
    joined = seen
    for by, name in ((["kind", "host", "domain"], "hn"), (["kind", "domain"], "dn")):
        counts = materialize(sums(by, name), name)  # written, so that a shuffled join can split a host with very many rows
        joined = joined.join(F.broadcast(counts) if counts.count() <= HOSTS else counts, by, "left")
    top = (np.array(everywhere) + 1) / (sum(everywhere) + len(langs))

    def fuse(c):
        def filled(values):
            return np.array([v if v is not None else [0.0] * len(langs) for v in values], float).reshape(-1, len(langs))

        own, prior = filled(c["own"]), top
        for counts in ("dn", "hn"):  # the domain's towards the table's, the host's towards the domain's
            known = np.array([v is not None for v in c[counts]], float)[:, None]
            n = np.maximum(filled(c[counts]) - own * known, 0)
            prior = (n + KAPPA * prior) / (KAPPA + n.sum(1, keepdims=True))
        lp = filled(c["ev"]) + np.log(np.maximum(prior, 1e-9))
        share = 1 / np.exp(lp - lp.max(1, keepdims=True)).sum(1)
        return {**{k: c[k] for k in ("kind", "doc_id", "page_id", "text_lang", "declared")}, "lang": [langs[i] for i in lp.argmax(1)], "confidence": share}

    fused = arrow_map(joined.select("kind", "doc_id", "page_id", "ev", "own", "hn", "dn", "text_lang", "declared"), fuse, "kind string, doc_id long, page_id long, lang string, confidence double, text_lang string, declared string")
    return fused.withColumn("confidence", F.round("confidence", 6))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(rows_of(docs, table(spark, sf_dir, "pages")), train(docs))
