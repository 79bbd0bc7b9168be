"""6. PII: exact base patterns, and a linear-chain CRF over word shapes that adds spans.

Base spans are found by linear scans that give just what the four patterns give,
leftmost and non-overlapping per kind. The CRF is trained from a small labelled
table (``labelled()``, a few hundred short lines made by rule) by maximum
likelihood, and decoded by Viterbi in numpy over every word of every text, many texts
side by side, longest first, each from its first word to its last without a cut;
the weights of a word are summed once and kept. The CRF adds spans that overlap no
base span; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PART = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    free, at = 0, t.find("@")
    while at >= 0:
        lo = at
        while lo > free and t[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(t, at + 1)):
            yield lo, m.end()
            free = m.end()
        else:
            free = at + 1  # what is before belongs to no later address
        at = t.find("@", max(at + 1, free))


def _ips(t: str) -> Iterator[tuple[int, int]]:
    if t.count(".") < 3:
        return
    for m in _DOTTED.finditer(t):
        if t.count(".", m.start(), m.end()) < 3:
            continue
        parts = [(p.start(), p.end()) for p in _PART.finditer(t, m.start(), m.end())]
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(x := t[a:b].lstrip("0")) <= 3 and int(x or "0") <= 255 for a, b in four):
                yield four[0][0], four[3][1]


def _cards(t: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(t):
        if m.end() - m.start() >= 12 and 12 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(t: str) -> Iterator[tuple[int, int]]:
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.span()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted; code points, end exclusive."""
    t = text or ""
    if not _TRIGGER.search(t):
        return []
    return sorted((a, k, b) for k, f in enumerate((_emails, _ips, _cards, _phones)) for a, b in f(t))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def shape(word: str) -> str:
    """Runs of digits, letters and signs: Ab9-9 for "Abc12-3"."""
    s = re.sub(r"[A-ZÀ-Þ]+", "A", re.sub(r"[^\W\d_A-ZÀ-Þ]+", "a", re.sub(r"\d+", "9", word)))
    return s[:16]


def _word_features(w: str) -> list[str]:
    digits = re.sub(r"\D", "", w)
    n = len(digits)
    out = [f"s={shape(w)}", f"n={n if n < 5 else 5 + n // 4}", f"end={w[-1] if not w[-1].isalnum() else 'w'}"]
    if "@" in w:
        out.append("at")
    if n in (13, 14, 15, 16) and luhn(digits):
        out.append("luhn")
    if not n and len(w) <= 12:
        out.append(f"w={w.lower().strip('.,:;()[]')}")
    return out


def _features(words: list[str]) -> list[list[str]]:
    own = [_word_features(w) for w in words]
    return [["bias", *own[i], *(f"-1{x}" for x in (own[i - 1] if i else ["edge"])), *(f"+1{x}" for x in (own[i + 1] if i + 1 < len(words) else ["edge"]))] for i in range(len(words))]


def labelled(seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: short lines with their labels, made by rule from fixed forms."""
    rng, out = np.random.default_rng(seed), []
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card(n=16):
        d = digits(n - 1)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def unchecked(n=16):
        d = digits(n - 1)
        return next(d + c for c in "0123456789" if not luhn(d + c))

    def pick(*xs):
        return xs[rng.integers(len(xs))]

    def plain(n):
        return [pick("the", "of", "and", "der", "les", "report", "ontion", "eau", "Heit.", "ende,", "el", "Ción", "with", "line", "page") for _ in range(n)]

    forms = {
        "email": lambda: pick(["ab", "(at)", "mail.org"], ["jo", "[at]", "host.net"], [f"{pick('ann', 'li', 'x')}.{digits(2)}@localhost"], [f"{pick('kim', 'bo')}{digits(1)}@intranet"]),
        "ip": lambda: pick([f"{rng.integers(1, 255)}.{rng.integers(255)}.{rng.integers(255)}.{rng.integers(255)}"], [f"fe80::{digits(4)}:{digits(4)}"], [f"2001:db8::{digits(2)}:{digits(1)}"]),
        "card": lambda: pick([card()], [(c := card())[:4], c[4:8], c[8:12], c[12:]], ["-".join((c := card())[i : i + 4] for i in range(0, 16, 4))]),
        "phone": lambda: pick([f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], ["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"00{digits(2)}", digits(3), digits(7)]),
    }
    cues = {"email": ("mail", "write", "e-mail:"), "ip": ("host", "from", "ip:"), "card": ("card", "visa", "paid"), "phone": ("call", "tel.", "phone:")}
    for i in range(240):
        kind = KINDS[i % 4]
        before, after, form = plain(rng.integers(1, 5)), plain(rng.integers(1, 5)), forms[kind]()
        if rng.random() < 0.5:
            before.append(pick(*cues[kind]))
        words = [*before, *form, *after]
        out.append((words, ["O"] * len(before) + [f"{'I' if j else 'B'}-{kind}" for j in range(len(form))] + ["O"] * len(after)))
    for _ in range(240):  # numbers that are nobody's
        other = pick([digits(rng.integers(1, 12))], [f"{digits(1)}.{digits(2)}"], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [f"v{digits(1)}.{digits(1)}.{digits(1)}"], [f'"{digits(5)}a{digits(6)}bc{digits(9)}"'], [digits(20)], [f"{digits(2)}:{digits(2)}"], [f"{digits(2)}%"], ["token", "=", f'"{digits(3)}e{digits(20)}"'], [f"{digits(1)},{digits(3)}"], [f"({digits(4)})"], [f"@{pick('name', 'user')}"], [unchecked()], [unchecked()])
        words = [*plain(rng.integers(1, 6)), *other, *plain(rng.integers(1, 6))]
        out.append((words, ["O"] * len(words)))
    return out


#: Classes of shape(), a character each; further characters stand for themselves.
_CLASSES = {c: k for c in range(0x250) if (k := "A" if re.match("[A-ZÀ-ÖØ-Þ]", chr(c)) else "9" if re.match(r"\d", chr(c)) else "a" if re.match(r"[^\W\d_A-ZÀ-Þ]", chr(c)) else None)}
#: Steps whose emissions are held at once.
STEPS = 256
#: Words whose weights a process keeps, and their characters.
KEPT_WORDS, KEPT_CHARS = 1 << 17, 1 << 23
#: Characters of texts whose words are held at once.
BLOCK_CHARS = 1 << 22


class CRF:
    """Linear-chain conditional random field with word features and label transitions."""

    _kept: list | None = None

    def __init__(self, table: list[tuple[list[str], list[str]]], rounds: int = 120, rate: float = 0.15, decay: float = 1e-3):
        feats = [_features(ws) for ws, _ in table]
        self.ids: dict[str, int] = {}
        for f in (x for row in feats for word in row for x in word):
            self.ids.setdefault(f, len(self.ids))
        k, n, t = len(LABELS), len(table), max(len(ws) for ws, _ in table)
        x, y, size = self._pad(feats, t), np.zeros((n, t), int), np.array([len(ws) for ws, _ in table])
        for i, (_, ls) in enumerate(table):
            y[i, : len(ls)] = [LABELS.index(v) for v in ls]
        real = np.arange(t) < size[:, None]
        self.w, self.a = np.zeros((len(self.ids) + 1, k)), np.zeros((k, k))
        moments = [np.zeros_like(p) for p in (self.w, self.w, self.a, self.a)]
        one = np.eye(k)[y] * real[..., None]
        pairs = np.einsum("nti,ntj->ij", one[:, :-1], one[:, 1:])
        for step in range(1, rounds + 1):
            node, edge = self._expect(self.w[x].sum(2), real)
            gw = np.zeros_like(self.w)
            np.add.at(gw, x.reshape(n * t, -1), ((one - node * real[..., None]).reshape(n * t, 1, k)))
            for p, g, m, v in ((self.w, gw / n - decay * self.w, *moments[:2]), (self.a, (pairs - edge) / n - decay * self.a, *moments[2:])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.w[-1] = 0  # the padding feature

    def _pad(self, feats, t):
        width = max((len(w) for row in feats for w in row), default=1)
        x = np.full((len(feats), t, width), len(self.ids))
        for i, row in enumerate(feats):
            for j, word in enumerate(row):
                got = [self.ids[f] for f in word if f in self.ids]
                x[i, j, : len(got)] = got
        return x

    def _expect(self, e, real):
        """Node marginals and expected transition counts (forward-backward)."""
        n, t, k = e.shape
        lse = lambda z, ax: (m := z.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(z - m).sum(ax))
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for i in range(1, t):
            f[:, i] = np.where(real[:, i, None], e[:, i] + lse(f[:, i - 1, :, None] + self.a, 1), f[:, i - 1])
        for i in range(t - 2, -1, -1):
            b[:, i] = np.where(real[:, i + 1, None], lse(self.a + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), b[:, i + 1])
        z = lse(f[:, -1], 1)
        node = np.exp(f + b - z[:, None, None])
        edge = np.exp(f[:, :-1, :, None] + self.a + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        return node, edge.sum((0, 1))

    def _weights(self, word: str) -> np.ndarray:
        """(3, labels): what a word gives itself (with the bias), the next word and the one before."""
        own = _word_features(word)
        sums = [[self.ids[f] for f in fs if f in self.ids] for fs in (["bias", *own], [f"-1{x}" for x in own], [f"+1{x}" for x in own])]
        return np.stack([self.w[i].sum(0) for i in sums])

    def _form(self, word: str) -> str:
        """Words of one form have the same features: letters and digits count by class, but in words of the table and checked numbers."""
        form = word.translate(_CLASSES)
        if "9" not in form:
            return word if len(word) <= 12 and f"w={word.lower().strip('.,:;()[]')}" in self.ids else form
        return word if 13 <= form.count("9") <= 16 else form

    def label(self, lines: list[list[str]]) -> list[np.ndarray]:
        """Label numbers of every word; the same as decode(), for many and long lines."""
        if self._kept is None or len(self._kept[0]) > KEPT_WORDS or self._kept[3] > KEPT_CHARS:
            self._kept = [{}, {}, np.zeros((0, 3, len(LABELS)), np.float32), 0]
        index, forms, weights, chars = self._kept
        coded, new = [], []
        for words in lines:
            for w in set(words).difference(index):
                form = self._form(w)
                if (k := forms.get(form)) is None:
                    k = forms[form] = len(weights) + len(new)
                    new.append(self._weights(w).astype(np.float32))
                index[w] = k
                chars += len(w) + len(form)
            coded.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        weights = np.concatenate([weights, new]) if new else weights
        self._kept[2:] = [weights, chars]
        return self._viterbi(coded, weights)

    def _viterbi(self, coded: list[np.ndarray], weights: np.ndarray) -> list[np.ndarray]:
        """Best labels of every line, given the numbers of its words' weights."""
        order = sorted((i for i, c in enumerate(coded) if len(c)), key=lambda i: -len(coded[i]))
        size = np.array([len(coded[i]) for i in order], np.int64)
        out = [np.zeros(len(c), np.int8) for c in coded]
        if not order:
            return out
        flat, at = np.concatenate([coded[i] for i in order]), np.cumsum(size) - size
        left, right = (self.w[self.ids[x]] if x in self.ids else np.zeros(len(LABELS)) for x in ("-1edge", "+1edge"))
        into, backs, best = np.ascontiguousarray(self.a.T, np.float32), [], np.zeros((0, len(LABELS)), np.float32)
        last = np.zeros(len(order), np.int8)
        for lo in range(0, int(size[0]), STEPS):
            n = int((size > lo).sum())  # lines that go on; the longest come first
            j = np.arange(lo, min(lo + STEPS, int(size[0])))[:, None]
            where, real = at[:n] + np.minimum(j, size[:n] - 1), j < size[:n]
            e = weights[flat[where], 0]
            e += np.where((j > 0)[..., None], weights[flat[np.maximum(where - 1, 0)], 1], left.astype(np.float32))
            e += np.where((j < size[:n] - 1)[..., None], weights[flat[np.minimum(where + 1, len(flat) - 1)], 2], right.astype(np.float32))
            for t in range(len(j)):
                m = int(real[t].sum())
                if lo + t:
                    s = best[:m, None, :] + into
                    back = s.argmax(2)
                    backs.append(back.astype(np.int8))
                    now = np.take_along_axis(s, back[..., None], 2)[..., 0] + e[t, :m]
                else:
                    now = e[0]
                ended = size[:m] == lo + t + 1
                if ended.any():
                    last[:m][ended] = now[ended].argmax(1)
                best = now
        found, now = np.zeros(len(flat), np.int8), last
        for t in range(int(size[0]) - 1, -1, -1):
            m = int(np.searchsorted(-size, -t, side="left"))  # lines of more than t words
            found[at[:m] + t] = now[:m]
            if t:
                now = now.copy()
                now[:m] = backs[t - 1][np.arange(m), now[:m]]
        for r, i in enumerate(order):
            out[i] = found[at[r] : at[r] + size[r]]
        return out

    def decode(self, lines: list[list[str]]) -> list[list[str]]:
        """Viterbi for all lines at once, padded to the longest of similar length."""
        out: list[list[str]] = [[] for _ in lines]
        order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
        for lo in range(0, len(order), 256):
            ids = [i for i in order[lo : lo + 256] if lines[i]]
            if not ids:
                continue
            t = max(len(lines[i]) for i in ids)
            e = self.w[self._pad([_features(lines[i]) for i in ids], t)].sum(2)
            best, back = e[:, 0], np.zeros(e.shape, int)
            bests = [best]
            for j in range(1, t):
                s = best[:, :, None] + self.a
                back[:, j] = s.argmax(1)
                best = s.max(1) + e[:, j]
                bests.append(best)
            for r, i in enumerate(ids):
                n = len(lines[i])
                k = int(bests[n - 1][r].argmax())
                path = [k]
                for j in range(n - 1, 0, -1):
                    k = int(back[r, j, k])
                    path.append(k)
                out[i] = [LABELS[p] for p in reversed(path)]
        return out


def _labelled_texts(texts: list[str | None], crf: CRF) -> Iterator[tuple[int, np.ndarray]]:
    """(index, labels of its words) of every text that isn't null; BLOCK_CHARS characters or one text are held at once."""
    held, chars = [], 0
    for i, t in enumerate(texts):
        if t is not None:
            held.append(i)
            chars += len(t)
        if held and (chars >= BLOCK_CHARS or i == len(texts) - 1):
            yield from zip(held, crf.label([_TOKEN.findall(texts[j]) for j in held]), strict=True)
            held, chars = [], 0


def added_spans(texts: list[str | None], base: list[list[tuple[int, int, int]]], crf: CRF) -> list[list[tuple[int, int, int]]]:
    """Per text: spans of the CRF that overlap no base span."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, labels in _labelled_texts(texts, crf):
        at = np.flatnonzero(labels).tolist()
        seg = [m.span() for m in _TOKEN.finditer(texts[i])] if at else []
        j = 0
        for j0 in at:
            if j0 < j:
                continue
            j = j0
            kind, k = LABELS[labels[j]][2:], j + 1
            while k < len(seg) and LABELS[labels[k]] == f"I-{kind}":
                k += 1
            a, b = seg[j][0], seg[k - 1][1]
            while b > a and not texts[i][b - 1].isalnum():
                b -= 1
            while a < b and texts[i][a] in "\"'[<,;":
                a += 1
            if a < b and not any(x < b and a < y for x, _, y in base[i]):
                out[i].append((a, KINDS.index(kind), b))
            j = k
    return out


def personal_data(docs: DataFrame, crf: CRF | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of ``docs``.

    Counts and digest are those of the base patterns; spans also holds what the CRF
    adds. Null texts count as empty; repeated rows and null ids are kept as they
    are. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf or CRF(labelled()))  # some thousand weights

    def run(c):
        base = [base_spans(t) for t in c["text"]]
        more = added_spans(c["text"], base, shared.value)
        out = {"doc_id": c["doc_id"], **{f"n_{k}": [sum(s[1] == i for s in b) for b in base] for i, k in enumerate(KINDS)}}
        out["base_sha256"] = [hashlib.sha256(listed(b).encode()).hexdigest() for b in base]
        out["spans"] = [listed(sorted({*b, *m})) for b, m in zip(base, more, strict=True)]
        return out

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", rows=2048)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
