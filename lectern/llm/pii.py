"""Personal data in whole texts: fixed patterns, and a character BiLSTM with CRF transitions that adds what they miss.

The model is trained in numpy from labelled spans: windows of a bounded sample of the corpus about the patterns' own
spans, about digits that are none, and altered copies of the former with their labels. At use, overlapping windows
are decoded one by one and reconciled over the whole text: where two windows meet, the tags of the one whose middle
is nearer hold. A span needs a digit or an at sign, so a window without either is not decoded.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: Windows of the corpus to train on at most, characters of a window and its step.
TRAIN_WINDOWS, WINDOW, STEP = 800, 64, 32

#: Windows made by rule, half of them with a span.
GENERATED = 1200

#: Parts of each kind's windows, from each of which the first ones are taken.
PARTS = 64

#: Sizes of the network, passes over the windows, windows in a step.
EMBED, HIDDEN, EPOCHS, BATCH = 12, 24, 12, 32

#: An added span needs this mean marginal probability of its tags.
SURE = 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ANCHOR = re.compile(r"[0-9@]")

Span = tuple[int, int, int]


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, one at sign at a time: what stands before it is scanned once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start; matches that fail their test are dropped without another try."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Characters: 0 pads, 1 is any other, ASCII from 2, other letters last.
CHARS = 131

_ALLOWED = np.zeros((TAGS, TAGS), bool)
for _to in range(TAGS):
    for _from in range(TAGS):
        _ALLOWED[_from, _to] = _to % 2 == 1 or _to == 0 or _from in (_to, _to - 1)


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return np.where(c < 128, c + 2, np.where(c > 0x2FF, 1, 130))


def _labels(length: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for k, a, b in spans:
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, two LSTMs (forward, backward), a linear layer and CRF transitions."""

    def __init__(self, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) * (1.2 / np.sqrt(s[0]))).astype(np.float32)
        self.p = {"E": g(CHARS, EMBED) * 3, "O": g(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p["W" + d], self.p["b" + d] = g(EMBED + HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)
            self.p["b" + d][HIDDEN : 2 * HIDDEN] = 1
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.t = 0

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, length, _ = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, saved = np.zeros((n, length, HIDDEN), np.float32), []
        W, b = self.p["W" + d], self.p["b" + d]
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = np.concatenate([x[:, t], h], 1)
            a = z @ W + b
            s = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            u = np.tanh(c)
            h = o * u
            out[:, t] = h
            if keep:
                saved.append((t, z, i, f, o, g, before, u))
        return out, saved

    def emissions(self, codes: np.ndarray, keep: bool = False):
        x = self.p["E"][codes]
        f, sf = self._lstm(x, "f", keep)
        b, sb = self._lstm(x, "b", keep)
        h = np.concatenate([f, b], 2)
        e = h @ self.p["O"] + self.p["c"]
        return (e, h, sf, sb) if keep else e

    def _sums(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums at each place, and the log of the whole sum."""
        n, length, _ = e.shape
        X = np.where(_ALLOWED, np.exp(self.p["T"].astype(np.float64)), 0.0)
        a, b = np.zeros((n, length, TAGS)), np.zeros((n, length, TAGS))
        a[:, 0] = e[:, 0]
        a[:, 0, 2::2] = -60
        for t in range(1, length):
            top = a[:, t - 1].max(1, keepdims=True)
            v = np.log(np.exp(a[:, t - 1] - top) @ X + 1e-30) + top + e[:, t]
            a[:, t] = np.where(mask[:, t, None], v, a[:, t - 1])
        for t in range(length - 2, -1, -1):
            w = e[:, t + 1] + b[:, t + 1]
            top = w.max(1, keepdims=True)
            b[:, t] = np.where(mask[:, t + 1, None], np.log(np.exp(w - top) @ X.T + 1e-30) + top, b[:, t + 1])
        top = a[:, -1].max(1)
        return a, b, np.log(np.exp(a[:, -1] - top[:, None]).sum(1)) + top

    def _crf(self, e: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradients of the negative log likelihood by the emissions and the transitions."""
        n = len(e)
        a, b, z = self._sums(e, mask)
        de = np.exp(a + b - z[:, None, None]) * mask[..., None]
        rows, columns = np.nonzero(mask)
        de[rows, columns, y[rows, columns]] -= 1
        both = mask[:, 1:]
        top = a[:, :-1].max(2, keepdims=True)
        left = np.exp(a[:, :-1] - top)
        right = np.exp(np.minimum(e[:, 1:] + b[:, 1:] + top - z[:, None, None], 50))
        dT = np.einsum("nti,ntj->ij", left * both[..., None], right) * np.exp(self.p["T"].astype(np.float64))
        np.subtract.at(dT, (y[:, :-1][both], y[:, 1:][both]), 1)
        return (de / n).astype(np.float32), (np.where(_ALLOWED, dT, 0) / n).astype(np.float32)

    def step(self, codes: np.ndarray, y: np.ndarray, rate: float) -> None:
        mask = codes > 0
        e, h, sf, sb = self.emissions(codes, keep=True)
        de, dT = self._crf(e.astype(np.float64), y, mask)
        flat = de.reshape(-1, TAGS)
        grads = {"O": h.reshape(-1, 2 * HIDDEN).T @ flat, "c": flat.sum(0), "T": dT, "E": np.zeros_like(self.p["E"])}
        dh = de @ self.p["O"].T
        dx = np.zeros((*codes.shape, EMBED), np.float32)
        for d, saved, part in (("f", sf, dh[..., :HIDDEN]), ("b", sb, dh[..., HIDDEN:])):
            W = self.p["W" + d]
            gW, gb = np.zeros_like(W), np.zeros_like(self.p["b" + d])
            nh = nc = np.zeros((len(codes), HIDDEN), np.float32)
            for t, z, i, f, o, g, before, u in reversed(saved):
                g_h = part[:, t] + nh
                g_c = g_h * o * (1 - u * u) + nc
                da = np.concatenate([g_c * g * i * (1 - i), g_c * before * f * (1 - f), g_h * u * o * (1 - o), g_c * i * (1 - g * g)], 1)
                gW += z.T @ da
                gb += da.sum(0)
                dz = da @ W.T
                dx[:, t] += dz[:, :EMBED]
                nh, nc = dz[:, EMBED:], g_c * f
            grads["W" + d], grads["b" + d] = gW, gb
        one = np.zeros((codes.size, CHARS), np.float32)
        one[np.arange(codes.size), codes.ravel()] = 1
        grads["E"] = one.T @ dx.reshape(-1, EMBED)
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            m, v = self.m[k]
            m[...] = 0.9 * m + 0.1 * g
            v[...] = 0.999 * v + 0.001 * g * g
            self.p[k] = (self.p[k] - rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)

    def fit(self, windows: list[tuple[str, list[Span]]], epochs: int = EPOCHS, seed: int = 0) -> Tagger:
        r = np.random.default_rng(seed)
        codes, y = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), np.int64)
        for k, (text, spans) in enumerate(windows):
            codes[k, : len(text)], y[k, : len(text)] = _codes(text), _labels(len(text), spans)
        for epoch in range(epochs):
            order = r.permutation(len(windows))
            for i in range(0, len(order), BATCH):
                self.step(codes[order[i : i + BATCH]], y[order[i : i + BATCH]], 0.01 / (1 + 0.15 * epoch))
        return self

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each window, and each tag's marginal probability."""
        e = self.emissions(codes)
        n, length, _ = e.shape
        T = np.where(_ALLOWED, self.p["T"], -1e4)
        v, back = e[:, 0].copy(), np.zeros((n, length, TAGS), np.int8)
        v[:, 2::2] -= 1e4
        for t in range(1, length):
            s = v[:, :, None] + T[None]
            back[:, t] = s.argmax(1)
            real = codes[:, t, None] > 0
            back[:, t] = np.where(real, back[:, t], np.arange(TAGS))
            v = np.where(real, s.max(1) + e[:, t], v)
        tags = np.zeros((n, length), np.int64)
        tags[:, -1] = v.argmax(1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        forward, backward, z = self._sums(e.astype(np.float64), codes > 0)
        p = np.exp(forward + backward - z[:, None, None])
        return tags, np.take_along_axis(p, tags[..., None], 2)[..., 0]

    def spans(self, text: str) -> list[Span]:
        """Spans of a whole text, from overlapping windows."""
        n = len(text)
        starts = sorted({s for m in _ANCHOR.finditer(text) for s in range(max(0, (m.start() - WINDOW) // STEP * STEP + STEP), m.start() + 1, STEP)})
        if not starts:
            return []
        tags, sure, near = {}, {}, {}
        for i in range(0, len(starts), 256):
            some = starts[i : i + 256]
            codes = np.zeros((len(some), WINDOW), np.int64)
            for k, s in enumerate(some):
                c = _codes(text[s : s + WINDOW])
                codes[k, : len(c)] = c
            found, p = self.decode(codes)
            for k, s in enumerate(some):
                for j in range(min(WINDOW, n - s)):
                    off = abs(j - WINDOW // 2) if s else max(0, j - WINDOW // 2)
                    if off < near.get(s + j, WINDOW):
                        near[s + j], tags[s + j], sure[s + j] = off, int(found[k, j]), float(p[k, j])
        out: list[Span] = []
        at = None
        for i in sorted(tags):
            tag = tags[i]
            if at and tag == 2 + 2 * at[0] and i == at[2]:
                at = (at[0], at[1], i + 1, at[3] + sure[i])
                continue
            if at:
                out.append(at)
            at = (tag // 2, i, i + 1, sure[i]) if tag % 2 else None
        if at:
            out.append(at)
        return [(k, a, b) for k, a, b, p in out if p / (b - a) >= SURE]


def _plausible(kind: int, text: str) -> bool:
    """What a span of a kind must hold at least, whatever the model says."""
    digits = len(_DIGIT.findall(text))
    return "@" in text and "." in text if kind == 0 else 4 <= digits <= 12 if kind == 1 else 15 <= digits <= 19 if kind == 2 else 7 <= digits <= 15


#: What an added span of a kind may begin and end with; what stands before or after that is no part of it.
_EDGES = (r"[A-Za-z0-9].*[A-Za-z0-9]", r"[0-9].*[0-9]", r"[0-9].*[0-9]", r"[(+0-9].*[0-9]")
_CORES = [re.compile(x, re.DOTALL) for x in _EDGES]


def _trimmed(span: Span, text: str) -> Span:
    k, a, b = span
    m = _CORES[k].search(text, a, b)
    return (k, m.start(), m.end()) if m else span


def find(text: str, model: Tagger | None) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and those with what the model adds: spans that touch none of the former."""
    base = base_spans(text)
    if model is None or not _ANCHOR.search(text):
        return base, base
    added = [s for s in (_trimmed(s, text) for s in model.spans(text)) if _plausible(s[0], text[s[1] : s[2]]) and not any(s[1] < b and a < s[2] for _, a, b in base)]
    return base, sorted(base + added)


def _altered(text: str, spans: list[Span], turn: int) -> tuple[str, list[Span]] | None:
    """A labelled window in another way of writing."""
    k, a, b = spans[0]
    s = text[a:b]
    new = s
    if k == 3:
        new = (s.lstrip("+"), s.replace("(", "").replace(")", "").replace(" ", "-"), s.split(" ", 1)[-1], s.replace(" ", "."))[turn % 4]
    elif k == 2:
        digits = "".join(_DIGIT.findall(s))
        new = ("-", " ", ".", "  ", "/")[turn % 5].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    elif k == 0:
        new = (s.replace("@", " @ "), s.upper(), s.replace(".", " . "))[turn % 3]
    elif k == 1:
        new = (s.replace(".", " . "), s.replace(".", "-"))[turn % 2]
    text = text[:a] + new + text[b:]
    moved = [(k, a, a + len(new))] + [(j, x + len(new) - len(s), y + len(new) - len(s)) for j, x, y in spans[1:]]
    return (text, moved) if len(text) <= WINDOW else None


def training_windows(docs: DataFrame, most: int = TRAIN_WINDOWS, seed: int = 0) -> list[tuple[str, list[Span]]]:
    """Labelled windows: ``most`` at most of the corpus, in hash order, and altered copies of those with a span.

    Equal windows count once. Half of the windows are such without a span, an eighth each such with a first span of one
    kind; what there is too little of is made up by the next windows in hash order, whatever they hold.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found: set[str] = set()
            for text in batch.column(0).to_pylist():
                seen = -WINDOW
                for m in _ANCHOR.finditer(text or ""):
                    if m.start() >= seen + WINDOW:
                        seen = m.start()
                        h = int.from_bytes(hashlib.blake2b(f"{seed}:{seen}:{text[seen:seen + 24]}".encode(), digest_size=4).digest(), "big")
                        start = max(0, seen - h % (WINDOW // 2))
                        found.add(text[start : start + WINDOW])
            windows = list(found)
            kinds = [min(base_spans(w), key=lambda s: s[1], default=(-1,))[0] for w in windows]
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(kinds, pa.int32())], ["window", "kind"])

    rows = docs.where(F.col("text").rlike("[0-9@]")).select("text").mapInArrow(run, "window string, kind int").distinct()
    rows = rows.withColumn("key", F.xxhash64("window", F.lit(seed)))
    # The first of each kind in each of a fixed number of parts, then of each kind: no task gets more than these.
    part, order = F.pmod(F.xxhash64("key"), F.lit(PARTS)), ("key", "window")
    for group in (["kind", part], ["kind"]):
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("n") <= most).drop("n")
    by_kind: dict[int, list[tuple[int, str]]] = {k: [] for k in range(-1, len(KINDS))}
    for w, kind, key in sorted(rows.select("window", "kind", "key").collect(), key=lambda r: (r[2], r[0])):  # ``most`` a kind
        by_kind[kind].append((key, w))
    quota = {k: most // 2 if k < 0 else most // 2 // len(KINDS) for k in by_kind}
    taken = [x for k, some in by_kind.items() for x in some[: quota[k]]]
    rest = sorted(x for k, some in by_kind.items() for x in some[quota[k] :])
    out: list[tuple[str, list[Span]]] = []
    for turn, (_, w) in enumerate(sorted(taken + rest[: most - len(taken)])):
        spans = sorted(base_spans(w), key=lambda s: s[1])
        spans = [s for i, s in enumerate(spans) if not any(s[1] < b and a < s[2] for _, a, b in spans[:i])]
        out.append((w, spans))
        if spans and (other := _altered(w, spans, turn)):
            out.append(other)
    return out


def _luhn_digits(r: random.Random, n: int) -> str:
    """A card number of ``n`` digits that passes the check."""
    head = str(r.randrange(3, 7)) + "".join(str(r.randrange(10)) for _ in range(n - 2))
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def written_out(kind: int, r: random.Random) -> str:
    """An item of a kind as people write it, in ways that the patterns don't know."""
    d = lambda n: str(r.randrange(1, 10)) + "".join(str(r.randrange(10)) for _ in range(n - 1))
    if kind == 0:
        word = lambda a, b: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(a, b)))
        name, host, end = r.choice((word(3, 9), f"{word(2, 7)}.{word(2, 8)}", f"{word(3, 8)}{r.randrange(100)}", word(3, 8).title())), r.choice((word(3, 9), f"{word(3, 6)}.{word(3, 7)}")), r.choice(("com", "org", "net", "de", "fr", "es", "edu"))
        at, dot = r.choice((" @ ", " @", "@ ")), r.choice((".", " . ", "."))
        return f"{name}{at}{host.replace('.', dot)}{dot}{end}"
    if kind == 1:
        parts = [str(r.choice((r.randrange(256), r.randrange(10), 10, 192))) for _ in range(4)]
        return r.choice((" . ", ". ", " .", "[.]")).join(parts)
    if kind == 2:
        digits = _luhn_digits(r, 16)
        return r.choice((".", "/", "  ", "_", " - ")).join(digits[i : i + 4] for i in range(0, 16, 4))
    area, mid, end = d(3), d(3), d(4)
    return r.choice((f"{area}-{mid}-{end}", f"({area}) {mid}-{end}", f"{area} {mid} {end}", f"{area}.{mid}.{end}", f"1-{area}-{mid}-{end}", f"({area}) {mid} {end}", f"0{d(2)} {d(3)} {d(4)}", f"0{d(3)}/{d(6)}", f"0{d(2)}-{d(7)}"))


def look_alike(r: random.Random) -> str:
    """Digits and at signs that are nobody's."""
    d = lambda n: str(r.randrange(1, 10)) + "".join(str(r.randrange(10)) for _ in range(n - 1))
    n = lambda a, b: r.randrange(a, b)
    return r.choice(
        (
            f"{n(1900, 2100)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}", f"{n(1, 13)}/{n(1, 29)}/{n(1900, 2100)}", f"{n(0, 24):02d}:{n(0, 60):02d}:{n(0, 60):02d}", f"{n(1, 999)},{n(100, 999)}.{n(10, 99)}", f"{n(1, 999)},{n(100, 999)},{n(100, 999)}",
            f"{n(1, 20)}.{n(0, 20)}.{n(0, 20)}", f"{n(1, 20)}.{n(0, 99)}", f"{n(1, 99)}-{n(100, 199)}", f"{n(1900, 2000)}-{n(2000, 2100)}", f"978-{n(0, 9)}-{d(2)}-{d(6)}-{n(0, 9)}", f"#{d(n(3, 9))}", d(n(1, 13)), f"{d(3)} {d(3)}", f"{n(1, 99)} %", f"@{r.choice(('home', 'todo', 'see', 'all'))}", f"{n(1, 99)} @ {n(1, 99)}",
            f"{d(4)} {d(4)}", f"{n(1, 99)} x {n(1, 99)} x {n(1, 99)}", f"no. {d(5)}", f"{d(2)} {d(2)} {d(2)}", f"{n(1, 9)} . {n(1, 9)}", f"ID-{d(6)}", f"{d(4)}-{d(4)}", f"v{n(1, 9)}.{n(0, 99)}.{n(0, 999)}.{d(5)}",
        )
    )


def generated(contexts: list[str], n: int = GENERATED, seed: int = 0) -> list[tuple[str, list[Span]]]:
    """Labelled windows made by rule: what people write out set into texts of the corpus, as often what only looks like it."""
    r, out = random.Random(seed), []
    for i in range(n):
        text = _ANCHOR.sub("", r.choice(contexts)) if contexts else ""
        kind = i // 2 % len(KINDS) if i % 2 else None
        item = look_alike(r) if kind is None else written_out(kind, r)
        room = WINDOW - len(item)
        left = r.randrange(0, min(room, len(text)) + 1)
        head, tail = text[:left], text[left : room]
        head, tail = (head[:-1] + " " if head else ""), (r.choice((" ", ", ", ". ", ") ")) + tail)[: room - left]
        out.append((head + item + tail, [] if kind is None else [(kind, len(head), len(head) + len(item))]))
    return out


def train(docs: DataFrame, seed: int = 0) -> Tagger | None:
    """The model, of windows of the corpus and of ones made by rule; none if the corpus has no window to learn from."""
    windows = training_windows(docs, seed=seed)
    return Tagger(seed).fit(windows + generated([w for w, spans in windows if not spans], seed=seed), seed=seed) if windows else None


def personal_data(docs: DataFrame, model: Tagger | None = None, seed: int = 0) -> DataFrame:
    """``doc_id``, counts of the patterns' spans by kind, ``base_sha256``, ``spans`` and ``n_added`` of each row.

    Offsets are code points, the end exclusive. A null or empty text has no spans. Repeated rows are alike; an empty
    table gives none; other columns are ignored; whole texts of any length are searched.
    """
    model = model or train(docs, seed)
    if model:
        model.m = {}
    names = [f"n_{k}" for k in KINDS]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            counts: list[list[int]] = [[] for _ in KINDS]
            shas, spans, added = [], [], []
            for text in batch.column(1).to_pylist():
                base, every = find(text or "", model)
                for k, column in enumerate(counts):
                    column.append(sum(s[0] == k for s in base))
                shas.append(hashlib.sha256(told(base).encode()).hexdigest())
                spans.append(told(every))
                added.append(len(every) - len(base))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string, n_added long")
