"""Personal data by patterns and a semi-Markov conditional random field over what the patterns leave.

The patterns' spans are given. Around every other digit and at-sign the text is cut into fine tokens (runs of
letters, of digits, single marks, blanks), and the field scores whole candidate segments: an exponential model over
the ways to divide the stretch into segments, each of a kind or outside, with features of the segment as a whole
(its shape, number and grouping of digits, checksum, what stands before and after). Entities are bounded by
MOST_TOKENS fine tokens, so the dynamic programme over ends and lengths is linear in the stretch; it chooses
boundaries and kinds together. A segment is added where the best division has it and its odds against being outside
are over MARGIN.

The weights are learned by gradient steps on the log-likelihood (forward and backward sums over all divisions) of
stretches whose labels the patterns give, and of variants of them in looser writing, which the patterns would miss:
cards and phones with other separators, phones without plus, addresses with blanks around their marks. The texts
are cut into windows that together hold every digit and at-sign; at most TRAIN_ROWS of these, of the smallest hashes,
are learned from.

Defined cases. Null texts are empty: no spans. Where patterns of different kinds overlap all spans stay. Every input
row gives one row; other columns are never read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyslot.llm.common import annotate, column

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS, MARGIN = 24, 3.0
TRAIN_ROWS, EPOCHS, RATE = 400, 3, 0.3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails at its first digit fails at every other one, so runs are tried once
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
SIGNS = re.compile(r"[0-9@]+")
FINE = re.compile(r"[^\W\d_]+|[0-9]+|[ \t]+|.", re.DOTALL)


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(c) - 9 * (c > "4") for c in even)) % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in text.split(".")) if text else False


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of what the patterns find, by start, then kind."""
    if not SIGNS.search(text):
        return []
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if octets(m.group())]
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(DIGITS.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def stretches(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where the field looks: digits and at-signs outside the patterns' spans, with the words around them."""
    out: list[list[int]] = []
    k, busy = 0, sorted((a, b) for a, b, _ in taken)
    for m in SIGNS.finditer(text):
        while k < len(busy) and busy[k][1] <= m.start():
            k += 1
        if k < len(busy) and busy[k][0] < m.end():
            continue
        lo = busy[k - 1][1] if k else 0
        hi = busy[k][0] if k < len(busy) else len(text)
        a, b = m.start(), m.end()
        while a > lo and not text[a - 1].isspace() and m.start() - a < 64:
            a -= 1
        while b < hi and not text[b].isspace() and b - m.end() < 64:
            b += 1
        if a > lo and text[a - 1] == " ":  # one more word to the left
            a -= 1
            while a > lo and not text[a - 1].isspace() and m.start() - a < 96:
                a -= 1
        if m.group().endswith("@") and b < hi and text[b] == " ":  # after an at-sign, one more word to the right too
            b += 1
            while b < hi and not text[b].isspace() and b - m.end() < 96:
                b += 1
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def shape(part: str) -> str:
    s = re.sub(r"[^\W\d_]+", "w", part)
    return re.sub(r"[0-9]+", "d", s)[:24]


def features(text: str, a: int, b: int) -> list[str]:
    """Of the segment as a whole; kinds are added by the caller."""
    part = text[a:b]
    digits = DIGITS.sub("", part)
    n = len(digits)
    before = text[a - 1] if a else " "
    after = text[b] if b < len(text) else " "
    out = [
        "bias", f"shape={shape(part)}", f"digits={min(n, 20)}",
        f"groups={'-'.join(str(min(len(g), 7)) for g in DIGITS.split(part) if g)[:16]}",
        f"first={'d' if part[0].isdigit() else 'w' if part[0].isalpha() else part[0]}",
        f"last={'d' if part[-1].isdigit() else 'w' if part[-1].isalpha() else part[-1]}",
        f"before={'d' if before.isdigit() else 'w' if before.isalpha() else 's' if before.isspace() else before}",
        f"after={'d' if after.isdigit() else 'w' if after.isalpha() else 's' if after.isspace() else after}",
        f"letters={any(map(str.isalpha, part))}", f"at={'@' in part and '.' in part.partition('@')[2]}",
    ]
    if 14 <= n <= 19:
        out.append(f"luhn={luhn(digits)}")
    if part.count(".") == 3 and n:
        out.append(f"octets={octets(part) if re.fullmatch(r'[0-9]+(?:[.][0-9]+){3}', part) else False}")
    return out


class Field:
    """The weights, and sums and best ways over the divisions of a stretch."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def segments(self, text: str, a: int, b: int) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
        """Ends of the fine tokens, and the candidate segments (first token, token after the last, features)."""
        edges = [a] + [a + m.end() for m in FINE.finditer(text[a:b])]
        tokens = [text[x:y] for x, y in zip(edges, edges[1:], strict=False)]
        speaking = [t[0].isdigit() or t == "@" for t in tokens]
        sums = np.concatenate([[0], np.cumsum(speaking)])
        out = []
        for i, t in enumerate(tokens):
            if t.isspace():
                continue
            for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
                if sums[j] > sums[i] and not tokens[j - 1].isspace():
                    out.append((i, j, features(text, edges[i], edges[j])))
        return edges, out

    def scored(self, segments) -> list[list[float]]:
        get = self.weights.get
        return [[sum(get(f"{k}|{f}", 0.0) for f in fs) for k in KINDS] for _, _, fs in segments]

    def divided(self, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
        """The spans of the best division whose odds are over the margin."""
        edges, segments = self.segments(text, a, b)
        best = [0.0] + [-math.inf] * (len(edges) - 1)
        came: list[tuple[int, int, float]] = [(0, -1, 0.0)] * len(edges)
        ending: dict[int, list] = {}
        for (i, j, _), row in zip(segments, self.scored(segments), strict=True):
            k = max(range(len(KINDS)), key=row.__getitem__)
            if row[k] > 0:
                ending.setdefault(j, []).append((i, k, row[k]))
        for j in range(1, len(edges)):
            best[j], came[j] = best[j - 1], (j - 1, -1, 0.0)
            for i, k, s in ending.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], came[j] = best[i] + s, (i, k, s)
        out, j = [], len(edges) - 1
        while j:
            i, k, s = came[j]
            if k >= 0 and s > MARGIN:
                out.append((edges[i], edges[j], k))
            j = i
        return out[::-1]

    def learn(self, text: str, a: int, b: int, spans: set[tuple[int, int, int]], rate: float) -> None:
        """One gradient step on the log-likelihood of these spans in this stretch."""
        edges, segments = self.segments(text, a, b)
        scores = self.scored(segments)
        n = len(edges)
        starting: dict[int, list] = {}
        ending: dict[int, list] = {}
        for at, (i, j, _) in enumerate(segments):
            for k in range(len(KINDS)):
                starting.setdefault(i, []).append((j, scores[at][k]))
                ending.setdefault(j, []).append((i, scores[at][k]))
        ahead = [0.0] * n
        for j in range(1, n):
            ways = [ahead[j - 1]] + [ahead[i] + s for i, s in ending.get(j, ())]
            top = max(ways)
            ahead[j] = top + math.log(sum(math.exp(w - top) for w in ways))
        behind = [0.0] * n
        for i in range(n - 2, -1, -1):
            ways = [behind[i + 1]] + [behind[j] + s for j, s in starting.get(i, ())]
            top = max(ways)
            behind[i] = top + math.log(sum(math.exp(w - top) for w in ways))
        whole = ahead[-1]
        for at, (i, j, fs) in enumerate(segments):
            for k, kind in enumerate(KINDS):
                truth = (edges[i], edges[j], k) in spans
                step = rate * (truth - math.exp(min(0.0, ahead[i] + scores[at][k] + behind[j] - whole)))
                if truth or step < -1e-3:
                    for f in fs:
                        key = f"{kind}|{f}"
                        self.weights[key] = self.weights.get(key, 0.0) + step


def loosened(part: str, kind: int, dice: random.Random) -> str:
    """The same entity in a writing that the patterns miss."""
    digits = DIGITS.sub("", part)
    if kind == 0:
        return part.replace("@", " @ ")
    if kind == 2:
        return dice.choice([".", "/"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        d = digits[-10:]
        return dice.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"00{digits[:-10]} {d[:3]} {d[3:6]} {d[6:]}"])
    return part


def trained(texts: list[str], epochs: int = EPOCHS, rate: float = RATE) -> Field:
    """A field from texts with a few entities each; the order and the variants are fixed by a seed."""
    dice, examples = random.Random(7), []
    for text in texts:
        spans = base_spans(text)
        for a, b in stretches(text, spans)[:4]:  # nothing here is an entity
            if b - a < 160:
                examples.append((text[max(0, a - 1) : b + 1], min(1, a), set()))
        for a, b, k in spans[:4]:
            lo, hi = max(text.rfind(" ", 0, max(0, a - 1)) + 1, a - 24, 0), min(len(text), b + 12)
            if any(x < hi and y > lo and (x, y, z) != (a, b, k) for x, y, z in spans):
                continue
            part = text[a:b]
            for new in {part, loosened(part, k, dice)}:
                left = text[lo:a]
                examples.append((left + new + text[b:hi], 0, {(len(left), len(left) + len(new), k)}))
    field = Field()
    for epoch in range(epochs):
        dice.shuffle(examples)
        for text, a, spans in examples:
            field.learn(text, a, len(text), spans, rate / (1 + epoch))
    return field


def windows(text: str) -> list[str]:
    """Pieces of a text that hold all its digits and at-signs; signs close to each other stay together up to a bound."""
    out, first, last = [], None, 0
    for m in SIGNS.finditer(text):
        if first is not None and m.start() - first > (300 if m.start() - last > 24 else 1000):
            out.append(text[max(0, first - 100) : last + 100])
            first = None
        first, last = m.start() if first is None else first, m.end()
    if first is not None:
        out.append(text[max(0, first - 100) : last + 100])
    return out


def train(docs: DataFrame, text: str = "text", rows: int = TRAIN_ROWS) -> Field:
    """Learn from the bounded sample of the windows of all texts."""

    def cut(batches):
        for batch in batches:
            found = {w for t in batch.column(0).to_pylist() for w in windows(t)}
            some = heapq.nsmallest(rows, ((hashlib.sha256(w.encode("utf-8", "replace")).hexdigest(), w) for w in found))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], pa.string()) for i in (0, 1)], names=["o", "t"])

    some = docs.select(column(text).cast("string").alias("t")).filter(F.col("t").rlike("[0-9@]"))
    some = some.mapInArrow(cut, "o string, t string").distinct().orderBy("o", "t").limit(rows)
    return trained(sorted(r["t"] for r in some.collect()))


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The patterns' spans, and those with the field's."""
    base = base_spans(text)
    if not base and not SIGNS.search(text):
        return base, base
    more = [s for a, b in stretches(text, base) for s in field.divided(text, a, b)]
    return base, sorted([*base, *more], key=lambda s: (s[0], s[2], s[1])) if more else base


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones together, replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (the patterns' spans), spans (all) of every whole text."""
    known = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        def score(texts):
            rows = []
            for t in texts:
                base, every = all_spans(t or "", known.value)
                counts = [sum(k == i for _, _, k in base) for i in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(every)))
            return dict(zip(NAMES, zip(*rows, strict=True), strict=True))

        return score

    return annotate(docs, make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", text, keep)


NAMES = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def redact(docs: DataFrame, field: Field, added: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the redacted text as column ``added``; null stays null."""
    known = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        def score(texts):
            return {added: [None if t is None else redacted(t, all_spans(t, known.value)[1]) for t in texts]}

        return score

    return annotate(docs, make, f"`{added}` string", text, docs.columns)
