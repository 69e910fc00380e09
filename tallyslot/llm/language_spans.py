"""Language identification of mixed-language texts: Viterbi over per-word scores with a switching penalty.

Words are cut at changes of script, and what is longer than PIECE characters (text in Chinese or Thai, words joined by
marks) into consecutive pieces; each piece is labelled. Its script (a range of code points) narrows the languages it may
belong to: those that wrote a fair share of their training letters in the script. Its score for each of them is the log-likelihood of the
padded byte n-grams that begin in it, also those that end in the next piece, from hashed counts with additive smoothing. The best sequence of labels pays PENALTY for every change of language,
which gives spans; the language of a text is the one whose spans hold the most letters, its score their share,
tempered by how clearly the spans' own words speak for it.

Learning sees text and non-null lang of documents outside the held-out fifth, from a bounded sample of them: at
most TRAIN_ROWS rows, those of the smallest hash of their id and text, each with its whole text. Prediction reads nothing but the text.

Defined cases. Null texts and texts without letters are `und` with score 0. With no language learned, everything
is `und`. Ties go to the language that comes first by name. Every input row gives one row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyslot.llm.common import Numbering, annotate, column, flat_ranges, held_out, number_words, slices, sums_by_row

TRAIN_ROWS = 20_000
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
PENALTY = 6.0
#: Share of a language's letters that a script must hold for the language to be a candidate for it.
SCRIPT_SHARE = 0.02
#: Characters of a piece that gets a label of its own.
PIECE = 24
#: Words, and characters of them, whose scores a task remembers before it starts over.
REMEMBERED, REMEMBERED_CHARS = 300_000, 1 << 24
#: Pieces whose n-grams are made at once.
RUN = 1 << 15
#: Characters of text that are labelled at once; a task holds some 40 bytes for each of them.
LABELLED_CHARS = 2_000_000

# First code points of the letters of scripts, in order; a script reaches to the next entry.
SCRIPT_STARTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
STARTS = np.array([a for a, _ in SCRIPT_STARTS])
SCRIPT_AT = np.array([0, *[SCRIPTS.index(s) for _, s in SCRIPT_STARTS]])
LATIN = SCRIPTS.index("latin")
#: All letters before this character are Latin.
GREEK = "\u0370"


def letters_of(word: str) -> tuple[int, int]:
    """Letters in a word, and the set of their scripts as bits."""
    if max(word, default="") < GREEK:
        n = len(word) if word.isalpha() else sum(map(str.isalpha, word))
        return n, (1 << LATIN) if n else 0
    found = [ord(c) for c in word if c.isalpha()]
    bits = 0
    for s in set(SCRIPT_AT[np.searchsorted(STARTS, found, side="right")].tolist()):
        bits |= 1 << s
    return len(found), bits


def script_runs(word: str) -> list[str]:
    """A word cut where its letters change script; other characters stay with the letters before them."""
    if max(word, default="") < GREEK:
        return [word]
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.flatnonzero(np.fromiter(map(str.isalpha, word), bool, len(word)))
    script = SCRIPT_AT[np.searchsorted(STARTS, points[at], side="right")]
    cuts = at[1:][script[1:] != script[:-1]].tolist()
    return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]


def pieces_of(word: str) -> list[tuple[str, bytes, int]]:
    """The pieces of a word: text, its bytes with up to three that follow, and how many of these it owns."""
    out = []
    for run in script_runs(word):
        for at in range(0, len(run), PIECE):
            own = run[at : at + PIECE]
            raw = own.lower().encode("utf-8", "replace")
            if not at:
                raw = b"\x02" + raw
            if at + PIECE >= len(run):
                out.append((own, raw + b"\x03", len(raw) + 1))
            else:
                ahead = run[at + PIECE : at + PIECE + 3].lower().encode("utf-8", "replace") + b"\x03"
                out.append((own, raw + ahead[: max(ORDERS) - 1], len(raw)))
    return out


def gram_buckets(raw: list[bytes], owned: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that begin in the owned bytes of each piece, within each order one piece after the other,
    and the piece of each."""
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(data))  # bytes from here to the end
    of = np.repeat(np.arange(len(raw)), lengths)
    mine = left > np.repeat(lengths - np.array(owned, np.int64), lengths)
    buckets, owners, h = [], [], np.zeros(len(data), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > len(data):
            break
        h = h[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            inside = (left[: len(h)] >= n) & mine[: len(h)]
            mixed = h[inside] * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(48)).astype(np.int64) % BUCKETS)
            owners.append(of[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class LanguageModel:
    languages: list[str]
    #: log-likelihoods, one row per bucket, one column per language
    table: np.ndarray
    #: may a language's word be written in the script: scripts x languages
    allowed: np.ndarray

    def piece_scores(self, pieces: list[tuple[str, bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (pieces x languages; 0 for all where a piece says nothing) and numbers of letters."""
        counts, bits = np.array([letters_of(p) for p, _, _ in pieces], np.int64).reshape(-1, 2).T
        out = np.zeros((len(pieces), len(self.languages)), np.float32)
        speaking = np.flatnonzero(counts)
        for lo in range(0, len(speaking), RUN):
            some = speaking[lo : lo + RUN]
            buckets, owners = gram_buckets([pieces[i][1] for i in some], [pieces[i][2] for i in some])
            for k in range(len(self.languages)):
                out[some, k] = np.bincount(owners, self.table[buckets, k], len(some))
        for b in np.unique(bits[speaking]).tolist():
            may = np.all([self.allowed[s] for s in range(len(SCRIPTS)) if b >> s & 1], axis=0)
            if may.any() and not may.all():
                out[np.ix_(np.flatnonzero((bits == b) & (counts > 0)), np.flatnonzero(~may))] -= 1e4
        # only differences matter; the best is 0 and one piece cannot outvote many
        best = out.max(axis=1, keepdims=True)
        return np.maximum(out - best, -12.0), counts


def train(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", rows: int = TRAIN_ROWS) -> LanguageModel:
    """Count n-grams and scripts per language over a bounded sample, inside the tasks; only tables come back."""
    known = docs.select(column(doc_id).alias("i"), column(text).cast("string").alias("t"), column(lang).cast("string").alias("l"))
    known = known.filter(F.col("t").isNotNull() & F.col("l").isNotNull() & ~held_out(F.col("i")))
    known = known.withColumn("o", F.xxhash64(F.col("i").cast("string"), "t"))
    edge = known.select("o").orderBy("o").limit(rows).agg(F.max("o")).first()[0]  # of the hashes only, never of the texts
    known = known.filter(F.col("o") <= edge) if edge is not None else known

    def count(batches):
        grams, scripts = {}, {}
        for batch in batches:
            for lo, hi in slices(batch.column(1).to_pylist()):
                for l, t in zip(batch.column(0).to_pylist()[lo:hi], batch.column(1).to_pylist()[lo:hi], strict=True):
                    words = t.split()
                    pieces = [p for w in words for p in pieces_of(w)]
                    for at in range(0, len(pieces), RUN):
                        _, raw, owned = zip(*pieces[at : at + RUN], strict=True)
                        grams[l] = grams.get(l, 0) + np.bincount(gram_buckets(raw, owned)[0], minlength=BUCKETS)
                    if words:
                        held = scripts.setdefault(l, np.zeros(len(SCRIPTS), np.int64))
                        points = [ord(c) for c in "".join(words) if c.isalpha()]
                        held += np.bincount(SCRIPT_AT[np.searchsorted(STARTS, points, side="right")].astype(np.int64), minlength=len(SCRIPTS))
        for l, g in grams.items():
            at = np.flatnonzero(g)
            yield pa.RecordBatch.from_arrays(
                [pa.array([l] * len(at)), pa.array(at.astype(np.int32)), pa.array(g[at].astype(np.int64))], names=["l", "b", "n"]
            )
            at = np.flatnonzero(scripts[l])
            yield pa.RecordBatch.from_arrays(
                [pa.array([l] * len(at)), pa.array((BUCKETS + at).astype(np.int32)), pa.array(scripts[l][at])], names=["l", "b", "n"]
            )

    counts = known.select("l", "t").mapInArrow(count, "l string, b int, n long")
    got = counts.groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column(0).to_pylist()))
    full = np.zeros((BUCKETS + len(SCRIPTS), len(names)))
    column_of = {l: k for k, l in enumerate(names)}
    if names:
        full[got.column(1).to_numpy(), [column_of[l] for l in got.column(0).to_pylist()]] = got.column(2).to_numpy()
    grams, scripts = full[:BUCKETS], full[BUCKETS:]
    table = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    return LanguageModel(names, table, scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0)))


def best_labels(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of all words of several texts, whose scores stand one text after the other.

    Texts step together, the longest first, so that each step is one numpy operation over those still running.
    """
    n, k = scores.shape
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max()) if len(lengths) else 0
    running = np.searchsorted(-lengths[order], -np.arange(steps), side="left")  # texts longer than each step
    back = np.zeros((n, k), np.int16)
    state = np.zeros((len(lengths), k), np.float32)
    begin = starts[order]
    stay = np.arange(k, dtype=np.int16)
    for step in range(steps):
        m = running[step]
        at = begin[:m] + step
        if step:
            now = state[:m]
            best = now.argmax(axis=1)
            top = now[np.arange(m), best] - penalty
            switch = top[:, None] > now
            back[at] = np.where(switch, best[:, None].astype(np.int16), stay)
            state[:m] = np.maximum(now, top[:, None]) + scores[at]
        else:
            state[:m] = scores[at]
    label = np.zeros(n, np.int16)
    current = state.argmax(axis=1).astype(np.int16)
    for step in range(steps - 1, -1, -1):
        m = running[step]
        at = begin[:m] + step
        label[at] = current[:m]
        current[:m] = back[at, current[:m]]
    return label


class SpanLabeller:
    def __init__(self, model: LanguageModel, penalty: float = PENALTY):
        self.model, self.penalty = model, penalty
        self.forget()

    def forget(self) -> None:
        self.numbers, self.chars = Numbering(), 0
        self.first, self.parts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.scores, self.letters = np.zeros((0, len(self.model.languages)), np.float32), np.zeros(0, np.int64)

    def labelled(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text and pieces of each word; labels, letters and scores of all pieces, one text after the other."""
        if len(self.numbers) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        words = [(t or "").split() for t in texts]
        at = number_words([w for ws in words for w in ws], self.numbers)
        if len(self.numbers) > len(self.parts):
            new = list(self.numbers)[len(self.parts):]
            self.chars += sum(map(len, new))
            cut = [pieces_of(w) for w in new]
            scores, letters = self.model.piece_scores([p for ps in cut for p in ps])
            self.scores = np.concatenate([self.scores, scores])
            self.letters = np.concatenate([self.letters, letters])
            self.parts = np.concatenate([self.parts, np.fromiter(map(len, cut), np.int64, len(cut))])
            self.first = np.cumsum(self.parts) - self.parts
        parts = self.parts[at]
        at = flat_ranges(self.first[at], parts)
        scores, letters = self.scores[at], self.letters[at]
        lengths = sums_by_row(parts, np.array([len(ws) for ws in words], np.int64))
        return words, parts, best_labels(scores, lengths, self.penalty), letters, scores

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(first piece, piece after the last, language) of each span of a text; most words are one piece."""
        if not self.model.languages or not (text or "").split():
            return []
        _, _, labels, _, _ = self.labelled([text])
        cuts = np.flatnonzero(np.diff(labels)) + 1
        edges = [0, *cuts.tolist(), len(labels)]
        return [(a, b, self.model.languages[labels[a]]) for a, b in zip(edges, edges[1:], strict=False)]

    def __call__(self, texts: list[str | None]) -> dict:
        k = len(self.model.languages)
        none = {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "n_spans": [0] * len(texts)}
        if not k:
            return none
        words, parts, labels, letters, scores = self.labelled(texts)
        row = np.repeat(np.repeat(np.arange(len(texts)), [len(ws) for ws in words]), parts)
        held = np.bincount(row * k + labels, letters, len(texts) * k).reshape(-1, k)
        total = held.sum(axis=1)
        best = held.argmax(axis=1)
        margin = np.bincount(row, scores[np.arange(len(row)), best[row]] - np.where(
            np.arange(k) == best[row][:, None], -np.inf, scores).max(axis=1) if k > 1 else np.ones(len(row)), len(texts))
        sure = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        share = held.max(axis=1) / np.maximum(1, total)
        change = np.flatnonzero((labels[1:] != labels[:-1]) & (row[1:] == row[:-1]))
        n_spans = np.bincount(row[change], minlength=len(texts)) + (total > 0)
        return {
            "lang_pred": [self.model.languages[b] if t else "und" for b, t in zip(best.tolist(), total.tolist(), strict=True)],
            "score": np.where(total > 0, np.clip(share * sure, 0, 1), 0.0),
            "n_spans": np.where(total > 0, n_spans, 0),
        }


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The columns of ``keep`` (doc_id), lang_pred, score, n_spans (spans of one language) of every whole text."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, lambda: SpanLabeller(known.value), "lang_pred string, score double, n_spans long", text, keep, prefix, LABELLED_CHARS)
