"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary texts, with a shared backoff.

Both classes have bigram models with absolute discounts; their unigrams are continuation counts (in how many
contexts a token was seen), and these back off to the continuation counts of both classes together, so an expression
rare in one class is judged by what both have seen. There are two such pairs of models: over words, and over the
overlapping UNIT-character units inside words, which knows inflected and compounded expressions. Tokens are hashed
to 2^20 numbers. A word's evidence is the difference of its two log-likelihoods. A blank-free piece of more than
LONG units (a text in Chinese or Thai, words joined by marks) is judged by all of its units, in consecutive parts of
PART units that each stand for a word; units that cross from part to part count. A text is described, by either
pair, by evidence per word, by that of its most toxic stretch of SPAN words, by the number of words of strong
evidence, and by its length; a logistic curve over these, fitted on labelled texts the counts have not seen, gives
the score.

Learning uses labelled rows outside the held-out fifth. Counts come from all of them in three of the four other
fifths, the curve from the fourth: at most ROWS texts of each class, those of the smallest hash of their id. The
counts are summed by Spark; arrays over the 2^20 numbers come back. All bigrams stay in one Spark table: while the driver
can hold them in BROADCAST_BYTES they are sent to all tasks, once and packed, because every executor writes what it is
sent to its disk; beyond that they are dealt into parts by their keys and the texts into blocks. Every block asks the
parts for its distinct bigrams and is judged with what they answer. Questions and answers are sorted keys, packed into one
row for each block and part. All texts take their turns, ROUNDS at most, and the shuffle files of a turn go with it.

Defined cases. Null and empty texts get the score of a text without evidence. Without labels of both classes every
score is 0. A document labelled twice is toxic if one label says so. Every input row gives one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyslot.llm.common import SLICE_CHARS, Numbering, annotate, column, flat_ranges, held_out, number_words, ranges, slices, split_words, sums_by_row
from tallyslot.sources.workdir import materialise, shuffles_dropped

#: Texts of a class from which the curve is fitted; counts have no bound.
ROWS = 8_000
BITS = 20
SIZE = 1 << BITS
#: Set in the keys of bigrams of units where they share a table with those of words.
UNITS = 1 << 2 * BITS
#: Bigrams are sent to all tasks up to this size, labels too; beyond it Spark joins by shuffle. A bigram's bytes are those
#: that the driver holds while it sorts and packs it.
BROADCAST_BYTES, PAIR_BYTES, MARK_BYTES = 96 << 20, 64, 32
#: Characters of the texts that meet their bigrams together when these are not sent to all tasks.
BLOCK_CHARS = 8_000_000
#: Turns in which the blocks are judged, and blocks for which another turn is worth while; bigrams of a part, about.
ROUNDS, ROUND_BLOCKS, PART_PAIRS = 4, 16, 1 << 19
SPAN, STRONG = 4, 2.5
LOWEST, HIGHEST = -4.0, 8.0
REMEMBERED = 300_000
#: Characters of a unit; units of a piece that is judged in parts, and of such a part.
UNIT, LONG, PART = 5, 64, 16
#: Units that are made at once, and characters of distinct words that a task remembers before it starts over.
RUN, REMEMBERED_CHARS = 1 << 19, 1 << 24
EDGES = ".,;:!?\"'()[]{}«»„“”"


def spelled(word: str) -> str:
    return word.lower().strip(EDGES)


def number_of(spelling: str) -> int:
    return zlib.crc32(spelling.encode("utf-8", "replace")) & (SIZE - 1)


def word_number(word: str) -> int:
    return number_of(spelled(word))


def marked_word(spelling: str) -> str:
    """What the units of a word are cut from."""
    return ("^^" + spelling + "$").ljust(UNIT, "$")


def characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-16 characters of words one after the other, and how many each word has."""
    data = np.frombuffer("".join(words).encode("utf-16-le", "surrogatepass"), "<u2")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if sizes.sum() < len(data):  # some characters take two
        sizes = np.fromiter((len(w.encode("utf-16-le", "surrogatepass")) // 2 for w in words), np.int64, len(words))
    return data, sizes


def unit_runs(words: list[str], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All units of all words, in consecutive runs of about ``most``: the word of each, its place in the word, its hashed
    number and that of the unit before it (0 at a word's start)."""
    return runs_in([marked_word(spelled(w)) for w in words], most)


def runs_in(marked: list[str], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    most = most or RUN
    for lo, hi in ranges(list(map(len, marked)), most):
        data, sizes = characters(marked[lo:hi])
        owner, none = np.arange(lo, hi), np.zeros(hi - lo, np.int64)
        if hi - lo > 1 or len(data) <= 2 * most:
            yield units_in(data, sizes, owner, none, none)
            continue
        for at in range(0, len(data) - UNIT + 1, most):
            back = min(at, 1)  # the unit before the first
            cut = data[at - back : at + most + UNIT - 1]
            yield units_in(cut, np.array([len(cut)]), owner, np.array([at]), np.array([back]))


def units_in(data: np.ndarray, sizes: np.ndarray, owner: np.ndarray, start: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = data.astype(np.uint64)
    h = np.zeros(len(data) - UNIT + 1, np.uint64)
    for k in range(UNIT):
        h *= np.uint64(0x100000001B3)
        h += data[k : k + len(h)]
        h += np.uint64(k + 1)
    per = sizes - UNIT + 1
    first = np.cumsum(per) - per
    inside = flat_ranges(np.cumsum(sizes) - sizes, per)
    units = ((h[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    before = np.concatenate([[0], units[:-1]])
    before[first] = 0
    found = np.repeat(owner, per), flat_ranges(start - back, per), units, before
    if not back.any():
        return found
    wanted = np.ones(len(units), bool)
    wanted[first[back > 0]] = False
    return tuple(x[wanted] for x in found)


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.diff(keys, prepend=-1))]


def parts_said(marked: list[str], model: KneserNey) -> tuple[np.ndarray, np.ndarray]:
    """The unit models' evidence of each part of each marked word, and the number of parts per word."""
    units = characters(marked)[1] - UNIT + 1
    parts = np.where(units > LONG, -(-units // PART), 1)
    first = np.cumsum(parts) - parts
    said = np.zeros(int(parts.sum()))
    for owner, place, unit, before in runs_in(marked):
        at = first[owner] + np.where(parts[owner] > 1, place // PART, 0)
        low = int(at[0])
        of = np.bincount(at - low, model.evidence(unit, before))
        said[low : low + len(of)] += of
    return said, parts


def unit_count(word: str) -> int:
    length = len(spelled(word).encode("utf-16-le", "surrogatepass")) // 2
    return max(1, length + 3 - UNIT + 1)


class Words:
    """The words of texts: hashed numbers and what the unit models say of each; distinct spellings are judged once."""

    def __init__(self, units=None):
        self.units = units
        self.forget()

    def forget(self) -> None:
        self.places, self.known, self.chars = Numbering(), np.zeros(0, np.int64), 0
        self.said, self.parts = np.zeros(0), np.zeros(0, np.int64)
        self.marked: list[str] = []  # without unit models, what those would read

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words among the distinct ones, and words per text."""
        if len(self.places) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        at, kinds, sizes = split_words(texts)
        at = number_words(kinds, self.places)[at]
        if len(self.places) > len(self.known):
            new = list(self.places)[len(self.known) :]
            self.chars += sum(map(len, new))
            new = list(map(spelled, new))
            self.known = np.concatenate([self.known, np.fromiter(map(number_of, new), np.int64, len(new))])
            marked = list(map(marked_word, new))
            if self.units is None:
                self.marked += marked
            else:
                said, parts = parts_said(marked, self.units)
                self.said, self.parts = np.concatenate([self.said, said]), np.concatenate([self.parts, parts])
                self.first = np.cumsum(self.parts) - self.parts
        return at, sizes

    def by_units(self, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit models' evidence of the parts of all words, and parts per text."""
        if not len(at):
            return np.zeros(0), sizes
        parts = self.parts[at]
        return self.said[flat_ranges(self.first[at], parts)], sums_by_row(parts, sizes)

    def numbered(self, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words and of the words before them (0 at a text's start)."""
        words = self.known[at]
        before = np.concatenate([[0], words[:-1]]) if len(words) else words
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        return words, before


def packed(values: np.ndarray) -> tuple[bytes, str, tuple[int, ...]]:
    """An array in fewer bytes: the first bytes of all values, then the second ones and so on, deflated."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T)
    return zlib.compress(planes, 1), values.dtype.str, values.shape


def unpacked(held: tuple[bytes, str, tuple[int, ...]]) -> np.ndarray:
    data, kind, shape = held
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(shape)


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys.astype("<i8"), prepend=0))[0]


def unpacked_long(data: bytes) -> np.ndarray:
    return unpacked((data, "<i8", (-1,)))


def part_of(keys, parts: int):
    """The part that holds a bigram: both of its tokens count, so the many bigrams of a frequent one are dealt out."""
    return ((keys >> BITS) ^ keys) & (parts - 1)


@dataclass
class KneserNey:
    pairs: np.ndarray  # sorted bigram keys
    counts: np.ndarray  # of each bigram, one column per class
    rest: np.ndarray  # per context: what is left for the unigrams
    unigram: np.ndarray  # log-free unigram probabilities, one column per class
    seen: np.ndarray  # per context: its count, one column per class
    discount: np.ndarray

    def packed(self) -> list:
        return [packed(np.diff(self.pairs, prepend=0)), *map(packed, (self.counts, self.rest, self.unigram, self.seen)), self.discount]

    @classmethod
    def unpacked(cls, held: list) -> KneserNey:
        steps, counts, rest, unigram, seen = map(unpacked, held[:5])
        return cls(np.cumsum(steps), counts, rest, unigram, seen, held[5])

    def holding(self, keys: np.ndarray, counts: np.ndarray) -> KneserNey:
        """The same model with these bigrams: keys, and counts with one column per class."""
        order = np.argsort(keys)
        return replace(self, pairs=keys[order], counts=counts.astype(np.min_scalar_type(int(counts.max(initial=0))))[order])

    def evidence(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of each word behind the one before it; each distinct bigram is judged once."""
        key, which = np.unique((before << BITS) | words, return_inverse=True)
        words, before = key & (SIZE - 1), key >> BITS
        p = self.rest[before] * self.unigram[words]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = np.flatnonzero(self.pairs[at] == key)
            kept = self.counts[at[hit]].astype(np.float32)
            kept -= self.discount.astype(np.float32)
            np.maximum(kept, 0, out=kept)
            kept /= np.maximum(1, self.seen[before[hit]])
            p[hit] += kept
        return np.clip(np.log(p[:, 1]) - np.log(p[:, 0]), LOWEST, HIGHEST)[which]


def described(r: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """What the evidence of its words says of each text."""
    n = np.maximum(1, sizes)
    strong = sums_by_row((r > STRONG).astype(np.int64), sizes)
    running = np.concatenate([[0.0], np.cumsum(r)])
    at = np.arange(len(r))
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    stretch = (running[at + 1] - running[np.maximum(starts, at + 1 - SPAN)]) / SPAN
    top, most = np.zeros(len(sizes)), np.zeros(len(sizes))
    full = np.flatnonzero(sizes)
    if len(full):
        first = (np.cumsum(sizes) - sizes)[full]
        top[full] = np.maximum.reduceat(stretch, first)
        most[full] = np.maximum.reduceat(r, first)
    return [sums_by_row(r, sizes) / n, top, most, np.log1p(strong), strong / np.sqrt(n)]


@dataclass
class ToxicModel:
    words: KneserNey
    units: KneserNey
    weights: np.ndarray
    scale: np.ndarray
    #: p, k, n0, n1: all bigrams of both pairs of models, packed by ``parts`` parts, where they are too many to be sent to all
    #: tasks; the units' keys have UNITS set
    stored: DataFrame | None = None
    parts: int = 1
    #: both pairs of models as the tasks have them, sent once
    sent: Broadcast | None = None

    def send(self, spark: SparkSession) -> Broadcast:
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast(Sent([self.words.packed(), self.units.packed()]))
        return self.sent

    def holding(self, keys: np.ndarray, n: np.ndarray) -> ToxicModel:
        """The same model with these bigrams: keys, the units' with UNITS set, and counts with one column per class."""
        of = keys >= UNITS
        words, units = (x.holding(keys[of == i] & (UNITS - 1), n[of == i]) for i, x in enumerate((self.words, self.units)))
        return replace(self, words=words, units=units, stored=None, sent=None)

    def features(self, read: Words, texts: list[str | None]) -> np.ndarray:
        at, sizes = read.read(texts)
        by_words = self.words.evidence(*read.numbered(at, sizes))
        by_units, parts = read.by_units(at, sizes)
        by_units = np.clip(by_units, 2 * LOWEST, 2 * HIGHEST)
        return np.stack([*described(by_words, sizes), *described(by_units, parts), np.log(np.maximum(1, sizes))], axis=1)

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.hstack([features / self.scale, np.ones((len(features), 1))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


class Sent:
    """Both pairs of models, packed until a task asks for them; then its worker keeps them."""

    def __init__(self, held: list):
        self.held, self.models = held, None

    def model(self, weights: np.ndarray, scale: np.ndarray) -> ToxicModel:
        if self.models is None:
            self.models, self.held = [KneserNey.unpacked(x) for x in self.held], []
        return ToxicModel(*self.models, weights, scale)


FEATURES = 11


def fitted(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a logistic curve by Newton steps, and the columns' scales."""
    scale = np.maximum(1e-6, x.std(axis=0))
    x = np.hstack([x / scale, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (w * (y - p)) - ridge * b
        bend = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b = b + np.linalg.solve(bend, slope)
    return b, scale


def marked(labels: DataFrame) -> DataFrame:
    """i, y, fold of the labelled documents that may be learned from."""
    marks = labels.select(column("doc_id").alias("i"), column("toxic").cast("int").alias("y"))
    marks = marks.filter(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y"))
    return marks.withColumn("fold", F.crc32(F.col("i").cast("string").cast("binary")) % 5)


def labelled(docs: DataFrame, marks: DataFrame, small: bool) -> DataFrame:
    """t, y of the texts of ``marks``, which are sent to all tasks if they are small."""
    texts = docs.select(column("doc_id").alias("i"), column("text").cast("string").alias("t")).filter(F.col("i").isNotNull())
    marks = marks.select("i", "y")
    return texts.join(F.broadcast(marks) if small else marks, "i").select("t", "y")


def curve_marks(marks: DataFrame, rows: int) -> DataFrame:
    marks = marks.filter("fold = 4").withColumn("o", F.xxhash64(F.col("i").cast("string")))
    one, none = (marks.filter(F.col("y") == y).orderBy("o", "i").limit(rows) for y in (1, 0))
    return one.union(none)


def kneser_ney(pairs: DataFrame) -> KneserNey | None:
    """The models of both classes from bigrams k and their counts n0, n1, without bigrams; what is collected has a
    fixed size."""
    n = [F.col("n0"), F.col("n1")]
    many = pairs.agg(*[F.count_if(x == times).alias(f"c{c}_{times}") for c, x in enumerate(n) for times in (1, 2)], *[F.max(x).alias(f"m{c}") for c, x in enumerate(n)]).first()
    if not (many["m0"] and many["m1"]):
        return None
    d = np.array([many[f"c{c}_1"] / max(1, many[f"c{c}_1"] + 2 * many[f"c{c}_2"]) for c in (0, 1)])
    d = np.where((d > 0) & (d < 1), d, 0.75)

    def dense(at: Column, *of: Column) -> list[np.ndarray]:
        got = pairs.groupBy(at.cast("int").alias("t")).agg(*of).toArrow()
        where = got.column(0).to_numpy()
        out = [np.zeros((SIZE, 2)) for _ in range(len(of) // 2)]
        for i in range(len(of)):
            out[i // 2][where, i % 2] = got.column(i + 1).to_numpy()
        return out

    kinds_of = [F.count_if(x > 0) for x in n]
    seen, kinds = dense(F.shiftright("k", BITS), *[F.sum(x) for x in n], *kinds_of)
    (after,) = dense(F.col("k").bitwiseAND(SIZE - 1), *kinds_of)
    rest = np.where(seen > 0, d * kinds / np.maximum(1, seen), 1.0)  # every bigram gives up the discount
    both = after.sum(axis=1)
    shared = (both + 1) / (both.sum() + SIZE)
    total = np.maximum(1, after.sum(axis=0))
    left = (np.minimum(after, d).sum(axis=0) / total) * shared[:, None]
    unigram = np.maximum(after - d, 0) / total + left
    rest, unigram, seen = (x.astype(np.float32) for x in (np.maximum(rest, 1e-6), unigram, seen))
    return KneserNey(np.zeros(0, np.int64), np.zeros((0, 2), np.uint8), rest, unigram, seen, d)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most_bytes: int = BROADCAST_BYTES) -> ToxicModel | None:
    with shuffles_dropped(docs.sparkSession):
        return learned(docs, labels, rows, most_bytes)


def learned(docs: DataFrame, labels: DataFrame, rows: int, most_bytes: int) -> ToxicModel | None:
    marks = materialise(marked(labels), "toxic-marks")
    small = marks.count() * MARK_BYTES <= BROADCAST_BYTES

    def counted(m, keys, n):
        """Bigrams and their counts, from keys with the class before them."""
        of = keys >> (2 * BITS)
        values = np.full(len(keys), m, np.int32), keys & ((1 << 2 * BITS) - 1), np.where(of == 0, n, 0), np.where(of == 1, n, 0)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["m", "k", "n0", "n1"])

    def count(batches):
        read = Words()
        for batch in batches:
            t, y = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist())
            for lo, hi in slices(t):
                at, sizes = read.read(t[lo:hi])
                words, before = read.numbered(at, sizes)
                of = np.repeat(y[lo:hi], sizes)
                keys, n = np.unique((of << (2 * BITS)) | (before << BITS) | words, return_counts=True)
                yield counted(0, keys, n)
                pair, times = np.unique((at << 1) | of, return_counts=True)
                for owner, _, units, behind in runs_in([read.marked[i] for i in (pair >> 1).tolist()]):
                    keys, where = np.unique(((pair & 1)[owner] << (2 * BITS)) | (behind << BITS) | units, return_inverse=True)
                    n = np.bincount(where, times[owner], len(keys)).astype(np.int64)
                    yield counted(1, keys, n)

    texts = labelled(docs, marks.filter("fold < 4"), small)
    pairs = texts.mapInArrow(count, "m int, k long, n0 long, n1 long").groupBy("m", "k").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    pairs = materialise(pairs, "toxic-bigrams")
    words, units = (kneser_ney(pairs.filter(F.col("m") == m).drop("m")) for m in (0, 1))
    if words is None or units is None:
        return None
    model = ToxicModel(words, units, np.zeros(FEATURES + 1), np.ones(FEATURES))
    many = pairs.count()
    if many * PAIR_BYTES <= most_bytes:
        # one pair of models after the other, in narrow columns: the driver holds little more than what it sends
        for m, name in enumerate(("words", "units")):
            got = pairs.filter(F.col("m") == m).select("k", *[F.col(c).cast("float") for c in ("n0", "n1")]).toArrow()
            counts = np.empty((len(got), 2), np.float32)
            counts[:, 0], counts[:, 1] = got.column("n0").to_numpy(), got.column("n1").to_numpy()
            keys = got.column("k").to_numpy()
            del got
            model = replace(model, **{name: getattr(model, name).holding(keys, counts)})
    else:
        model.parts = 1 << (many // PART_PAIRS).bit_length()
        model.stored = packed_parts(pairs, model.parts)
    names = [f"f{i}" for i in range(FEATURES)]
    sample = labelled(docs, curve_marks(marks, rows), True)
    got = told(sample, model, lambda _, x: dict(zip(names, x.T, strict=True)), ", ".join(f"{n} double" for n in names), "t", ["y"]).toArrow()
    x = np.stack([got.column(n).to_numpy() for n in names], axis=1)
    y = got.column("y").to_numpy()
    if len(set(y.tolist())) == 2:
        # the sample holds up to as many rows of either class; each counts as often as it is labelled
        share = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
        weight = np.where(y == 1, share.get(1, 1) / max(1, (y == 1).sum()), share.get(0, 1) / max(1, (y == 0).sum()))
        model.weights, model.scale = fitted(x, y, weight * len(y) / weight.sum())
    return model


def packed_parts(pairs: DataFrame, parts: int) -> DataFrame:
    """p, k, n0, n1: one row per part with its bigrams in the order of their keys, from m, k, n0, n1."""

    def pack(part: pa.Table) -> pa.Table:
        p, k, *n = (part.column(c).to_numpy() for c in ("p", "k", "n0", "n1"))
        order = np.argsort(k)
        return pa.table({"p": p[:1], "k": [packed_keys(k[order])], **{f"n{i}": [packed(x[order].astype("<i8"))[0]] for i, x in enumerate(n)}})

    pairs = pairs.select(F.col("k").bitwiseOR(F.col("m").cast("long") * UNITS).alias("k"), "n0", "n1")
    both = F.shiftright("k", BITS).bitwiseXOR(F.col("k")).bitwiseAND(F.lit(parts - 1))  # as in part_of
    pairs = pairs.select(both.alias("p"), "k", "n0", "n1")
    return materialise(pairs.groupBy("p").applyInArrow(pack, "p long, k binary, n0 binary, n1 binary"), "toxic-parts")


def told(df: DataFrame, model: ToxicModel, say: Callable[[ToxicModel, np.ndarray], dict], added: str, text: str, keep: list[str] | None) -> DataFrame:
    """The columns of ``keep`` and those that ``say`` makes of the features of every whole text."""
    known, weights, scale = model.send(df.sparkSession), model.weights, model.scale
    if model.stored is None:

        def make():
            here = known.value.model(weights, scale)
            read = Words(here.units)
            return lambda texts: say(here, here.features(read, texts))

        return annotate(df, make, added, text, keep)
    keep = ["doc_id"] if keep is None else keep
    held = [f"c{i}" for i in range(len(keep))]
    rows = df.select(*[column(k).alias(c) for k, c in zip(keep, held, strict=True)], column(text).cast("string").alias("whole"))
    size = rows.agg(F.sum(F.coalesce(F.char_length("whole"), F.lit(0)) + 64)).first()[0] or 0
    blocks, parts = size // BLOCK_CHARS + 1, model.parts
    rows = rows.withColumn("b", F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)))
    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keep] + T._parse_datatype_string(added).fields)
    stored = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    shown = to_arrow_schema(stored)

    def ask(block: pa.Table) -> pa.Table:
        words, units = distinct_bigrams(block.column("whole").to_pylist())
        keys = np.concatenate([words, units | UNITS])
        part = part_of(keys, parts)
        order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")  # keys stay sorted within a part
        found, first = np.unique(part[order], return_index=True)
        asked = [packed_keys(k) for k in np.split(keys[order], first[1:])] if len(keys) else []
        return pa.table({"b": np.full(len(found), block.column("b")[0].as_py()), "p": found, "k": pa.array(asked, pa.binary())})

    kinds = pa.schema([("b", pa.int64()), ("k", pa.binary()), ("n0", pa.binary()), ("n1", pa.binary())])

    def answer(asked: pa.Table, part: pa.Table) -> pa.Table:
        out = []
        if len(asked) and len(part):
            known = np.cumsum(unpacked_long(part.column("k")[0].as_py()))
            n = [unpacked_long(part.column(c)[0].as_py()) for c in ("n0", "n1")]
            for b, data in zip(asked.column("b").to_pylist(), asked.column("k").to_pylist(), strict=True):
                keys = np.cumsum(unpacked_long(data))
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                at = at[known[at] == keys]
                if len(at):
                    out.append((b, packed_keys(known[at]), *[packed(x[at])[0] for x in n]))
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kinds)], schema=kinds)

    def meet(block: pa.Table, found: pa.Table) -> pa.Table:
        none = [np.zeros(0, np.int64)]
        keys = np.concatenate([np.cumsum(unpacked_long(k)) for k in found.column("k").to_pylist()] or none)
        n = np.stack([np.concatenate([unpacked_long(x) for x in found.column(c).to_pylist()] or none) for c in ("n0", "n1")], axis=1)
        mine = known.value.model(weights, scale).holding(keys, n)
        read, texts = Words(mine.units), block.column("whole")
        out = []
        for lo, hi in ranges(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), SLICE_CHARS):
            got = say(mine, mine.features(read, texts.slice(lo, hi - lo).to_pylist()))
            values = [block.column(c).slice(lo, hi - lo) for c in held]
            values += [pa.array(got[f.name], type=shown.field(i).type) for i, f in list(enumerate(schema))[len(keep) :]]
            out.append(pa.Table.from_arrays(values, names=shown.names))
        return pa.concat_tables(out) if out else shown.empty_table()

    def judged(rows: DataFrame) -> DataFrame:
        dealt = rows.groupBy("b")
        asked = dealt.applyInArrow(ask, "b long, p long, k binary")
        found = asked.groupBy("p").cogroup(model.stored.groupBy("p")).applyInArrow(answer, "b long, k binary, n0 binary, n1 binary")
        return materialise(dealt.cogroup(found.groupBy("b")).applyInArrow(meet, stored), "toxic-told")

    rounds = max(1, min(ROUNDS, blocks // ROUND_BLOCKS))
    with shuffles_dropped(df.sparkSession):
        done = [judged(rows.filter(F.col("b") % rounds == i)) for i in range(rounds)]
    return reduce(DataFrame.unionAll, done).toDF(*schema.names)


def distinct_bigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bigrams of words and of units in texts."""
    read = Words()
    words, before = read.numbered(*read.read(texts))
    runs = [distinct((behind << BITS) | units) for _, _, units, behind in runs_in(read.marked)]
    return distinct((before << BITS) | words), distinct(np.concatenate([np.zeros(0, np.int64), *runs]))


def toxicity(docs: DataFrame, model: ToxicModel | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) of every whole text."""
    added = "score double, predicted int"
    if model is None:
        return annotate(docs, lambda: lambda texts: {"score": [0.0] * len(texts), "predicted": [0] * len(texts)}, added, text, keep)

    def say(known: ToxicModel, features: np.ndarray) -> dict:
        p = known.score(features)
        return {"score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return told(docs, model, say, added, text, keep)
