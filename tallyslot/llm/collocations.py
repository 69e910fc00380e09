"""Phrase collocations by the stripes pattern.

A stripe is a prefix of words with an associative counter of the words that follow it inside a piece. Tasks emit
stripes, stripes of one prefix are merged element by element, and everything the report needs is read from them:

* the stripe of the empty prefix counts the words; its total is ``n``;
* stripes of one word count its extensions, the two-word phrases;
* stripes of two words count the three-word phrases, and their largest counters say which phrases are subsumed.

The total of a prefix is the counter under which the prefix itself stands in the stripe one word shorter.

A phrase with ``least`` occurrences holds only words and phrases with as many. So a level counts only extensions
whose shorter phrases passed the level before; the tasks ask a Bloom filter of at most 2^``filter_bits`` bits (32 MB,
broadcast). What passes it by mistake is counted too and then falls under ``least``, so the filter only saves work.

Inside stripes a word is a 64-bit hash. Whether two words of a language share one is looked up in the table of all
words first; if so, another seed is taken, so equal hashes are equal words.

A prefix that occurs more than ``hot`` times (or more than 1 / ``HOT_PREFIXES`` of all words, if that is more) is cut
by the hash of the next word into stripes of about that many occurrences, so no stripe is merged in one task whole.

Cases: null text is empty, null lang is ``und``. Words may be of any length. Texts longer than a block are cut at
separators, which no phrase crosses. Ties in score and count are ordered by the phrase's UTF-8 bytes. Repeated rows
count again. Empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyslot.llm.byte_words import Machine, Texts, blocks, hash_spans, insert_spans, name_hash, scramble, span_strings
from tallyslot.llm.common import column
from tallyslot.sources.workdir import materialise

LEAST = 10
TOP = 2000
HOT_PREFIXES = 1 << 16


@dataclass(frozen=True)
class Limits:
    """What bounds the work of a task; no value changes the result."""

    #: Occurrences of a prefix beyond which its stripe is cut.
    hot: int = 1 << 20
    #: Bytes of text that are worked on at once.
    block: int = 4 << 20
    #: The largest Bloom filter has two to this power bits.
    filter_bits: int = 28
    #: Entries of one stripe row; a longer stripe is several rows, so a batch of rows stays small.
    entries: int = 1024
    hash_bits: int = 64
    seed: int = 0


# What ends a piece, the blanks between words, the share of a phrase that a longer one has to cover.
SEPARATORS = b".,;:!?" + bytes(range(0x0A, 0x0E))
BLANKS = b" \t"
COVERED_PER_CENT = 50

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
SEPARATOR = 2


def _step() -> np.ndarray:
    step = np.zeros((2, 256), np.uint8)
    step[:, [b for b in range(256) if b not in SEPARATORS + BLANKS]] |= Machine.INSIDE
    step[:, list(SEPARATORS)] |= SEPARATOR
    return step


MACHINE = Machine(_step())


class Bloom:
    """Membership of 64-bit keys with three probes a key; says yes for every key put in, and for a few others."""

    SHIFTS = (0, 18, 36)

    def __init__(self, log2: int, packed: np.ndarray):
        self.mask, self.packed = np.uint64((1 << log2) - 1), packed

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for shift in self.SHIFTS:
            place = (keys >> np.uint64(shift)) & self.mask
            out &= (self.packed[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def bloom(keys: DataFrame, bits: int) -> Bloom:
    """The filter of a column ``key``. Spark sets the bits; the driver gets them packed, 4 KB a row, 32 MB at most."""
    log2 = min(bits, max(15, (16 * keys.count()).bit_length()))
    place = F.explode(F.array(*[F.shiftrightunsigned("key", s).bitwiseAND(F.lit((1 << log2) - 1)) for s in Bloom.SHIFTS]))
    packed = np.zeros(1 << (log2 - 3), np.uint8)
    pages = keys.select(place.alias("place")).groupBy(F.shiftright("place", 15).alias("page")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(0x7FFF))).alias("bits")
    )
    for row in pages.collect():
        part = np.frombuffer(row["bits"], np.uint8)
        packed[row["page"] * 4096 : row["page"] * 4096 + len(part)] = part
    return Bloom(log2, packed)


class Hot:
    """How many stripes a hot prefix is cut into, by the prefix's key; there are at most ``HOT_PREFIXES`` such keys."""

    def __init__(self, counts: DataFrame, total: int, hot: int):
        limit = max(hot, total // HOT_PREFIXES)
        rows = counts.where(F.col("n") > limit).select("key", F.ceil(F.col("n") / limit).alias("cuts")).collect()
        keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.cuts = keys[order], np.array([r["cuts"] for r in rows], np.int64)[order]

    def cut(self, keys: np.ndarray, following: np.ndarray) -> np.ndarray:
        """The number of the cut that each (prefix key, next word) belongs to; 0 where the prefix is not hot."""
        out = np.zeros(len(keys), np.int32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = np.flatnonzero(self.keys[at] == keys)
            out[found] = ((following[found] >> np.uint64(20)) % self.cuts[at[found]].astype(np.uint64)).astype(np.int32)
        return out


class Words:
    """The words of a block: their numbers among the block's distinct words of a language, and which two are neighbours."""

    def __init__(self, texts: Texts, langs: np.ndarray, lang_hashes: np.ndarray, limits: Limits):
        texts.data[:] = _LOWER[texts.data]
        flags = MACHINE.run(texts.data, texts.first)
        starts, lengths = texts.spans((flags & Machine.INSIDE).astype(bool))
        row = texts.owner_of(starts)
        piece = np.cumsum(flags & SEPARATOR != 0)[starts] if len(starts) else starts
        hashes = hash_spans(texts, starts, lengths, limits.seed) >> np.uint64(64 - limits.hash_bits)
        stands = insert_spans(texts, starts, lengths, hashes, langs[row])
        self.distinct = np.flatnonzero(stands == np.arange(len(starts)))
        number = np.empty(len(starts), np.int64)
        number[self.distinct] = np.arange(len(self.distinct))
        self.ids = number[stands]
        self.starts, self.lengths = starts[self.distinct], lengths[self.distinct]
        self.langs = langs[row[self.distinct]]
        self.hashes = hashes[self.distinct]
        self.keys = scramble(self.hashes ^ lang_hashes[self.langs])
        #: Whether a word and the one after it stand in the same piece of the same text.
        self.joined = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])


def pair_keys(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of two-word phrases of words with the numbers ``a`` and ``b``."""
    return pair_key(words.keys[a], words.hashes[b])


def pair_key(first_key: np.ndarray, second_hash: np.ndarray) -> np.ndarray:
    return scramble(first_key * np.uint64(3) + second_hash)


def _short(texts: Texts, rows: np.ndarray, limit: int) -> Iterator[tuple[Texts, np.ndarray]]:
    """The block, or where one text exceeds the limit, parts of that text cut behind separators."""
    if len(texts.ends) > 1 or texts.size <= limit:
        yield texts, rows
        return
    stops = np.flatnonzero(MACHINE.step[texts.data] & SEPARATOR) + 1
    lo = 0
    while lo < texts.size:
        near = stops[np.searchsorted(stops, lo, side="right") : np.searchsorted(stops, lo + limit, side="right")]
        later = stops[stops > lo + limit][:1]
        hi = int(near[-1]) if len(near) else int(later[0]) if len(later) else texts.size
        hi = texts.size if texts.size - lo <= limit else hi
        yield Texts(texts.data[lo:hi], np.array([hi - lo])), rows
        lo = hi


def _words_of(batches, limits: Limits) -> Iterator[tuple[Words, Texts, list[str]]]:
    """The words of each block of a stream of (lang, text) batches, with the names of the languages' numbers."""
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        names = coded.dictionary.to_pylist()
        lang_hashes = np.array([name_hash(x, limits.seed) for x in names], np.uint64)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi, texts in blocks(batch.column(1), limits.block):
            for part, rows in _short(texts, codes[lo:hi], limits.block):
                words = Words(part, rows, lang_hashes, limits)
                if len(words.ids):
                    yield words, part, names


def _named(names: list[str], codes: np.ndarray) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(codes))


def word_counts(docs: DataFrame, limits: Limits) -> DataFrame:
    """``lang, word, hash, key, n``: the stripe of the empty prefix, merged."""

    def run(batches):
        for words, texts, names in _words_of(batches, limits):
            n = np.bincount(words.ids, minlength=len(words.distinct))
            yield pa.RecordBatch.from_arrays(
                [
                    _named(names, words.langs), span_strings(texts, words.starts, words.lengths),
                    pa.array(words.hashes.view(np.int64)), pa.array(words.keys.view(np.int64)), pa.array(n),
                ],
                names=["lang", "word", "hash", "key", "n"],
            )

    emitted = docs.mapInArrow(run, "lang string, word string, hash long, key long, n long")
    return emitted.groupBy("lang", "word", "hash", "key").agg(F.sum("n").alias("n"))


def _packed(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Runs of numbers that begin at ``begins`` as binary values."""
    ends = np.append(begins[1:], len(values))
    offsets = (np.concatenate([begins[:1], ends]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _stripe_rows(langs: pa.Array, first, second, prefix: np.ndarray, cut: np.ndarray, following: np.ndarray, n: np.ndarray, entries: int) -> pa.RecordBatch:
    """Stripe rows from entries that are sorted by (prefix, cut); the first four describe each entry."""
    new = np.ones(len(prefix), bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (cut[1:] != cut[:-1])
    heads = np.flatnonzero(new)
    within = np.arange(len(prefix)) - np.repeat(heads, np.diff(np.append(heads, len(prefix))))
    begins = np.flatnonzero(within % entries == 0)
    return pa.RecordBatch.from_arrays(
        [
            langs.take(pa.array(begins)), pa.array(first[begins].view(np.int64)), pa.array(second[begins].view(np.int64)),
            pa.array(cut[begins]), _packed(following, begins), _packed(n, begins),
        ],
        names=["lang", "first", "second", "cut", "following", "n"],
    )


STRIPE = "lang string, first long, second long, cut int, following binary, n binary"


def _stripes(words: Words, names: list[str], a, b, following, n, prefix_keys, hot: Hot, entries: int) -> pa.RecordBatch:
    """Stripes of the prefixes (a) or (a, b); ``a``, ``b`` and ``following`` are word numbers of distinct entries."""
    nexts = words.hashes[following]
    cut = hot.cut(prefix_keys, nexts)
    number = a if b is None else a * len(words.distinct) + b
    if cut.any():
        order = np.lexsort((cut, number))
        a, b, number, nexts, n, cut = a[order], None if b is None else b[order], number[order], nexts[order], n[order], cut[order]
    second = np.zeros(len(a), np.uint64) if b is None else words.hashes[b]
    return _stripe_rows(_named(names, words.langs[a]), words.hashes[a], second, number, cut, nexts, n.astype(np.int64), entries)


def _tallied(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers and how often each occurs."""
    codes = np.sort(codes)
    heads = np.flatnonzero(np.concatenate([np.ones(len(codes[:1]), bool), codes[1:] != codes[:-1]]))
    return codes[heads], np.diff(np.append(heads, len(codes)))


def pair_stripes(docs: DataFrame, known: Bloom, hot: Hot, limits: Limits) -> DataFrame:
    """Stripes of one-word prefixes over the words that may be frequent."""
    sent = docs.sparkSession.sparkContext.broadcast((known, hot))

    def run(batches):
        known, hot = sent.value
        for words, _, names in _words_of(batches, limits):
            often = known.has(words.keys)[words.ids]
            at = np.flatnonzero(words.joined & often[1:] & often[:-1])
            if len(at):
                size = len(words.distinct)
                codes, n = _tallied(words.ids[at] * size + words.ids[at + 1])
                a, following = codes // size, codes % size
                yield _stripes(words, names, a, None, following, n, words.keys[a], hot, limits.entries)

    return docs.mapInArrow(run, STRIPE)


def triple_stripes(docs: DataFrame, known: Bloom, pairs: Bloom, hot: Hot, limits: Limits) -> DataFrame:
    """Stripes of two-word prefixes, where both two-word phrases of a three-word phrase may be frequent."""
    sent = docs.sparkSession.sparkContext.broadcast((known, pairs, hot))

    def run(batches):
        known, pairs, hot = sent.value
        for words, _, names in _words_of(batches, limits):
            often = known.has(words.keys)[words.ids]
            at = np.flatnonzero(words.joined & often[1:] & often[:-1])
            at = at[pairs.has(pair_keys(words, words.ids[at], words.ids[at + 1]))]
            at = at[:-1][at[1:] == at[:-1] + 1] if len(at) else at
            if len(at):
                size = len(words.distinct)
                twos, number = np.unique(words.ids[at] * size + words.ids[at + 1], return_inverse=True)
                codes, n = _tallied(number * size + words.ids[at + 2])
                two, following = twos[codes // size], codes % size
                a, b = two // size, two % size
                yield _stripes(words, names, a, b, following, n, pair_keys(words, a, b), hot, limits.entries)

    return docs.mapInArrow(run, STRIPE)


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """``lang, first, second, following, n``: extensions with ``least`` occurrences, from stripes merged element by element.

    Stripes of one prefix reach a task one after the other. It holds the counter of one prefix at a time, besides a
    batch of rows.
    """
    keys = ["lang", "first", "second", "cut"]

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.int64, (at[-1] - at[0]) // 8, at[0]), np.diff(at) // 8

    def out(langs, prefix, following, n):
        good = n >= least
        prefix = prefix[good]
        return pa.RecordBatch.from_arrays(
            [
                langs.take(pa.array(prefix[:, 0])), pa.array(prefix[:, 1]), pa.array(prefix[:, 2]),
                pa.array(following[good].view(np.int64)), pa.array(n[good]),
            ],
            names=["lang", "first", "second", "following", "n"],
        )

    def run(batches):
        key, following, n = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)  # the counter still open
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            langs = coded.dictionary
            rows = np.stack([coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), *(batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))], 1)
            nexts, sizes = flat(batch.column(4))
            counts, _ = flat(batch.column(5))
            nexts = nexts.view(np.uint64)
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]).any(1)
            number = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            entry = np.repeat(number, sizes)
            named = [(langs[int(c)].as_py(), *rest) for c, *rest in rows[heads[[0, -1]]].tolist()]
            if key is not None:
                if key == named[0]:
                    nexts, counts = np.concatenate([following, nexts]), np.concatenate([n, counts])
                    entry = np.concatenate([np.zeros(len(n), np.int64), entry])
                else:
                    yield out(pa.array([key[0]], pa.string()), np.tile([0, *key[1:]], (len(n), 1)), following, n)
            order = np.lexsort((nexts, entry))
            nexts, counts, entry = nexts[order], counts[order], entry[order]
            first = np.ones(len(nexts), bool)
            first[1:] = (nexts[1:] != nexts[:-1]) | (entry[1:] != entry[:-1])
            at = np.flatnonzero(first)
            nexts, counts, entry = nexts[at], np.add.reduceat(counts, at), entry[at]
            open_from = int(np.searchsorted(entry, number[-1]))
            yield out(langs, rows[heads[entry[:open_from]]], nexts[:open_from], counts[:open_from])
            key, following, n = named[1], nexts[open_from:], counts[open_from:]
        if key is not None:
            yield out(pa.array([key[0]], pa.string()), np.tile([0, *key[1:]], (len(n), 1)), following, n)

    dealt = stripes.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "lang string, first long, second long, following long, n long")


def _score(a: str, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) in whole decimals: counts of up to 14 digits, products of up to 37."""
    a, l, r = (c.cast("decimal(14,0)") for c in (F.col(a), l, r))  # noqa: E741
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), l * r)


def phrases(docs: DataFrame, least: int = LEAST, limits: Limits = Limits()) -> DataFrame:
    """``lang, phrase, a, l, r, n, score``: every candidate that no longer candidate covers."""
    texts = docs.select(F.coalesce(column("lang").cast("string"), F.lit("und")).alias("lang"), column("text").cast("string").alias("text"))
    words = materialise(word_counts(texts, limits), "stripe-words")
    while not words.groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        limits = replace(limits, seed=limits.seed + 1)
        words = materialise(word_counts(texts, limits), "stripe-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    total = words.agg(F.sum("n")).first()[0] or 0
    often = words.where(F.col("n") >= least)
    known = bloom(often.select("key"), limits.filter_bits)

    pairs = materialise(merged(pair_stripes(texts, known, Hot(often, total, limits.hot), limits), least), "stripe-pairs")
    first = often.select("lang", F.col("hash").alias("first"), F.col("key").alias("first_key"), F.col("word").alias("one"), F.col("n").alias("l"))
    second = often.select("lang", F.col("hash").alias("following"), F.col("word").alias("two"), F.col("n").alias("r"))
    twos = materialise(
        pairs.join(first, ["lang", "first"]).join(second, ["lang", "following"]).select(
            "lang", "first", F.col("following").alias("second"), "first_key", "one", "two", F.col("n").alias("a"), "l", "r"
        ),
        "stripe-twos",
    )
    keyed = with_pair_keys(twos)
    threes = materialise(
        merged(
            triple_stripes(
                texts, known, bloom(keyed.select("key"), limits.filter_bits), Hot(keyed.withColumnRenamed("a", "n"), total, limits.hot), limits
            ),
            least,
        ),
        "stripe-threes",
    )
    covers = threes.select("lang", "first", "second", "n").unionByName(
        threes.select("lang", F.col("second").alias("first"), F.col("following").alias("second"), "n")
    )
    covers = covers.groupBy("lang", "first", "second").agg(F.max("n").alias("longer"))
    short = twos.join(covers, ["lang", "first", "second"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < COVERED_PER_CENT * F.col("a"))
    ).select("lang", F.concat_ws(" ", "one", "two").alias("phrase"), "a", "l", "r", _score("a", F.col("l"), F.col("r")).alias("score"))

    begins = twos.select("lang", "first", "second", "one", "two", F.col("a").alias("ab"), F.col("l").alias("w1"))
    closes = twos.select("lang", F.col("first").alias("second"), F.col("second").alias("following"), F.col("two").alias("three"), F.col("a").alias("bc"), F.col("r").alias("w3"))
    long = threes.withColumnRenamed("n", "a").join(begins, ["lang", "first", "second"]).join(closes, ["lang", "second", "following"])
    long = long.withColumn("k1", _score("a", F.col("w1"), F.col("bc"))).withColumn("k2", _score("a", F.col("ab"), F.col("w3")))
    early = F.col("k1") <= F.col("k2")
    long = long.select(
        "lang", F.concat_ws(" ", "one", "two", "three").alias("phrase"), "a", F.when(early, F.col("w1")).otherwise(F.col("ab")).alias("l"),
        F.when(early, F.col("bc")).otherwise(F.col("w3")).alias("r"), F.least("k1", "k2").alias("score"),
    )
    return short.unionByName(long).join(totals, "lang").select("lang", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def with_pair_keys(twos: DataFrame) -> DataFrame:
    """Add ``key``, the key of a two-word phrase."""

    def run(batches):
        for batch in batches:
            first, second = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64).view(np.uint64) for c in ("first_key", "second"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pair_key(first, second).view(np.int64))], names=["a", "key"])

    return twos.select("a", "first_key", "second").mapInArrow(run, "a long, key long")


def top_phrases(docs: DataFrame, top: int = TOP, least: int = LEAST, limits: Limits = Limits()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases(docs, least, limits).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
