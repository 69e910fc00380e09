"""Token ids in compressed files: Re-Pair grammars per block, decoded at any place without the rest.

Documents are dealt out by ranges of doc_id and sorted, so files hold them in ascending order. A task encodes its
texts and cuts the id stream, each document ended by id 0, into blocks of about BLOCK ids. A block's grammar grows
in rounds: the pairs at least a SHARE as frequent as the most frequent one become nonterminals and all their
occurrences that do not overlap are replaced, until no pair is frequent. The file format is a Parquet table with
one row per block:

    shard, block            place in the order of files
    start                   ids of the shard before the block
    terminals               ids below this number stand for themselves
    doc_ids, lengths        documents in the block, in order, and their numbers of ids, end id included
    rules                   little-endian pairs of 32-bit symbols; rule r defines symbol terminals + r
    spans                   the number of ids that each rule expands to, 32 bits each
    symbols                 the compressed stream, 32 bits each

``decoded`` expands a range of a block: the running sum of expansion lengths finds the symbols that cover it.

Encoding: a blank between two characters that are not white space always begins a token of the vocabulary's
pre-tokenizer, so the pieces between such blanks are encoded once a worker and remembered, Latin words apart from the marks
that close them and by the library's merges alone. Texts with other white space beside a blank are cut at the remaining places of that kind.

Defined cases. Null texts are empty: one id, the end. Null doc_ids come first. Repeated rows are stored as often as
they come. An empty table gives an empty store. Other columns are never read.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyslot.llm.common import Numbering, coded_pieces, column, flat_ranges, number_words, quiet_tokenizers, slices

END = 0
BLOCK = 1_000_000
#: Pairs seen fewer times in a block are not replaced; rounds of replacement at most.
LEAST_PAIR, ROUNDS = 24, 12
#: Pairs of one round: those at least 1 / SHARE as frequent as the most frequent one.
SHARE = 32
REMEMBERED = 300_000
#: Pieces of Latin letters and closing marks: the pre-tokenizer cuts them between the two, and words come with many marks.
PLAIN = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: log2 of the bins in which the pairs of a block are counted first.
BINS = 18

FORMAT = (
    "shard int, block int, start long, terminals int, doc_ids array<long>, lengths array<long>, rules binary, spans binary, symbols binary"
)


@contextmanager
def no_collection() -> Iterator[None]:
    """Encoding makes no cycles, and Python's collector would walk all remembered pieces again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, each distinct piece between blanks encoded once."""

    def __init__(self, model: str):
        quiet_tokenizers()
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(model)
        size = self.tokenizer.get_vocab_size()
        self.size = size
        # the library writes a blank at a token's start as this letter
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        # words of Latin letters are one token of the pre-tokenizer, so they go to the library's merges in its byte letters
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        pairs = [(chr(c).encode(), spell(chr(c))[0][0]) for c in range(0x80, 0x250)]
        self.letters = {b: letter for two, letters in pairs for b, letter in zip(two, letters, strict=True)}
        added = [t.content.strip() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytewise = (
            isinstance(self.tokenizer.model, models.BPE) and isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel)
            and self.tokenizer.normalizer is None and not any(map(PLAIN.fullmatch, added))
        )
        self.forget()

    def forget(self) -> None:
        self.numbers, self.clean = Numbering(), np.zeros(0, bool)
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.units = Numbering()
        self.units[("",)]  # unit 0 has no ids
        self.unit_flat, self.unit_offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ids(self, text: str) -> np.ndarray:
        (got,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(got.ids, np.int32)

    def learn(self) -> None:
        """Encode the pieces met since the last time: strings follow a blank, one-element tuples open a text."""
        new = list(islice(self.numbers, len(self.clean), None))
        heads, tails = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        clean = np.zeros(len(new), bool)
        units, plain = self.units, PLAIN.fullmatch
        for i, p in enumerate(new):
            if not isinstance(p, str):
                heads[i] = units[p]
                clean[i] = not p[0] or not p[0][-1].isspace()
                continue
            word = p.rstrip(MARKS)
            if word.isascii() and word.isalpha() or plain(word):
                heads[i] = units[word]
                if len(word) < len(p):
                    tails[i] = units[(p[len(word) :],)]
                clean[i] = True
            elif p and not p[0].isspace() and not p[-1].isspace():
                heads[i] = units[p]
                clean[i] = True
        self.learn_units()
        begin, size = self.unit_offsets[:-1], np.diff(self.unit_offsets)
        both = np.stack([heads, tails], axis=1).ravel()
        ids = self.unit_flat[flat_ranges(begin[both], size[both])]
        self.flat = np.concatenate([self.flat, ids])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(size[heads] + size[tails])])
        self.clean = np.concatenate([self.clean, clean])

    def kind(self, unit: str | tuple[str]) -> int:
        if isinstance(unit, tuple):
            return 1
        return 2 if self.bytewise and (unit.isascii() and unit.isalpha() or PLAIN.fullmatch(unit)) else 0

    def learn_units(self) -> None:
        """Encode the units met since the last time: a string stands behind a blank, a tuple holds one that does not."""
        new = list(islice(self.units, len(self.unit_offsets) - 1, None))
        # 0: a string, 1: a tuple, 2: a string that is a word of Latin letters
        kind = np.fromiter((self.kind(p) for p in new), np.uint8, len(new))
        inner = [new[i] for i in np.flatnonzero(kind == 0).tolist()]
        joined = self.ids("".join([" " + p for p in inner])) if inner else np.zeros(0, np.int32)
        cuts = np.flatnonzero(self.opens[joined])
        if len(cuts) == len(inner):
            sizes = np.diff(np.append(cuts, len(joined)))
        else:
            each = [self.ids(" " + p) for p in inner]
            joined, sizes = np.concatenate([joined[:0], *each]), np.fromiter(map(len, each), np.int64, len(each))
        merge, letters = self.tokenizer.model.tokenize, self.letters
        words, lengths = [], []
        for i in np.flatnonzero(kind == 2).tolist():
            w = new[i]
            got = merge("Ġ" + (w if w.isascii() else w.encode().decode("latin-1").translate(letters)))
            lengths.append(len(got))
            words += [t.id for t in got]
        outer = [self.ids(p[0]) for p in new if isinstance(p, tuple)]
        flat = np.concatenate([joined, *outer, np.array(words, np.int32)])
        at = np.concatenate([sizes, np.fromiter(map(len, outer), np.int64, len(outer)), np.array(lengths, np.int64)])
        # they come by kind in flat; put all in the order of their numbers
        place = np.empty(len(new), np.int64)
        place[np.argsort(kind, kind="stable")] = np.arange(len(new))
        begin = np.cumsum(at) - at
        self.unit_flat = np.concatenate([self.unit_flat, flat[flat_ranges(begin[place], at[place])]])
        self.unit_offsets = np.concatenate([self.unit_offsets, self.unit_offsets[-1] + np.cumsum(at[place])])

    def whole(self, parts: list[str]) -> np.ndarray:
        """A text with white space beside blanks, cut at the blanks between two other characters."""
        units, held = [], parts[0]
        for p in parts[1:]:
            if held and p and not held[-1].isspace() and not p[0].isspace():
                units.append(held)
                held = " " + p
            else:
                held += " " + p
        units.append(held)
        got = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return np.concatenate([np.array(e.ids, np.int32) for e in got])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        with no_collection():
            return self.encoded(texts)

    def encoded(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.numbers) > REMEMBERED:
            self.forget()
        if not texts:
            return []
        at, kinds, counts = coded_pieces(pc.split_pattern(pc.fill_null(pa.array(texts, pa.string()), ""), " "))
        ends = np.cumsum(counts)
        opening = [(kinds[i],) for i in at[ends - counts].tolist()]
        at = number_words(kinds, self.numbers)[at]
        at[ends - counts] = number_words(opening, self.numbers)
        if len(self.numbers) > len(self.clean):
            self.learn()
        sizes = self.offsets[at + 1] - self.offsets[at]
        ids = self.flat[flat_ranges(self.offsets[at], sizes)]
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])]
        good = np.logical_and.reduceat(self.clean[at], ends - counts)
        return [
            ids[edges[i] : edges[i + 1]] if good[i] else self.whole((texts[i] or "").split(" ")) for i in range(len(texts))
        ]


@lru_cache(maxsize=1)
def encoder_of(model: str) -> ChunkEncoder:
    """A worker keeps its encoder, and what that remembers, from task to task."""
    return ChunkEncoder(model)


def compress(ids: np.ndarray, terminals: int, least: int = LEAST_PAIR, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, spans, symbols): the grammar of one stream of ids."""
    seq = ids.astype(np.int64)
    rules, spans = [], []
    length = np.ones(terminals, np.int64)
    for _ in range(rounds):
        if len(seq) < 2:
            break
        pair = (seq[:-1] << 32) | seq[1:]
        # All occurrences of a pair share a bin, so only those in bins of enough pairs need sorting. What is
        # enough is at least what the best pair of the fullest bin asks for.
        bins = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BINS)).view(np.int64)
        held = np.bincount(bins, minlength=1 << BINS)
        best = np.unique(pair[bins == held.argmax()], return_counts=True)[1].max()
        places = np.flatnonzero((held >= max(least, int(best) // SHARE))[bins])
        some = pair[places]
        kinds, which, times = np.unique(some, return_inverse=True, return_counts=True)
        if not len(kinds) or times.max() < least:
            break
        taken = times >= max(least, int(times.max()) // SHARE)
        chosen = kinds[taken]
        hit = taken[which]
        hits, at = places[hit], (np.cumsum(taken) - 1)[which[hit]]
        # overlapping hits are runs of neighbouring places; every second one of a run is taken
        new_run = np.concatenate([[True], np.diff(hits) > 1])
        first = np.maximum.accumulate(np.where(new_run, np.arange(len(hits)), 0))
        odd = (np.arange(len(hits)) - first) % 2 == 0
        hits, at = hits[odd], at[odd]
        base = terminals + len(rules)
        seq[hits] = base + at
        keep = np.ones(len(seq), bool)
        keep[hits + 1] = False
        seq = seq[keep]
        left, right = chosen >> 32, chosen & 0xFFFFFFFF
        rules.extend(zip(left.tolist(), right.tolist(), strict=True))
        grown = length[left] + length[right]
        spans.extend(grown.tolist())
        length = np.concatenate([length, grown])
    return np.array(rules, "<u4").reshape(-1, 2), np.array(spans, "<u4"), seq.astype("<u4")


class Block:
    """A stored block, ready to be read at any place."""

    def __init__(self, terminals: int, rules: bytes, spans: bytes, symbols: bytes):
        pairs = np.frombuffer(rules, "<u4").reshape(-1, 2).astype(np.int64)
        grown = np.frombuffer(spans, "<u4").astype(np.int64)
        self.length = np.concatenate([np.ones(terminals, np.int64), grown])
        self.begin = np.concatenate([np.arange(terminals), terminals + np.cumsum(grown) - grown])
        self.flat = np.concatenate([np.arange(terminals, dtype=np.int32), np.zeros(int(grown.sum()), np.int32)])
        for r, (a, b) in enumerate(pairs.tolist()):
            at, mid = self.begin[terminals + r], self.begin[terminals + r] + self.length[a]
            self.flat[at:mid] = self.flat[self.begin[a] : self.begin[a] + self.length[a]]
            self.flat[mid : mid + self.length[b]] = self.flat[self.begin[b] : self.begin[b] + self.length[b]]
        self.symbols = np.frombuffer(symbols, "<u4").astype(np.int64)
        self.ends = np.cumsum(self.length[self.symbols])

    def decoded(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start .. stop - 1 of the block, from the symbols that cover them."""
        stop = int(self.ends[-1]) if stop is None and len(self.ends) else stop or 0
        if stop <= start:
            return self.flat[:0]
        lo = int(np.searchsorted(self.ends, start, side="right"))
        hi = int(np.searchsorted(self.ends, stop, side="left")) + 1
        cover = self.symbols[lo:hi]
        out = self.flat[flat_ranges(self.begin[cover], self.length[cover])]
        skip = start - int(self.ends[lo] - self.length[self.symbols[lo]])
        return out[skip : skip + stop - start]


def write(docs: DataFrame, model: str, path: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> None:
    """Encode every whole text and write the store to ``path``, in ascending order of doc_id."""
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def store(batches):
        encoder, shard = encoder_of(model), TaskContext.get().partitionId()
        held, names, sizes, total, number = [], [], 0, 0, 0

        def flush():
            nonlocal held, names, sizes, total, number
            stream = np.concatenate(held)
            rules, spans, symbols = compress(stream, encoder.size)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([total]), pa.array([encoder.size], pa.int32()),
                    pa.array([names], pa.list_(pa.int64())), pa.array([[len(h) for h in held]], pa.list_(pa.int64())),
                    pa.array([rules.tobytes()]), pa.array([spans.tobytes()]), pa.array([symbols.tobytes()]),
                ],
                names=["shard", "block", "start", "terminals", "doc_ids", "lengths", "rules", "spans", "symbols"],
            )
            total, number = total + len(stream), number + 1
            held, names, sizes = [], [], 0
            return out

        end = np.array([END], np.int32)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                for name, got in zip(ids[lo:hi], encoder.encode(texts[lo:hi]), strict=True):
                    held.append(np.concatenate([got, end]))
                    names.append(name)
                    sizes += len(held[-1])
                    if sizes >= block:
                        yield flush()
        if held:
            yield flush()

    rows.mapInArrow(store, FORMAT).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORMAT).parquet(path)


def read_back(store: DataFrame) -> DataFrame:
    """One row per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def digest(batches):
        for batch in batches:
            for row in batch.to_pylist():
                whole = Block(row["terminals"], row["rules"], row["spans"], row["symbols"]).decoded().astype("<u4")
                ends = np.cumsum(row["lengths"])
                edges = np.concatenate([[0], ends])
                crcs = [zlib.crc32(whole[a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(crcs), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["start"] + edges[:-1]), pa.array(np.diff(edges)), pa.array(crcs, pa.int64()),
                    ],
                    names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = store.mapInArrow(digest, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    held = store.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = held.groupBy("shard").agg(F.sum("n").alias("n"))  # one row per file
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(shards, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
