"""Words of UTF-8 texts as byte spans, in numpy: byte transducers, span hashes and a verified hash table.

Texts are read straight from Arrow's buffers, in blocks of about ``BLOCK_BYTES``; no word becomes a Python object.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Spans of more bytes are hashed and compared by one library call each instead of eight bytes a step.
LONG = 256

_ODD_1, _ODD_2, _ODD_3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _ODD_2
    x = (x ^ (x >> np.uint64(27))) * _ODD_3
    return x ^ (x >> np.uint64(31))


def name_hash(name: str, seed: int = 0) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little"))


class Machine:
    """A transducer over bytes: two states (between words, in a word) and the flags that a byte raises in each.

    ``step[state, byte]`` holds the flags, with ``INSIDE`` for the next state. That bit hangs on the byte alone, so the
    state before a byte is known from the byte before it and all positions are taken through the table at once.
    """

    INSIDE = 1

    def __init__(self, step: np.ndarray):
        self.step = np.ascontiguousarray(step, np.uint8).reshape(-1)
        self.inside = self.step[:256] & self.INSIDE

    def run(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Flags for every byte; a text starts between words at each index of ``first``."""
        place = data.astype(np.uint16)
        before = self.inside[data[:-1]].astype(np.uint16) << 8
        if len(before):
            place[1:] += before
            place[first] = data[first]
        return self.step[place]


class Texts:
    """A block of texts: their bytes with eight bytes to spare, and where each text starts and ends."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.size = len(data)
        self.bytes = np.zeros(len(data) + 8, np.uint8)
        self.bytes[: self.size] = data
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.ends = np.asarray(ends, np.int64)
        full = self.ends > self.starts
        self.first, self.last = self.starts[full], self.ends[full] - 1

    @property
    def data(self) -> np.ndarray:
        return self.bytes[: self.size]

    def owner_of(self, places: np.ndarray) -> np.ndarray:
        """The number of the text that holds each place."""
        return np.searchsorted(self.ends, places, side="right")

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the longest runs of true bytes; runs end with their text."""
        if not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins, closes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[self.first] = inside[self.first]
        closes[:-1] &= ~inside[1:]
        closes[self.last] = inside[self.last]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(closes) + 1 - starts

    def eights(self) -> np.ndarray:
        """The eight bytes from each place on, as one number."""
        return np.ndarray((self.size + 1,), "<u8", self.bytes, strides=(1,))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """``(from row, to row, texts)`` of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, Texts(data[at[lo] : at[hi]], at[lo + 1 : hi + 1] - at[lo])
        lo = hi


def hash_spans(texts: Texts, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    eights = texts.eights()
    out = scramble(lengths.astype(np.uint64) * _ODD_1 + np.uint64(seed))
    live, done = np.flatnonzero(lengths <= LONG), 0
    while len(live):
        left = lengths[live] - done
        out[live] = scramble(out[live] ^ (eights[starts[live] + done] & _KEEP[np.minimum(left, 8)]) * _ODD_1)
        done += 8
        live = live[left > 8]
    for i in np.flatnonzero(lengths > LONG).tolist():
        span = texts.bytes[starts[i] : starts[i] + lengths[i]].tobytes()
        out[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(span, digest_size=8).digest(), "little"))
    return out


def equal_spans(texts: Texts, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans from ``a`` and from ``b`` of the same lengths hold the same bytes."""
    eights = texts.eights()
    same = np.ones(len(a), bool)
    live, done = np.flatnonzero((lengths <= LONG) & (a != b)), 0
    while len(live):
        left = lengths[live] - done
        other = (eights[a[live] + done] ^ eights[b[live] + done]) & _KEEP[np.minimum(left, 8)]
        same[live[other != 0]] = False
        done += 8
        live = live[(left > 8) & (other == 0)]
    for i in np.flatnonzero((lengths > LONG) & (a != b)).tolist():
        same[i] = np.array_equal(texts.bytes[a[i] : a[i] + lengths[i]], texts.bytes[b[i] : b[i] + lengths[i]])
    return same


def insert_spans(texts: Texts, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each span the number of the span that stands for it: equal spans of one group share one.

    An open hash table with at least two slots a span. All spans that are not placed look at their slot together: an
    empty slot takes one of them, and a span joins the holder only if group, length and bytes agree; else it moves on.
    """
    n = len(starts)
    size = 1 << max(4, (2 * n).bit_length())
    table = np.full(size, -1, np.int64)
    keys = scramble(hashes ^ (groups.astype(np.uint64) * _ODD_1))
    slot = (keys & np.uint64(size - 1)).astype(np.int64)
    out = np.empty(n, np.int64)
    left = np.arange(n)
    while len(left):
        at = slot[left]
        holder = table[at]
        empty = holder < 0
        table[at[empty]] = left[empty]
        holder = np.where(empty, table[at], holder)
        like = np.flatnonzero((keys[holder] == keys[left]) & (groups[holder] == groups[left]) & (lengths[holder] == lengths[left]))
        like = like[equal_spans(texts, starts[holder[like]], starts[left[like]], lengths[left[like]])]
        out[left[like]] = holder[like]
        placed = np.zeros(len(left), bool)
        placed[like] = True
        left = left[~placed]
        slot[left] = (slot[left] + 1) & (size - 1)
    return out


def span_strings(texts: Texts, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The spans as an Arrow string column."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    places = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    held = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(texts.bytes[places])))
    return held.cast(pa.string())
