"""SentencePiece encoding and decoding: Viterbi over a trie of marked words, sharing what common prefixes compute.

A text is normalised as the model says and cut into marked words: a run of word marks and the characters up to the
next one. No piece of a usable model reaches from a character into a mark (checked when the model is loaded), so
words are independent. Where no piece joins a letter to another character, words are cut there too: a word comes with
many marks and line breaks, but is met once. The distinct words of a slice are sorted; read in that order they are a trie in depth-first
order, and everything computed for a prefix stays valid for the next word up to their common prefix.

For each prefix the forward state is the best path's score and last piece. The model is a merge model (BPE), whose
result is the one path all of whose neighbouring pieces survive the merges of the two together; so a transition is
allowed only for such pairs (remembered per pair), which leaves one path at most: scores are carried along but never
have to decide. Pieces ending at a character come from an automaton over all pieces, so that a character costs one step and a few candidates.
Characters without a piece become byte pieces. The ids equal the library's.

Many words at once take each step together: the first characters of all, then the second ones and so on, each prefix
once. Long words, and few, go one by one. A worker keeps its encoder, and what that remembers, from task to task.

Defined cases. Null and empty texts have no pieces. A word mark in a text decodes to a blank, as in the library.
Every input row gives one row; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallyslot.llm.common import Numbering, annotate, flat_ranges, number_words, slices

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words whose pieces, and pairs whose fate, a task remembers before it starts over.
REMEMBERED, PAIRS = 150_000, 300_000
#: Characters of text whose words are held at once.
RUN_CHARS = 1_000_000
#: Words of up to so many characters, and so many of them, take their steps together.
TOGETHER_CHARS, TOGETHER = 48, 64
#: A code point, in a key beside a state of the automaton.
CODE_BITS = 21


class Table:
    """A hash table from 64-bit integers of at least 0 to integers of at least 0, looked up by arrays."""

    def __init__(self):
        self.clear()

    def clear(self, bits: int = 12) -> None:
        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free slot that it meets first."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[at]
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return at

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 where there is none."""
        at = self.slots(keys)
        return np.where(self.keys[at] >= 0, self.values[at], np.int32(-1))

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Some distinct keys that are not there yet."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            full = self.keys >= 0
            old, kept = self.keys[full], self.values[full]
            self.clear((2 * (len(old) + len(keys))).bit_length() + 1)
            self.put(old, kept)
        self.size += len(keys)
        while len(keys):
            at = self.slots(keys)
            self.keys[at] = keys  # of keys that meet the same free slot one stays
            there = self.keys[at] == keys
            self.values[at[there]] = values[there]
            keys, values = keys[~there], values[~there]


class Pieces:
    """The pieces of a model, their scores, and an automaton that names the pieces ending at a character."""

    def __init__(self, model: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        spelled = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.bytes = {int(spelled[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.ids = {p: i for i, p in enumerate(spelled) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece of this model reaches from one word into the next")
        self.words = self.cuts()
        self.lengths = [len(p) for p in spelled]
        self.text = [p.replace(MARK, " ").encode() for p in spelled]
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        for i in range(n):
            if sp.is_control(i):
                self.text[i] = b""
        self.sizes = np.fromiter(map(len, self.text), np.int64, n)
        self.begin, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.text), np.uint8)
        self.build()

    def cuts(self) -> re.Pattern:
        """The words of a text: letters apart from other characters unless a piece joins the two. Characters without a
        piece are joined to nothing, so it does not matter where they are."""
        letters = {c for p in self.ids for c in p if c.isalpha()}
        if not letters or any((a in letters) != (b in letters) for p in self.ids for a, b in zip(p, p[1:]) if a != MARK):
            return WORDS
        some = re.escape("".join(sorted(letters)))
        return re.compile(f"{MARK}*[{some}]+|{MARK}*[^{some}{MARK}]+|{MARK}+")

    def build(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        ends = [0]
        for piece, i in self.ids.items():
            at = 0
            for c in piece:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    ends.append(-1)
                at = nxt
            ends[at] = i
        ends[0] = -1
        self.back = [0] * len(ends)
        self.ending: list[tuple[int, ...]] = [()] * len(ends)
        level = list(self.children[0].values())
        for s in level:
            self.ending[s] = (ends[s],) if ends[s] >= 0 else ()
        while level:
            below = []
            for s in level:
                for c, t in self.children[s].items():
                    f = self.back[s]
                    while f and c not in self.children[f]:
                        f = self.back[f]
                    self.back[t] = self.children[f].get(c, 0)
                    self.ending[t] = ((ends[t],) if ends[t] >= 0 else ()) + self.ending[self.back[t]]
                    below.append(t)
            level = below
        self.steps: dict[tuple[int, str], int] = {}
        # the same as arrays
        self.edges, self.stepped = Table(), Table()
        edges = [((s << CODE_BITS) | ord(c), t) for s, below in enumerate(self.children) for c, t in below.items()]
        self.edges.put(np.array([k for k, _ in edges], np.int64), np.array([t for _, t in edges], np.int32))
        self.back_of = np.array(self.back, np.int64)
        self.many_end = np.fromiter(map(len, self.ending), np.int64, len(self.ending))
        self.first_end = np.cumsum(self.many_end) - self.many_end
        self.all_ending = np.fromiter((i for e in self.ending for i in e), np.int64, int(self.many_end.sum()))
        self.length_of, self.score_of = np.array(self.lengths, np.int64), np.array(self.scores, np.float64)

    def step(self, state: int, c: str) -> int:
        """The state after one more character: the longest suffix that begins a piece."""
        key = (state, c)
        found = self.steps.get(key)
        if found is None:
            while state and c not in self.children[state]:
                state = self.back[state]
            found = self.children[state].get(c, 0)
            if len(self.steps) < PAIRS:
                self.steps[key] = found
        return found

    def step_many(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """``step`` of many states and code points."""
        keys = (states << CODE_BITS) | codes
        found = self.stepped.get(keys).astype(np.int64)
        if (found < 0).any():
            new = np.unique(keys[found < 0])
            at, code, to = new >> CODE_BITS, new & ((1 << CODE_BITS) - 1), np.zeros(len(new), np.int32)
            left = np.arange(len(new))
            while len(left):
                got = self.edges.get((at[left] << CODE_BITS) | code[left])
                to[left] = np.maximum(got, 0)
                left = left[(got < 0) & (at[left] > 0)]
                at[left] = self.back_of[at[left]]
            if self.stepped.size + len(new) > PAIRS:
                self.stepped.clear()
            self.stepped.put(new, to)
            missing = found < 0
            found[missing] = to[np.searchsorted(new, keys[missing])]
        return found

    def merged(self, text: str) -> list[str]:
        """The merges themselves on a short text: always the pair of the best score, the leftmost of several."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                p = self.ids.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or self.scores[p] > best):
                    best, where = self.scores[p], i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts


class TrieEncoder:
    def __init__(self, model: str):
        self.pieces = Pieces(model)
        self.spelled = {i: p for p, i in self.pieces.ids.items()}
        self.size = len(self.pieces.lengths)
        self.pairs: dict[int, bool] = {}  # by left * size + right
        self.known_pairs = Table()  # by (left + 1) * size + right
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbering()
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def survives(self, left: int, right: int) -> bool:
        """Do the merges of two pieces' characters end in just these two? left < 0: nothing to merge with."""
        key = left * self.size + right
        found = self.pairs.get(key)
        if found is None:
            found = self.tried(left, right)
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def tried(self, left: int, right: int) -> bool:
        p = self.spelled[right]
        parts = [p] if left < 0 else [self.spelled[left], p]
        whole = "".join(parts)
        # two pieces that make a third would have been merged
        return (left < 0 or whole not in self.pieces.ids) and self.pieces.merged(whole) == parts

    def survive(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``survives`` of many pairs."""
        keys = (left + 1) * self.size + right
        found = self.known_pairs.get(keys)
        missing = found < 0
        if missing.any():
            new = np.unique(keys[missing])
            got = np.array([self.tried(k // self.size - 1, k % self.size) for k in new.tolist()], np.int32)
            if self.known_pairs.size + len(new) > PAIRS:
                self.known_pairs.clear()
            self.known_pairs.put(new, got)
            found[missing] = got[np.searchsorted(new, keys[missing])]
        return found > 0

    def encode_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of some distinct words, one after the other, and how many each has."""
        short = np.fromiter(map(len, words), np.int64, len(words)) <= TOGETHER_CHARS
        if short.sum() < TOGETHER:
            short[:] = False
        elif short.all():
            return self.encode_together(words)
        alone, short = np.flatnonzero(~short), np.flatnonzero(short)
        got = self.encode_words([words[i] for i in alone])
        flat, own = self.encode_together([words[i] for i in short])
        sizes = np.zeros(len(words), np.int64)
        sizes[alone], sizes[short] = [len(ids) for ids in got], own
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        out[flat_ranges(starts[short], own)] = flat
        out[flat_ranges(starts[alone], sizes[alone])] = np.fromiter((i for ids in got for i in ids), np.int32, int(sizes[alone].sum()))
        return out, sizes

    def encode_together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_words``: row r is the r-th word in the order of their code points, level i what its first i
        characters have come to. A prefix that a row shares with the one before is taken from there."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        p, n = self.pieces, len(words)
        order = pc.sort_indices(pa.array(words, pa.string())).to_numpy().astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)[order]
        most = int(lengths.max())
        codes = np.full((most + 1, n), -1, np.int64)
        flat = np.frombuffer("".join([words[i] for i in order.tolist()]).encode("utf-32-le"), np.uint32)
        codes[flat_ranges(np.zeros(n, np.int64), lengths), np.repeat(np.arange(n), lengths)] = flat
        shared = np.zeros(n, np.int64)
        shared[1:] = np.argmax(codes[:, 1:] != codes[:, :-1], axis=0)
        state, last, total = np.zeros(n, np.int64), np.full((most + 1, n), -1, np.int32), np.zeros((most + 1, n))
        rows = np.arange(n)
        for i in range(most):
            rows = rows[lengths[rows] > i]
            fresh = shared[rows] <= i
            new = rows[fresh]
            state[new] = now = p.step_many(state[new], codes[i, new])
            best, value = np.full(len(new), -1, np.int32), total[i, new] - 1e12  # no piece: the character stands alone
            many, first = p.many_end[now], p.first_end[now]
            left, k = np.flatnonzero(many), 0
            while len(left):
                piece = p.all_ending[first[left] + k]
                start, row = i + 1 - p.length_of[piece], new[left]
                ok = self.survive(last[start, row].astype(np.int64), piece)
                # the merges of a word end in one way only, so no second piece survives here
                best[left[ok]] = piece[ok]
                value[left[ok]] = total[start[ok], row[ok]] + p.score_of[piece[ok]]
                k += 1
                left = left[~ok & (many[left] > k)]
            last[i + 1, new], total[i + 1, new] = best, value
            old, of = rows[~fresh], rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))][~fresh]
            state[old], last[i + 1, old], total[i + 1, old] = state[of], last[i + 1, of], total[i + 1, of]
        # back from the ends; a character that stands alone is -1 less its code point
        at, rows, seen, tokens = lengths.copy(), np.flatnonzero(lengths), [], []
        while len(rows):
            piece = last[at[rows], rows].astype(np.int64)
            lone = piece < 0
            tokens.append(np.where(lone, -1 - codes[at[rows] - 1, rows], piece))
            seen.append(rows)
            at[rows] -= np.where(lone, 1, p.length_of[piece])
            rows = rows[at[rows] > 0]
        count = np.zeros(n, np.int64)
        for r in seen:
            count[order[r]] += 1
        ends = np.cumsum(count)
        out = np.zeros(int(ends[-1]), np.int64)
        for k, (r, t) in enumerate(zip(seen, tokens, strict=True)):
            out[ends[order[r]] - 1 - k] = t
        return self.with_bytes(out, count)

    def with_bytes(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that stand alone, given below 0, as their byte pieces."""
        if not (tokens < 0).any():
            return tokens.astype(np.int32), sizes
        own = {c: self.alone(chr(-1 - c)) for c in np.unique(tokens[tokens < 0]).tolist()}
        each = np.ones(len(tokens), np.int64)
        for c, ids in own.items():
            each[tokens == c] = len(ids)
        out, starts = np.repeat(tokens, each), np.cumsum(each) - each
        for c, ids in own.items():
            at = starts[tokens == c]
            for k, i in enumerate(ids):
                out[at + k] = i
        return out.astype(np.int32), np.bincount(np.repeat(np.arange(len(sizes)), sizes), each, len(sizes)).astype(np.int64)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Pieces of each of some distinct words, in the order given."""
        p = self.pieces
        step, ending, lengths, scores = p.step, p.ending, p.lengths, p.scores
        survives, pairs, size = self.survives, self.pairs, self.size
        out: list[list[int]] = [[]] * len(words)
        states, last, total = [0], [-1], [0.0]  # by number of characters read; last -1: a boundary without merges
        before = ""
        for at in sorted(range(len(words)), key=words.__getitem__):
            word = words[at]
            n = min(len(before), len(word))
            shared = 0
            while shared < n and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :], last[shared + 1 :], total[shared + 1 :]
            state = states[shared]
            for i in range(shared, len(word)):
                state = step(state, word[i])
                best, value = -1, total[i] - 1e12  # no piece: the character stands alone, as bytes
                for piece in ending[state]:
                    start = i + 1 - lengths[piece]
                    if start < 0:
                        continue
                    left = last[start]
                    ok = pairs.get(left * size + piece)
                    if ok is None:
                        ok = survives(left, piece)
                    if ok:
                        # The merges of a word end in one way only, so no second piece survives here.
                        best, value = piece, total[start] + scores[piece]
                        break
                states.append(state)
                last.append(best)
                total.append(value)
            before, i, ids = word, len(word), []
            while i:
                piece = last[i]
                if piece >= 0:
                    ids.append(piece)
                    i -= lengths[piece]
                else:
                    i -= 1
                    ids.extend(self.alone(word[i])[::-1])
            ids.reverse()
            out[at] = ids
        return out

    def alone(self, c: str) -> list[int]:
        if not self.pieces.bytes:
            return [self.pieces.unknown]
        return [self.pieces.bytes[b] for b in c.encode("utf-8", "replace")]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        got = [self.encode_run(texts[lo:hi]) for lo, hi in slices(texts, RUN_CHARS)]
        return np.concatenate([np.zeros(0, np.int32), *(i for i, _ in got)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in got)])

    def encode_run(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > REMEMBERED:
            self.forget()
        split = [self.pieces.words.findall(self.pieces.processor.normalize(t)) if t else [] for t in texts]
        at = number_words([w for ws in split for w in ws], self.numbers)
        done = len(self.offsets) - 1
        if len(self.numbers) > done:
            flat, sizes = self.encode_all(list(islice(self.numbers, done, None)))
            self.flat = np.concatenate([self.flat, flat])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        sizes = self.offsets[at + 1] - self.offsets[at]
        ids = self.flat[flat_ranges(self.offsets[at], sizes)]
        rows = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        return ids, np.bincount(rows, sizes, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; the blank that the model put in front is taken off."""
        p = self.pieces
        text = p.flat[flat_ranges(p.begin[ids], p.sizes[ids])].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def encoder_of(model: str) -> TrieEncoder:
    return TrieEncoder(model)


def encoded(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (doc_id) and piece_ids (array of int) of every whole text."""

    def make():
        encoder = encoder_of(model)

        def score(texts):
            ids, sizes = encoder.encode(texts)
            ends = np.cumsum(sizes)
            return {"piece_ids": [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]}

        return score

    return annotate(docs, make, "piece_ids array<int>", text, keep)


def digests(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), round_trip (do the
    ids decode to the text?) of every whole text."""

    def make():
        encoder = encoder_of(model)
        lone = np.zeros(len(encoder.pieces.text), bool)
        lone[list(encoder.pieces.bytes.values())] = True

        def score(texts):
            ids, sizes = encoder.encode(texts)
            rows = []
            end = 0
            for t, n in zip(texts, sizes.tolist(), strict=True):
                own, end = ids[end : end + n], end + n
                rows.append((n, int(lone[own].sum()), zlib.crc32(own.astype("<u4").tobytes()), encoder.decode(own) == (t or "")))
            names = ("n_pieces", "n_byte_pieces", "ids_crc32", "round_trip")
            return dict(zip(names, zip(*rows, strict=True), strict=True))

        return score

    return annotate(docs, make, "n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean", text, keep)
