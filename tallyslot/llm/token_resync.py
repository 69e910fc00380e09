"""Token counts: huge documents are encoded in overlapping chunks that are spliced at proven boundaries.

A chunk is cut at a number of characters, so its ends may fall inside a word. Two neighbouring chunks share an
overlap; a place in it is a stable boundary when a blank or line break stands before it and both encodings start
a token there. The vocabulary's pre-tokenizer drops white space and its normaliser never joins across it, so what
stands before such a place cannot change the tokens after it, and the other way round. Where the overlap has no
such place it is widened, at last over whole chunks. Shorter documents are counted word by word from a table of
the words met so far, filled by the same library.

Defined cases. Null counts as the empty text: 0 tokens. Every input row gives one row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tallyslot.llm.common import Numbering, annotate, number_words, quiet_tokenizers, sums_by_row

#: Texts of more characters are spliced from chunks of so many, sharing OVERLAP with the next.
CHUNK, OVERLAP = 32_768, 256
#: Words whose counts a task remembers before it starts over.
REMEMBERED = 400_000
LIMIT = 2048


class TokenCounter:
    def __init__(self, model: str, chunk: int = CHUNK, overlap: int = OVERLAP, remembered: int = REMEMBERED):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        self.chunk, self.overlap, self.remembered = chunk, overlap, remembered
        self.numbers, self.counts = Numbering(), np.zeros(0, np.int64)
        self.widened = 0

    def starts(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Where the tokens of text[lo:hi] start, in characters of the whole text, in order."""
        offsets = self.tokenizer.encode(text[lo:hi], add_special_tokens=False).offsets
        return np.array([a for a, _ in offsets], np.int64) + lo

    @staticmethod
    def boundary(text: str, left: np.ndarray, right: np.ndarray, lo: int, hi: int) -> int:
        """The middle one of the stable boundaries inside (lo, hi), or -1."""
        both = np.intersect1d(left[(left > lo) & (left < hi)], right)
        stable = [b for b in both.tolist() if text[b - 1] in " \n"]
        return stable[len(stable) // 2] if stable else -1

    def count_long(self, text: str) -> int:
        n, total, base, lo = len(text), 0, 0, 0
        hi = min(n, self.chunk)
        left = self.starts(text, lo, hi)
        while hi < n:
            shared = self.overlap
            while True:
                start = max(lo, hi - shared)
                stop = min(n, hi + self.chunk)
                right = self.starts(text, start, stop)
                cut = self.boundary(text, left, right, max(start, base), hi)
                if cut >= 0 or start == lo:
                    break
                shared *= 2
                self.widened += 1
            if cut < 0:  # no boundary in the whole chunk: it grows by the next one
                self.widened += 1
                hi, left = stop, right
                continue
            total += int(((left >= base) & (left < cut)).sum())
            base, lo, hi, left = cut, start, stop, right
        return total + int((left >= base).sum())

    def count_words(self, texts: list[str]) -> np.ndarray:
        """Counts by words between blanks; a blank always ends a token, whatever stands around it."""
        if len(self.numbers) > self.remembered:
            self.numbers, self.counts = Numbering(), np.zeros(0, np.int64)
        split = [t.split(" ") for t in texts]
        found = number_words([w for ws in split for w in ws], self.numbers)
        if len(self.numbers) > len(self.counts):
            new = list(self.numbers)[len(self.counts):]
            got = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            self.counts = np.concatenate([self.counts, np.fromiter(map(len, got), np.int64, len(new))])
        return sums_by_row(self.counts[found], np.array([len(ws) for ws in split], np.int64))

    def __call__(self, texts: list[str | None]) -> dict:
        texts = [t or "" for t in texts]
        tokens = np.zeros(len(texts), np.int64)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        if short:
            tokens[short] = self.count_words([texts[i] for i in short])
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                tokens[i] = self.count_long(t)
        n_bytes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
        return {"n_bytes": n_bytes, "n_tokens": tokens, "over_limit": tokens > LIMIT}


def token_counts(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than LIMIT tokens) of every whole text."""
    return annotate(docs, lambda: TokenCounter(model), "n_bytes long, n_tokens long, over_limit boolean", text, keep)
