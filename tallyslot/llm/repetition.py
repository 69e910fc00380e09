"""Quality rules by repetition: how much of a text lies inside n-grams and lines that the text has already shown.

Each word has a 64-bit value that hangs on its bytes alone; the hash of an n-gram is a polynomial of the values of its
words, rolled over the whole text at once in numpy for each length. Within a document equal hashes mark duplicated
n-grams, and the characters of all words they cover are summed. The base rule's 3-word windows are compared by
numbers of the words, so they are exact. All results are functions of the text alone, whatever texts stand beside it.

The verdict: a text is kept if it passes the base rule and none of these shares is over its limit:
- characters inside duplicated n-grams, later occurrences only, n = 5 .. 10 (limits fall from 0.15 to 0.10);
- characters of the most frequent n-gram, all its occurrences, n = 2 .. 4 (0.20, 0.18, 0.16), if it occurs three
  times or more; of equally frequent ones the one that covers most;
- characters inside lines equal to an earlier line (0.30), and such lines among lines with a word (0.30).

Defined cases. Null and empty texts have no words, fail the base rule and are not kept. A text of fewer words than
n has no n-gram. Every input row gives one row, also a repeated one; an empty table gives none; columns outside
``keep`` are never read, and names in ``keep`` may not be those of the results. A very long text is judged whole.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from tallyslot.llm.common import Numbering, annotate, number_words

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
DUPLICATE_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
TOP_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
LINE_CHARS, LINE_SHARE = 0.30, 0.30

ADDED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, top_share double, dup_share double, dup_line_share double"
)


class Values:
    """The 64-bit values of numbered words, from their bytes; each distinct word is hashed once."""

    def __init__(self, numbers: Numbering):
        self.numbers, self.held, self.n = numbers, np.zeros(1024, np.uint64), 0

    def of(self, at: np.ndarray) -> np.ndarray:
        n = len(self.numbers)
        if n > self.n:
            if n > len(self.held):
                self.held = np.concatenate([self.held[: self.n], np.zeros(2 * n - self.n, np.uint64)])
            # The numbering keeps the order of its words, so the new ones are the last.
            new = islice(reversed(self.numbers), n - self.n)
            self.held[self.n : n] = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, n - self.n)[::-1]
            self.n = n
        return self.held[at]


def rolled(values: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams from those of the (n - 1)-grams: one multiplication and one addition each."""
    return before[:-1] * np.uint64(0x9FB21C651E98DF25) + values[n - 1 :]


def covered(marks: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Words inside the n-grams whose first words are marked."""
    steps = np.zeros(n_words + 1, np.int32)
    at = np.flatnonzero(marks)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place: its group, the groups' sizes, and whether an earlier place has the same key."""
    _, first, group, sizes = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return group, sizes, later


def most_covered(group: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, n: int) -> int:
    """Characters inside the occurrences of an n-gram, for that of the most frequent ones that covers most."""
    at = np.flatnonzero(sizes[group] == sizes.max())
    at = at[np.argsort(group[at], kind="stable")]
    before = np.concatenate([[0], np.cumsum(lengths)])
    starts = at.copy()
    again = group[at[1:]] == group[at[:-1]]
    # what the occurrence before already covers counts once
    starts[1:][again] = np.maximum(at[1:], at[:-1] + n)[again]
    return int(np.bincount(group[at], before[at + n] - before[starts]).max())


def exact_windows(numbers: np.ndarray) -> np.ndarray:
    """A number per 3-word window, equal only for equal windows."""
    if int(numbers.max()) >= 1 << 21:
        numbers = np.unique(numbers, return_inverse=True)[1]
    if len(numbers) < 1 << 21 or int(numbers.max()) < 1 << 21:
        a, b, c = numbers[:-2], numbers[1:-1], numbers[2:]
        return (a << 42) | (b << 21) | c
    pairs = np.unique(np.stack([numbers[:-1], numbers[1:]]), axis=1, return_inverse=True)[1].ravel()
    return np.unique(np.stack([pairs[:-1], numbers[2:]]), axis=1, return_inverse=True)[1].ravel()


def judged(numbers: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> tuple[int, float, float]:
    """Words in repeated 3-word windows; how far the shares of top and of duplicated n-grams use up their limits."""
    n_words, total = len(numbers), int(lengths.sum())
    repeated, top, dup = 0, 0.0, 0.0
    if n_words >= 3:
        group, sizes, _ = grouped(exact_windows(numbers))
        repeated = int(covered(sizes[group] > 1, 3, n_words).sum())
    h = values
    for n in range(2, 1 + min(n_words, max(DUPLICATE_SHARE))):
        h = rolled(values, h, n)
        if n == 3 and repeated == 0:
            break  # no 3-gram twice, so no longer one either
        group, sizes, later = grouped(h)
        if n in TOP_SHARE and sizes.max() >= 3:
            top = max(top, most_covered(group, sizes, lengths, n) / total / TOP_SHARE[n])
        if n in DUPLICATE_SHARE:
            dup = max(dup, int(lengths[covered(later, n, n_words)].sum()) / total / DUPLICATE_SHARE[n])
    return repeated, top, dup


def lines(text: str) -> tuple[int, int, int, int]:
    """Lines with a word, those equal to an earlier one, and the characters of both kinds."""
    if "\n" not in text:
        return (1, 0, len(text), 0) if text.strip(" \t\n\r\v\f") else (0, 0, 0, 0)
    seen, n, again, chars, twice = set(), 0, 0, 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\r\v\f"):
            n += 1
            chars += len(line)
            if line in seen:
                again += 1
                twice += len(line)
            else:
                seen.add(line)
    return n, again, chars, twice


def score(texts: list[str | None]) -> dict:
    numbers_of, rows = Numbering(), []
    values = Values(numbers_of)
    for text in texts:
        text = text or ""
        words = text.encode("utf-8", "surrogatepass").split()
        n_words = len(words)
        n_symbols = sum(map(text.count, SYMBOLS))
        n_lines, again, chars, twice = lines(text)
        repeated, top, dup, word_chars = 0, 0.0, 0.0, 0
        if n_words:
            numbers = number_words(words, numbers_of)
            # code points of a word: its bytes that do not continue one
            if text.isascii():
                lengths = np.fromiter(map(len, words), np.int64, n_words)
            else:
                lengths = np.fromiter(map(len, text.translate(BLANKS).split(" ")), np.int64)
                lengths = lengths[lengths > 0]
            word_chars = int(lengths.sum())
            repeated, top, dup = judged(numbers, values.of(numbers), lengths)
        failed = n_words < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n_words
        line_share = max(twice / chars / LINE_CHARS, again / n_lines / LINE_SHARE) if n_lines else 0.0
        bad = max(top, dup, line_share) > 1
        rows.append((n_words, word_chars, n_symbols, again, repeated, failed, not failed and not bad, top, dup, line_share))
    names = [c.split()[0] for c in ADDED.split(", ")]
    return dict(zip(names, zip(*rows, strict=True), strict=True))


#: The five other characters that part words, all turned into a blank.
BLANKS = {c: " " for c in range(0x09, 0x0E)}


def quality(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id and ADDED for every whole text; the shares are in units of their limits."""
    return annotate(docs, lambda: score, ADDED, text, keep)
