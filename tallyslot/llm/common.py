"""What the text operators share: reading tables, running a scorer over whole texts in slices, word dictionaries."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of text that a scorer sees at once; one longer text is a slice of its own.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its whole name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``limit`` characters together, one text at least."""
    return ranges([len(t) if t else 0 for t in texts], limit)


def ranges(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def annotate(
    df: DataFrame,
    make: Callable[[], Callable[[list[str | None]], dict]],
    added: str,
    text: str = "text",
    keep: list[str] | None = None,
    prefix: str = "",
    limit: int = SLICE_CHARS,
) -> DataFrame:
    """One row per row of ``df``: the columns of ``keep`` and those of the DDL ``added``, with ``prefix`` before their names.

    ``make`` is called once a task and gives the scorer: from a list of texts to a dict with one sequence per
    added column, at most ``limit`` characters at a time. Columns are passed on by position, so names in ``df``
    outside ``keep`` never clash. A text that is kept is sent once, and of a batch only one slice is made Python strings.
    """
    keep = ["doc_id"] if keep is None else keep
    new = T._parse_datatype_string(added)
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(prefix + f.name, f.dataType) for f in new.fields])
    sent = [column(k).alias(f"c{i}") for i, k in enumerate(keep)]
    at = keep.index(text) if text in keep and df.schema[text].dataType == T.StringType() else len(keep)
    source = df.select(*sent, *([column(text).cast("string").alias("whole")] if at == len(keep) else []))
    kinds = [to_arrow_type(f.dataType) for f in new.fields]
    names = [f.name for f in new.fields]
    shown = [*keep, *(prefix + n for n in names)]

    def run(batches):
        score = None
        for batch in batches:
            score = score or make()
            texts = batch.column(at)
            for lo, hi in ranges(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), limit):
                got = score(texts.slice(lo, hi - lo).to_pylist())
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    kept + [pa.array(got[n], type=k) for n, k in zip(names, kinds, strict=True)], names=shown
                )

    return source.mapInArrow(run, schema)


def quiet_tokenizers() -> None:
    """Spark already fills the cores; the tokenizer library must not start threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


class Numbering(dict):
    """Numbers keys 0, 1, 2 .. in the order in which they are first looked up."""

    def __init__(self):
        super().__init__()
        self.next = count().__next__

    def __missing__(self, key):
        self[key] = n = self.next()
        return n


def number_words(words: list, numbers: Numbering) -> np.ndarray:
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def coded_pieces(pieces: pa.ListArray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of lists of strings: the place of every string among the distinct ones, these, and the lengths of the lists."""
    coded = pieces.flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.diff(pieces.offsets.to_numpy()).astype(np.int64)


def split_words(texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The words that str.split() finds: the place of every one among the distinct ones, these, and words per text."""
    at, kinds, sizes = coded_pieces(pc.utf8_split_whitespace(pc.fill_null(pa.array(texts, pa.string()), "")))
    if "" in kinds:  # what stands before or after white space at an edge
        empty = kinds.index("")
        full = at != empty
        sizes = sums_by_row(full.astype(np.int64), sizes)
        at = at[full]
        at = at - (at > empty)
        del kinds[empty]
    return at, kinds, sizes


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, .. start + length - 1 of each range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums_by_row(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; a run of length 0 gives 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def vocabulary_file(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)
