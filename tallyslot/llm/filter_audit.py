"""Filter interaction audit: what each of five filters removes, in every order of the five, per source.

A table-driven byte transducer runs over the UTF-8 bytes of whole texts once. It counts words, capitals, code points
and symbols, and its word spans go into a hash table whose hits are verified byte by byte, which counts the distinct
words. The filters are: A too few words, B too few distinct words, C too many capitals, D a symbol, E an equal text
with a smaller doc_id anywhere in the table.

Texts are equal when their SHA-256 digests are. A text with very many copies is never gathered: its rows are counted
per source and failed filters before the smallest id of the digest meets them. The 600 pairs of order and step of a
source need only 80 sums (a filter and the set of filters before it), taken from counts by the set of failed filters.

Cases: null texts are empty; null or empty sources are the source ''. A document without doc_id, or with the same
doc_id as its smallest copy (a repeated row), fails E for no reason of its own: it has no smaller copy, so it passes.
A document is good or toxic if any of its label rows says so; labels that are null or without doc_id say nothing.
Empty tables give no rows. Other columns are ignored, whatever their names. A text longer than a block is a block of
its own.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyslot.llm.byte_words import Machine, Texts, blocks, hash_spans, insert_spans
from tallyslot.llm.common import column
from tallyslot.llm.exact_copies import digest

LETTERS = "ABCDE"
# The limits, the blanks and the symbols of the filters.
LEAST_WORDS = 50
DISTINCT_PER_CENT = 65
CAPITALS_PER_CENT = 5
SYMBOLS = b"#$%&*|"
BLANKS = bytes([32, *range(9, 14)])

CAPITAL, LATER_BYTE, SYMBOL, BEGIN = 2, 4, 8, 16
COUNTS = "n_words long, n_distinct long, n_capitals long, n_chars long, n_symbols long"


def _step() -> np.ndarray:
    step = np.zeros((2, 256), np.uint8)
    step[:, [b for b in range(256) if b not in BLANKS]] |= Machine.INSIDE
    step[:, ord("A") : ord("Z") + 1] |= CAPITAL
    step[:, 0x80:0xC0] |= LATER_BYTE
    step[:, list(SYMBOLS)] |= SYMBOL
    step[0, [b for b in range(256) if b not in BLANKS]] |= BEGIN
    return step


MACHINE = Machine(_step())


def count(texts: Texts) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    flags = MACHINE.run(texts.data, texts.first)
    n = len(texts.ends)

    def per_text(places: np.ndarray) -> np.ndarray:
        return np.bincount(texts.owner_of(places), minlength=n)

    starts, lengths = texts.spans((flags & Machine.INSIDE).astype(bool))
    owner = texts.owner_of(starts)
    first = insert_spans(texts, starts, lengths, hash_spans(texts, starts, lengths), owner)
    return {
        "n_words": per_text(np.flatnonzero(flags & BEGIN)),
        "n_distinct": np.bincount(owner[first == np.arange(len(starts))], minlength=n),
        "n_capitals": per_text(np.flatnonzero(flags & CAPITAL)),
        "n_chars": texts.ends - texts.starts - per_text(np.flatnonzero(flags & LATER_BYTE)),
        "n_symbols": per_text(np.flatnonzero(flags & SYMBOL)),
    }


def measure(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per row of ``df``: the columns of ``keep`` and the five counts of the text."""
    added = T._parse_datatype_string(COUNTS)
    schema = T.StructType([df.schema[k] for k in keep] + added.fields)
    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    source = df.select(*[column(k).alias(f"c{i}") for i, k in enumerate(keep)], column(text).cast("string").alias("whole"))

    def run(batches):
        for batch in batches:
            for lo, hi, texts in blocks(batch.column(len(keep))):
                got = count(texts)
                made = [pa.array(got[f.name], type=k) for f, k in zip(added.fields, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))] + made, names=[f.name for f in schema.fields]
                )

    return source.mapInArrow(run, schema)


def failed_by_text():
    """The set of the filters A to D that a measured text fails, as bits 0 to 3."""
    fails = [
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < DISTINCT_PER_CENT * F.col("n_words"),
        100 * F.col("n_capitals") > CAPITALS_PER_CENT * F.col("n_chars"),
        F.col("n_symbols") > 0,
    ]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def marks(labels: DataFrame) -> DataFrame:
    """``doc_id, good, toxic``: one row per labelled document."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, good, toxic, n``: documents by source, set of failed filters (bits 0 to 4) and label."""
    told = docs.select(
        column("doc_id").alias("doc_id"), F.coalesce(column("source").cast("string"), F.lit("")).alias("part"),
        digest().alias("digest"), column("text").cast("string").alias("text"),
    )
    rows = measure(told, ["doc_id", "part", "digest"]).select("doc_id", "part", "digest", failed_by_text().alias("failed"))
    # Rows without an id go to many tasks although they meet no label.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(F.lit(0))
    rows = rows.withColumn("spread", spread).join(
        marks(labels).withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left"
    )
    kind = ["part", "failed", "good", "toxic"]
    rows = rows.select(
        "digest", "doc_id", "part", "failed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    )
    # A text's copies: first by id, then by kind with the smallest id and its count, then the smallest of all kinds.
    by_id = rows.groupBy("digest", "doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    by_kind = by_id.groupBy("digest", *kind).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without"),
    )
    by_kind = by_kind.withColumn("least_of_all", F.min("least").over(Window.partitionBy("digest")))
    firsts = F.col("without") + F.when(F.col("least") == F.col("least_of_all"), F.col("at_least")).otherwise(0)
    dealt = F.array(
        F.struct(F.col("failed").alias("failed"), firsts.alias("n")),
        F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - firsts).alias("n")),
    )
    dealt = by_kind.select("part", "good", "toxic", F.explode(dealt).alias("d")).select("part", "good", "toxic", "d.*")
    return dealt.groupBy(*kind).agg(F.sum("n").alias("n"))


def orders(spark) -> DataFrame:
    """``filter_order, step, bit, before``: the 600 pairs of an order and a step, a fixed table."""
    rows = []
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            rows.append(("".join(order), step, bit, before))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    counts = failures(docs, labels)
    n_letters = len(LETTERS)
    asked = [(1 << i, before) for i in range(n_letters) for before in range(1 << n_letters) if not before >> i & 1]
    cells = counts.withColumn(
        "cell", F.explode(F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in asked]))
    ).select("part", "failed", "good", "toxic", "n", "cell.bit", "cell.before")
    failed, bit, before, n = (F.col(c) for c in ("failed", "bit", "before", "n"))
    fails, earlier = failed.bitwiseAND(bit) != 0, failed.bitwiseAND(before) != 0
    removed = fails & ~earlier

    def total(where, what=n):
        return F.sum(F.when(where, what).otherwise(0).cast("long"))

    # A document is removed by one of the filters it fails, by each in an equal share of the 120 orders.
    share = n * F.element_at(F.array(*[F.lit(120 // k) for k in range(1, n_letters + 1)]), F.greatest(F.bit_count("failed"), F.lit(1)))
    sums = cells.groupBy("part", "bit", "before").agg(
        total(~fails & ~earlier).alias("kept"), total(removed).alias("removed"), total(fails & earlier).alias("redundant"),
        total(failed == bit).alias("unique_fails"), total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"), total(fails, share).alias("shapley"),
    )
    return sums.join(F.broadcast(orders(docs.sparkSession)), ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
