"""Exact duplicates by a heavy-hitter split.

Every text becomes its SHA-256 digest, written once beside the document's id and a row number. Each task keeps a
Misra-Gries summary of the digests it reads; the sums of the summaries name at most ``2 * HEAVY`` digests among which
every digest with over 1 / ``HEAVY`` of all rows is found. Those are counted exactly. The ones that really are that
frequent, with the rows that stay, are at most ``HEAVY`` rows and are broadcast: their copies are answered where they
lie, without a shuffle. All other digests have few rows each and are grouped by an ordinary shuffle.

Cases: null text counts as empty. The largest doc_id of equal texts stays; a null doc_id is below all others. Of rows
that share that doc_id too (repeated rows) one stays. Empty tables give no rows; other columns are ignored, whatever
their names. Text length does not matter: only digests are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyslot.llm.common import column
from tallyslot.sources.workdir import materialise

#: A digest with over 1 / HEAVY of all rows is answered without a shuffle; so many digests at most are broadcast.
HEAVY = 1024


def digest(text: str = "text"):
    """The SHA-256 of the whole text, 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(column(text).cast("string"), F.lit("")).cast("binary"), 256))


class Summary:
    """Misra-Gries: at most ``size`` digests with counters. A digest with more than rows / (size + 1) rows is among
    them, and no counter is short by more than that. Batches are added whole."""

    def __init__(self, size: int):
        self.size = size
        self.held = pa.table({"digest": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})

    def add(self, digests: pa.Array) -> None:
        seen = pa.table({"digest": digests.cast(pa.binary()), "n": np.ones(len(digests), np.int64)})
        sums = pa.concat_tables([self.held, seen]).group_by("digest").aggregate([("n", "sum")])
        n = sums["n_sum"].to_numpy()
        if len(n) > self.size:
            n = n - np.partition(n, len(n) - 1 - self.size)[len(n) - 1 - self.size]
        left = n > 0
        self.held = pa.table({"digest": sums["digest"].filter(pa.array(left)).combine_chunks(), "n": n[left]})


def summaries(digests: DataFrame, size: int) -> DataFrame:
    """``digest, n``: the summary of each task, at most ``size`` rows a task."""

    def run(batches):
        summary = Summary(size)
        for batch in batches:
            summary.add(batch.column(0))
        yield from summary.held.to_batches()

    return digests.select("digest").mapInArrow(run, "digest binary, n long")


def frequent(digests: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``digest, top, size`` of each digest with over 1 / ``heavy`` of all rows: ``top`` is its last (id, row)."""
    total = digests.count()
    # A sum of counters is short by less than total / (2 * heavy), and the counters add up to total at most: so every
    # frequent digest passes, and at most 2 * heavy digests do.
    named = summaries(digests, 2 * heavy).groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= total / (2 * heavy))
    exact = digests.join(F.broadcast(named.select("digest")), "digest").groupBy("digest").agg(
        F.max(F.struct("id", "row")).alias("top"), F.count(F.lit(1)).alias("size")
    )
    return exact.where(F.col("size") > total / heavy)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carried: list[str] | None = None, heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs``: ``id, digest, top, size, c0, c1 ..`` (the carried columns) and ``stays``."""
    carried = carried or []
    digests = materialise(
        docs.select(
            column(doc_id).alias("id"), digest(text).alias("digest"), F.monotonically_increasing_id().alias("row"),
            *[column(c).alias(f"c{i}") for i, c in enumerate(carried)],
        ),
        "text-digests",
    )
    winners = F.broadcast(materialise(frequent(digests.select("id", "digest", "row"), heavy), "text-winners"))
    alike = Window.partitionBy("digest")
    shuffled = digests.join(winners.select("digest"), "digest", "left_anti")
    shuffled = shuffled.withColumn("top", F.max(F.struct("id", "row")).over(alike)).withColumn("size", F.count(F.lit(1)).over(alike))
    both = digests.join(winners, "digest").unionByName(shuffled)
    return both.withColumn("stays", F.col("row") == F.col("top.row"))


def copies(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per document."""
    return groups(docs, heavy=heavy).select(
        F.col("id").alias("doc_id"), F.col("top.id").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("stays").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The documents that stay, with all their columns."""
    found = groups(docs, carried=docs.columns, heavy=heavy).where("stays")
    return found.select(*[column(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
