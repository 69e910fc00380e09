"""Benchmark decontamination by a distributed positional inverted index; DataFrame functions only.

The index holds one posting per document word that also occurs in the benchmark: document, position, term, and
one header row per document with its number of words. It is written once and read for everything that follows.
A phrase is found from the rarest terms of each window: their posting lists, shifted by the term's place in the
item, are intersected to alignments (document, item, shift); the lists of all item terms are then intersected on
those alignments alone, and runs of consecutive matches that cover a window are exact hits.

Defined cases. A null text has no words: n_words 0, nothing hit. Null ids are ids like any other; an item without
id can be hit, but is not listed. Repeated rows of documents each get their own row, with equal values; repeated
benchmark rows count once. Empty tables give empty results or no hits. Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyslot.llm.common import column
from tallyslot.sources.workdir import materialise

#: A word: letters and digits of ASCII after lower-casing, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: Terms of a window, the rarest first, whose lists make the first intersection.
ANCHORS = 2
#: The benchmark's terms are sent to all executors up to this size; beyond it Spark joins by shuffle.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Words in order; only A-Z are lower-cased. The plain lower() is the same, and faster, for ASCII texts."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(f"({WORD})"), F.lit(1))


@dataclass
class PhraseIndex:
    """postings: doc_id, text_hash, n_words (header rows only), pos (1 is the first word), term ('' in headers).
    items: item_key, item_id, item_words, item_pos, term."""

    postings: DataFrame
    items: DataFrame

    def headers(self) -> DataFrame:
        return self.postings.filter("pos = 0").select("doc_id", "text_hash", "n_words")

    def terms(self) -> DataFrame:
        return self.postings.filter("pos > 0").drop("n_words")


def build(docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text") -> PhraseIndex:
    """Write the postings of ``docs`` for all terms of ``benchmark``."""
    rows = benchmark.select(column(item_id).alias("item_id"), column(item_text).cast("string").alias("text")).distinct()
    spelled = rows.select("item_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    items = materialise(
        spelled.select(
            F.concat_ws(":", F.col("item_id").cast("string"), F.col("h").cast("string")).alias("item_key"),
            "item_id", F.size("w").alias("item_words"), F.posexplode("w").alias("item_pos", "term"),
        ).withColumn("item_pos", F.col("item_pos") + 1),
        "phrase-items",
    )
    vocabulary = items.select("term").distinct()
    held = vocabulary.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    vocabulary = vocabulary.union(items.sparkSession.createDataFrame([("",)], "term string"))
    if held <= BROADCAST_BYTES:
        vocabulary = F.broadcast(vocabulary)
    spread = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w")
    )
    postings = spread.select(
        "doc_id", "text_hash", F.size("w").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "term")
    ).join(vocabulary, "term", "left_semi")
    postings = postings.select(
        "doc_id", "text_hash", F.when(F.col("pos") == 0, F.col("n").cast("long")).alias("n_words"), "pos", "term"
    )
    return PhraseIndex(materialise(postings, "phrase-postings"), items)


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def alignments(index: PhraseIndex, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, text_hash, item_key, shift) that hold the rarest terms of some window at their places."""
    seen = index.terms().groupBy("term").agg(F.count("*").alias("seen"))
    last = F.greatest(F.lit(1), F.col("item_words") - (window - 1))
    first = F.greatest(F.lit(1), F.col("item_pos") - (window - 1))
    placed = index.items.join(seen, "term").withColumn("start", F.explode(F.sequence(first, F.least("item_pos", last))))
    # a window with a term that no document has cannot occur
    whole = Window.partitionBy("item_key", "start")
    rarest = whole.orderBy("seen", "item_pos")
    placed = placed.withColumn("present", F.count("*").over(whole)).withColumn("rank", F.row_number().over(rarest))
    placed = placed.filter((F.col("present") == F.least(F.lit(window), "item_words")) & (F.col("rank") <= anchors))
    leads = materialise(placed.select("item_key", "item_words", "item_pos", "term").distinct(), "phrase-leads")
    shifted = index.terms().join(leads, "term").withColumn("shift", F.col("pos") - F.col("item_pos"))
    met = shifted.groupBy("doc_id", "text_hash", "item_key", "shift").agg(
        F.min("item_pos").alias("a"), F.max("item_pos").alias("b"), F.max("item_words").alias("item_words")
    )
    return met.filter("a < b OR item_words = 1").drop("a", "b")


def phrase_matches(index: PhraseIndex, window: int = WINDOW) -> DataFrame:
    """Maximal runs of an item's words that a document holds and that cover a window: doc_id, text_hash, item_key,
    start, stop (document positions, both inside)."""
    found = materialise(alignments(index, window), "phrase-alignments")
    near = index.terms()
    holders = found.select("doc_id", "text_hash").distinct()
    near = near.join(holders, same_document(near, holders), "left_semi")
    wanted = found.drop("item_words").join(index.items.drop("item_id"), "item_key")
    wanted = wanted.withColumn("pos", F.col("shift") + F.col("item_pos"))
    same = same_document(wanted, near) & (wanted["pos"] == near["pos"]) & (wanted["term"] == near["term"])
    met = wanted.join(near, same, "left_semi")
    order = Window.partitionBy("doc_id", "text_hash", "item_key", "shift").orderBy("item_pos")
    runs = met.withColumn("run", F.col("item_pos") - F.row_number().over(order))
    runs = runs.groupBy("doc_id", "text_hash", "item_key", "shift", "run").agg(
        F.min("pos").alias("start"), F.max("pos").alias("stop"), F.max("item_words").alias("item_words")
    )
    long_enough = F.col("stop") - F.col("start") + 1 >= F.least(F.lit(window), "item_words")
    return runs.filter(long_enough).select("doc_id", "text_hash", "item_key", "start", "stop")


def proximity_matches(index: PhraseIndex, terms: int = 4, slack: int = 16) -> DataFrame:
    """Documents that hold an item's ``terms`` rarest distinct terms, in any order, within ``slack`` words:
    doc_id, text_hash, item_key, stop (the last place where such a stretch ends)."""
    seen = index.terms().groupBy("term").agg(F.count("*").alias("seen"))
    mine = index.items.select("item_key", "term").distinct().join(seen, "term")
    rarest = Window.partitionBy("item_key").orderBy("seen", "term")
    mine = mine.withColumn("rank", F.row_number().over(rarest)).filter(F.col("rank") <= terms)
    mine = mine.withColumn("needed", F.count("*").over(Window.partitionBy("item_key"))).drop("seen", "rank")
    listed = index.terms().join(mine, "term")
    stretch = Window.partitionBy("doc_id", "text_hash", "item_key").orderBy("pos").rangeBetween(-slack, 0)
    full = listed.withColumn("held", F.size(F.collect_set("term").over(stretch))).filter("held = needed")
    return full.groupBy("doc_id", "text_hash", "item_key").agg(F.max("pos").alias("stop"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **names: str) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit (words inside any occurrence of a window), n_items,
    items_sha256 (of the sorted, comma-joined ids of the items that occur), contaminated."""
    index = build(docs, benchmark, **names)
    runs = materialise(phrase_matches(index, window), "phrase-runs")
    inside = runs.select("doc_id", "text_hash", F.explode(F.sequence("start", "stop")).alias("pos")).distinct()
    hit = inside.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit"))
    ids = index.items.filter("item_id IS NOT NULL").select("item_key", F.col("item_id").cast("string").alias("item")).distinct()
    held = runs.select("doc_id", "text_hash", "item_key").distinct().join(ids, "item_key")
    held = held.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("items"))
    head = index.headers()
    out = head.join(hit, same_document(head, hit), "left").select(head["*"], hit["n_hit"])
    out = out.join(held, same_document(out, held), "left").select(out["*"], held["items"])
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that contamination() marks; all columns and other rows stay."""
    judged = contamination(docs, benchmark, window).filter("contaminated")
    judged = judged.select(F.col("doc_id").alias("judged id"), F.col("text_hash").alias("judged hash")).distinct()
    same = docs["doc_id"].eqNullSafe(judged["judged id"]) & (F.xxhash64(docs["text"].cast("string")) == judged["judged hash"])
    return docs.join(judged, same, "left_anti")
