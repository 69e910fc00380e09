"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, piece ids.

Each stage works on all that the one before has kept and returns the columns of documents; the last adds the ids.
Its results are written as Parquet in the shared folder and read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyslot.llm import jaccard_segments, language_spans, phrase_index, pii_segments, piece_trie
from tallyslot.llm.common import column, table, vocabulary_file
from tallyslot.sources.workdir import materialise

SHINGLE, PER_CENT = 5, 80
EXTRA = "found by the stage"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; all others stay as they are. With no language learned, all that
    have letters stay."""
    model = language_spans.train(docs)
    if not model.languages:
        return docs.filter(column("text").cast("string").rlike(r"\p{L}"))
    found = language_spans.identify(docs, model, keep=docs.columns, prefix=EXTRA)
    return found.filter(column(EXTRA + "lang_pred") != "und").select(*[column(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their word shingles, also over others, the one with the smallest id stays."""
    return jaccard_segments.keep_one(docs, per_cent=PER_CENT, shingle=SHINGLE)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go."""
    return phrase_index.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows the new text."""
    found = pii_segments.redact(docs, pii_segments.train(docs), EXTRA)
    kept = {"text": column(EXTRA)}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.char_length(column(EXTRA)).cast(docs.schema["n_chars"].dataType)
    return found.select(*[kept.get(c, column(c)).alias(c) for c in docs.columns])


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents and piece_ids."""
    return piece_trie.encoded(docs, vocabulary_file("piece_bpe_32k.model"), keep=[c for c in docs.columns if c != "piece_ids"])


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("benchmark", no_benchmark),
    ("personal_data", no_personal_data),
    ("pieces", piece_ids),
]

#: Trained models and encodings are not SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
