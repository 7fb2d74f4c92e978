"""From raw documents to a mixed, encoded corpus: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's rows as Parquet in the shared folder and reads them back for the
next. All stages but the last return the columns of documents.

The SQL side cannot express the robust estimates, the signatures, the index
family or the merges, so ORACLE_SQL is None; tests/llm compares run() with a
brute-force version on a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsieve.llm import bagminhash, mixing, quality, sentencepieces, suffixes
from foldsieve.session import read, ship_package, work_table

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outliers of their language and source."""
    ship_package(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest doc_id."""
    ship_package(spark)
    return bagminhash.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur again; a text without a word left goes."""
    ship_package(spark)
    kept = suffixes.remove_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the weighted mix hands them out, by virtual time; a second pass repeats rows."""
    ship_package(spark)
    return mixing.mixed_rows(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with ids and n_tokens."""
    ship_package(spark)
    return sentencepieces.encode_documents(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", piece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = work_table(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
