"""A corpus pipeline of the document operators: STAGES in order, each on all that the one before kept.

Toxic documents go, one document of each near-duplicate group stays, documents that hold a benchmark
item go, personal data is masked in place, and what is left is encoded. Every stage but the last returns the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelgrove.llm import neardup, pii, tiling, toxicity, unigram
from pixelgrove.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score below 0.3; null, empty and blank texts have no toxic words and stay, repeated rows go or stay together."""
    return toxicity.non_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group that links of five-word shingles at 0.8 connect.

    Rows without a text or an id are in no group and stay. Rows that repeat both stay if their document does.
    """
    return neardup.deduplicated(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item by half; null and empty texts cover none and stay."""
    return tiling.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data masked in text and n_chars made to fit; a null text stays null."""
    return pii.redacted(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, round_trip of every row; a null text has null ids, an empty one none."""
    return unigram.encode(docs).select("doc_id", "ids", "n_pieces", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("encoding", encode_pieces),
]

#: Classifier, sketches, tiles and Viterbi have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
