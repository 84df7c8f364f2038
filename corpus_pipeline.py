"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltaloom.llm import bpe, decontaminate, exact_dedup, quality, similar
from deltaloom.llm._io import new_path, stage, table

NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8

#: No SQL expresses the first stage.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    found = quality.classify(docs, table(spark, sf_dir, "labels"))
    return found.filter("keep").select("doc.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id."""
    path = new_path(spark, "digest_index")
    index = exact_dedup.DigestIndex(spark, path.rpartition("/")[2].replace("-", "_"), path)
    return exact_dedup.distinct(docs, index)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least doc_id. Near copies are texts that wide
    SimHash fingerprints bring together and whose sets of five-word shingles have a Jaccard similarity of 0.8 or
    more, and what such pairs connect."""
    return similar.deduplicate(docs, size=NEAR_WORDS, similarity=NEAR_SIMILARITY)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark; without those that mostly consist of them."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("simhash near-dedup", dissimilar),
    ("benchmark decontamination", clean),
    ("bpe encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
