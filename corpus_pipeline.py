"""Documents to training sequences: each stage is one of the library's operators, over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spoofscan.llm import line_dedup, mixing, packing, simhash, toxicity
from spoofscan.llm.common import documents, labels, materialise


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from labelled rows of the table `docs` is taken from."""
    return toxicity.drop_toxic(docs, labels(spark, sf_dir))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without later copies of repeated lines."""
    return line_dedup.deduplicated(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked by a Jaccard similarity of 0.8 or more."""
    return simhash.keep_similar(docs, size=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]
#: Learned scores, fingerprints and packing aren't SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage keeps is written, and the next one reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
