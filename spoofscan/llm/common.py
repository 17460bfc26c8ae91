"""Helpers that several operators share."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop_path, fresh_path, materialise, release, shared_dir

#: A word is a maximal run of bytes outside these; the same class in every operator.
WORD = r"[^\x20\x09-\x0D]+"
#: Stored bytes of a join's smaller side that one task may hold.
BUILD_BYTES = 16 << 20


def hash_join(large: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`large` joined to a materialised table by a key that no row of `small` shares with many others.

    The large side isn't sorted. A table of the size that Spark broadcasts is broadcast; a larger one is dealt to so many
    partitions that each one's hash table holds BUILD_BYTES or so of the stored form at most.
    """
    spark = large.sparkSession
    stored = int(str(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if stored <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        return large.join(small, key, how)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored // BUILD_BYTES + 1)
    return large.repartition(parts, key).join(small.repartition(parts, key).hint("shuffle_hash"), key, how)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(batches, column: str = "text", most: int = 8_000_000):
    """Arrow batches cut so that the texts of one hold `most` bytes, or are one text; nothing is copied."""
    for batch in batches:
        texts = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for a, b in slices(sizes, most):
            yield batch.slice(a, b - a)


def arrow_texts(batch, column: str = "text") -> list[str]:
    """The texts of one Arrow batch, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def slices(sizes: list[int], most: int):
    """(start, end) runs over `sizes`, each of at least one item and else at most `most` in sum."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


__all__ = [
    "WORD", "arrow_texts", "benchmark", "documents", "drop_path", "fresh_path", "hash_join", "labels",
    "materialise", "release", "shared_dir", "slices", "small_batches", "word_count",
]
