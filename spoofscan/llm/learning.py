"""What the two classifiers share: held-out rows and a bounded sample of labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled texts of more bytes than this aren't learnt from, so that the sample's size has a bound; all are scored.
MOST_BYTES = 200_000


def remainder(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether a row is in the fold that training never sees. Rows with a null key have no labels and aren't in it."""
    return F.coalesce(remainder(key, folds) == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int, key: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """At most `most` labelled rows (order, id, text, y) outside the held-out fold, of at most `most_bytes` each.

    The sample is the first `most` keys in the order of a hash, so it is the same on every run; its keys are few enough
    to broadcast, so that only the sampled texts leave the scan. Null labels and keys are left out; of a key labelled
    twice, the larger label counts; of a key that stands at several texts, the least text.
    """
    chosen = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    chosen = chosen.filter(~held_out(F.col("id"), folds, fold)).groupBy("id").agg(F.max("y").alias("y"))
    chosen = chosen.withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(most)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.filter(F.octet_length("text") <= most_bytes).join(F.broadcast(chosen), "id")
    return rows.groupBy("order", "id", "y").agg(F.min("text").alias("text")).select("order", "id", "text", "y")
