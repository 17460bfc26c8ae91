"""Token counts through a digest cache.

A count depends on a text and a tokenizer only. Texts are normalised (null is the empty text) and digested; digests are
joined to the counts that the cache holds for this tokenizer version; only distinct misses are encoded, and appended.
Digests are compared before any text moves: with a cache that knows most texts, only the others are shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_texts, fresh_path, materialise, small_batches

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def normalised(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def read_cache(spark, path: str, tokenizer_digest: str) -> DataFrame:
    """One row per content digest that the cache at `path` has for a tokenizer; none if there is no cache yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA)
    found = spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("tokenizer_digest") == tokenizer_digest)
    return found.groupBy("content_digest", "tokenizer_digest").agg(F.min("n_tokens").alias("n_tokens"))


def _encode(path: str):
    def run(batches):
        for batch in small_batches(batches, most=4_000_000):
            counts = tokens.count(path, arrow_texts(batch))
            yield pa.record_batch([batch.column("content_digest"), pa.array(counts, pa.int64())], names=["content_digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, cache: str | None = None, tokenizer: str | None = None, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty ones (0 bytes, 0 tokens); null and repeated keys are kept. `cache` is a Parquet folder
    that later calls may share; without one, a fresh folder beside the checkpoints is used. A job that dies while it
    appends leaves no half rows (Spark commits whole jobs); rows that two writers append twice are read once.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokens.default_path()
    cache = cache or fresh_path(spark, "token-cache")
    version = tokens.version_digest(tokenizer)
    rows = docs.select(F.col(key).alias("id"), normalised(F.col(text)).alias("text"))
    rows = rows.withColumn("content_digest", F.unhex(F.sha2("text", 256)))
    known = read_cache(spark, cache, version)
    if not known.isEmpty():
        missing = materialise(rows.select("content_digest").distinct().join(known, "content_digest", "left_anti"), "missing-digests")
        wanted = materialise(rows.select("content_digest", "text").join(missing, "content_digest", "left_semi"), "missing-texts")
    else:
        wanted = rows.select("content_digest", "text")
    # partial aggregation keeps one text per digest and task before the shuffle, so copies never meet in one task
    misses = wanted.dropDuplicates(["content_digest"])
    new = misses.mapInArrow(_encode(tokenizer), "content_digest binary, n_tokens long")
    new.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    counted = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest")
    out = counted.join(read_cache(spark, cache, version), "content_digest")
    return out.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
