"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_middle, fingerprints, lexical_search, line_dedup, media, minhash, mixing, packing, quality, simhash, suffix_dedup, token_counts, toxicity
from .common import benchmark, documents, labels


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.text_media(documents(spark, sf_dir))
    stored = [F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")]
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", *stored, "feature", F.sha2("tile", 256).alias("tile_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir), with_text=False)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_mix(documents(spark, sf_dir)).drop("copies")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(documents(spark, sf_dir))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(benchmark(spark, sf_dir), documents(spark, sf_dir))


_ALL = (
    op1_simhash, op2_token_counts, op3_toxicity, op4_fingerprints, op5_media_columns, op6_packing, op7_suffix_dedup, op8_quality, op9_mixing,
    op10_line_dedup, op11_fill_middle, op12_minhash, op13_lexical_search,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op9_mixing": mixing.SQL, "op10_line_dedup": line_dedup.SQL, "op11_fill_middle": fill_middle.SQL, "op12_minhash": minhash.SQL, "op13_lexical_search": lexical_search.SQL}
