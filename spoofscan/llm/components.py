"""Connected components of a graph given by its links, as joins and groupings until nothing changes.

What a node's links are joined to is written first, so that Spark can split the links of a hub among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_path, fresh_path, materialise


def _stored(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The links, written once; their place; a digest of them, taken while they are written."""
    spark, path, seen = edges.sparkSession, fresh_path(edges.sparkSession, "links"), Observation()
    digest = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")]
    edges.observe(seen, *digest).write.parquet(path)
    told = seen.get
    return spark.read.schema(edges.schema).parquet(path), path, (told.get("n"), told.get("x"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialise(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Of links (a long, b long), one row for each linked node: node, component (the component's least node).

    Null ends, loops and repeated links are ignored; no links give no rows. Alternating large and small stars
    [Kiveris et al. 2014] need a logarithmic number of rounds; each is written to the shared folder.
    """
    links = edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, path, digest = _stored(links)
    while digest[0]:
        new, new_path, new_digest = _stored(_small_star(materialise(_large_star(links), "large-star")))
        drop_path(links.sparkSession, path)
        links, path, done, digest = new, new_path, new_digest == digest, new_digest
        if done:
            break
    centres = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres.select("node", F.col("node").alias("component")))
