"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A set of word shingles has a signature of 64 minima, of each of which 16 bits are kept; the distance of two signatures is
the number of minima that differ. It is cut into 16 chunks of 4 minima. If two signatures differ in at most DISTANCE = 31
of 64, some chunk differs in one minimum at most (31 / 16 < 2), so one of the four ways to leave a minimum out makes that
chunk equal: each signature is entered under all 16 * 4 keys of a chunk without one minimum, and every pair within the
distance shares a key. Pairs that share one are pruned by their distance and confirmed on their full sets.

At a similarity of 0.8 a pair's distance is binomial with a mean of 12.8, and exceeds 31 about once in 12 million pairs.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts, hash_join, materialise, release, slices, small_batches
from .similar import similar_components
from .simhash import shingle_set

MINIMA, CHUNK, DISTANCE = 64, 4, 31
#: Odd multipliers of a 64-bit mixer, and one seed a minimum. Any values do, as long as they stay.
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SEEDS = [xxhash.xxh64_intdigest(str(i), 12) for i in range(MINIMA)]
#: Members that are mixed together, few enough to stay in a core's cache.
_TOGETHER = 1 << 16


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 64 minima, 16 bits each, for each set of hashes; none of an empty set (zeros)."""
    out = np.zeros((len(sets), MINIMA), np.uint16)
    full = [i for i, x in enumerate(sets) if len(x)]
    for a, b in slices([len(sets[i]) for i in full], _TOGETHER):
        own = full[a:b]
        hashes = np.concatenate([sets[i] for i in own])
        starts = np.cumsum([0] + [len(sets[i]) for i in own[:-1]])
        for m, seed in enumerate(_SEEDS):
            v = hashes ^ np.uint64(seed)
            v *= _A
            v ^= v >> np.uint64(33)
            v *= _B
            out[own, m] = (np.minimum.reduceat(v, starts) * _A) >> np.uint64(48)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """Of each signature, the 64 keys of its chunks without one of their minima: 6 bits of place, 48 of content."""
    chunks = signature.reshape(len(signature), MINIMA // CHUNK, CHUNK).astype(np.int64)
    keys = []
    for out in range(CHUNK):
        x, y, z = (chunks[:, :, i] for i in range(CHUNK) if i != out)
        place = np.arange(MINIMA // CHUNK, dtype=np.int64) * CHUNK + out
        keys.append((place << 48) | (x << 32) | (y << 16) | z)
    return np.concatenate(keys, 1)


def within_distance(sketches: list[bytes], i: int, j: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the signature of row i is within DISTANCE of those of rows j."""
    own = np.frombuffer(sketches[i], "<u2")
    others = np.frombuffer(b"".join([sketches[x] for x in j.tolist()]), "<u2").reshape(-1, MINIMA)
    return (others != own).sum(1) <= DISTANCE


def _described(size: int):
    """Of rows (id, text): id, number of shingles, digest of their set, signature."""

    def run(batches):
        for batch in small_batches(batches):
            sets = [shingle_set(x, size) for x in arrow_texts(batch)]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            yield pa.record_batch({"id": batch.column("id"), "n": pa.array([len(x) for x in sets], pa.int64()), "digest": pa.array(digests, pa.binary()), "sketch": pa.array([x.tobytes() for x in signatures(sets)], pa.binary())})

    return run


def _keyed(batches):
    """The rows with the keys of their signatures."""
    for batch in batches:
        found = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u2").reshape(-1, MINIMA)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * MINIMA), pa.array(chunk_keys(found).reshape(-1)))
        yield pa.record_batch([*batch.columns, keys], names=[*batch.schema.names, "keys"])


def _shingles(size: int):
    """Of rows (text): digest and members of the set."""

    def run(batches):
        for batch in small_batches(batches):
            sets = [shingle_set(x, size) for x in arrow_texts(batch)]
            yield pa.record_batch({"digest": pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), "members": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))})

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, similarity: float = 0.8) -> DataFrame:
    """One row per row of `docs`: key, n_shingles, component_id (least key linked to it), kept (whether it is that key).

    Texts are linked if their sets of `size`-word shingles have a Jaccard similarity of `similarity` or more; those with
    fewer words have one shingle, the whole. Texts without words (null, empty, white space) have none and are linked with
    nothing, not even each other. A null key is never a component_id unless all keys of the component are null; such rows
    are kept. Rows of one key are judged by their own texts, so a repeated row is kept as often as it stands there. An
    empty table gives none. Similarities under 0.8 lose links, as DISTANCE is made for that.
    """
    least = Fraction(str(similarity))
    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = materialise(given.mapInArrow(_described(size), "id long, n long, digest binary, sketch binary"), "minhash")
    sets = rows.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    sets = sets.select(F.monotonically_increasing_id().alias("node"), "id", "n", "digest", "sketch")
    sets = materialise(sets.mapInArrow(_keyed, "node long, id long, n long, digest binary, sketch binary, keys array<long>"), "distinct-sets")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The sets of some nodes, from the texts of their least keys; a key's other texts have other digests."""
        asked = materialise(wanted.join(sets.select("node", "id", "digest"), "node").withColumn("at", F.xxhash64("id")), "asked")
        texts = given.withColumn("at", F.xxhash64("id"))
        found = hash_join(texts, materialise(asked.select("at").distinct(), "asked-keys"), "at", "left_semi").select("text")
        found = found.mapInArrow(_shingles(size), "digest binary, members array<long>")
        return found.join(asked.select("node", "digest"), "digest").dropDuplicates(["node"]).select("node", "members")

    joined = similar_components(sets, sets_of, within_distance, least)
    named = materialise(sets.join(joined, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("component")), "components-named")
    firsts = materialise(named.groupBy("component").agg(F.min("id").alias("first")), "components-first")
    groups = materialise(named.join(firsts, "component").select("digest", "first"), "groups")
    release(sets, named, firsts, joined)
    own = F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("id"))
    out = rows.join(groups, "digest", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) END AS s FROM words
), kinds AS (
  SELECT s, min(r) AS k FROM sets WHERE len(s) > 0 GROUP BY s
), grams AS (
  SELECT k, len(s) AS n, unnest(s) AS g FROM kinds
), links AS (
  SELECT a.k AS a, b.k AS b FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT k AS a, k AS b FROM kinds UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT reach.a AS k, min(sets.doc_id) AS first FROM reach JOIN kinds ON kinds.k = reach.b JOIN sets ON sets.s = kinds.s GROUP BY reach.a
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE first END AS component_id,
  sets.doc_id IS NOT DISTINCT FROM CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE first END AS kept
FROM sets LEFT JOIN kinds ON kinds.s = sets.s LEFT JOIN least ON least.k = kinds.k
"""
