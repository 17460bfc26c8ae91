"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is a ring of four segments of 16 bits. If two fingerprints differ in at most three bits, then from some
segment on, every chain of l consecutive segments differs in at most l * 3 / 4 bits: the first in none, the first two in
one at most, the first three in two at most. So the first segment and one half of the second are equal: these 24 bits
are the join key (eight keys a fingerprint), and the longer chains prune what shares a key before all bits are compared.

What shares a key is never turned into pairs: a breadth-first search over the key's fingerprints drops each one once it
is reached, so a dense group costs few comparisons and yields a spanning forest. A key with more than MOST fingerprints
is split exactly: of the bits not fixed yet, cut into four parts, at least one part must be equal too.

`keep_similar` asks for similar sets of shingles. The same chains over the fingerprints of the sets propose pairs, which are
confirmed on the full sets. That isn't all: at a Jaccard similarity of 0.8 fingerprints of 64 bits differ in 10 bits on
average and 15 or more in one pair of 40, and no ring of 64 bits with such a budget prunes anything. For pairs beyond the
reach of the chains the ring is one of the set's own hashes in ascending order, and its segments are the runs of three that
follow each other on it. Each shingle that only one of two sets has can break three runs of its own set, or two of the
other's, so sets of n shingles that are similar enough lose 3 n / 5 of their runs at most: the smallest 3 n / 5 + 1 of a
set's runs, in any order that both agree on, hold one that the other has too. Sets that share a run are pruned by their
fingerprints and by counts of shingles, and confirmed on the full sets.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts, hash_join, materialise, release, small_batches

BITS, SEGMENTS, REACH = 64, 4, 3
#: Fingerprints of one key that one task compares; keys with at most 16 free bits can't have more.
MOST = 1 << 16
_LOW = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, size: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words, or of all words if there are fewer; none for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n, counts = len(hashes), np.zeros((8, 8), np.int64)
    for shift in range(8):  # eight byte lanes at once, in runs that a lane can count
        lanes = (hashes >> np.uint64(shift)) & _LOW
        sums = np.add.reduceat(lanes, np.arange(0, n, 255)) if n else lanes
        counts[:, shift] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    bits = (2 * counts.reshape(-1) > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def simhash(text: Column) -> Column:
    """The fingerprint as a long; zero for a text without words or a null one."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        found = np.array([majority_bits(shingle_hashes(x)) if x else 0 for x in texts], np.uint64)
        return pd.Series(found.view(np.int64))

    return fingerprint(text)


def chain_keys(fp: Column) -> Column:
    """(start, key, fixed bits) of each chain that may begin in `fp`."""
    out = []
    for i in range(SEGMENTS):
        for half in range(2):
            fixed = (0xFFFF << 16 * i) | (0xFF << (16 * ((i + 1) % SEGMENTS) + 8 * half))
            signed = fixed - (1 << 64) if fixed >> 63 else fixed
            out.append(F.struct(F.lit(i).alias("start"), fp.bitwiseAND(F.lit(signed)).alias("bits"), F.lit(signed).cast("long").alias("fixed")))
    return F.array(*out)


def _chains_hold(difference: np.ndarray, start: int) -> np.ndarray:
    """Where all chains from `start` stay within their budgets, shortest chain first."""
    turn = np.uint64(16 * start)
    ring = (difference >> turn) | (difference << np.uint64((64 - 16 * start) % 64)) if start else difference
    left = np.arange(len(ring))
    for width, budget in ((16, 0), (32, 1), (48, 2), (64, 3)):
        left = left[np.bitwise_count(ring[left] & np.uint64((1 << width) - 1)) <= budget]
    return left


def forest(fps: np.ndarray, start: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the groups among `fps` that chains from `start` make."""
    out, left = [], fps
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = _chains_hold(left ^ x, start)
            if len(near):
                found = left[near]
                out.append((np.full(len(found), x), found))
                front.extend(found)
                left = np.delete(left, near)
    return out


def _split(fps: np.ndarray, fixed: int) -> list[tuple[np.ndarray, int]]:
    """Keys one step longer: the bits of each of four parts of the free bits, beside those fixed so far."""
    free = [b for b in range(64) if not fixed >> b & 1]
    wider = [fixed | sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(free), 4)]
    return [(fps & np.uint64(w), w) for w in wider]


def _link(batches):
    """Of rows sorted by key (start, fixed, bits): spanning links, and the longer keys of keys that are too large."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("start", pa.int32()), ("bits", pa.int64()), ("fixed", pa.int64())])

    def links(pairs):
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs, strict=True))
        none = pa.nulls(len(a))
        return pa.record_batch([pa.array(a), pa.array(b), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64())], schema=schema)

    def larger(fps, start, fixed):
        for bits, wider in _split(fps, fixed):
            n = len(fps)
            signed = wider - (1 << 64) if wider >> 63 else wider
            yield pa.record_batch([pa.array(fps.view(np.int64)), pa.nulls(n, pa.int64()), pa.array(np.full(n, start, np.int32)), pa.array(bits.view(np.int64)), pa.array(np.full(n, signed, np.int64))], schema=schema)

    def close(parts, key, large):
        if not parts:
            return
        fps = np.unique(np.concatenate(parts))
        if large:
            yield from larger(fps, key[0], key[1])
        elif len(fps) > 1 and (pairs := forest(fps, key[0])):
            yield links(pairs)

    held, key, large = [], None, False
    for batch in batches:
        start, fixed, bits, fps = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("start", "fixed", "bits", "fp"))
        fps, fixed = fps.view(np.uint64), fixed.view(np.uint64)
        new = np.flatnonzero((np.diff(start) != 0) | (np.diff(fixed) != 0) | (np.diff(bits) != 0)) + 1
        at = np.concatenate([[0], new, [len(fps)]])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if a == b:
                continue
            own = (int(start[a]), int(fixed[a]), int(bits[a]))
            if own != key:
                yield from close(held, key, large)
                held, key, large = [], own, False
            held.append(fps[a:b])
            if sum(map(len, held)) > MOST:
                yield from close(held, key, True)
                held, large = [], True
    yield from close(held, key, large)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Of distinct fingerprints (fp long), links (a, b) that connect just those that at most three bits set apart."""
    keyed = fps.select("fp", F.explode(chain_keys(F.col("fp"))).alias("k")).select("fp", "k.*")
    schema = "a long, b long, start int, bits long, fixed long"
    links = None
    while True:
        order = ["start", "fixed", "bits", "fp"]
        found = materialise(keyed.repartition("start", "fixed", "bits").sortWithinPartitions(*order).mapInArrow(_link, schema), "chains")
        own = found.filter("b IS NOT NULL").select("a", "b")
        links = own if links is None else links.union(own)
        more = found.filter("b IS NULL").select(F.col("a").alias("fp"), "start", "bits", "fixed")
        if more.isEmpty():
            return links
        keyed = more


def _groups(fps: DataFrame) -> DataFrame:
    """Of rows (id, fp): fp, group, first; one row for each fp, `first` the least id of its group that isn't null."""
    from .components import connected_components

    firsts = fps.groupBy("fp").agg(F.min("id").alias("own"))
    joined = connected_components(fingerprint_links(firsts.select("fp")))
    named = firsts.join(joined, firsts["fp"] == joined["node"], "left").select("fp", "own", F.coalesce("component", "fp").alias("group"))
    named = materialise(named, "simhash-groups")
    least = materialise(named.groupBy("group").agg(F.min("own").alias("first")), "simhash-firsts")
    return named.join(least, "group").select("fp", "group", "first")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, fingerprint (16 hex digits), component_id (the least key linked to it).

    Texts without words (null, empty, white space) have fingerprint zero and are linked like any other. A null key is
    never a component_id unless all keys of the component are null. Repeated rows are kept. An empty table gives none.
    """
    fps = materialise(docs.select(F.col(key).alias("id"), simhash(F.col(text)).alias("fp")), "simhash")
    out = fps.join(_groups(fps), "fp")
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group, one row of its least key (of equal ones, any) stays.

    Null keys come last. The columns are those of `docs`.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    rows = materialise(rows.select("row", "id", simhash(F.col("text")).alias("fp")), "simhash-rows")
    fps = rows.select("id", "fp")
    groups = _groups(fps)
    # of the fingerprints in a group, the least one among those that have the least key
    own = fps.groupBy("fp").agg(F.min("id").alias("own")).join(groups, "fp").filter(F.col("own").eqNullSafe(F.col("first")))
    stay = own.groupBy("group").agg(F.min("fp").alias("fp"), F.first("first").alias("first"))
    kept = rows.join(stay, (rows["fp"] == stay["fp"]) & rows["id"].eqNullSafe(stay["first"]), "left_semi")
    return kept.dropDuplicates(["fp", "id"]).select("row.*")


#: Runs of a set that are its keys at most. A set with over 80 shingles would have more; as of its runs at least two in five
#: are shared, all 48 miss a similar set once in 4e10 pairs.
MOST_RUNS = 48
#: Buckets of a set's counts; sets from so many shingles on are pruned by their fingerprints too.
BUCKETS, PRINTED = 64, 64
#: Bits in which fingerprints of similar sets may differ: at 0.8, more do once in a hundred million pairs.
WIDE_REACH = 28
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def shingle_set(text: str, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, size))


def bucket_counts(shingles: np.ndarray) -> bytes:
    return np.bincount((shingles % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).astype("<u4").tobytes()


@lru_cache(maxsize=4096)
def runs_needed(n: int, least: Fraction) -> int:
    """How many of the smallest runs of a set of n shingles hold one of any similar set's, MOST_RUNS at most.

    Another set that is similar has `b` shingles beyond this one, which then has at most `a` beyond the other.
    """
    if n > 2 * MOST_RUNS:
        return MOST_RUNS
    beyond = range(n * least.denominator // least.numerator - n + 1)
    lost = max(3 * max(0, n - -(-least.numerator * (n + b) // least.denominator)) + 2 * b for b in beyond)
    return min(lost + 1, MOST_RUNS, n)


def run_keys(shingles: np.ndarray, least: Fraction) -> np.ndarray:
    """The keys of a sorted set of hashes: the smallest hashes of its runs of three on the ring."""
    n = len(shingles)
    if not n:
        return np.empty(0, np.int64)
    v = shingles * _MIX[0] + np.roll(shingles, -1)
    v = (v ^ (v >> np.uint64(29))) * _MIX[1] + np.roll(shingles, -2)
    v = (v ^ (v >> np.uint64(32))) * _MIX[2]
    most = runs_needed(n, least)
    return (np.partition(v, most - 1)[:most] if most < n else v).view(np.int64)


def _described(size: int, least: Fraction):
    """Of a text's distinct shingles: number, digest, fingerprint, sketch (fingerprint, counts by bucket) and keys."""

    @F.pandas_udf("n int, digest binary, fp long, sketch binary, keys array<long>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        found = [shingle_set(x or "", size) for x in texts]
        fps = np.array([majority_bits(x) for x in found], np.uint64)
        return pd.DataFrame({
            "n": [len(x) for x in found],
            "digest": [xxhash.xxh3_128_digest(x.tobytes()) for x in found],
            "fp": fps.view(np.int64),
            "sketch": [fp.astype("<u8").tobytes() + bucket_counts(x) for fp, x in zip(fps, found, strict=True)],
            "keys": [run_keys(x, least) for x in found],
        })

    return describe


def may_be_similar(least: Fraction, reach: int = WIDE_REACH):
    """Whether the sketches of row i and rows j allow the similarity: their counts can overlap enough, and if both sets are
    large, their fingerprints differ in `reach` bits at most, that is, all chains from some segment keep their budgets."""

    def agree(sketches: list[bytes], i: int, j: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        x = np.frombuffer(sketches[i], "<u4")
        y = np.frombuffer(b"".join([sketches[k] for k in j.tolist()]), "<u4").reshape(len(j), -1)
        bits = np.bitwise_count(y[:, :2] ^ x[:2]).sum(1)
        ok = (bits <= reach) | (sizes[j] < PRINTED) | (sizes[i] < PRINTED)
        most = np.minimum(y[:, 2:], x[2:]).sum(1, dtype=np.int64)
        return ok & (most * least.denominator >= (sizes[j] + sizes[i] - most) * least.numerator)

    return agree


def _sets(size: int):
    def run(batches):
        for batch in small_batches(batches):
            found = [shingle_set(x, size).view(np.int64) for x in arrow_texts(batch)]
            yield pa.record_batch({"node": batch.column("rid"), "members": pa.array(found, pa.list_(pa.int64()))})

    return run


def chained_pairs(sets: DataFrame) -> DataFrame:
    """Of sets (node, fp), pairs that join just those whose fingerprints chains link, that is, at most three bits apart.

    Equal fingerprints hang on the least of their nodes, so a group brings as many pairs as it has sets, or links.
    """
    firsts = materialise(sets.groupBy("fp").agg(F.min("node").alias("first")), "near-prints")
    a, b = (firsts.select(F.col("fp").alias(x), F.col("first").alias(f"node_{x}")) for x in ("a", "b"))
    linked = fingerprint_links(firsts.select("fp")).join(a, "a").join(b, "b").select("node_a", "node_b")
    return sets.join(firsts, "fp").filter("node <> first").select("node", "first").union(linked)


def keep_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, reach: int = WIDE_REACH) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group linked by similar texts, one row of its least key stays.

    Texts are similar if their sets of `size`-word shingles have a Jaccard similarity of `similarity` or more; texts without
    words are all alike. Null keys come last; of equal keys, the row of the least hash stays. The columns are those of
    `docs`. An empty table gives none.
    """
    from .similar import similar_components

    least = Fraction(str(similarity))
    row = F.struct(*docs.columns)
    rows = docs.select(row.alias("row"), F.xxhash64(row).alias("hash"), F.col(key).alias("id"), _described(size, least)(F.col(text)).alias("d"))
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("rid"), "row", "hash", "id", "d.*"), "near-rows")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash", "rid")).alias("best")
    sets = rows.groupBy("digest").agg(F.min("rid").alias("node"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("keys").alias("keys"), best)
    sets = materialise(sets.drop("digest"), "near-sets")
    full = sets.filter("n > 0")
    texts = rows.select("rid", F.col("row")[text].alias("text"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        return hash_join(texts, materialise(wanted.select(F.col("node").alias("rid")), "near-wanted"), "rid", "left_semi").mapInArrow(_sets(size), "node long, members array<long>")

    joined = similar_components(full, sets_of, may_be_similar(least, reach), least, chained_pairs(full.select("node", "fp")))
    named = sets.join(joined, "node", "left").withColumn("group", F.coalesce("component", "node"))
    stay = named.groupBy("group").agg(F.min("best").alias("best")).select(F.col("best.rid").alias("rid"))
    # few rows go, so the texts needn't be shuffled
    gone = materialise(rows.select("rid").join(stay, "rid", "left_anti"), "near-gone")
    release(sets, joined)
    return rows.join(gone, "rid", "left_anti").select("row.*")
