"""MinHash near-duplicates against plain comparison of all sets; the guarantee of the multi-index join; hot groups."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spoofscan.llm import minhash, similar
from spoofscan.llm.simhash import shingle_set

SCHEMA = "doc_id long, text string"


def shingles(text, size=4):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain(rows, similarity=80):
    """(key, shingles, component, kept) of each row."""
    sets = [shingles(x) for _, x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    own = [least.get(find(i)) if sets[i] else key for i, (key, _) in enumerate(rows)]
    return sorted(repr((k, len(s), c, k == c)) for (k, _), s, c in zip(rows, sets, own, strict=True))


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("node", F.lit(2)).repartition(3)
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in minhash.near_duplicates(docs, **options).collect())


def corpus():
    r, rows = random.Random(4), []
    for i in range(30):
        words = [f"w{r.randrange(2000)}" for _ in range(r.choice([1, 3, 4, 5, 8, 9, 40, 150]))]
        rows.append((i, " ".join(words)))
        for j, edits in enumerate((1, 1, 2, 3, 5, 8)):
            own = list(words)
            for _ in range(edits):
                own[r.randrange(len(own))] = f"x{r.randrange(2000)}"
            rows.append((1000 * (j + 1) + i, " ".join(own)))
        rows.append((9000 + i, " ".join(words + words[:1])))  # four against five shingles, and so on
    return [*rows, (None, rows[0][1]), (None, "only null keys here"), (3, rows[3][1]), (3, "quite another text"), (9500, None), (9501, ""), (9502, " \n "), (9503, "A b\tC d"), (9504, "a B c D")]


def test_components_against_plain_sets(spark):
    rows = corpus()
    assert got(spark, rows) == plain(rows)


def test_empty_table(spark):
    out = minhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 0


def test_every_pair_within_the_distance_shares_a_key():
    r = np.random.default_rng(5)
    own = r.integers(0, 1 << 16, (1, minhash.MINIMA), dtype=np.uint16)
    keys = set(minhash.chunk_keys(own)[0].tolist())
    assert len(keys) == 64
    for _ in range(300):
        other = own.copy()
        at = r.choice(minhash.MINIMA, minhash.DISTANCE, replace=False)
        other[0, at] ^= r.integers(1, 1 << 16, len(at), dtype=np.uint16)
        assert keys & set(minhash.chunk_keys(other)[0].tolist())
        assert minhash.within_distance([own.tobytes(), other.tobytes()], 0, np.array([1]), None)[0]
    even = own.copy()
    even[0, [4 * c + i for c in range(16) for i in (0, 1)]] ^= 1  # two errors in every chunk: 32 are too many
    assert not keys & set(minhash.chunk_keys(even)[0].tolist())


def test_signatures_estimate_similarity():
    r = np.random.default_rng(6)
    for share in (0.5, 0.8, 0.95):
        same = []
        for _ in range(60):
            n = 400
            both = int(2 * n * share / (1 + share))
            pool = r.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            x, y = np.sort(pool[:n]), np.sort(pool[n - both :])
            a, b = minhash.signatures([x, y])
            same.append((a == b).mean())
        assert abs(np.mean(same) - share) < 0.03
    assert (minhash.signatures([np.empty(0, np.uint64)]) == 0).all()


def dense(n, seed=1):
    """One group whose texts differ in a few of 60 words each: pairs lie on both sides of the limit."""
    r = random.Random(seed)
    base, rows = [f"b{i}" for i in range(60)], []
    for i in range(n):
        own = list(base)
        for _ in range(r.randrange(1, 4)):
            own[r.randrange(60)] = f"v{i}x{r.randrange(9)}"
        rows.append((i, " ".join(own)))
    return rows


def test_dense_group_in_blocks(spark, monkeypatch):
    rows = dense(120)
    want = plain(rows)
    assert got(spark, rows) == want
    monkeypatch.setattr(similar, "BLOCK_SETS", 16)  # keys cut into blocks give the same
    assert got(spark, rows) == want


def test_rows_of_a_key_hang_on_a_shallow_tree(monkeypatch):
    """Batches may cut a key's rows anywhere; a lone key gives nothing; sizes that differ too much aren't tried."""
    from fractions import Fraction

    monkeypatch.setattr(similar, "FAN", 3)
    rows = [(1, 10, 5), (2, 11, 5), (2, 12, 5), (2, 13, 9), (3, 14, 1), (4, 15, 2), (4, 16, 2)] + [(5, 100 + i, 7) for i in range(30)] + [(6, 200, 1)]

    def parent(i):
        up = 1
        while i % (3 * up) == 0:
            up *= 3
        return i - i % (3 * up)

    want = [(2, 11, None), (2, 12, 11), (2, 13, None), (4, 15, None), (4, 16, 15)] + [(5, 100 + i, 100 + parent(i) if i else None) for i in range(30)]
    assert parent(9) == 0 and parent(10) == 9 and parent(12) == 9 and parent(14) == 12
    for size in range(1, len(rows) + 1):
        batches = [pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows[i : i + size], strict=True)], names=["k", "node", "n"]) for i in range(0, len(rows), size)]
        out = [tuple(r.values()) for b in similar._neighbours(Fraction("0.8"))(batches) for r in b.to_pylist()]
        assert out == want, size


def test_comparisons_grow_with_the_input_not_its_square():
    """Unrelated sets of one size share no key; so no pair is looked at."""
    r = np.random.default_rng(9)
    for n in (2000, 4000):
        sets = [np.sort(r.integers(0, 1 << 63, 50, dtype=np.uint64)) for _ in range(n)]
        keys = np.sort(minhash.chunk_keys(minhash.signatures(sets)).reshape(-1))
        assert (np.diff(keys) == 0).sum() == 0


def test_whole_texts_count(spark):
    base = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, base), (2, base + " and a tail of words"), (3, base.replace("w29990", "other"))]
    assert {r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == {1}
    assert len(shingle_set(base, 4)) == 29_997
