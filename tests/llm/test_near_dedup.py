"""The pipeline's near-dedup stage against plain pairs of five-word shingle sets."""

import random

import numpy as np

from spoofscan.llm import simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def near_copies():
    """Texts with copies of which a few words changed: some within Jaccard 0.8, some not."""
    r, out = random.Random(5), []
    for i in range(40):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(4, 400))]
        out.append((i, " ".join(words)))
        for j, edits in enumerate((1, 2, 4, 8, 16)):
            own = list(words)
            for _ in range(edits):
                own[r.randrange(len(own))] = f"x{r.randrange(3000)}"
            out.append((1000 * (j + 1) + i, " ".join(own)))
    return [*out, (None, out[0][1]), (3, out[3][1]), (3, "other words for the same key"), (9000, None), (9001, ""), (9002, " \n ")]


def test_near_dedup_stage_against_plain_pairs(spark):
    import corpus_pipeline

    rows = near_copies()
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    missed = 0
    for i in range(len(rows)):
        for j in range(i):
            if alike(rows[i][1], rows[j][1]):
                root[find(i)] = find(j)
                a, b = (simhash.majority_bits(simhash.shingle_set(rows[k][1] or "", 5)) for k in (i, j))
                missed += 3 < (a ^ b).bit_count()
    assert missed > 10  # pairs that three bits don't reach
    least = {}
    for i, (key, _) in enumerate(rows):
        own = (key is None, key or 0)
        least[find(i)] = min(least.get(find(i), own), own)
    docs = spark.createDataFrame([(*x, "s0") for x in rows], "doc_id long, text string, source string").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == sorted(k for _, k in least.values())


def test_similar_sets_share_a_run():
    """Sets up to the limit share one of their keys, whatever they differ in; small sizes exhaustively near the limit."""
    from fractions import Fraction

    r, least = np.random.default_rng(3), Fraction("0.8")
    tried = 0
    for n in [*range(1, 60), 200, 1000]:
        for m in range(-(-4 * n // 5), n + 1):
            for _ in range(20):
                both = -(-4 * (n + m) // 9)  # the least overlap that gives 0.8
                if both > m:
                    continue
                pool = r.integers(0, 1 << 63, n + m - both, dtype=np.uint64) * np.uint64(2)
                x, y = np.sort(pool[:n]), np.sort(pool[n - both :])
                assert len(x) == n and len(y) == m and 5 * both >= 4 * (n + m - both)
                assert set(simhash.run_keys(x, least).tolist()) & set(simhash.run_keys(y, least).tolist()), (n, m)
                tried += 1
            if n > 100:
                break
    assert tried > 5000


def test_comparisons_grow_linearly():
    """Of unrelated sets of one size, no two share a key: nothing is compared at 10, 20 or 40 thousand sets. Sets that share
    a passage of a tenth of their shingles hardly ever do."""
    from fractions import Fraction

    r, least = np.random.default_rng(4), Fraction("0.8")
    shared = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    for n in (10_000, 20_000, 40_000):
        keys = np.concatenate([simhash.run_keys(np.sort(r.integers(0, 1 << 63, 60, dtype=np.uint64)), least) for _ in range(n)])
        assert len(np.unique(keys)) == len(keys)
    keys = [simhash.run_keys(np.sort(np.concatenate([shared, r.integers(0, 1 << 63, 108, dtype=np.uint64)])), least) for _ in range(5000)]
    _, often = np.unique(np.concatenate(keys), return_counts=True)
    assert (often * (often - 1) // 2).sum() < 5 * 5000


def test_short_texts_of_eight_and_nine_words(spark):
    """Four shingles against five are similar by 0.8: every such pair is found."""
    r, rows = random.Random(6), []
    for i in range(400):
        words = [f"v{i}q{r.randrange(50)}" for _ in range(9)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:8]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.keep_similar(docs).collect()) == [2 * i for i in range(400)]


def test_dense_group_and_blocks(spark, monkeypatch):
    """Near copies on both sides of the limit, one key's group cut into blocks: the groups are those of all pairs."""
    from spoofscan.llm import similar

    r, base, rows = random.Random(8), [f"b{i}" for i in range(70)], []
    for i in range(150):
        own = list(base)
        for _ in range(r.randrange(1, 4)):
            own[r.randrange(70)] = f"y{i}x{r.randrange(9)}"
        rows.append((i, " ".join(own)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(rows[i][1], rows[j][1]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = sorted({find(i) for i in range(len(rows))})
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(similar, "BLOCK_SETS", 32)
    assert sorted(x.doc_id for x in simhash.keep_similar(docs).collect()) == want and 1 < len(want) < 150


def test_recall_is_whole_on_a_table(spark):
    """All pairs of different sets at 0.8 or more among the documents of a table, found by an exact prefix filter."""
    from collections import Counter, defaultdict

    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(path).select("doc_id", "text").collect()]
    sets = {k: shingles(t) for k, t in rows}
    often = Counter(g for s in sets.values() for g in s)
    root = {k: k for k in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for k, s in sets.items():
        for g in sorted(s, key=lambda g: (often[g], g))[: len(s) - -(-4 * len(s) // 5) + 1]:
            for other in by[g]:
                if 5 * len(s & sets[other]) >= 4 * len(s | sets[other]):
                    a, b = find(k), find(other)
                    root[max(a, b)] = min(a, b)
            by[g].append(k)
    empty = [k for k, s in sets.items() if not s]
    for k in empty[1:]:
        root[k] = empty[0]
    got = simhash.keep_similar(spark.read.parquet(path))
    assert sorted(x.doc_id for x in got.select("doc_id").collect()) == sorted({find(k) for k in sets})


def test_empty_table_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string, node long, row string")
    assert simhash.keep_similar(none).count() == 0
    some = spark.createDataFrame([(2, "a b c d e f g", 9, "x"), (1, "a b c d e f g", 8, "y"), (1, "a b c d e f g", 8, "y")], none.schema)
    assert [tuple(x) for x in simhash.keep_similar(some).collect()] == [(1, "a b c d e f g", 8, "y")]
