"""The near-dedup stage proposes pairs by chains over the sets' fingerprints; ring keys of the sets find those beyond them."""

import random

from pyspark.sql import functions as F

from spoofscan.llm import simhash


def copies():
    """Texts of 600 words with copies of which one or two words changed."""
    r, rows = random.Random(15), []
    for i in range(20):
        words = [f"w{r.randrange(9000)}" for _ in range(600)]
        rows.append((i, " ".join(words)))
        for j in range(1, 4):
            own = list(words)
            for at in range(0, 600, 300)[: 1 + j % 2]:
                own[at + r.randrange(300)] = f"x{r.randrange(9000)}"
            rows.append((100 * j + i, " ".join(own)))
    return rows


def roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near(fps):
    return [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]


def test_chains_propose_what_their_reach_holds(spark):
    fps = [simhash.majority_bits(simhash.shingle_set(x, 5)) for _, x in copies()]
    fps += fps[:5]
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)]
    pairs = simhash.chained_pairs(spark.createDataFrame(rows, "node long, fp long")).collect()
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in pairs)
    assert roots(len(fps), pairs) == roots(len(fps), near(fps))


def test_stage_joins_by_chains_alone(spark, monkeypatch):
    """Without any keys of the sets' rings, the stage still drops the copies that chains over fingerprints reach."""
    rows, described = copies(), simhash._described
    without = lambda *options: lambda text: described(*options)(text).withField("keys", F.array().cast("array<bigint>"))
    monkeypatch.setattr(simhash, "_described", without)
    kept = simhash.keep_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    found = roots(len(rows), near([simhash.majority_bits(simhash.shingle_set(x, 5)) for _, x in rows]))
    least = {}
    for (key, _), group in zip(rows, found, strict=True):
        least[group] = min(least.get(group, key), key)
    assert 20 <= len(least) < 70
    assert sorted(x.doc_id for x in kept.collect()) == sorted(least.values())
