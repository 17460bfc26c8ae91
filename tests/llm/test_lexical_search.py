"""Ranked search against plain scoring of every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spoofscan.llm import lexical_search as L


def terms(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain(items, docs, top=50):
    bags = [(k, Counter(terms(x))) for k, x in docs]
    bags = [(k, b, sum(b.values())) for k, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for k, b, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if t in b)
            if score > 0:
                scored.append((-score, k is None, k or 0, k))
        out += [(item, i + 1, k, -s) for i, (s, _, _, k) in enumerate(sorted(scored)[:top])]
    return out


def corpus():
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÉCLAIR", "日本", "don't", "A-B", "x_y", "ABC"]
    docs = [(i, " ".join(r.choices(words, weights=range(len(words), 0, -1), k=r.randrange(1, 80)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(70)]  # equal scores beyond the limit
    docs += [(5, docs[5][1])] * 3 + [(None, docs[9][1]), (None, None), (400, None), (401, ""), (402, "-- \n"), (403, "w1 " * 50_000)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(1, 12)))) for i in range(12)]
    return [*items, (20, docs[7][1]), (21, None), (22, ""), (23, "nowhere else"), (24, "W1 w1 w1"), (24, "w2")], docs


def test_search_against_plain_scores(spark, monkeypatch):
    items, docs = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("score", F.lit(1)).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(repr, plain(items, docs)))
    assert sorted(repr(tuple(r)) for r in L.ranked_search(asked, table).collect()) == want
    # in blocks of a few items, and of a few impacts, the same
    monkeypatch.setattr(L, "MOST_IMPACTS", 50)
    few = [x for x in L.item_blocks(asked, "item_id", "text", most=60)]
    assert len(few) > 3 and sum(len(k) for k, _ in few) == len(items)
    monkeypatch.setattr(L, "item_blocks", lambda *a: iter(few))
    assert sorted(repr(tuple(r)) for r in L.ranked_search(asked, table).collect()) == want
    assert sorted(repr(tuple(r)) for r in L.ranked_search(asked, table, top=3).collect()) == sorted(map(repr, plain(items, docs, 3)))


def test_search_of_nothing(spark):
    items, docs = corpus()
    asked, none = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    table, empty = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, None)], "doc_id long, text string")
    for a, b in ((none, table), (asked, empty), (asked, empty.limit(0))):
        out = L.ranked_search(a, b)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_radix_order_is_stable():
    r = np.random.default_rng(1)
    for bits in (1, 16, 17, 40, 64):
        keys = r.integers(0, 2 ** min(bits, 63), 5000, dtype=np.uint64) % np.uint64(max(2, 2 ** min(bits, 63) // 3))
        assert (L.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(L.radix_order(np.empty(0, np.uint64))) == 0
