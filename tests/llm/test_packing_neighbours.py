"""Retrieval of op6 against plain BM25: all terms of a seed ask, and a window takes its seed's best unused documents."""

import math
from collections import Counter

import numpy as np

from spoofscan.llm import packing


def shard():
    """Thirty short documents a subject, each of which shares a term of its own with one document only."""
    r = np.random.default_rng(4)
    return [np.concatenate([r.integers(0, 40, 12) + 1000 * (i % 3), [5000 + i // 2]]).astype("<u4") for i in range(90)]


def plain_scores(docs, seed):
    df = Counter(t for d in docs for t in set(d.tolist()))
    mean = sum(map(len, docs)) / len(docs)
    out = []
    for d in docs:
        tf = Counter(d.tolist())
        weigh = lambda t: math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean))
        out.append(sum(weigh(t) for t in set(docs[seed].tolist()) if t in tf))
    return out


def test_all_terms_of_a_seed_ask():
    docs = shard()
    index = packing.Index(docs)
    for seed in (0, 17, 89):
        unused = np.ones(len(docs), bool)
        unused[seed] = False
        want = plain_scores(docs, seed)
        got = index.neighbours(seed, unused).tolist()
        assert set(got) == {d for d in range(len(docs)) if want[d] > 0 and d != seed} and len(got) > 8
        assert np.allclose([want[d] for d in got], sorted((want[d] for d in got), reverse=True))


def test_window_is_filled_by_its_seed():
    """A window of over twenty short documents takes the best of its seed's neighbours, not those of the ninth."""
    docs = shard()
    window = 13 * 25
    pieces = packing.pack_shard(docs, window)
    first = [d for d, _, _, sequence, _ in pieces if sequence == 0]
    want = plain_scores(docs, first[0])
    best = sorted((want[d] for d in range(len(docs)) if d != first[0]), reverse=True)[: len(first) - 1]
    assert len(first) == 25 and np.allclose([want[d] for d in first[1:]], best)
