"""Each stage of the pipeline against a plain version, on the rows that the stage before it kept."""

from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from spoofscan.llm import mixing, tokens, toxicity
from spoofscan.llm.common import labels, materialise

from test_llm import plain_line_removal

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows before, rows after) of each stage."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, DATA), "test-stage")
        out[name] = (docs, after)
        docs = after
    return out


def pandas(stages, name):
    return [x.toPandas() for x in stages[name]]


def test_names_and_columns(stages):
    assert list(stages) == ["toxicity", "line dedup", "simhash near-dedup", "mixing", "packing"]
    for name, (before, after) in stages.items():
        assert name == "packing" or after.columns == before.columns


def test_toxicity(spark, stages):
    """Rows go whose features' weights, added up one by one, give a probability over the threshold; other rows stay as they are."""
    before, after = stages["toxicity"]
    at, weight, bias = toxicity.train(before, labels(spark, DATA))
    known = dict(zip(at.tolist(), weight.tolist(), strict=True))
    score = lambda t: 1 / (1 + np.exp(-(bias + sum(known.get(i, 0.0) for i in set(toxicity.features(t or "").tolist())))))
    want = Counter(r for r in before.collect() if score(r.text) < toxicity.THRESHOLD)
    assert Counter(after.collect()) == want and 0 < sum(want.values()) < before.count()


def test_line_dedup(stages):
    before, after = pandas(stages, "line dedup")
    before = before.sort_values("doc_id")
    given = [t.split("\n") for t in before["text"]]
    gone = plain_line_removal(given, 20)
    want = {i: "\n".join(x for k, x in enumerate(lines) if k not in g) for i, lines, g in zip(before["doc_id"], given, gone, strict=True)}
    assert dict(zip(after["doc_id"], after["text"], strict=True)) == want and any(gone)
    assert (after["n_chars"] == after["text"].str.len()).all()


def test_near_dedup(stages):
    """Every pair of texts is compared; one text of each group that similar ones link stays, the one of the least id."""
    before, after = pandas(stages, "simhash near-dedup")
    sets = {}
    for i, text in zip(before["doc_id"], before["text"], strict=True):
        words = text.encode().lower().split()
        sets[i] = frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x == y or (x and y and 5 * len(x & y) >= 4 * len(x | y)):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(after["doc_id"]) == sorted({find(i) for i in ids}) and len(after) < len(before)


def test_mixing(stages):
    """The copies that the stage's rows have, against the mix's SQL over the stage's own input."""
    before, after = pandas(stages, "mixing")
    con = duckdb.connect()
    con.register("documents", before)
    taken = {i: (size, n) for i, size, n in con.sql(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall()}
    want = Counter({i: n // size for i, (size, n) in taken.items() if n})
    assert Counter(after["doc_id"].tolist()) == want
    assert set(map(tuple, after[["doc_id", "text", "source"]].values)) <= set(map(tuple, before[["doc_id", "text", "source"]].values))


def test_packing(stages):
    """Each row's ids, as the library gives them, are in its pieces once; sequences are full but for the shards' last ones."""
    before, after = pandas(stages, "packing")
    library = tokens.library(tokens.default_path())
    want = Counter()
    for i, t in zip(before["doc_id"], before["text"], strict=True):
        want.update((i, k, x) for k, x in enumerate([*library.encode(t, add_special_tokens=False).ids, 0]))
    got = Counter((i, start + k, x) for i, start, ids in zip(after["doc_id"], after["start"], after["ids"], strict=True) for k, x in enumerate(ids))
    assert got == want
    size = after.groupby("sequence_id")["length"].sum()
    assert (size <= 1024).all() and (size < 1024).sum() <= 8


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, DATA)
    assert Counter(map(str, got.select("doc_id", "start", "ids").collect())) == Counter(map(str, stages["packing"][1].select("doc_id", "start", "ids").collect()))
