"""The first turn tries a bounded number of pairs a set, whatever its keys and its group; the second finds what that leaves."""

import random

from spoofscan.llm import minhash, similar
from tests.llm.test_minhash import SCHEMA, plain


def test_dense_group_brings_few_pairs(spark, monkeypatch):
    r, base, rows = random.Random(12), [f"b{i}" for i in range(90)], []
    for i in range(150):
        own = list(base)
        for _ in range(r.randrange(1, 4)):
            own[r.randrange(90)] = f"y{i}x{r.randrange(9)}"
        rows.append((i, " ".join(own)))
    made, write = {}, similar.materialise

    def counted(df, name, **options):
        out = write(df, name, **options)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(similar, "materialise", counted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(repr((x.doc_id, x.n_shingles, x.component_id, x.kept)) for x in got) == plain(rows)
    assert 150 <= made["pairs"] <= 8 * 150
    assert made["shared-keys"] > 4 * made["pairs"]  # each key of each set had a partner of its own
