"""Fill-in-the-middle: cuts against a plain version, forms, exact round trips, odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from spoofscan.llm import fill_middle
from spoofscan.llm.queries import op11_fill_middle


def plain(text, key, unit="line", seed=7, rate=100, spm_rate=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    r = random.Random(11)
    lines = ["a", "", "éß 日本", "🎉🎉", "x" * 300, "<P", "S>", "\r"]
    out = ["\n".join(r.choice(lines) for _ in range(n)) + r.choice(["", "\n"]) for n in (1, 2, 3, 10, 63, 64, 65, 200, 1000)]
    return [*out, None, "", "\n", "\n\n\n", "a <M> b\nc", "no line feed", "é" * 400_000 + "\n" + "z\n" * 100_000, "日\n" * 200_000]


@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_checkpoints_give_every_cut(unit):
    r = random.Random(2)
    for n in (0, 1, 63, 64, 65, 129, 500):
        text = "".join(r.choice("aé日🎉\n") for _ in range(n))
        units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
        index = fill_middle.checkpoints(text.encode(), unit, every=4)
        assert index.n == len(units)
        for u in range(len(units) + 1):
            before = "".join(units[:u])
            assert index.cut(u) == (len(before.encode()), len(before))


def test_checkpoints_are_sparse_and_reach_across_blocks():
    data = "日本\n".encode() * 300_000
    index = fill_middle.checkpoints(data)
    assert index.n == 300_000 and len(index.units) == 300_000 // fill_middle.EVERY + 1
    assert index.cut(150_001) == (150_001 * 7, 150_001 * 3) and index.cut(300_000) == (len(data), 900_000)


@pytest.mark.parametrize(("unit", "seed", "rate", "spm"), [("line", 7, 100, 50), ("char", 3, 60, 0), ("line", 1, 50, 100), ("line", 7, 0, 50)])
def test_transformation_against_plain_version(spark, unit, seed, rate, spm):
    rows = [(i if i % 5 else None, x) for i, x in enumerate(texts() * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("form", F.lit(1)).repartition(3)
    out = fill_middle.fill_in_middle(docs, unit=unit, seed=seed, rate=rate, spm_rate=spm)
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()]
    order = lambda x: repr(x)
    assert sorted(got, key=order) == sorted(((k, *plain(x or "", k, unit, seed, rate, spm)) for k, x in rows), key=order)
    back = out.select(fill_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(x or "" for _, x in rows)


def test_query_whole_table_and_empty(spark, tmp_path):
    spark.createDataFrame([(i, x) for i, x in enumerate(texts())], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op11_fill_middle(spark, str(tmp_path)).collect()
    want = {i: plain(x or "", i) for i, x in enumerate(texts())}
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == want[r.doc_id][:4]
        assert r.output_sha256 == hashlib.sha256(want[r.doc_id][4].encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((texts()[r.doc_id] or "").encode()).hexdigest()
    assert {r.form for r in rows} == {"plain", "psm", "spm"} and len(rows) == len(want)
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), unit="word")
