"""First claims: batch against stream, refusals, restarts, and the stored index."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spoofscan.operators.claim_index import ClaimIndex
from spoofscan.streaming import guard

SCHEMA = "id long, name string, at timestamp"
START = datetime(2024, 1, 1)
#: Names that look alike, by what they look like.
LOOKS = {"paypal": ["paypal", "pаypal", "раураl", "PayPal".lower(), "paypa1"], "rn": ["m", "rn"], "oslo": ["oslo", "οslο"], "Oslo": ["0slo", "Oslo"], "zed": ["zed"]}


def events(n, seed=1):
    r = random.Random(seed)
    names = [x for own in LOOKS.values() for x in own] + [None, ""]
    return [(i, r.choice(names), START + timedelta(minutes=i)) for i in range(n)]


def plain(rows):
    """(id, accepted, claimed_by) of each row: the first by time of what looks alike."""
    kind = {x: k for k, own in LOOKS.items() for x in own} | {"": ""}
    held, out = {}, []
    for i, name, at in sorted(rows, key=lambda x: (x[2], x[1] or "")):
        if name is None:
            out.append((i, True, None))
        else:
            first = held.setdefault(kind[name], (i, name))
            out.append((i, first[0] == i, first[1]))
    return sorted(out)


def told(df):
    return sorted((r.id, r.accepted, r.claimed_by) for r in df.collect())


def test_batch_claims(spark):
    rows = events(60)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert told(guard.claims(docs, "name", "at")) == plain(rows)
    assert sorted(r.id for r in guard.first_claims(docs, "name", "at").collect()) == [i for i, ok, _ in plain(rows) if ok]
    refused = guard.refusals(docs, "name", "at")
    assert refused.columns == ["id", "name", "at", "claimed_by", "claimed_at"]
    assert sorted((r.id, r.claimed_by) for r in refused.collect()) == [(i, by) for i, ok, by in plain(rows) if not ok]


def test_null_names_claim_nothing(spark):
    docs = spark.createDataFrame([(1, None, START), (2, None, START), (3, None, None), (4, "a", None), (5, "a", START)], SCHEMA)
    assert told(guard.claims(docs, "name", "at")) == [(1, True, None), (2, True, None), (3, True, None), (4, True, "a"), (5, False, "a")]
    assert guard.first_claims(docs.limit(0), "name", "at").count() == 0
    clash = docs.withColumn("accepted", F.lit("x"))
    assert guard.claims(clash, "name", "at").filter("accepted").count() == 4


def test_stream_equals_batch_across_a_restart(spark, tmp_path):
    """Three files, a stop after the first: the state goes on from its checkpoint, and refusals name who holds the claim."""
    rows = events(60)
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = guard.claims(stream, "name", "at").writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(once=True).start(sink)
        q.awaitTermination()

    for k in range(3):
        run(rows[20 * k : 20 * k + 20])
    assert told(spark.read.parquet(sink)) == plain(rows)


def batches(rows, n):
    return [rows[i : i + n] for i in range(0, len(rows), n)]


def test_index_in_batches_equals_one_batch(spark, tmp_path):
    rows = events(80, seed=3)
    index = ClaimIndex(spark, str(tmp_path / "claims"), buckets=4)
    got = []
    for i, part in enumerate(batches(rows, 25)):
        got += told(index.add(spark.createDataFrame(part, SCHEMA), "name", "at", i))
        if i == 1:
            index.compact()
            index = ClaimIndex(spark, str(tmp_path / "claims"))  # opened anew, with the buckets it was made with
            assert index.told["buckets"] == 4
    assert sorted(got) == plain(rows)
    index.compact()
    kept = index.rows()
    assert kept.count() == kept.select("skeleton").distinct().count() == len({by for _, _, by in plain(rows) if by is not None})


def test_a_batch_that_is_tried_again_is_stored_once(spark, tmp_path):
    index = ClaimIndex(spark, str(tmp_path / "claims"), buckets=3)
    first, second = (spark.createDataFrame(x, SCHEMA) for x in batches(events(40, seed=5), 20))
    index.add(first, "name", "at", "a")
    once, n = told(index.add(second, "name", "at", "b")), index.rows().count()
    assert told(index.add(second, "name", "at", "b")) == once and index.rows().count() == n
    assert told(index.add(first.limit(0), "name", "at", "c")) == []


def test_the_index_is_neither_shuffled_nor_sorted_out(spark, tmp_path):
    index = ClaimIndex(spark, str(tmp_path / "claims"), buckets=4)
    index.add(spark.createDataFrame(events(30), SCHEMA), "name", "at", "a")
    held = index.rows().select(F.col("skeleton").alias("k"), "name")
    batch = spark.createDataFrame([("oslo",)], "k string").groupBy("k").count()
    plan = batch.join(held.hint("merge"), "k", "left")._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.index("FileScan parquet") - 200 :]
    assert "Bucketed: true" in plan and "Exchange" not in right.split("FileScan")[0][-200:]


def test_an_index_of_another_version_is_refused(spark, tmp_path):
    index = ClaimIndex(spark, str(tmp_path / "claims"))
    index._write(index.told | {"version": "1.0"})
    with pytest.raises(ValueError, match="Unicode 1.0"):
        ClaimIndex(spark, str(tmp_path / "claims"))
