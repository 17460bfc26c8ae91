"""Mixing sources to target weights by weighted fair queueing. Native: DataFrame functions only.

Every document gets a virtual finish time, the cumulative size of its source's shuffled documents divided by the
source's target. All copies of all documents are ordered by that time and the order is cut where the running total
reaches the budget. Cumulative sums are two-level (sums of buckets, then within buckets), so that neither a hot source
nor the global order meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_join, materialise, word_count

#: Buckets of the shuffle order within a source (three hex digits), and of virtual time.
ORDER_DIGITS, TIME_BUCKETS = 3, 4096


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_copies: int = 3) -> DataFrame:
    """One row per source: source, rank, source_size, target.

    Sources by code point, null last, weigh `weights` in turn. Water-filling has a closed form: in ascending order of
    limit by weight, the level each source would see if all before it were full has its maximum at the true level.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    cap = (F.col("source_size") * max_copies).alias("cap")
    out = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    out = out.withColumn("rank", F.row_number().over(one)).withColumn("cap", cap)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    out = out.withColumn("weight", F.get(cycle, (F.col("rank") - 1) % len(weights)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("level", (total - before).cast("double") / rest)
    level = F.max("level").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * level)
    return out.select("source", "rank", "source_size", target.alias("target"))


def _running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """`df` with the inclusive running sum of `value` in `out`, by `group`, in the order of `bucket`, then `order`."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    rows = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(rows), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(sums, [*group, bucket]).withColumn(out, F.col("_before") + F.sum(value).over(inner)).drop("_before")


def fair_mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_copies: int = 3,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of `docs`: key, size, source_size, target, taken, copies, and the columns in `carry`.

    Carried columns go through all windows, so they should be short.

    A null text has size 0; a null source is a source of its own, the last; a null key is shuffled like the text
    'null'. Rows of equal key and size are interchangeable. Documents of size 0 have taken 0 and copies 0. An empty
    table gives an empty result.
    """
    seed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")))
    kept = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    # the working columns are made first, so that no other column of `docs` can clash with them
    docs = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), seed.alias("seed"), *kept)
    docs = docs.withColumn("bucket", F.substring("seed", 1, ORDER_DIGITS))
    light = materialise(docs, "sizes")  # the texts are read once
    targets = materialise(source_targets(light, weights, max_copies), "targets")
    named = light.join(targets, light["source"].eqNullSafe(targets["source"])).drop("source")
    queued = _running(named, ["rank"], "bucket", ["seed", "id", "size"], "size", "done")

    finish = lambda copy: (F.col("done") + copy * F.col("source_size")).cast("double") / F.col("target")
    place = lambda copy: F.struct(finish(copy).alias("finish"), F.col("rank"), F.col("seed"), F.col("id"), F.col("size"), copy.alias("copy"))

    copies = queued.filter("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_copies - 1))))
    copies = copies.withColumn("at", place(F.col("copy"))).withColumn("slot", F.floor(F.col("at.finish") * TIME_BUCKETS))
    copies = copies.select("at", "slot", "size")
    budget = targets.agg(F.sum("source_size").alias("budget"))
    slots = copies.groupBy("slot").agg(F.sum("size").alias("_sum"))
    rows = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = slots.withColumn("upto", F.sum("_sum").over(rows)).withColumn("before", F.col("upto") - F.col("_sum"))
    # the one slot in which the budget is reached; all slots before it are taken whole
    last = slots.crossJoin(F.broadcast(budget)).filter("before <= budget").groupBy("budget").agg(F.max(F.struct("slot", "before")).alias("last"))
    last = last.select("budget", "last.slot", "last.before")
    inner = Window.partitionBy("slot").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = copies.join(F.broadcast(last), "slot").withColumn("total", F.col("before") + F.sum("size").over(inner)).filter("total <= budget")
    cut = last.select(F.col("slot").alias("cut_slot")).crossJoin(F.broadcast(end.agg(F.max("at").alias("cut"))))

    def takes(copy: Column) -> Column:
        at = place(copy)
        return ((F.floor(at["finish"] * TIME_BUCKETS) < F.col("cut_slot")) | F.coalesce(at <= F.col("cut"), F.lit(False))).cast("long")

    count = sum((takes(F.lit(i)) for i in range(max_copies)), F.lit(0).cast("long"))
    out = queued.join(F.broadcast(cut), how="left").withColumn("copies", F.when(F.col("size") > 0, F.coalesce(count, F.lit(0))).otherwise(0))
    names = [F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)]
    return out.select(F.col("id").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *names)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with the columns of `docs`.

    The mix is computed on keys and sizes alone; rows meet their number of copies at the end.
    """
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "mix-rows")
    own = rows.select("uid", *[F.col("row")[c].alias(c) for c in ("doc_id", "text", "source")])
    copies = materialise(fair_mix(own, carry=("uid",), **how).filter("copies > 0").select("uid", "copies"), "mix-copies")
    out = hash_join(rows, copies, "uid")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS seed
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 3 * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sources),
weighted AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
levels AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighted),
targets AS (SELECT source, rank, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM levels),
queued AS (
  SELECT d.doc_id, d.size, d.seed, t.rank, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.seed, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS done
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.*, c.copy, (done + c.copy * source_size)::DOUBLE / target AS finish
  FROM queued q CROSS JOIN (VALUES (0), (1), (2)) c(copy) WHERE size > 0),
cut AS (
  SELECT doc_id, size, rank, sum(size) OVER (ORDER BY finish, rank, seed, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS total FROM copies),
took AS (SELECT doc_id, rank, sum(size)::BIGINT AS taken FROM cut WHERE total <= (SELECT sum(source_size) FROM targets) GROUP BY doc_id, rank)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN took t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.rank = t.rank
"""
