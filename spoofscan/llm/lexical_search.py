"""Ranked lexical search by sort-based accumulation.

A batch of documents yields, for each item's term that a document holds, a packed key (item, document) and an integer
impact. The keys are put in order by a radix sort, sixteen bits a pass, equal neighbours are summed with numpy's reduceat,
and each item's best documents are selected with a heap. Partial results of all tasks, at most `top` an item and task, are
dealt by ranges of items and selected once more.

Items are taken in blocks of bounded size, so what a task holds of them is bounded however many there are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_texts, materialise, release, small_batches

#: ASCII letters and digits, and everything beyond ASCII, make terms; A-Z is lower-cased, the rest of ASCII separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of item texts that one block holds, and impacts that a task sorts together.
BLOCK_BYTES, MOST_IMPACTS = 4 << 20, 1 << 22


def terms(text: str) -> list[bytes]:
    """The terms of a text, in order, repeats included."""
    return text.encode().translate(_FOLD).split()


def radix_order(keys: np.ndarray) -> np.ndarray:
    """A stable order of unsigned keys: one counting pass for each sixteen bits that any key uses."""
    top, order, shift = int(keys.max()) if len(keys) else 0, np.arange(len(keys)), 0
    while top >> shift:
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
        shift += 16
    return order


class Block:
    """A block of items: their distinct terms by number, and the items of each term as one array with offsets."""

    def __init__(self, texts: list[str]) -> None:
        own = [sorted(set(terms(x))) for x in texts]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for x in own for t in x}))}
        pairs = sorted((self.vocabulary[t], i) for i, x in enumerate(own) for t in x)
        self.items = np.array([i for _, i in pairs], np.int64)
        self.counts = np.bincount(np.array([t for t, _ in pairs], np.int64), minlength=len(self.vocabulary))
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64) if len(self.counts) else np.empty(0, np.int64)


def item_blocks(items: DataFrame, key: str, text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of the items in key order, a block at a time; one that is larger than `most` stands alone."""
    keys, texts, held = [], [], 0
    for row in items.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).orderBy("k", "t").toLocalIterator():
        if texts and held + len(row.t) > most:
            yield keys, texts
            keys, texts, held = [], [], 0
        keys.append(row.k)
        texts.append(row.t)
        held += len(row.t)
    if texts:
        yield keys, texts


def _postings(sent):
    """Of each document with a term: its key, number of terms, and the numbers and frequencies of the block's terms."""

    def run(batches):
        vocabulary = sent.value.vocabulary
        for batch in small_batches(batches):
            n, numbers, often = [], [], []
            for text in arrow_texts(batch):
                words = terms(text)
                at = np.array([i for w in words if (i := vocabulary.get(w)) is not None], np.uint32)
                own, tf = np.unique(at, return_counts=True)
                n.append(len(words))
                numbers.append(own.astype("<u4").tobytes())
                often.append(tf.astype("<u4").tobytes())
            yield pa.record_batch([batch.column("doc"), pa.array(n, pa.int64()), pa.array(numbers, pa.binary()), pa.array(often, pa.binary())], names=["doc", "n", "numbers", "often"])

    return run


def _holding(sent):
    """(term, documents) a task: how many of its documents hold each term."""

    def run(batches):
        counts = np.zeros(len(sent.value.vocabulary), np.int64)
        for batch in batches:
            for x in batch.column("numbers").to_pylist():
                counts[np.frombuffer(x, "<u4")] += 1
        at = np.flatnonzero(counts)
        yield pa.record_batch({"term": pa.array(at, pa.int64()), "df": pa.array(counts[at])})

    return run


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def _accumulated(block: Block, weight: np.ndarray, m: np.ndarray, numbers: list[bytes], often: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document's place, score) of every pair of a batch with a common term, by item, then place."""
    term = np.frombuffer(b"".join(numbers), "<u4").astype(np.int64)
    tf = np.frombuffer(b"".join(often), "<u4").astype(np.int64)
    place = np.repeat(np.arange(len(numbers)), [len(x) // 4 for x in numbers])
    impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[place]))
    wide = block.counts[term]
    each = np.repeat(np.arange(len(term)), wide)
    item = block.items[np.arange(len(each)) + np.repeat(block.starts[term] - np.cumsum(wide) + wide, wide)]
    keys = (item.astype(np.uint64) << np.uint64(32)) | place[each].astype(np.uint64)
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    score = np.add.reduceat(impact[each[order]], first) if len(first) else np.empty(0, np.int64)
    return (keys[first] >> np.uint64(32)).astype(np.int64), (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), score


def _best(sent, told, top: int):
    """(item, doc, score) of the best `top` documents of each item in a task."""

    def run(batches):
        block, (weight, n_docs, n_terms) = sent.value, told.value
        heaps: dict[int, list] = {}
        for batch in batches:
            docs, n = batch.column("doc").to_pylist(), batch.column("n").to_numpy()
            numbers, often = batch.column("numbers").to_pylist(), batch.column("often").to_pylist()
            sizes = [int(block.counts[np.frombuffer(x, "<u4")].sum()) for x in numbers]
            start = 0
            while start < len(docs):
                end, total = start, 0
                while end < len(docs) and (end == start or total + sizes[end] <= MOST_IMPACTS):
                    total += sizes[end]
                    end += 1
                m = np.array([100 - 50 + (50 * x * n_docs) // n_terms for x in n[start:end].tolist()], np.int64)
                item, place, score = _accumulated(block, weight, m, numbers[start:end], often[start:end])
                edges = np.concatenate([[0], np.flatnonzero(np.diff(item)) + 1, [len(item)]]) if len(item) else [0]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    own, s, p = int(item[a]), score[a:b], place[a:b]
                    heap = heaps.setdefault(own, [])
                    # only what may enter a full heap is looked at
                    floor = heap[0][0] if len(heap) == top else 1
                    if b - a > top:
                        floor = max(floor, int(np.partition(s, b - a - top)[b - a - top]))
                    for i in np.flatnonzero(s >= max(floor, 1)).tolist():
                        doc = docs[start + int(p[i])]
                        entry = (int(s[i]), doc is not None, -(doc or 0), doc)
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        elif entry[:3] > heap[0][:3]:
                            heapq.heapreplace(heap, entry)
                start = end
        rows = [(i, x[3], x[0]) for i, heap in heaps.items() for x in heap]
        items, docs, scores = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch({"item": pa.array(items, pa.int64()), "doc": pa.array(docs, pa.int64()), "score": pa.array(scores, pa.int64())})

    return run


def _searched(spark, given: DataFrame, keys: list, texts: list[str], top: int) -> DataFrame:
    """The ranking of one block of items: item_id, rank, doc_id, score."""
    sent = spark.sparkContext.broadcast(Block(texts))
    found = materialise(given.mapInArrow(_postings(sent), "doc long, n long, numbers binary, often binary").filter("n > 0"), "postings")
    n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one number a term of the block, whatever the documents
    df = np.zeros(len(sent.value.vocabulary), np.int64)
    for row in found.select("numbers").mapInArrow(_holding(sent), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row.term] = row.df
    told = spark.sparkContext.broadcast((weights(df, n_docs), n_docs, max(n_terms, 1)))
    part = found.mapInArrow(_best(sent, told, top), "item long, doc long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = part.repartitionByRange("item").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    named = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "item long, item_id long")
    out = materialise(ranked.join(F.broadcast(named), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score"), "ranking")
    release(found)
    return out


def ranked_search(items: DataFrame, docs: DataFrame, top: int = 50, item_key: str = "item_id", item_text: str = "text", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The `top` documents of each item by BM25 in integers: item_id, rank (from 1), doc_id, score (above 0).

    Equal scores go by ascending key, null keys last. Null texts have no terms; items without any, or whose terms no
    document holds, have no rows. A repeated item row ranks for itself, a repeated document row is a document of its own.
    Counts (documents, terms, document frequencies) are of all rows. Without items or documents there are no rows.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    out = [_searched(spark, given, keys, texts, top) for keys, texts in item_blocks(items, item_key, item_text)]
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SQL = """
WITH doc_terms AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents
), sizes AS (
  SELECT doc_id, r, t, CAST(len(t) AS BIGINT) AS n FROM doc_terms WHERE len(t) > 0
), sums AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), item_terms AS (
  SELECT item_id, row_number() OVER () AS i, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark
), asked AS (
  SELECT item_id, i, unnest(t) AS term FROM item_terms
), tf AS (
  SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM sizes) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, sums GROUP BY term
), scored AS (
  SELECT item_id, i, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) AS BIGINT) AS score
  FROM tf JOIN weighed USING (term) JOIN asked USING (term), sums GROUP BY item_id, i, r, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
