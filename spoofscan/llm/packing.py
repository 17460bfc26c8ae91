"""Lexical retrieval packing.

Documents are encoded once. Document frequencies and the mean length are taken over all of them; the former have at most
one number a vocabulary entry, so they go to every task. Documents are then dealt by content: ranges of a global sort by
their terms of most weight, so that those which share rare terms meet wherever they stood in the input. A range is cut
into shards of bounded size, each with a BM25 inverted index; a seed document asks its shard's index by all of its terms
for all unused neighbours, best first, which fill the seed's window. The document that overflows a window is cut, and its
rest seeds the next window, so only a shard's last window is padded.
"""

from __future__ import annotations

import zlib
from collections import deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import tokens
from .common import arrow_texts, materialise, small_batches

#: A shard ends at so many documents or tokens; BM25's usual constants; terms by which documents are sorted.
SHARD_DOCS, SHARD_TOKENS, K1, B, LEADS = 2048, 4_000_000, 1.2, 0.75, 3
#: Of a shard's terms, those in over one of so many documents (the most frequent, at most so many) are scored as a matrix.
COMMON, MOST_COMMON = 16, 1024


class Corpus(NamedTuple):
    """What BM25 needs of all documents: their number, their mean length, and in how many each term stands."""

    docs: int
    mean: float
    df: np.ndarray

    def idf(self, term: np.ndarray) -> np.ndarray:
        df = self.df[term]
        return np.log(1 + (self.docs - df + 0.5) / (df + 0.5))

    def weight(self, term: np.ndarray, tf: np.ndarray, length) -> np.ndarray:
        return self.idf(term) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(self.mean, 1)))


def terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of each distinct term of each document, in that order, for all of them at once."""
    size = [len(x) for x in docs]
    both = (np.repeat(np.arange(len(docs)), size) << 32) | (np.concatenate(docs) if docs else np.empty(0, "<u4"))
    both.sort()
    first = np.flatnonzero(np.diff(both, prepend=-1))
    return both[first] >> 32, both[first] & 0xFFFFFFFF, np.diff(first, append=len(both))


def corpus_of(docs: list[np.ndarray]) -> Corpus:
    return Corpus(len(docs), sum(map(len, docs)) / max(len(docs), 1), np.bincount(terms(docs)[1]))


def leads(docs: list[np.ndarray], corpus: Corpus) -> np.ndarray:
    """Each document's LEADS terms of most weight that another document has too, the best first; -1 for each one missing."""
    doc, term, tf = terms(docs)
    shared = corpus.df[term] > 1
    doc, term, tf = doc[shared], term[shared], tf[shared]
    weight = corpus.weight(term, tf, np.array([len(x) for x in docs], np.float64)[doc])
    best, start = np.full((len(docs), LEADS), -1, np.int32), np.flatnonzero(np.diff(doc, prepend=-1))
    for i in range(LEADS if len(doc) else 0):
        top = np.repeat(np.maximum.reduceat(weight, start), np.diff(start, append=len(doc)))
        hit = np.flatnonzero((weight == top) & (weight > 0))
        hit = hit[np.flatnonzero(np.diff(doc[hit], prepend=-1))]
        best[doc[hit], i] = term[hit]
        weight[hit] = 0
    return best


class Index:
    """BM25 over a shard, by the whole corpus's statistics: scores by common terms, and postings of all other terms."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None) -> None:
        corpus = corpus or corpus_of(docs)
        doc, term, tf = terms(docs)
        here = np.bincount(term)
        weight = corpus.weight(term, tf, np.array([len(x) for x in docs], np.float64)[doc])
        # most postings are of common terms: one product of matrices scores those for all seeds at once
        n = len(docs)
        common = np.argsort(-here, kind="stable")[:MOST_COMMON]
        common = common[here[common] > max(n // COMMON, 1)]
        row = np.full(len(here), -1)
        row[common] = np.arange(len(common))
        own = row[term] >= 0
        weights, holds = np.zeros((len(common), n), np.float32), np.zeros((n, len(common)), np.float32)
        weights[row[term[own]], doc[own]] = weight[own]
        holds[doc[own], row[term[own]]] = 1
        self.base = holds @ weights
        # of the others, the postings; a seed asks by those that another document of the shard has
        rare = ~own & (here[term] > 1)
        doc, term, weight = doc[rare], term[rare], weight[rare]
        self.query = np.split(term, np.cumsum(np.bincount(doc, minlength=n))[:-1])
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(here)))])
        self.n = n

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """All unused documents that share a term with the seed, the best first."""
        score, query = self.base[seed], self.query[seed]
        if len(query):
            spans = list(zip(self.start[query].tolist(), self.start[query + 1].tolist(), strict=True))
            docs = np.concatenate([self.doc[a:b] for a, b in spans])
            score = score + np.bincount(docs, np.concatenate([self.weight[a:b] for a, b in spans]), self.n)
        top = np.flatnonzero((score > 0) & unused)
        return top[np.argsort(-score[top], kind="stable")]


def pack_shard(docs: list[np.ndarray], window: int, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every id of every document lies in one piece."""
    index, unused, pieces = Index(docs, corpus), np.ones(len(docs), bool), []
    queue: deque[int] = deque()
    sequence = offset = nearest = 0
    while True:
        if not queue:  # no unused document shares a term with the last one: the first unused document goes on
            while nearest < len(docs) and not unused[nearest]:
                nearest += 1
            if nearest == len(docs):
                return pieces
            queue.append(nearest)
        d = queue.popleft()
        if not unused[d]:
            continue
        unused[d], at, seeds = False, 0, False
        while at < len(docs[d]):
            n = min(len(docs[d]) - at, window - offset)
            pieces.append((d, at, n, sequence, offset))
            seeds |= not offset
            at, offset = at + n, offset + n
            if offset == window:
                sequence, offset = sequence + 1, 0
        # whatever begins a window is its seed; a document that ends in mid-window asks for what fills the rest
        if seeds or not queue:
            queue = deque(index.neighbours(d, unused).tolist())


def _width(tokenizer: str, end_id: int) -> str:
    """The type that holds all ids."""
    return "<u2" if max(tokens.library(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _encode(tokenizer: str, end_id: int):
    """Of texts, their ids and `end_id` as little-endian bytes."""

    def run(batches):
        for batch in small_batches(batches):
            width = _width(tokenizer, end_id)
            found = [np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)).astype(width).tobytes() for x in tokens.encode(tokenizer, arrow_texts(batch))]
            yield pa.record_batch([batch.column("id"), pa.array(found, pa.binary())], names=["id", "ids"])

    return run


def _ids(batch, width: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), width) for x in batch.column("ids")]


def _count_terms(width: str):
    return lambda batches: _counted(batches, width)


def _counted(batches, width: str):
    """A task's share of the statistics, a row a term that it saw; documents as term -1, tokens as -2."""
    docs = total = 0
    df = np.zeros(1, np.int64)
    for batch in small_batches(batches, "ids"):
        ids = _ids(batch, width)
        docs, total = docs + len(ids), total + sum(map(len, ids))
        own = np.bincount(terms(ids)[1], minlength=len(df))
        own[: len(df)] += df
        df = own
    term = np.flatnonzero(df)
    yield pa.record_batch([pa.array([*term.tolist(), -1, -2], pa.int64()), pa.array([*df[term].tolist(), docs, total], pa.int64())], names=["term", "n"])


def corpus_statistics(encoded: DataFrame, width: str) -> Corpus:
    """Statistics over all of `encoded`; what reaches the driver is bounded by the vocabulary."""
    counts = encoded.select("ids").mapInArrow(_count_terms(width), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = {r["term"]: r["n"] for r in counts.collect()}
    docs, total = n.pop(-1, 0), n.pop(-2, 0)
    df = np.zeros(max(n, default=0) + 1, np.int64)
    df[list(n)] = list(n.values())
    return Corpus(docs, total / max(docs, 1), df)


def _lead(sent, width: str):
    def run(batches):
        for batch in small_batches(batches, "ids"):
            found = leads(_ids(batch, width), sent.value)
            yield pa.record_batch([*batch.columns, *(pa.array(found[:, i]) for i in range(LEADS))], names=[*batch.schema.names, *(f"lead{i}" for i in range(LEADS))])

    return run


def _pack(window: int, with_ids: bool, sent, width: str):
    def shard(base: int, keys: list, ids: list[np.ndarray]):
        own = pack_shard(ids, window, sent.value)
        cut = [ids[d][a : a + n].astype("<u4") for d, a, n, _, _ in own]
        columns = {
            "id": pa.chunked_array(keys).combine_chunks().take(pa.array([x[0] for x in own], pa.int64())),
            "start": pa.array([x[1] for x in own], pa.int64()),
            "length": pa.array([x[2] for x in own], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()),
            "doc_tokens": pa.array([len(ids[x[0]]) for x in own], pa.int64()),
            "sequence_id": pa.array([base + x[3] for x in own], pa.int64()),
            "offset": pa.array([x[4] for x in own], pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32()))
        return pa.record_batch(columns), own[-1][3] + 1

    def run(batches):
        base, keys, ids, total = TaskContext.get().partitionId() << 36, [], [], 0
        for batch in batches:
            for i, own in enumerate(_ids(batch, width)):
                if ids and (len(ids) >= SHARD_DOCS or total >= SHARD_TOKENS):
                    out, used = shard(base, keys, ids)
                    yield out
                    base, keys, ids, total = base + used, [], [], 0
                keys.append(batch.column("id").slice(i, 1))
                ids.append(own)
                total += len(own)
        if ids:
            yield shard(base, keys, ids)[0]

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and (if asked for) ids.

    A document's ids are its tokens and `end_id`; a null or empty text has `end_id` alone. Keys may be null or repeat;
    each row is packed once. A sequence's pieces fill it without gaps from offset 0. An empty table gives no pieces.
    Documents of equal terms are ordered by their ids' hash and key, so the order of rows in the input has no influence.
    """
    sc, kind = docs.sparkSession.sparkContext, docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    encoded = StructType([StructField("id", kind), *StructType.fromDDL("ids binary")])
    tokenizer = tokenizer or tokens.default_path()
    ids, width = materialise(rows.mapInArrow(_encode(tokenizer, end_id), encoded), "pack-ids"), _width(tokenizer, end_id)
    sent = sc.broadcast(corpus_statistics(ids, width))
    names = [f"lead{i}" for i in range(LEADS)]
    led = ids.mapInArrow(_lead(sent, width), StructType([*encoded, *StructType.fromDDL(", ".join(f"{x} int" for x in names))]))
    order = [*names, F.xxhash64("ids"), "id"]
    dealt = led.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "ids")
    fields = [StructField(x, LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = StructType([StructField("id", kind), *fields, *StructType.fromDDL("ids array<int>")][: None if with_ids else -1])
    return dealt.mapInArrow(_pack(window, with_ids, sent, width), schema).withColumnRenamed("id", key)
