"""Removal of repeated byte strings, by ranks of growing length at synchronised positions.

A suffix array of every byte position would move tens of bytes a byte of text at each doubling. Positions are therefore
synchronised: each window of WINDOW bytes is placed by the least rank among the ANCHOR-byte strings in it (the leftmost
of equals), which follows from the window's bytes alone, so that equal windows have equal anchors at equal offsets.
Ranks of ANCHOR bytes come by doubling (1, 2, 4, ... bytes, where the text is read). Windows that follow each other
mostly share their anchor and travel as one run.

1. Runs whose anchor's rank is unique in the corpus hold no repeated window, and go no further.
2. The runs left are ranked by all their bytes. Runs that occur again are repeated as a whole.
3. Where runs of one anchor differ (a repeat begins or ends there), one run of each kind is sorted by anchor, and the
   ranks of their windows are compared. Anchors with more than MOST kinds of runs are compared window by window by a
   grouping instead, so no task holds a group without bound.
4. The spans of repeated windows go back to their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import hash_join, materialise, release, small_batches

WINDOW, ANCHOR = 200, 64
#: Kinds of runs of one anchor that one task compares; bytes of a text that are ranked at once.
MOST, BLOCK = 1_000, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xC2B2AE3D27D4EB4F)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def ranks(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit ranks of all strings of `size` bytes: by doubling to a power of two, then of two such that overlap."""
    rank, length = _BYTES[data], 1
    while 2 * length <= size:
        rank = rank[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + rank[length:]
        length *= 2
    if length < size:
        rank = _mixed(rank)
        rank = rank[: len(rank) - (size - length)] * np.uint64(_BASE) + rank[size - length :]
    return _mixed(rank)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of `width` values."""
    length = 1
    while 2 * length <= width:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    return np.minimum(x[: len(x) - (width - length)], x[width - length :]) if length < width else x


def runs(data: bytes, window: int, anchor: int):
    """(start, windows, anchor's rank) of the runs of windows that have one anchor."""
    found = []
    for at in range(0, max(0, len(data) - window) + 1, BLOCK):
        block = np.frombuffer(data, np.uint8)[at : at + BLOCK + window - 1]
        if len(block) < window:
            break
        rank = ranks(block, anchor)
        low = np.uint64((1 << 24) - 1)
        place = _least((rank & ~low) | np.arange(len(rank), dtype=np.uint64), window - anchor + 1) & low
        starts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        found.append((starts + at, np.diff(np.append(starts, len(place))), rank[place[starts].astype(np.int64)]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _place(window: int, anchor: int):
    def run(batches):
        for batch in batches:
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text"), strict=True):
                start, n, rank = runs(text.as_py().encode(), window, anchor)
                if len(start):
                    columns = [np.full(len(start), uid, np.int64), start.astype(np.int32), n.astype(np.int32), rank.view(np.int64)]
                    yield pa.record_batch(list(map(pa.array, columns)), names=["uid", "start", "n", "rank"])

    return _gathered(run)


def _gathered(run, most: int = 50_000):
    """Small batches put together, so that Spark doesn't get one a document."""

    def out(batches):
        held, rows = [], 0
        for x in run(batches):
            held.append(x)
            rows += x.num_rows
            if rows >= most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def _part(data: bytes, run: dict, window: int) -> bytes:
    return data[run["start"] : run["start"] + run["n"] + window - 1]


def _digests(window: int):
    """Of texts and the runs left in them: the digest of each run's bytes."""

    def run(batches):
        for batch in batches:
            for uid, text, own in zip(*(batch.column(x) for x in ("uid", "text", "runs")), strict=True):
                uid, data, own = uid.as_py(), text.as_py().encode(), own.as_py()
                digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(_part(data, r, window)) for r in own]), ">i8").reshape(-1, 2).astype(np.int64)
                columns = [pa.array([r[name] for r in own], kind) for name, kind in (("start", pa.int32()), ("n", pa.int32()), ("rank", pa.int64()))]
                yield pa.record_batch([pa.array(np.full(len(own), uid, np.int64)), *columns, pa.array(digest[:, 0]), pa.array(digest[:, 1])], names=["uid", "start", "n", "rank", "d1", "d2"])

    return _gathered(run)


def _bytes(window: int):
    """Of texts and chosen runs in them: each run with its bytes."""

    def run(batches):
        for batch in batches:
            for uid, text, own in zip(*(batch.column(x) for x in ("uid", "text", "runs")), strict=True):
                uid, data, own = uid.as_py(), text.as_py().encode(), own.as_py()
                columns = [pa.array([r[name] for r in own], kind) for name, kind in (("start", pa.int32()), ("rank", pa.int64()), ("kinds", pa.int64()))]
                yield pa.record_batch([pa.array(np.full(len(own), uid, np.int64)), *columns, pa.array([_part(data, r, window) for r in own], pa.binary())], names=["uid", "start", "rank", "kinds", "bytes"])

    return _gathered(run, 20_000)


def _window_ranks(parts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, offset, rank) of every window of every part."""
    sizes = np.array([len(x) for x in parts])
    rank = ranks(np.frombuffer(b"".join(parts), np.uint8), window)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    member = np.repeat(np.arange(len(parts)), sizes - window + 1)
    first = np.concatenate([[0], np.cumsum(sizes - window + 1)[:-1]])
    offset = np.arange(len(member)) - first[member]
    return member, offset, rank[begin[member] + offset]


def _spans(member, offset):
    """(member, first offset, windows) of the stretches in sorted (member, offset)."""
    new = np.concatenate([[0], np.flatnonzero((np.diff(member) != 0) | (np.diff(offset) != 1)) + 1])
    return member[new], offset[new], np.diff(np.append(new, len(member)))


def _compare(window: int):
    """Of kinds of runs sorted by anchor: the stretches of windows that another kind of the same anchor has too."""

    def close(held):
        if len(held) < 2:
            return
        member, offset, rank = _window_ranks([x[2] for x in held], window)
        _, which, times = np.unique(rank, return_inverse=True, return_counts=True)
        again = times[which] > 1
        if again.any():
            m, o, n = _spans(member[again], offset[again])
            uid, start = (np.array([held[j][i] for j in m.tolist()], np.int64) for i in (0, 1))
            yield pa.record_batch([pa.array(uid), pa.array((start + o).astype(np.int32)), pa.array(n.astype(np.int32))], names=["uid", "start", "n"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("uid", "start", "bytes", "rank")]
            for row in zip(*columns, strict=True):
                if row[3] != now:
                    yield from close(held)
                    held, now = [], row[3]
                held.append(row)
        yield from close(held)

    return _gathered(run)


def _each_window(window: int):
    def run(batches):
        for batch in batches:
            rows = list(zip(*(batch.column(x).to_pylist() for x in ("uid", "start", "bytes", "rank")), strict=True))
            for a in range(0, len(rows), 1000):
                part = rows[a : a + 1000]
                member, offset, rank = _window_ranks([x[2] for x in part], window)
                own = lambda i: np.array([x[i] for x in part], np.int64)[member]  # noqa: B023, E731
                yield pa.record_batch([pa.array(own(0)), pa.array((own(1) + offset).astype(np.int32)), pa.array(own(3)), pa.array(rank.view(np.int64))], names=["uid", "start", "rank", "of_window"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(window: int, with_text: bool):
    def run(batches):
        for batch in small_batches(batches):
            rows = []
            for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
                data = text.as_py().encode()
                spans = merged([(x["start"], x["start"] + x["n"] + window - 1) for x in found.as_py() or []])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([batch.column("id"), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def equal_texts(rows: DataFrame, window: int) -> DataFrame:
    """Of rows (uid, k1, k2, bytes), those whose text of `window` bytes or more another row has: (uid, bytes, first uid).

    Equal texts are repeated from end to end, so one of them stands for all in what follows; the cost of a group is
    linear in its rows.
    """
    long = rows.filter(F.col("bytes") >= window)
    groups = materialise(long.groupBy("k1", "k2").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "texts-again")
    out = materialise(long.join(groups, ["k1", "k2"]).select("uid", "bytes", "first"), "equal-texts")
    release(groups)
    return out


def repeated_spans(rows: DataFrame, others: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """Of rows (uid, text), stretches (uid, start, n) of windows that start anywhere else too.

    Rows in `others` (uid) are left out: an equal text stands for them.
    """
    at = "uid long, start int, n int"
    placed = materialise(rows.select("uid", "text").mapInArrow(_place(window, anchor), f"{at}, rank long").join(others, "uid", "left_anti"), "runs")
    # what a hot key is joined to is written first: Spark can split a skewed join only between plain exchanges
    many = materialise(placed.groupBy("rank").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("rank"), "ranks-again")
    left = placed.join(many, "rank", "left_semi").groupBy("uid").agg(F.collect_list(F.struct("start", "n", "rank")).alias("runs"))
    left = materialise(left, "runs-left", free=True)
    release(placed, many)
    told = hash_join(rows.select("uid", "text"), left, "uid").mapInArrow(_digests(window), f"{at}, rank long, d1 long, d2 long")
    told = materialise(told, "run-digests", free=True)
    release(left)
    first = F.min(F.struct("uid", "start", "n")).alias("first")
    kinds = materialise(told.groupBy("rank", "d1", "d2").agg(F.count(F.lit(1)).alias("times"), first), "run-kinds")
    whole = told.join(kinds.filter("times > 1").select("rank", "d1", "d2"), ["rank", "d1", "d2"], "left_semi").select("uid", "start", "n")
    whole = materialise(whole, "whole-runs", free=True)
    release(told)
    mixed = kinds.groupBy("rank").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    mixed = materialise(mixed, "ranks-mixed")
    chosen = kinds.join(mixed, "rank").select("first.*", "rank", "kinds")
    chosen = materialise(chosen.groupBy("uid").agg(F.collect_list(F.struct("start", "n", "rank", "kinds")).alias("runs")), "runs-chosen")
    release(kinds, mixed)
    ones = hash_join(rows.select("uid", "text"), chosen, "uid").mapInArrow(_bytes(window), "uid long, start int, rank long, kinds long, bytes binary")
    ones = materialise(ones, "run-bytes", free=True)
    release(chosen)
    few = ones.filter(F.col("kinds") <= most).repartition("rank").sortWithinPartitions("rank").mapInArrow(_compare(window), at)
    each = ones.filter(F.col("kinds") > most).mapInArrow(_each_window(window), "uid long, start int, rank long, of_window long")
    again = each.groupBy("rank", "of_window").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("rank", "of_window")
    single = each.join(again, ["rank", "of_window"], "left_semi").select("uid", "start", F.lit(1).alias("n"))
    out = materialise(whole.union(few).union(single), "repeated-windows", free=True)
    release(whole, ones)
    return out


def suffix_dedup(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of `docs`: key, n_bytes, n_removed, n_spans, kept_sha256 and (if asked for) kept, the bytes left.

    Each byte goes that a string of `window` bytes covers which also starts elsewhere, in this or another text; all
    copies go, as strings are judged on the input. Null texts count as empty ones. Repeated rows of `window` bytes or
    more lose everything. Texts shorter than a window stay. An empty table gives none. Equal texts and runs are told by
    digests of 128 bits, windows of one anchor by 64.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = materialise(rows.select("uid", "id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), F.octet_length("text").alias("bytes"), "text"), "suffix-texts")
    equal = equal_texts(rows.drop("text", "id"), window)
    spans = repeated_spans(rows, equal.filter("uid <> first").select("uid"), window)
    spans = spans.union(equal.select("uid", F.lit(0).alias("start"), (F.col("bytes") - window + 1).alias("n")))
    found = materialise(spans.groupBy("uid").agg(F.collect_list(F.struct("start", "n")).alias("found")), "spans")
    release(equal, spans)
    schema = StructType([StructField("id", docs.schema[key].dataType), *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")])
    out = hash_join(rows.select("uid", "id", "text"), found, "uid", "left").select("id", "text", "found").mapInArrow(_cut(window, with_text), schema)
    return out.select(F.col("id").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)
