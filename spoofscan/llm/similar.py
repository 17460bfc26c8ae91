"""Components of similar sets, found by keys that similar sets share; a key's group is never turned into its pairs.

Each set brings keys, a sketch and its size. The join goes in two turns. In the first, the sets of a key are read in order
of size, and each is tried with one shortly before it; of a set's partners under all its keys, the TRIED that it meets most
often are compared: a linear number of pairs, which joins most of a dense group. In the
second, only keys remain whose sets the first turn has not joined; there every pair of two groups is tried, so that no link
is lost. Those pairs are looked up where a key's sets meet, with their sketches and then with the sets themselves, and never
become rows. A key with more sets than a task should hold is cut into cells.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release
from .components import connected_components

#: Sets, and members of sets, of one key that one task holds a block of.
BLOCK_SETS, BLOCK_MEMBERS = 256, 4_000_000
#: Rows of a key that are tried with one and the same row.
FAN = 64
#: Rows that the first turn tries a row with, at most. What it leaves apart, the second turn tries with every row of its keys.
TRIED = 8
#: Whether the sketches of rows `i` (one) and `j` (several) of a list allow the similarity.
Agree = Callable[[list, int, np.ndarray, np.ndarray], np.ndarray]


def _parents(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows by number in their key's order: (number of the row each is tried with, its level): the last digit that isn't
    zero, base FAN, is made zero. So rows hang on a tree of logarithmic depth."""
    level, up = np.zeros(len(i), np.int64), np.ones(len(i), np.int64)
    while (more := (i % (up * FAN) == 0) & (i > 0)).any():
        level[more] += 1
        up[more] *= FAN
    return i - i % (up * FAN), level + 1


def _neighbours(least: Fraction):
    """Of rows (k, node, n) sorted by k and n: (k, node, other) of the keys that several have; `other` is what a row is tried
    with, a row shortly before it, if their sizes allow the similarity.

    From batch to batch go the last row and, of its key, one row a level.
    """

    def run(batches):
        held = None  # the last row: k, node, n, its number, other
        leaders: dict[int, tuple] = {}
        for batch in batches:
            k, node, n = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("k", "node", "n"))
            if not len(k):
                continue
            new = np.concatenate([[held is None or held[0] != k[0]], k[1:] != k[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            i = np.arange(len(k)) - np.maximum(start, 0)
            i[start < 0] += held[3] + 1 if held else 0
            parent, level = _parents(i)
            at = np.arange(len(k)) - (i - parent)
            x, m = node[np.maximum(at, 0)], n[np.maximum(at, 0)]
            for r in np.flatnonzero(at < 0).tolist():
                x[r], m[r] = leaders[int(level[r])]
            fits = (i > 0) & (m * least.denominator >= n * least.numerator)
            other = np.where(fits, x, -1)
            last = np.concatenate([new[1:], [False]])  # the last rows of their keys; of the batch's last row that isn't known
            out = ~((i == 0) & last)
            if held and held[3] == 0 and not new[0]:
                yield _members([held[0]], [held[1]], [held[4]])
            out[-1] = i[-1] > 0
            yield _members(k[out], node[out], other[out])
            if new.any():
                leaders = {}
            own = np.flatnonzero(start == start[-1])
            for depth in range(1, 11):
                if len(top := own[i[own] % FAN**depth == 0]):
                    leaders[depth] = (node[top[-1]], n[top[-1]])
            held = (k[-1], node[-1], n[-1], i[-1], other[-1])

    return run


def _members(k, node, other) -> pa.RecordBatch:
    return pa.record_batch({"k": pa.array(k, pa.int64()), "node": pa.array(node, pa.int64()), "other": pa.array(other, pa.int64(), mask=np.asarray(other) < 0)})


def _may_agree(agree: Agree):
    """Of rows (a, b, x, y, n_x, n_y) with two sketches and sizes, the pairs (a, b) that they allow."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            sizes = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_x", "n_y")], 1)
            keep = [bool(agree([p, q], 0, np.array([1]), m)[0]) for p, q, m in zip(x, y, sizes, strict=True)]
            yield pa.record_batch({c: batch.column(c) for c in ("a", "b")}).filter(pa.array(keep, pa.bool_()))

    return run


def _cells(batches, extra: str | None):
    """The rows of each (k, cell), which arrive together, by column."""
    names = ["node", "n", "group", "home", "main", "keys", "sketch", *([extra] if extra else [])]
    key, held = None, []
    for batch in batches:
        ids = np.stack([batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("k", "cell")], 1)
        edges = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1, [len(ids)]]) if len(ids) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = tuple(ids[a].tolist())
            if own != key:
                if held:
                    yield key, _gathered(held, names)
                key, held = own, []
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield key, _gathered(held, names)


def _gathered(parts: list[pa.RecordBatch], names: list[str]) -> dict:
    table = pa.Table.from_batches(parts)
    out = {x: table.column(x).to_numpy() for x in names[:5]}
    out["n"] = out["n"].astype(np.int64)
    return out | {x: table.column(x).to_pylist() if x == "sketch" else table.column(x).combine_chunks() for x in names[5:]}


def _lists(column) -> list[np.ndarray]:
    """The rows of an Arrow list column as arrays."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _found(cell: dict, key: tuple, least: Fraction, agree: Agree):
    """(row, earlier rows) of a cell, by size, whose groups differ, whose sizes and sketches allow the likeness, and whose
    first common key is this one; of all cells in which two rows meet, in one alone."""
    n, keys, group, home, main, node = cell["n"], _lists(cell["keys"]), cell["group"], cell["home"], cell["main"], cell["node"]
    width = max(map(len, keys))
    matrix = np.stack([np.concatenate([x, np.full(width - len(x), x[0])]) for x in keys])
    for i in range(1, len(n)):
        first = np.searchsorted(n[:i], -(-n[i] * least.numerator // least.denominator))
        at = slice(first, i)
        # visitors are compared with those at home; of two that visit each other, in the cell of the smaller node
        twice = (home[at] != home[i]) & ~main[at] & ~main[i] & (np.where(home[i], node[at], node[i]) < np.where(home[i], node[i], node[at]))
        j = first + np.flatnonzero((group[at] != group[i]) & (home[at] | home[i]) & ~twice)
        if len(j):
            j = j[agree(cell["sketch"], i, j, n)]
        if len(j):
            common = np.isin(matrix[j], matrix[i])
            j = j[np.where(common, matrix[j], np.iinfo(np.int64).max).min(1) == key[0]]
        if len(j):
            yield i, j


def _marked(least: Fraction, agree: Agree):
    """(k, cell, node) of the sets that a cell has a pair for."""

    def run(batches):
        for key, cell in _cells(batches, None):
            mark = np.zeros(len(cell["n"]), bool)
            for i, j in _found(cell, key, least, agree):
                mark[i] = mark[j] = True
            if mark.any():
                n = int(mark.sum())
                yield pa.record_batch({**{c: pa.array(np.full(n, x), pa.int64()) for c, x in zip(("k", "cell"), key, strict=True)}, "node": pa.array(cell["node"][mark])})

    return run


def _linked(least: Fraction, agree: Agree):
    """Links of a cell's pairs that are similar; none between sets that its links join already."""

    def run(batches):
        for key, cell in _cells(batches, "members"):
            sets, root, links = _lists(cell["members"]), {}, []

            def find(x, root=root):
                while (y := root.get(x, x)) != x:
                    root[x] = root.get(y, y)
                    x = y
                return x

            for i, j in _found(cell, key, least, agree):
                own, mine = sets[i], int(cell["group"][i])
                j = np.array([x for x in j.tolist() if find(int(cell["group"][x])) != find(mine)], np.int64)
                if not len(j):
                    continue
                values = np.concatenate([sets[x] for x in j])
                size = np.array([len(sets[x]) for x in j])
                at = np.minimum(np.searchsorted(own, values), len(own) - 1)
                both = np.add.reduceat((own[at] == values).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
                for x in j[both * least.denominator >= (size + len(own) - both) * least.numerator].tolist():
                    if find(int(cell["group"][x])) != find(mine):
                        root[find(int(cell["group"][x]))] = find(mine)
                        links.append((int(cell["node"][i]), int(cell["node"][x])))
            if links:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])

    return run


def _neighbour_links(sets: DataFrame, members: DataFrame, proposed: DataFrame | None, sets_of, agree: Agree, least: Fraction) -> DataFrame:
    """The similar pairs (a, b) among those proposed and those that stand next to each other under a key, for each set those
    that do so most often."""
    often = members.filter("other IS NOT NULL").groupBy("node", "other").agg(F.count(F.lit(1)).alias("c"))
    tried = often.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "other")), False), 1, TRIED).alias("t")).select("node", F.explode("t.other").alias("other"))
    tried = tried if proposed is None else tried.union(proposed)
    pairs = materialise(tried.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "pairs")
    x = sets.select(F.col("node").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("n_x"))
    y = sets.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("n_y"))
    allowed = materialise(pairs.join(x, "a").join(y, "b").mapInArrow(_may_agree(agree), "a long, b long"), "allowed")
    own = materialise(sets_of(allowed.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "members")
    left, right = own.select(F.col("node").alias("a"), F.col("members").alias("x")), own.select(F.col("node").alias("b"), F.col("members").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - both
    out = materialise(allowed.join(left, "a").join(right, "b").filter(both * least.denominator >= union * least.numerator).select("a", "b"), "similar")
    release(pairs, allowed, own)
    return out


def _dealt(open_keys: DataFrame, members: DataFrame) -> DataFrame:
    """(k, cell, home, main, node): the sets of open keys by cell. Each is at home in one cell of its key; those outside the
    key's main group, the largest, visit the others too. Rows grow with the visitors, not with the square of the group."""
    own = members.join(open_keys, "k").withColumn("half", F.pmod(F.xxhash64("node"), "blocks")).withColumn("main", F.col("group") == F.col("largest"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    own = own.withColumn("cell", F.explode(F.when(F.col("main"), F.array("half")).otherwise(every)))
    return own.select("k", "cell", (F.col("cell") == F.col("half")).alias("home"), "main", "node")


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("k", "cell").sortWithinPartitions("k", "cell", "n", "node")


def _remaining_links(sets: DataFrame, members: DataFrame, joined: DataFrame, sets_of, agree: Agree, least: Fraction) -> DataFrame | None:
    """Links that join all groups of `joined` (node, component) which a similar pair under a key joins; None if no key is open."""
    named = sets.join(joined, "node", "left").select("node", "n", F.coalesce("component", "node").alias("group"), "keys", "sketch")
    named = materialise(named, "named")
    placed = materialise(members.select("k", "node").join(named.select("node", "n", "group"), "node"), "placed")
    # the groups of a key are counted before they meet, so a hot key is a row a group
    groups = placed.groupBy("k", "group").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("m"))
    sums = groups.groupBy("k").agg(F.count(F.lit(1)).alias("groups"), F.sum("c").alias("c"), F.sum("m").alias("m"), F.max_by("group", F.struct("c", "group")).alias("largest"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("m") / BLOCK_MEMBERS)).cast("long")
    open_keys = materialise(sums.filter("groups > 1").select("k", blocks.alias("blocks"), "largest"), "open-keys")
    if open_keys.isEmpty():
        release(named, placed, open_keys)
        return None
    dealt = materialise(_dealt(open_keys, placed.select("k", "node", "group")), "dealt")
    marked = materialise(_together(dealt.join(named, "node")).mapInArrow(_marked(least, agree), "k long, cell long, node long"), "marked")
    own = materialise(sets_of(marked.select("node").distinct()).select("node", F.array_sort("members").alias("members")), "members")
    kept = dealt.join(marked, ["k", "cell", "node"], "left_semi")
    out = materialise(_together(kept.join(named, "node").join(own, "node")).mapInArrow(_linked(least, agree), "a long, b long"), "links")
    release(placed)
    release(named, open_keys, dealt, marked, own)
    return out


def similar_components(sets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], agree: Agree, least: Fraction, proposed: DataFrame | None = None) -> DataFrame:
    """(node, component) of the sets that similar pairs join; sets without any have no row.

    `sets` is a materialised table (node, n, keys array<long>, sketch) of distinct sets; `sets_of` gives (node, members
    array<long>) of a table of nodes. Two sets are similar if 100 times their Jaccard similarity is 100 * `least` or more.
    Only pairs that are `proposed` (two columns of nodes) or have a common key, and whose sketches agree, are tried.
    """
    keyed = sets.select("node", "n", F.explode("keys").alias("k")).repartition("k").sortWithinPartitions("k", "n", "node")
    members = materialise(keyed.mapInArrow(_neighbours(least), "k long, node long, other long"), "shared-keys", free=True)
    first = _neighbour_links(sets, members, proposed, sets_of, agree, least)
    joined = materialise(connected_components(first), "joined")
    more = _remaining_links(sets, members, joined, sets_of, agree, least)
    release(members)
    if more is None or more.isEmpty():
        release(first, *([] if more is None else [more]))
        return joined
    # what the first turn joined needs no more than a star
    stars = joined.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    out = materialise(connected_components(stars.union(more)), "components")
    release(first, joined, more)
    return out
