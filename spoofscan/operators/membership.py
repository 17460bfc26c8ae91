"""Whether rows have a key of a given set, with a plan that depends on the set's measured size.

A small set goes to every task as literals of the plan or as a broadcast. For a large one, each task tests a row's keys
against bits: each key of the set sets one bit of 16 a key, and the words of bits are broadcast. Rows that no bit admits are
done; of the others (all members, and about one in sixteen of the rest) the keys alone are joined to the set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise, stored_bytes

#: Keys that are compared as literals; bytes of a set that is broadcast whole; bits that are broadcast at most (16 MB).
LITERALS, BROADCAST_BYTES, MOST_BITS = 1000, 4 << 20, 1 << 27
#: Bits of one word of bits, as Spark's bitmap functions have them.
_WORD = 32768


def _bit(key, bits: int):
    """The place of a key's bit, from 1."""
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def admitted(rows: DataFrame, keys: str, members: DataFrame, bits: int, out: str) -> DataFrame:
    """`rows` with whether a bit of the set admits any of a row's keys: never false for a member."""
    at = _bit(F.col("key"), bits)
    words = members.groupBy(F.bitmap_bucket_number(at).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("word"))
    # one row of at most bits / 8 bytes: the words by their number
    found = words.agg(F.map_from_entries(F.collect_list(F.struct("number", "word"))).alias("w"))
    whole = found.select(F.transform(F.sequence(F.lit(1).cast("long"), F.lit(-(-bits // _WORD)).cast("long")), lambda i: F.try_element_at("w", i)).alias("_words"))

    def is_set(key):
        p = _bit(key, bits)
        word = F.get("_words", (F.bitmap_bucket_number(p) - 1).cast("int"))
        place = F.bitmap_bit_position(p)
        byte = F.conv(F.hex(F.substring(word, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))

    return rows.crossJoin(F.broadcast(whole)).withColumn(out, F.exists(keys, is_set)).drop("_words")


def is_member(rows: DataFrame, keys: str, members: DataFrame, flag: str) -> DataFrame:
    """`rows` with whether one of the keys (array<string>) is in `members` (key); false for null keys.

    The set is written once, so its size is known before a plan is chosen. Rows are never shuffled whole unless they are
    admitted by the bits of a set too large to broadcast.
    """
    members = materialise(members.filter("key IS NOT NULL").distinct(), "members")
    n = members.count()
    if n <= LITERALS:
        own = F.array(*[F.lit(r.key) for r in members.collect()]).cast("array<string>")
        return rows.withColumn(flag, F.coalesce(F.arrays_overlap(keys, own), F.lit(False)))
    if stored_bytes(members) <= BROADCAST_BYTES:
        return _looked_up(rows, keys, F.broadcast(members), flag)
    bits = min(MOST_BITS, 1 << max(15, (16 * n - 1).bit_length()))
    tested = admitted(rows, keys, members, bits, "_may")
    none = tested.filter(~F.coalesce("_may", F.lit(False))).withColumn(flag, F.lit(False))
    some = tested.filter(F.col("_may"))
    return _looked_up(some, keys, members, flag).unionByName(none).drop("_may")


def _looked_up(rows: DataFrame, keys: str, members: DataFrame, flag: str) -> DataFrame:
    """Each of a row's two keys is joined in turn, so nothing is exploded or joined by OR."""
    wide = rows.withColumn("_k1", F.get(keys, 0)).withColumn("_k2", F.get(keys, 1))
    first, second = members.select(F.col("key").alias("_k1"), F.lit(True).alias("_hit1")), members.select(F.col("key").alias("_k2"), F.lit(True).alias("_hit2"))
    wide = wide.join(first, "_k1", "left").join(second, "_k2", "left")
    return wide.withColumn(flag, F.coalesce("_hit1", "_hit2", F.lit(False))).drop("_k1", "_k2", "_hit1", "_hit2")
