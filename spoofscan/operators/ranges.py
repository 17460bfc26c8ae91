"""Range joins and as-of lookups as equi-joins on blocks.

Ranges are cut at multiples of a width, and points look only at the parts in their own block, so Spark plans an equi-join
with a comparison and never compares every point with every range. Code points are looked up in blocks of 256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The width of a block of code points.
BLOCK = 256


def range_join(points: DataFrame, ranges: DataFrame, point: str, first: str = "first", last: str = "last", width: int = BLOCK, how: str = "inner") -> DataFrame:
    """Rows of `points` with those of `ranges` whose [first, last] holds the point; with `how` 'left', points without any stay.

    Nulls match nothing. A range costs one row for each block that it reaches into, so `width` should be near the usual
    length of a range. Columns of the two tables must differ in name.
    """
    block = lambda c: F.floor(F.col(c) / width).cast("long")
    parts = ranges.filter(F.col(first).isNotNull() & F.col(last).isNotNull() & (F.col(first) <= F.col(last)))
    parts = parts.withColumn("_block_of_range", F.explode(F.sequence(block(first), block(last))))
    own = points.withColumn("_block_of_point", block(point))
    held = (F.col("_block_of_point") == F.col("_block_of_range")) & F.col(point).between(F.col(first), F.col(last))
    return own.join(parts, held, how).drop("_block_of_point", "_block_of_range")


def as_of(starts: DataFrame, start: str, end: int) -> DataFrame:
    """Rows of a table of starts as ranges (first, last, ...): each reaches to the next start, the last one to `end`.

    The rows of a sorted run of starts find their next one by a window over blocks' order, in one task: this is for tables
    of bounded size, as those of Unicode's runs are.
    """
    following = F.lead(start).over(Window.orderBy(start))
    return starts.select(F.col(start).alias("first"), (F.coalesce(following, F.lit(end + 1)) - 1).alias("last"), *[c for c in starts.columns if c != start])
