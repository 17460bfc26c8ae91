"""Structured Streaming on top of the text checks: gates, first claims, rates of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StringType, StructType

from ..operators.membership import is_member
from ..operators.skeletons import Skeletons


def protected_gate(stream: DataFrame, protected_names: DataFrame, name: str, protected_name: str) -> DataFrame:
    """A stream's rows whose names look like none of a static table's; rows with null names pass.

    The table's keys are written once and looked up by their measured size, see `membership`.
    """
    s = Skeletons(stream.sparkSession)
    keys = protected_names.select(s.skeleton(F.col(protected_name)).alias("key"))
    wide = stream.select(F.struct(*stream.columns).alias("row"), F.array(s.skeleton(F.col(name))).alias("keys"))
    return is_member(wide, "keys", keys, "hit").filter(~F.col("hit")).select("row.*")


def _milliseconds(duration: str) -> int:
    number, unit = duration.split()
    return int(float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit.rstrip("s")] * 1000)


def _claiming(name: str, time: str, columns: list[str], keep: int):
    """Of a skeleton's rows of one micro-batch: who holds the claim, kept as state until it has lived for `keep`."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = pd.concat(list(frames), ignore_index=True).sort_values([time, name], kind="stable")[columns]
        if state.exists:
            by, at = state.get
            own["accepted"] = False
        else:
            by, at = own[name].iloc[0], own[time].iloc[0]
            state.update((by, None if pd.isna(at) else at.to_pydatetime() if isinstance(at, pd.Timestamp) else at.item()))
            state.setTimeoutDuration(keep)
            own["accepted"] = [True] + [False] * (len(own) - 1)
        own["claimed_by"] = by
        own["claimed_at"] = pd.Series([at] * len(own), dtype=own[time].dtype)
        yield own

    return step


def claims(rows: DataFrame, name: str, time: str, keep: str = "1 day") -> DataFrame:
    """`rows` with accepted, claimed_by and claimed_at: of the names that look alike the first is accepted, later ones are
    refused, and each says who holds the claim.

    A name that is null claims nothing: its row is accepted, by nobody. In a batch, the first by time, then name, holds a
    claim, over all rows (of rows that agree in both, any). In a stream it is the first by arrival, within a micro-batch by
    time, then name; claims live for `keep` (of
    processing time) as state by skeleton, and survive a restart from the checkpoint. Since
    claims expire by the clock, Spark goes on asking for them: to stop such a stream when its input is read, trigger it once. Columns
    of these three names are replaced.
    """
    spark, told = rows.sparkSession, ("accepted", "claimed_by", "claimed_at")
    given = rows.select(*[c for c in rows.columns if c not in told])
    kind = given.schema[time].dataType
    named = given.filter(F.col(name).isNotNull()).withColumn("_key", Skeletons(spark).skeleton(F.col(name)))
    nameless = given.filter(F.col(name).isNull()).select("*", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("claimed_by"), F.lit(None).cast(kind).alias("claimed_at"))
    if rows.isStreaming:
        schema = StructType(list(given.schema.fields)).add("accepted", BooleanType()).add("claimed_by", StringType()).add("claimed_at", kind)
        held = StructType().add("by", StringType()).add("at", kind)
        step = _claiming(name, time, list(given.columns), _milliseconds(keep))
        out = named.groupBy("_key").applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.ProcessingTimeTimeout)
        return out.union(nameless)
    from ..sources.shared import materialise

    keyed = materialise(named.withColumn("_row", F.monotonically_increasing_id()), "claims")
    # a minimum combines before the shuffle, so a name that many claim isn't gathered
    first = keyed.groupBy("_key").agg(F.min(F.struct(F.col(time).alias("at"), F.col(name).alias("by"), "_row")).alias("_first"))
    out = keyed.join(materialise(first, "first-claims"), "_key").select(*given.columns, (F.col("_row") == F.col("_first._row")).alias("accepted"), F.col("_first.by").alias("claimed_by"), F.col("_first.at").alias("claimed_at"))
    return out.unionByName(nameless)


def first_claims(rows: DataFrame, name: str, time: str, keep: str = "1 day") -> DataFrame:
    """The accepted rows of `claims`: the first of the names that look alike, and all rows without a name."""
    return claims(rows, name, time, keep).filter("accepted").select(*rows.columns)


def refusals(rows: DataFrame, name: str, time: str, keep: str = "1 day") -> DataFrame:
    """The refused rows of `claims`, with claimed_by and claimed_at."""
    return claims(rows, name, time, keep).filter("NOT accepted").drop("accepted")


def attempt_rates(rows: DataFrame, suspicious: Column, time: str, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows and suspicious rows per tumbling or sliding window of event time, and per value of the columns in `by`."""
    own = rows.withWatermark(time, late).groupBy(F.window(time, window, slide) if slide else F.window(time, window), *by)
    return own.agg(F.count(F.lit(1)).alias("n"), F.count_if(suspicious).alias("n_suspicious"))


def attempt_sessions(stream: DataFrame, suspicious: Column, key: str, time: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and suspicious rows per session of a key: rows that follow each other by less than `gap`."""
    own = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key)
    return own.agg(F.count(F.lit(1)).alias("n"), F.count_if(suspicious).alias("n_suspicious"))
