"""A stored index of names by skeleton, in which no two names look alike.

The index is a bucketed table in a folder: its rows are dealt to buckets by skeleton once, when they are written. A batch of
names is dealt to the same buckets and looked up there; the index itself is neither shuffled nor are its skeletons made
again. It says which Unicode version its skeletons follow, and refuses to be used with another.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop_path, materialise
from ..sources.unicode import characters
from .skeletons import Skeletons

_COLUMNS = "skeleton STRING, name STRING, at {kind}, batch STRING"


class ClaimIndex:
    """An index at `path`, made on first use with so many buckets; `kind` is the type of what orders claims."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, kind: str = "TIMESTAMP") -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.version = characters(spark).version
        told = self._read()
        if told is None:
            told = {"version": self.version, "buckets": buckets, "kind": kind, "rows": "rows-0"}
            self._write(told)
        if told["version"] != self.version:
            raise ValueError(f"the index follows Unicode {told['version']}, this session {self.version}: make it anew")
        self.told = told

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _read(self) -> dict | None:
        fs, at = self._fs(f"{self.path}/index.json")
        if not fs.exists(at):
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(at.toString()).collect()))

    def _write(self, told: dict) -> None:
        """Say what holds from now on, in one rename."""
        fs, new = self._fs(f"{self.path}/.index-{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        _, at = self._fs(f"{self.path}/index.json")
        if fs.exists(at):
            fs.delete(at, False)
        if not fs.rename(new, at):
            raise OSError(f"{at.toString()} can't be written")

    def _table(self, rows: str) -> str:
        """The bucketed table over a folder of rows, by a name of this session."""
        where = f"{self.path}/{rows}"
        name = "claims_" + uuid.uuid5(uuid.NAMESPACE_URL, where).hex
        kind, n = self.told["kind"], self.told["buckets"]
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_COLUMNS.format(kind=kind)}) USING parquet CLUSTERED BY (skeleton) SORTED BY (skeleton) INTO {n} BUCKETS LOCATION '{where}'")
        return name

    def rows(self) -> DataFrame:
        """(skeleton, name, at, batch) of all claims."""
        return self.spark.table(self._table(self.told["rows"]))

    def decided(self, batch: DataFrame, name: str, at: str, batch_id: str) -> DataFrame:
        """`batch` with accepted, claimed_by and claimed_at against the index and the batch itself; nothing is stored.

        The first by `at`, then name, claims; null names are accepted and claim nothing. What the index has from the same
        batch doesn't count, so a batch that is tried again is decided alike.
        """
        given = batch.select(*[c for c in batch.columns if c not in ("accepted", "claimed_by", "claimed_at")])
        named = given.filter(F.col(name).isNotNull()).withColumn("_key", Skeletons(self.spark).skeleton(F.col(name)))
        keyed = materialise(named.withColumn("_row", F.monotonically_increasing_id()), "batch")
        first = keyed.groupBy("_key").agg(F.min(F.struct(F.col(at).alias("at"), F.col(name).alias("by"), "_row")).alias("_first"))
        held = self.rows().filter(F.col("batch") != batch_id).select(F.col("skeleton").alias("_key"), F.struct("at", F.col("name").alias("by")).alias("_held"))
        # the batch goes to the index's buckets; the index stays where it is
        first = materialise(first.join(held.hint("merge"), "_key", "left"), "first-claims")
        out = keyed.join(first, "_key").select(
            *given.columns,
            (F.col("_held").isNull() & (F.col("_row") == F.col("_first._row"))).alias("accepted"),
            F.coalesce("_held.by", "_first.by").alias("claimed_by"),
            F.coalesce("_held.at", "_first.at").alias("claimed_at"),
        )
        nothing = F.lit(None)
        nameless = given.filter(F.col(name).isNull()).select("*", F.lit(True).alias("accepted"), nothing.cast("string").alias("claimed_by"), nothing.cast(out.schema["claimed_at"].dataType).alias("claimed_at"))
        return out.unionByName(nameless)

    def add(self, batch: DataFrame, name: str, at: str, batch_id: str | int) -> DataFrame:
        """`decided`, with the accepted names stored. A batch that was stored in part, or whole, is stored once."""
        decided = materialise(self.decided(batch, name, at, str(batch_id)), "decided")
        own = decided.filter(F.col("accepted") & F.col(name).isNotNull())
        new = own.select(Skeletons(self.spark).skeleton(F.col(name)).alias("skeleton"), F.col(name).alias("name"), F.col(at).alias("at"), F.lit(str(batch_id)).alias("batch"))
        new = new.join(self.rows().filter(F.col("batch") == str(batch_id)).select("skeleton"), "skeleton", "left_anti")
        materialise(new.repartition(self.told["buckets"], "skeleton"), "new-claims").select("skeleton", "name", "at", "batch").write.insertInto(self._table(self.told["rows"]))
        return decided

    def compact(self) -> None:
        """One sorted file a bucket in place of one a batch and bucket; readers of the old files have until the next call."""
        old, new = self.told["rows"], f"rows-{uuid.uuid4().hex}"
        self.rows().repartition(self.told["buckets"], "skeleton").write.insertInto(self._table(new))
        stale = self.told.get("stale")
        self.told = self.told | {"rows": new, "stale": old}
        self._write(self.told)
        if stale:
            drop_path(self.spark, f"{self.path}/{stale}")
