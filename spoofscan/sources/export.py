"""The homoglyph data as two JSON files, for other programs."""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .ucd import runs
from .unicode import characters


def export(spark: SparkSession, directory: str) -> list[str]:
    """Write categories.json and confusables.json into a folder and return their paths; existing files are replaced.

    Both tables are bounded by the number of code points, so they are put together on the driver: each file is one object.
    """
    chars = characters(spark)
    both = chars.aliases.select("cp", F.struct("alias", "category").alias("value"))
    rows = sorted((r["first"], r["last"], r["value"]["alias"], r["value"]["category"]) for r in runs(both).collect())
    aliases, categories = sorted({r[2] for r in rows}), sorted({r[3] for r in rows})
    ranges = [[a, b, aliases.index(x), categories.index(y)] for a, b, x, y in rows]
    looks = {r["character"]: [h.asDict() for h in r["homoglyphs"]] for r in chars.homoglyphs.orderBy("character").collect()}
    out = {"categories.json": {"iso_15924_aliases": aliases, "categories": categories, "code_points_ranges": ranges}, "confusables.json": looks}
    os.makedirs(directory, exist_ok=True)
    paths = []
    for name, data in out.items():
        paths.append(os.path.join(directory, name))
        with open(paths[-1], "w", encoding="ascii") as f:
            json.dump(data, f)
    return paths


CATEGORIES = "iso_15924_aliases array<string>, categories array<string>, code_points_ranges array<array<int>>"
CONFUSABLES = "map<string, array<struct<c: string, n: string>>>"


def _one_object(spark: SparkSession, path: str, kind: str):
    """A file that is one JSON object (compressed or not), as a row."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("x"))


def read_categories(spark: SparkSession, path: str):
    """Rows (first, last, alias, category) of a categories.json."""
    whole = _one_object(spark, path, f"struct<{CATEGORIES.replace(' array', ': array')}>").select("x.*")
    rows = whole.select("iso_15924_aliases", "categories", F.explode("code_points_ranges").alias("r"))
    named = [F.get("iso_15924_aliases", F.get("r", 2)).alias("alias"), F.get("categories", F.get("r", 3)).alias("category")]
    return rows.select(F.get("r", 0).alias("first"), F.get("r", 1).alias("last"), *named)


def read_confusables(spark: SparkSession, path: str, inside: str | None = None):
    """Rows (character, homoglyphs) of a confusables.json, or of the field `inside` of a larger object."""
    kind = CONFUSABLES if inside is None else f"struct<{inside}: {CONFUSABLES}>"
    whole = _one_object(spark, path, kind).select(F.col("x") if inside is None else F.col("x")[inside].alias("x"))
    return whole.select(F.explode("x").alias("character", "homoglyphs"))
