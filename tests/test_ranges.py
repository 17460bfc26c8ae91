"""Range joins on blocks against plain comparison; prototypes that follow from roots and rules."""

import random

from pyspark.sql import functions as F

from spoofscan.operators.ranges import as_of, range_join
from spoofscan.sources.unicode import characters


def test_range_join_against_plain_comparison(spark):
    r = random.Random(2)
    spans = [(a, a + r.randrange(0, 900), f"r{i}") for i, a in enumerate(r.randrange(0, 5000) for _ in range(80))]
    spans += [(None, 5, "no start"), (7, None, "no end"), (9, 3, "empty"), (-300, -1, "below")]
    points = [(i, r.randrange(-100, 6000)) for i in range(400)] + [(900, None), (901, 256), (902, 255)]
    p, s = spark.createDataFrame(points, "id int, cp int"), spark.createDataFrame(spans, "first int, last int, value string")
    want = sorted((i, v) for i, c in points for a, b, v in spans if None not in (a, b, c) and a <= c <= b)
    for width in (7, 256, 10_000):
        assert sorted((x.id, x.value) for x in range_join(p, s, "cp", width=width).collect()) == want
    left = range_join(p, s, "cp", how="left")
    assert left.filter("value IS NULL").count() == len(points) - len({i for i, _ in want})
    plan = range_join(p, s, "cp")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_as_of_runs(spark):
    runs = spark.createDataFrame([(0, "a"), (10, "b"), (11, "c")], "start int, value string")
    assert sorted(map(tuple, as_of(runs, "start", 99).collect())) == [(0, 9, "a"), (10, 10, "b"), (11, 99, "c")]
    found = range_join(spark.createDataFrame([(9,), (10,), (50,)], "cp int"), as_of(runs, "start", 99), "cp")
    assert sorted((x.cp, x.value) for x in found.select("cp", F.col("value")).collect()) == [(9, "a"), (10, "b"), (50, "c")]


def test_prototypes_by_roots_and_rules(spark):
    """What looks like a character with a newer prototype follows it; squared letters are what they show on one line."""
    looks = characters(spark).prototypes
    assert looks["ᄋ"] == "o" and looks["ᆼ"] == "o" and looks["ᅇ"] == "oo" and looks["ꥷ"] == "oᄒ"
    assert looks["ة"] == looks["ۃ"] == "ö" and looks["॥"] == "ll" and looks["ओ"] == "अ\U000119d1\U00011b64"
    assert looks["㎏"] == "kg" and looks["㎧"] == "rn/s" and looks["㏂"] == "a.rn." and looks["㍻"] == "平成"
    assert not {"㎡", "㍿", "㌀"} & set(looks)
