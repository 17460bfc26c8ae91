"""Normal forms against Python's and ICU's, on any texts; long runs of marks in linear time; data that changes in a session."""

import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from spoofscan.functions.register import register
from spoofscan.functions.text import nfc, nfd, text_functions
from spoofscan.sources.unicode import characters


@pytest.fixture(scope="module")
def forms(spark):
    return characters(spark).forms


def icu(spark, text, composed):
    n = spark._jvm.com.ibm.icu.text.Normalizer
    return n.compose(text, False) if composed else n.decompose(text, False)


def alphabet(spark):
    """Letters that compose and decompose, marks of all classes, Hangul, and characters that Python doesn't know yet."""
    chars = characters(spark)
    newer = [chr(c) for a, b in chars.ranges("[[:NFD_QC=No:][^[:ccc=0:]][:NFC_QC=Maybe:]]") for c in range(a, b + 1) if unicodedata.category(chr(c)) == "Cn"]
    marks = [chr(c) for a, b in chars.ranges("[^[:ccc=0:]]") for c in range(a, b + 1)]
    return list("aeoqAE ẛṩÅ각가각কাাে") + ["̈́", "ཱི", "ཱུ", "ཱྀ", "ẛ̣"], marks, newer


def test_forms_agree_with_icu(spark, forms):
    plain, marks, newer = alphabet(spark)
    r = random.Random(7)
    assert newer
    for turn in range(1000):
        pool = [plain, marks, newer] if turn % 2 else [plain, marks]
        text = "".join(r.choice(r.choice(pool)) for _ in range(r.randrange(1, 60)))
        assert forms.nfd(text) == icu(spark, text, False), ascii(text)
        assert forms.nfc(text) == icu(spark, text, True), ascii(text)
    for _ in range(40):  # runs beyond the length from which their order is found here
        text = "é" + "".join(r.choice(marks + newer) for _ in range(200)) + "x"
        assert forms.nfd(text) == icu(spark, text, False)
        assert forms.nfc(text) == icu(spark, text, True)


def test_every_character_decomposes_as_in_icu(spark, forms):
    for a, b in characters(spark).ranges("[:NFD_QC=No:]-[:Hang:]"):
        for c in map(chr, range(a, b + 1)):
            assert forms.nfd(c) == icu(spark, c, False)
            assert forms.nfc(c) == icu(spark, c, True)


@pytest.mark.parametrize("run", ["̣́", "ཱི́", "̖̈́"])
def test_a_million_marks_take_seconds(spark, run):
    t = text_functions(spark)
    one = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(run), 1_000_000 // len(run))).alias("x"))
    one.select(nfd(F.col("x")), nfc(F.col("x"))).limit(0).collect()  # start workers
    for made in (F.length(nfd(F.col("x"))), F.length(nfc(F.col("x"))), t.is_allowed(F.col("x")), t.has_unlikely_marks(F.col("x")), t.has_repeated_mark(F.col("x"))):
        began = time.time()
        one.select(made.alias("y")).collect()
        assert time.time() - began < 6
    began = time.time()
    characters(spark).forms.nfd("a" + run * (1_000_000 // len(run)))
    assert time.time() - began < 2


def test_repeated_marks_over_long_runs(spark):
    """The bound on the distance of a repeat loses none: a run with more marks than there are has a nearer one."""
    marks = [chr(c) for a, b in characters(spark).ranges("[:Mn:]") for c in range(a, b + 1) if characters(spark).forms.nfd(chr(c)) == chr(c)]
    t = text_functions(spark)
    rows = [("a" + "".join(marks[:400]), False), ("a" + "".join(marks[:400]) + marks[0], True), ("a" + marks[3] + "b" + marks[3], False), ("a" + "".join(marks) + "b", False)]
    got = spark.createDataFrame(rows, "x string, want boolean").select(t.has_repeated_mark(F.col("x")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def folder_with(path, name, text):
    path.mkdir()
    (path / name).write_text(text)
    return str(path)


def test_a_folder_set_within_a_session_counts_at_once(spark, tmp_path):
    """A character unknown so far gets a decomposition: normal forms and skeletons follow, and go back."""
    data = folder_with(tmp_path / "ucd", "UnicodeData.txt", "378;TEST LETTER;Lo;0;L;0061 0301;;;;N;;;;;\n")
    row = spark.createDataFrame([("͸",)], "x string")
    own = spark.newSession()
    assert row.select(nfd(F.col("x"))).first()[0] == "͸"
    spark.conf.set("spark.spoofscan.unicode.dir", data)
    try:
        assert row.select(nfd(F.col("x"))).first()[0] == "á" == characters(spark).forms.nfd("͸")
    finally:
        spark.conf.unset("spark.spoofscan.unicode.dir")
    assert row.select(nfd(F.col("x"))).first()[0] == "͸"
    assert characters(own).version == characters(spark).version


def test_sql_names_of_two_versions_stand_side_by_side(spark, tmp_path):
    """What was registered under one prefix goes on answering by its own data after another folder is registered."""
    register(spark, "before_")
    data = folder_with(tmp_path / "looks", "confusables.txt", "# Version: 98.0.0\n0436 ; 0078 ; MA\n")
    spark.conf.set("spark.spoofscan.unicode.dir", data)
    try:
        register(spark, "after_")
        assert characters(spark).version == "98.0.0"
    finally:
        spark.conf.unset("spark.spoofscan.unicode.dir")
    got = spark.sql("SELECT before_skeleton('жш'), after_skeleton('жш'), before_nfd('é'), after_nfd('é')").first()
    assert got[0] == "жw" and got[1] == "xш" and got[2] == got[3] == "é"
    assert characters(spark).version.endswith("+18")
