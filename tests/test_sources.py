"""Readers of Unicode's files, the export, streams, SQL names, and the queries against DuckDB."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spoofscan.__main__ import main
from spoofscan.functions.register import register
from spoofscan.functions.text import text_functions
from spoofscan.operators import skeletons
from spoofscan.sources import ucd
from spoofscan.sources.export import read_categories, read_confusables
from spoofscan.sources.folder import DIRECTORY
from spoofscan.sources.unicode import characters
from spoofscan.streaming import guard

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def write(tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    return put


def test_enumerated(spark, write):
    path = write("p.txt", "# @missing: 0000..10FFFF; Unknown\n# @missing: 0010..001F; Later\n0012..0013 ; Own # c\n0020 ; Own\n\n# note\n")
    got = {r.cp: r.value for r in ucd.enumerated(spark, path).filter("cp < 40").collect()}
    assert (got[0], got[0x10], got[0x12], got[0x14], got[0x20], got[0x21]) == ("Unknown", "Later", "Own", "Later", "Own", "Unknown")
    some = ucd.runs(ucd.enumerated(spark, path).filter("cp < 40"))
    assert sorted((r["first"], r["last"], r["value"]) for r in some.collect()) == [(0, 15, "Unknown"), (16, 17, "Later"), (18, 19, "Own"), (20, 31, "Later"), (32, 32, "Own"), (33, 39, "Unknown")]


def test_binary_and_aliases(spark, write):
    path = write("b.txt", "0041..0043 ; A\n0050 ; B # x\n")
    assert sorted(r.cp for r in ucd.binary(spark, path, "A").collect()) == [65, 66, 67]
    names = ucd.value_aliases(spark, write("v.txt", "sc ; Latn ; Latin # x\ngc ; L ; Letter\n"), "sc").collect()
    assert [(r.long, r.short) for r in names] == [("Latin", "Latn")]


def test_unicode_data(spark, write):
    path = write("u.txt", "0041;LATIN A;Lu;0;L;;;;;N;;;;;\n4E00;<CJK, First>;Lo;0;L;;;;;N;;;;;\n4E03;<CJK, Last>;Lo;0;L;;;;;N;;;;;\n0663;THREE;Nd;0;AN;;3;3;3;N;;;;;\n")
    got = {r.cp: (r.category, r.digit) for r in ucd.unicode_data(spark, path).collect()}
    assert got == {0x41: ("Lu", None), 0x663: ("Nd", 3), **{c: ("Lo", None) for c in range(0x4E00, 0x4E04)}}


def test_conformance_files(spark, write):
    path = write("f.txt", "# head\n0061\t0062 1F600\t=\n0063\t\t=\n")
    assert [tuple(r) for r in ucd.fixture(spark, path, ["a", "b", "c"]).collect()] == [("a", "b\U0001f600", "a"), ("c", "", "c")]
    r = ucd.grapheme_break_tests(spark, write("g.txt", "÷ 0061 × 0301 ÷ 0062 ÷ # x\n")).head()
    assert (r.text, r.clusters) == ("áb", ["á", "b"])
    r = ucd.bidi_character_tests(spark, write("c.txt", "#\n0061 202A;0;0;0 x;0\n")).head()
    assert (r.text, r.direction, r.level, r.levels, r.order) == ("a‪", 0, 0, [0, None], [0])
    r = ucd.normalization_tests(spark, write("n.txt", "@Part1\n00C5;00C5;0041 030A;00C5;0041 030A; # x\n")).head()
    assert tuple(r) == ("Å", "Å", "Å", "Å", "Å")
    rows = ucd.bidi_tests(spark, write("t.txt", "@Levels: x 1\n@Reorder: 1\nBN R; 3\n\n@Levels: 0\n@Reorder:\nL; 2\n")).collect()
    assert sorted(map(tuple, rows)) == [(["BN", "R"], 0, [None, 1], [1]), (["BN", "R"], 2, [None, 1], [1]), (["L"], 0, [0], [])]
    rows = ucd.property_sections(spark, write("s.txt", "## gc default=Cn\n0041..0042\tLu\n## sc default=Zzzz\n0041\tLatn\n")).collect()
    assert [tuple(r) for r in rows] == [("gc", "Cn", 65, 66, "Lu"), ("sc", "Zzzz", 65, 65, "Latn")]


def test_compare(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "w"), (4, "q")], "k int, v string")
    assert tuple(ucd.compare(a, b, "k", "v").head()) == (4, 1, 1, 1, 1, ["2", "3", "4"])


def test_export(spark, tmp_path, capsys):
    assert main(["export", str(tmp_path / "out")]) == 0
    paths = capsys.readouterr().out.split()
    categories, looks = (json.load(open(p)) for p in paths)
    first, last, alias, category = next(r for r in categories["code_points_ranges"] if r[0] <= 65 <= r[1])
    assert (categories["iso_15924_aliases"][alias], categories["categories"][category]) == ("LATIN", "L")
    assert {"c": "a", "n": "LATIN SMALL LETTER A"} in looks["а"]
    ranges = read_categories(spark, paths[0])
    assert ranges.count() == len(categories["code_points_ranges"]) and ranges.filter("first <= 65 AND last >= 65").head()[2:] == ("LATIN", "L")
    back = {r.character: [h.asDict() for h in r.homoglyphs] for r in read_confusables(spark, paths[1]).collect()}
    assert back == looks
    (tmp_path / "both.json").write_text(json.dumps({"categories": {}, "confusables": {"x": [{"c": "y", "n": "Y"}]}}))
    assert [r.character for r in read_confusables(spark, str(tmp_path / "both.json"), inside="confusables").collect()] == ["x"]
    with pytest.raises(SystemExit) as e:
        main([])
    assert e.value.code == 2


def test_sql_names(spark):
    """Each SQL function answers as its Column expression does."""
    from spoofscan.functions import register as module

    made = register(spark)
    assert len(made) > 30 and spark.sql("SELECT spoof_skeleton('p\u0430ypa1'), spoof_skeleton(NULL)").head()[:] == ("paypal", None)
    texts = ["", "abc", "p\u0430y pal", "7\u0661", "e\u0301\u0301x", "i\u0307", "a\u200bb\n", "\u0628\u200c\u062d", "\u05d0(\u05d1", "\u4e00\u30a2", "\U0001f468\u200d\U0001f469", None]
    df = spark.createDataFrame([(x,) for x in texts], "s string").withColumn("a", F.col("s")).withColumn("b", F.concat("s", F.lit("\u200b")))
    df.createOrReplaceTempView("texts")
    # functions of other values have tests of their own
    asked = [(name, "a, b" if "a STRING" in p else "s", column) for name, (p, _, column) in module._checks(spark).items() if p in ("s STRING", "a STRING, b STRING")]
    assert len(asked) > 40
    for i in range(0, len(asked), 8):
        some = asked[i : i + 8]
        sql = spark.sql(f"SELECT s, {', '.join(f'spoof_{name}({given}) AS {name}' for name, given, _ in some)} FROM texts").collect()
        want = df.select("s", *[column.alias(name) for name, _, column in some]).collect()
        for name, _, _ in some:
            assert sorted(str((r.s, r[name])) for r in sql) == sorted(str((r.s, r[name])) for r in want), name
    assert spark.sql("SELECT c.* FROM VALUES ('ab') t(x), LATERAL spoof_characters_of(t.x) c").count() == 2
    rows = spark.sql("SELECT c.* FROM VALUES ('a\u200bb\u0301') t(x), LATERAL spoof_invisible_rows(t.x) c").collect()
    assert [tuple(r) for r in rows] == [(1, "default-ignorable")]
    assert [r.cluster for r in spark.sql("SELECT c.* FROM VALUES ('ab\u0301') t(x), LATERAL spoof_grapheme_rows(t.x) c").collect()] == ["a", "b\u0301"]
    assert spark.sql("SELECT spoof_truncate_graphemes('e\u0301xyz', 2)").head()[0] == "e\u0301x"
    got = skeletons.shared_scripts(spark.createDataFrame([(1, "ab"), (1, "\u0430"), (2, "\u30a2"), (2, "\u4e00")], "k int, s string"), ["k"], "s")
    assert {r.k: r.shared_scripts for r in got.collect()} == {1: [], 2: ["Jpan"]}


#: A folder in the forms of Unicode's own files: a few lines that no library has.
FOLDER = {
    "confusables.txt": "# Version: 99.0.0\n0061 ;\t0062 ;\tMA\t# a -> b\n0071 ; 006F 0327 ; MA\n",
    "IdentifierStatus.txt": "0061..0071 ; Allowed # x\n",
    "IdentifierType.txt": "0061..0070 ; Recommended\n0071 ; Obsolete Technical\n",
    "Scripts.txt": "# Scripts-99.0.0.txt\n0061..0070 ; Latin\n0071 ; Newish\n0430 ; Cyrillic\n",
    "ScriptExtensions.txt": "0062 ; Latn Grek\n",
    "PropertyValueAliases.txt": "sc ; Latn ; Latin\nsc ; Newi ; Newish\nsc ; Cyrl ; Cyrillic\n",
    "StandardizedVariants.txt": "0061 FE00; a kind; # x\n",
    "UnicodeData.txt": "0061;A;Ll;0;L;;;;;N;;;;;\n378;NEW;Ll;0;L;0061 0301;;;;N;;;;;\n",
    "BidiMirroring.txt": "0062; 0063 # x\n",
    "BidiBrackets.txt": "0064; 0065; o # x\n0065; 0064; c # x\n",
    "DerivedBidiClass.txt": "# @missing: 0000..10FFFF; Left_To_Right\n0061 ; R\n",
}


def test_a_folder_of_unicode_s_files(spark, tmp_path):
    """A session that names a folder follows it, file by file; others are as before."""
    for name, text in FOLDER.items():
        (tmp_path / name).write_text(text)
    before = spark.range(1).select(skeletons.Skeletons(spark).skeleton(F.lit("aq\u0430"))).head()[0]
    spark.conf.set(DIRECTORY, str(tmp_path))
    try:
        chars, t, s = characters(spark), text_functions(spark), skeletons.Skeletons(spark)
        assert chars.version == "99.0.0" and chars.prototypes["a"] == "b" and "1" not in chars.prototypes
        one = spark.createDataFrame([("aq",), ("z",), ("a\ufe00",), ("b\ufe00",), ("\u0378",)], "s string")
        rows = {r.s: r for r in one.select("s", s.internal(F.col("s")).alias("k"), t.is_allowed(F.col("s")).alias("ok"), t.has_invisible(F.col("s")).alias("hidden"), skeletons.script_sets(spark, F.col("s")).alias("sets")).collect()}
        assert rows["aq"].k == "bo\u0327" and rows["aq"].ok and not rows["z"].ok
        assert not rows["a\ufe00"].hidden and rows["b\ufe00"].hidden
        assert rows["\u0378"].k == "b\u0301"
        assert spark.range(1).select(t.identifier_types(F.lit("q"))).head()[0] == ["Obsolete", "Technical"]
        assert chars.ranges("[:sc=Newi:]") == ((0x71, 0x71),) and chars.ranges("[:scx=Grek:]") == ((0x62, 0x62),)
        assert spark.range(1).select(t.bidi_class(F.lit("a"))).head()[0] == "R"
        assert chars.bidi.mirrors == {"b": "c"} and chars.bidi.brackets == {"d": ("e", True), "e": ("e", False)}
    finally:
        spark.conf.unset(DIRECTORY)
    assert spark.range(1).select(skeletons.Skeletons(spark).skeleton(F.lit("aq\u0430"))).head()[0] == before


def test_files_are_written_and_read_back(spark, tmp_path):
    values = spark.createDataFrame([(0x41, "A"), (0x42, "A"), (0x44, "B"), (0x1F600, "A")], "cp int, value string")
    ucd.write_runs(values, str(tmp_path / "runs"))
    assert sorted(map(tuple, ucd.enumerated(spark, str(tmp_path / "runs")).collect())) == sorted(map(tuple, values.collect()))
    rows = spark.createDataFrame([("a\U0001f600", "a\U0001f600", ""), ("b", "c", "b")], "t string, x string, y string")
    for name, how in (("plain", "none"), ("packed", "gzip")):
        ucd.write_fixture(rows, str(tmp_path / name), ["t", "x", "y"], head="made for a test", compression=how)
        assert sorted(map(tuple, ucd.fixture(spark, str(tmp_path / name), ["t", "x", "y"]).collect())) == sorted(map(tuple, rows.collect()))


def test_agreement_by_rules(spark):
    a = spark.createDataFrame([(i, "x") for i in range(8)], "k int, v string")
    b = spark.createDataFrame([(i, "x" if i < 3 else "y" if i < 6 else "z") for i in range(7)], "k int, v string")
    got = {r.rule: (r.n, r.examples) for r in ucd.agreement(a, b, "k", "v", {"known": F.col("b") == "y", "late": F.col("key") > 6}).collect()}
    assert got == {"identical": (3, []), "known": (3, [3, 4, 5]), "unexplained": (1, [6]), "late": (1, [7])}
    n, first = ucd.mismatches(a, b, "k", "v", most=2)
    assert n == 5 and [r.key for r in first.collect()] == [3, 4]
    letters = ucd.letters_by_script(spark.createDataFrame([(65, "Latn"), (66, "Latn"), (49, "Zyyy")], "cp int, script string"), spark.createDataFrame([(65, "Lu"), (66, "Lu"), (49, "Nd")], "cp int, category string"))
    assert [tuple(r) for r in letters.collect()] == [("Latn", 2, [65, 66])]
    alike = ucd.look_alikes_of(spark.createDataFrame([("1", "l"), ("I", "l"), ("m", "rn")], "source string, prototype string"))
    assert {r.prototype: r.sources for r in alike.collect()} == {"l": ["1", "I"], "rn": ["m"]}
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert sorted(map(tuple, ucd.stale_files(names("a", "b"), names("b", "c")).collect())) == [("a", "missing"), ("c", "unexpected")]


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(once=True).start()
    try:
        q.awaitTermination(60)
        return stream.sparkSession.table(name).collect()
    finally:
        q.stop()


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "paypal"), ("2024-01-01 00:01:00", "pаypal"), ("2024-01-01 00:02:00", "other"), ("2024-01-01 02:00:00", None)]
    spark.createDataFrame(rows, "ts string, name string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, name string").parquet(str(tmp_path / "in"))
    guarded = spark.createDataFrame([("PAYPAL",), ("paypa1",)], "n string")
    assert sorted(str(r.name) for r in drain(guard.protected_gate(stream, guarded, "name", "n"), "gate")) == ["None", "other"]
    names = [r.name for r in drain(guard.first_claims(stream, "name", "ts"), "claims")]
    assert len(names) == 3 and "other" in names
    rates = drain(guard.attempt_rates(stream, F.col("name") != "other", "ts", "1 hour"), "rates", "complete")
    assert sorted((r.n, r.n_suspicious) for r in rates) == [(1, 0), (3, 2)]
    sessions = drain(guard.attempt_sessions(stream.withColumn("who", F.lit("x")), F.col("name") != "other", "who", "ts"), "sessions", "complete")
    assert sorted((r.who, r.n, r.n_suspicious) for r in sessions) == [("x", 1, 0), ("x", 3, 2)]


SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith("op")}


@pytest.mark.parametrize("name", SQL)
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "part", "documents", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(SQL[name])
    columns = [x[0] for x in want.description]
    got = __spark_entry__.queries()[name](spark, DATA).select(*columns).collect()
    key = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    assert key(got) == key(want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
