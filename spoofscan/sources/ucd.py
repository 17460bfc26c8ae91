"""Files of the Unicode Character Database and conformance files as DataFrames.

Nothing here is tied to a version: point the readers at a folder of the version wanted. Lines are read by Spark, so
compressed files and any file system that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\r"))


def _hex(c: Column) -> Column:
    return F.conv(_trim(c), 16, 10).cast("int")


def text_of(hex_points: Column) -> Column:
    """The text that space-separated hexadecimal code points spell; '' for none."""
    points = F.filter(F.split(_trim(hex_points), " +"), lambda x: x != "")
    return F.array_join(F.transform(points, lambda x: F.decode(F.unhex(F.lpad(x, 8, "0")), "UTF-32")), "")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (first, last, fields) of the data lines: comments go, fields are split at semicolons and trimmed."""
    rows = spark.read.text(path).select(_trim(F.split("value", "#")[0]).alias("line")).filter("line <> ''")
    parts = F.transform(F.split("line", ";"), _trim)
    span = F.split(parts[0], r"\.\.")
    return rows.select(_hex(span[0]).alias("first"), _hex(F.coalesce(F.get(span, 1), span[0])).alias("last"), F.slice(parts, 2, 99).alias("fields"))


def missing(spark: SparkSession, path: str) -> DataFrame:
    """Rows (first, last, fields, place) of the '# @missing' lines, in file order."""
    rows = spark.read.text(path).filter(F.col("value").startswith("# @missing:")).withColumn("place", F.monotonically_increasing_id())
    parts = F.transform(F.split(F.substring("value", 12, 9999), ";"), _trim)
    span = F.split(parts[0], r"\.\.")
    return rows.select(_hex(span[0]).alias("first"), _hex(span[1]).alias("last"), F.slice(parts, 2, 99).alias("fields"), "place")


def points(ranges: DataFrame) -> DataFrame:
    """One row per code point of (first, last, ...)."""
    return ranges.select(F.explode(F.sequence("first", "last")).alias("cp"), *[c for c in ranges.columns if c not in ("first", "last")])


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """Rows (text, kind) of a file whose lines begin with a sequence of code points."""
    rows = spark.read.text(path).select(_trim(F.split("value", "#")[0]).alias("line")).filter("line <> ''")
    parts = F.transform(F.split("line", ";"), _trim)
    return rows.select(text_of(parts[0]).alias("text"), F.get(parts, 1).alias("kind"))


def enumerated(spark: SparkSession, path: str, prop: str | None = None, default: str | None = None) -> DataFrame:
    """Rows (cp, value) of an enumerated property: data lines count before @missing lines, later ones of those before
    earlier ones, and `default`, if given, for the rest.

    In files with several properties, `prop` names the one.
    """
    own = lines(spark, path)
    own = own.filter(own["fields"][0] == prop).withColumn("value", F.get("fields", 1)) if prop else own.withColumn("value", F.get("fields", 0))
    data = own.select("first", "last", "value", F.lit(1 << 62).alias("place"))
    gaps = missing(spark, path).select("first", "last", F.element_at("fields", -1).alias("value"), "place")
    every = data.union(gaps)
    if default is not None:
        every = every.union(spark.range(1).select(F.lit(0), F.lit(0x10FFFF), F.lit(default), F.lit(-1)))
    return points(every).groupBy("cp").agg(F.max_by("value", "place").alias("value"))


def binary(spark: SparkSession, path: str, prop: str) -> DataFrame:
    """Rows (cp) of the code points that have a binary property."""
    own = lines(spark, path)
    return points(own.filter(own["fields"][0] == prop).select("first", "last"))


def unicode_data(spark: SparkSession, path: str) -> DataFrame:
    """Rows (cp, name, category, combining, decomposition, digit), First and Last lines spread over what they span."""
    parts = F.split("value", ";")
    rows = spark.read.text(path).filter("value <> ''").select(_hex(parts[0]).alias("cp"), parts[1].alias("name"), parts[2].alias("category"), parts[3].cast("int").alias("combining"), parts[5].alias("decomposition"), F.nullif(parts[6], F.lit("")).cast("int").alias("digit"))
    # a range's two lines follow each other; pairing them needs their order alone, over a table of bounded size
    after = Window.orderBy("cp")
    spans = rows.withColumn("next", F.lead("cp").over(after)).filter(~F.col("name").endswith("Last>"))
    last = F.when(F.col("name").endswith("First>"), F.col("next")).otherwise(F.col("cp"))
    return spans.select(F.explode(F.sequence("cp", last)).alias("cp"), F.regexp_replace("name", ", First>$", ">").alias("name"), "category", "combining", "decomposition", "digit")


def value_aliases(spark: SparkSession, path: str, prop: str) -> DataFrame:
    """Rows (long, short) of a property's value names."""
    parts = F.transform(F.split(F.split("value", "#")[0], ";"), _trim)
    return spark.read.text(path).filter(parts[0] == prop).select(parts[2].alias("long"), parts[1].alias("short"))


def runs(values: DataFrame) -> DataFrame:
    """(first, last, value) stretches of equal values of (cp, value): the inverse of points()."""
    order = Window.partitionBy("value").orderBy("cp")
    marked = values.withColumn("stretch", F.col("cp") - F.row_number().over(order))
    return marked.groupBy("value", "stretch").agg(F.min("cp").alias("first"), F.max("cp").alias("last")).select("first", "last", "value")


def fixture(spark: SparkSession, path: str, columns: list[str], same: str = "=") -> DataFrame:
    """A conformance table: '#' lines go, fields are tabs apart and hold hexadecimal text; `same` repeats the first."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    read = [F.when(F.get(parts, i) == same, text_of(parts[0])).otherwise(text_of(F.coalesce(F.get(parts, i), F.lit("")))).alias(c) for i, c in enumerate(columns)]
    return rows.select(*read)


def grapheme_break_tests(spark: SparkSession, path: str) -> DataFrame:
    """Rows (text, clusters) of GraphemeBreakTest.txt, where a division sign parts clusters."""
    line = _trim(F.split("value", "#")[0])
    rows = spark.read.text(path).select(line.alias("line")).filter("line <> ''")
    clusters = F.filter(F.split("line", "÷"), lambda x: _trim(x) != "")
    clusters = F.transform(clusters, lambda x: F.array_join(F.transform(F.filter(F.split(F.regexp_replace(x, "×", " "), r"\s+"), lambda p: p != ""), lambda p: F.decode(F.unhex(F.lpad(p, 8, "0")), "UTF-32")), ""))
    return rows.select(F.array_join(clusters, "").alias("text"), clusters.alias("clusters"))


def bidi_character_tests(spark: SparkSession, path: str) -> DataFrame:
    """Rows (text, direction 0/1/2, level, levels, visual order) of BidiCharacterTest.txt; a removed character's level is null."""
    parts = F.split("value", ";")
    rows = spark.read.text(path).filter(F.col("value").rlike("^[0-9A-F]"))
    numbers = lambda c: F.transform(F.filter(F.split(c, " "), lambda x: x != ""), lambda x: F.nullif(x, F.lit("x")).cast("int"))
    return rows.select(text_of(parts[0]).alias("text"), parts[1].cast("int").alias("direction"), parts[2].cast("int").alias("level"), numbers(parts[3]).alias("levels"), numbers(parts[4]).alias("order"))


def bidi_tests(spark: SparkSession, path: str) -> DataFrame:
    """Rows (classes, direction 0/1/2, levels, visual order) of BidiTest.txt, one for each direction that a line names.

    '@Levels' and '@Reorder' hold for the lines that follow, in file order, over a file of bounded size.
    """
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    numbers = lambda c: F.transform(F.filter(F.split(c, " "), lambda x: x != ""), lambda x: F.nullif(x, F.lit("x")).cast("int"))
    held = lambda head: F.last(F.when(F.col("value").startswith(head), F.substr("value", F.lit(len(head) + 1))), True).over(upto)
    rows = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    rows = rows.withColumn("levels", held("@Levels:")).withColumn("order", held("@Reorder:")).filter(F.col("value").rlike("^[A-Z]"))
    parts = F.split("value", ";")
    bits = _trim(parts[1]).cast("int")
    # the bits say: 1 by the text, 2 left to right, 4 right to left
    named = F.array(*[F.when(bits.bitwiseAND(bit) > 0, F.lit(direction)) for bit, direction in ((2, 0), (4, 1), (1, 2))])
    return rows.select(F.split(_trim(parts[0]), " +").alias("classes"), F.explode(F.array_compact(named)).alias("direction"), numbers(F.col("levels")).alias("levels"), numbers(F.col("order")).alias("order"))


def normalization_tests(spark: SparkSession, path: str) -> DataFrame:
    """Rows (c1, c2, c3, c4, c5) of NormalizationTest.txt."""
    parts = F.split("value", ";")
    rows = spark.read.text(path).filter(F.col("value").rlike("^[0-9A-F]"))
    return rows.select(*[text_of(parts[i]).alias(f"c{i + 1}") for i in range(5)])


def property_sections(spark: SparkSession, path: str) -> DataFrame:
    """Rows (property, default, first, last, value) of a file whose sections begin '## Name default=value'.

    A section's lines follow its head: the head is carried forward in file order, over a file of bounded size.
    """
    rows = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    head = F.regexp_extract("value", r"^## (\S+) default=(\S*)", 1), F.regexp_extract("value", r"^## (\S+) default=(\S*)", 2)
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("value").startswith("## ")
    own = rows.withColumn("property", F.last(F.when(is_head, head[0]), True).over(upto)).withColumn("default", F.last(F.when(is_head, head[1]), True).over(upto))
    parts = F.split("value", "\t")
    span = F.split(parts[0], r"\.\.")
    return own.filter(F.col("value").rlike("^[0-9A-F]")).select("property", "default", _hex(span[0]).alias("first"), _hex(F.coalesce(F.get(span, 1), span[0])).alias("last"), F.get(parts, 1).alias("value"))


def write_runs(values: DataFrame, path: str) -> None:
    """Write (cp, value) as 'first..last ; value' lines in code point order; `enumerated` and `lines` read them back."""
    hexed = lambda c: F.lpad(F.hex(c), F.greatest(F.length(F.hex(c)), F.lit(4)), "0")
    span = F.when(F.col("first") == F.col("last"), hexed("first")).otherwise(F.concat(hexed("first"), F.lit(".."), hexed("last")))
    # at most one line a code point, so one sorted partition is bounded
    runs(values).repartition(1).sortWithinPartitions("first").select(F.concat(span, F.lit(" ; "), F.col("value")).alias("value")).write.text(path)


def _points(text: Column) -> Column:
    """Space-separated hexadecimal code points of a text."""
    each = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(each, lambda c: F.lpad(F.hex(F.ascii(c)), F.greatest(F.length(F.hex(F.ascii(c))), F.lit(4)), "0")), " ")


def write_fixture(rows: DataFrame, path: str, columns: list[str], head: str = "", same: str = "=", compression: str = "none") -> None:
    """Write a conformance table that `fixture` reads: hexadecimal texts, tabs, `same` where a column repeats the first."""
    first = F.col(columns[0])
    cells = [_points(first), *[F.when(F.col(c) == first, same).otherwise(_points(F.col(c))) for c in columns[1:]]]
    body = rows.repartition(1).sortWithinPartitions(columns[0]).select(F.concat_ws("\t", *cells).alias("value"))
    lines = [(f"# {x}",) for x in head.splitlines()]
    body = rows.sparkSession.createDataFrame(lines, "value string").coalesce(1).union(body).coalesce(1) if lines else body
    body.write.option("compression", compression).text(path)


def letters_by_script(scripts: DataFrame, categories: DataFrame) -> DataFrame:
    """(script, n, letters): of (cp, script) and (cp, category), each script's letters in order."""
    letters = categories.filter(F.col("category").startswith("L")).select("cp").join(scripts, "cp")
    return letters.groupBy("script").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.col("cp"))).alias("letters"))


def look_alikes_of(prototypes: DataFrame) -> DataFrame:
    """(prototype, sources): of (source, prototype), what looks like each prototype."""
    return prototypes.groupBy("prototype").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def stale_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(name, state) of file names that are missing or not expected."""
    return expected.select("name").exceptAll(present.select("name")).withColumn("state", F.lit("missing")).union(
        present.select("name").exceptAll(expected.select("name")).withColumn("state", F.lit("unexpected"))
    )


def explained(a: DataFrame, b: DataFrame, key: str, value: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """Rows (key, a, b, rule) where two tables of one value per key differ.

    `rules` are named conditions over columns key, a and b; a difference is explained by the first that holds, and is
    'unexplained' if none does.
    """
    x, y = a.select(F.col(key).alias("key"), F.col(value).alias("a")), b.select(F.col(key).alias("key"), F.col(value).alias("b"))
    differing = x.join(y, "key", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    rule = F.coalesce(*[F.when(c, F.lit(name)) for name, c in (rules or {}).items()], F.lit("unexplained"))
    return differing.withColumn("rule", rule)


def agreement(a: DataFrame, b: DataFrame, key: str, value: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """(rule, n, examples) of the differences under each rule, and a row 'identical'; three examples at most."""
    out = explained(a, b, key, value, rules)
    place = F.row_number().over(Window.partitionBy("rule").orderBy("key"))
    few = out.withColumn("place", place).filter("place <= 3").groupBy("rule").agg(F.sort_array(F.collect_list("key")).alias("examples"))
    same = a.select(key, value).join(b.select(key, F.col(value).alias("other")), key).filter(F.col(value).eqNullSafe(F.col("other")))
    counts = out.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).join(few, "rule")
    none = F.array().cast(counts.schema["examples"].dataType)
    return counts.select("rule", "n", "examples").union(same.agg(F.lit("identical").alias("rule"), F.count(F.lit(1)).alias("n")).select("rule", "n", none))


def mismatches(a: DataFrame, b: DataFrame, key: str, value: str, most: int = 25) -> tuple[int, DataFrame]:
    """(number of differences, the first `most` by key): a report for readers."""
    out = explained(a, b, key, value).drop("rule")
    return out.count(), out.orderBy("key").limit(most)


def compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(compared, identical, only_a, only_b, differing, examples) of two tables of one value per key, outer-joined."""
    x, y = a.select(key, F.col(value).alias("_a")), b.select(key, F.col(value).alias("_b"))
    both = x.join(y, key, "full_outer")
    same = F.col("_a").eqNullSafe(F.col("_b"))
    # three examples, by a top-k that keeps three rows a partition
    few = both.filter(~same).orderBy(key).limit(3).agg(F.sort_array(F.collect_list(F.col(key).cast("string"))).alias("examples"))
    counts = both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(same).alias("identical"), F.count_if(F.col("_b").isNull() & F.col("_a").isNotNull()).alias("only_a"), F.count_if(F.col("_a").isNull() & F.col("_b").isNotNull()).alias("only_b"), F.count_if(F.col("_a") != F.col("_b")).alias("differing"))
    return counts.crossJoin(few)
