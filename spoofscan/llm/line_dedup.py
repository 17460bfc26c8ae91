"""Line dedup by prefix doubling over line-ID sequences. Native: DataFrame functions only.

A text is a sequence of line IDs. What is looked for are maximal runs of lines, of `min_words` words or more together,
that stand earlier too; their later copies are deleted. Every such run is the union of its least windows: those that
begin at a line and end where they first hold `min_words` words, and those that end at a line and begin as late as they
can. A window's length follows from its lines alone, so two equal windows have equal names.

Names come by prefix doubling: runs of 1, 2, 4, ... lines are named by pairs of names of half their length; at each
length only positions whose name occurs again go on, and lengths past the longest window aren't named. A window of any
length is the pair of names of the power of two below it, at its begin and at its end. Positions of one name are those
that would stand together in a suffix array, with a common prefix that holds the window. Only which positions stand
together matters here, not the order of the groups: names are 128-bit hashes and not ranks, and groups come by hashing
and not by a global sort at each length. The least position of a group is the copy that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_join, materialise, release, word_count

MIN_WORDS = 20
_SALT = 0x5EED


def _name(*parts: Column | str) -> list[Column]:
    """128 bits as two longs."""
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(_SALT), *parts).alias("h2")]


def _again(rows: DataFrame) -> DataFrame:
    """The rows whose name (h1, h2) occurs more than once.

    Those names are written first: Spark can split a skewed join only between plain exchanges.
    """
    many = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    many = materialise(many, "names-again")
    return rows.join(many, ["h1", "h2"], "left_semi")


def _least_windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(uid, s, e) of the least windows in stretches of lines that all occur again: (uid, part, ln, words).

    The first sum of words from a line's begin that reaches `min_words` is found by merging the sums at the lines' ends,
    in falling order, with the sums wanted; likewise, in rising order, for windows that end at a line.
    """
    order = Window.partitionBy("uid", "part").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    sums = lines.withColumn("upto", F.sum("words").over(order))
    total = F.max("upto").over(Window.partitionBy("uid", "part"))
    sums = sums.withColumn("total", total).filter(F.col("total") >= min_words)
    ends = F.struct(F.col("upto").alias("at"), F.lit(0).alias("asks"), "ln")
    asks = F.struct((F.col("upto") - F.col("words") + min_words).alias("at"), F.lit(1).alias("asks"), "ln")
    merged = sums.select("uid", "part", F.explode(F.array(ends, asks)).alias("x")).select("uid", "part", "x.*")
    falling = Window.partitionBy("uid", "part").orderBy(F.desc("at"), "asks", F.desc("ln")).rowsBetween(Window.unboundedPreceding, 0)
    forward = merged.withColumn("other", F.min(F.when(F.col("asks") == 0, F.col("ln"))).over(falling)).filter("asks = 1 AND other IS NOT NULL")
    begins = F.struct((F.col("upto") - F.col("words")).alias("at"), F.lit(0).alias("asks"), "ln")
    asks = F.struct((F.col("upto") - min_words).alias("at"), F.lit(1).alias("asks"), "ln")
    merged = sums.select("uid", "part", F.explode(F.array(begins, asks)).alias("x")).select("uid", "part", "x.*")
    rising = Window.partitionBy("uid", "part").orderBy("at", "asks", "ln").rowsBetween(Window.unboundedPreceding, 0)
    backward = merged.withColumn("other", F.max(F.when(F.col("asks") == 0, F.col("ln"))).over(rising)).filter("asks = 1 AND other IS NOT NULL")
    forward = forward.select("uid", F.col("ln").alias("s"), F.col("other").alias("e"))
    return forward.union(backward.select("uid", F.col("other").alias("s"), F.col("ln").alias("e"))).distinct()


def repeated_lines(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Of lines (uid, id, ln, h1, h2, words), the (uid, ln) that lie in a later copy of a repeated run.

    Copies are ordered by id (null first), uid and line. Where copies of a run overlap in one text, the lines before the
    second copy stay. No lines give none.
    """
    inner = Window.partitionBy("uid").orderBy("ln")
    named = _again(lines).withColumn("part", F.col("ln") - F.row_number().over(inner))
    named = materialise(named, "lines-again")
    windows = _least_windows(named, min_words).withColumn("size", F.col("e") - F.col("s") + 1)
    windows = materialise(windows, "line-windows")
    longest = windows.agg(F.max("size")).head()[0] or 0
    level, names, found, spent = 0, named.select("uid", "ln", "h1", "h2"), None, [windows]
    while longest >= 1 << level:
        step = 1 << level
        at_end = names.select("uid", (F.col("ln") + step - 1).alias("e"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
        own = windows.filter((F.col("size") >= step) & (F.col("size") < 2 * step))
        own = own.join(names.withColumnRenamed("ln", "s"), ["uid", "s"]).join(at_end, ["uid", "e"])
        own = own.select("uid", "s", "e", *_name("size", "h1", "h2", "g1", "g2"))
        found = own if found is None else found.union(own)
        level += 1
        if longest >= 1 << level:
            half = names.select("uid", (F.col("ln") - step).alias("ln"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
            pairs = names.join(half, ["uid", "ln"]).select("uid", "ln", *_name("h1", "h2", "g1", "g2"))
            names = materialise(_again(pairs), "line-names")
            spent.append(names)
    if found is None:
        return lines.filter("false").select("uid", "ln")
    ids = named.select("uid", "id").distinct()
    placed = materialise(found.join(ids, "uid").select("uid", "s", "e", "h1", "h2", F.struct("id", "uid", "s").alias("at")), "line-runs")
    release(*spent)
    firsts = placed.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = materialise(firsts, "first-runs")
    later = placed.join(firsts, ["h1", "h2"]).filter("at > first").select("uid", F.col("s").alias("ln"), "e")
    # a line is covered if a window that begins at or before it ends at or after it
    events = named.select("uid", "ln", F.lit(None).cast("int").alias("e")).union(later.select("uid", "ln", "e"))
    upto = Window.partitionBy("uid").orderBy("ln", F.col("e").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    out = materialise(events.withColumn("reach", F.max("e").over(upto)).filter("e IS NULL AND reach >= ln").select("uid", "ln"), "lines-gone", free=True)
    release(named, placed, firsts)
    return out


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: key, text without later copies, n_lines, n_removed, and the columns in `carry`.

    Lines end at line feeds. Runs with fewer than `min_words` words in all stay. A null text stays null and has no
    lines; an empty one has one line. A text all of whose lines go becomes empty. Repeated rows are texts of their own,
    so all but one lose what they share. An empty table gives none.
    """
    kept = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("id"), F.col(text).alias("text"), *kept)
    rows = materialise(rows, "line-texts")
    split = F.split("text", "\n", -1)
    lines = rows.filter("text IS NOT NULL").select("uid", "id", F.posexplode(split).alias("ln", "line"))
    lines = materialise(lines.select("uid", "id", "ln", *_name("line"), word_count(F.col("line")).alias("words")), "lines")
    gone = repeated_lines(lines, min_words).withColumn("gone", F.lit(True))
    touched = lines.join(gone.select("uid").distinct(), "uid", "left_semi").select("uid", "ln").join(gone, ["uid", "ln"], "left")
    flags = touched.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("ln", F.coalesce("gone", F.lit(False)).alias("gone")))).alias("flags"))
    flags = materialise(flags.select("uid", F.transform("flags", lambda x: x["gone"]).alias("flags")), "line-flags")
    release(lines)
    out = hash_join(rows, flags, "uid", "left")  # the texts aren't sorted
    stay = F.filter(split, lambda x, i: ~F.get("flags", i))
    names = [F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)]
    return out.select(
        F.col("id").alias(key),
        F.when(F.col("flags").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("flags", lambda x: x)), F.lit(0)).cast("long").alias("n_removed"),
        *names,
    )


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs`, with later copies of repeated lines gone from text (and n_chars set anew, if there is one)."""
    packed = docs.select("doc_id", "text", F.struct("*").alias("row"))
    out = line_dedup(packed, min_words, carry=("row",))
    fields = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return out.select(*[fields.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


#: The definition itself, over all runs of all texts, for small tables.
SQL = rf"""
WITH texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS ln FROM texts),
named AS (SELECT doc_id, ln, dense_rank() OVER (ORDER BY line) AS name, coalesce(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')), 0) AS words FROM numbered),
packed AS (SELECT doc_id, list(name ORDER BY ln) AS names FROM named GROUP BY doc_id),
sums AS (SELECT doc_id, ln, words, sum(words) OVER (PARTITION BY doc_id ORDER BY ln) AS upto FROM named),
runs AS (
  SELECT a.doc_id, a.ln AS s, b.ln AS e, list_slice(p.names, a.ln, b.ln) AS run
  FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.ln >= a.ln AND b.upto - a.upto + a.words >= {MIN_WORDS} JOIN packed p ON p.doc_id = a.doc_id),
later AS (SELECT * FROM (SELECT doc_id, s, e, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS copy FROM runs) WHERE copy > 1),
gone AS (SELECT DISTINCT n.doc_id, n.ln FROM named n JOIN later l ON n.doc_id = l.doc_id AND n.ln BETWEEN l.s AND l.e),
kept AS (
  SELECT n.doc_id, count(g.ln) AS n_removed, coalesce(string_agg(n.line, chr(10) ORDER BY n.ln) FILTER (g.ln IS NULL), '') AS kept
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.ln = g.ln GROUP BY n.doc_id)
SELECT t.doc_id, len(t.lines) AS n_lines, k.n_removed, length(k.kept) AS n_chars, sha256(k.kept) AS kept_sha256 FROM texts t JOIN kept k USING (doc_id)
"""
