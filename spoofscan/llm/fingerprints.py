"""Document fingerprints by consistent weighted sampling. Native: DataFrame functions only.

Terms are words (long ones in pieces), their weights the number of times they stand in the text. For each of SAMPLES samples, a term draws
r and c from Gamma(2, 1) and b from [0, 1), all functions of the term and the sample alone; with t = floor(ln w / r + b)
the term of the least c * exp(-r * (t - b + 1)) is the sample, together with its t [Ioffe 2010]. Two texts agree in a sample
with the probability of their generalised Jaccard similarity, sum of least weights over sum of largest.

Documents are dealt once by ranges of the key, so that a document's successor, its terms and its samples all stay in the
partition that read its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import WORD, materialise

#: Samples of a fingerprint, computed so many a row; 16 bits (four hex digits) are kept of each. Longer words count as
#: pieces of so many characters, so that a text without spaces has many terms too.
SAMPLES, A_ROW, PIECE = 64, 4, 24
#: Documents a range holds about; ranges into which each level cuts those of the level before. Their product, about a
#: million, bounds the number of ranges, and the edges and ends that are broadcast.
RANGE_ROWS, LEVELS = 1000, (256, 256, 16)
_MASK21 = (1 << 21) - 1


def _ranges(rows: DataFrame) -> DataFrame:
    """Rows (id, h, ...) with the number of their range, rising with (id, h), null ids first.

    Edges are quantiles of the id, those of the second level within each range of the first, and so on. An id that
    several edges have (one that stands at very many rows) is dealt among their ranges by h.
    """
    n, nulls = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull())).head()
    share = F.col("h").cast("double") / float(1 << 63)
    none = max(1, nulls // RANGE_ROWS)
    out, wanted = rows.withColumn("range", F.lit(0).cast("long")).withColumn("share", share), n // RANGE_ROWS
    for most in LEVELS:
        if wanted < 2:
            break
        width = min(most, wanted)
        wanted = -(-wanted // width)
        edges = out.groupBy("range").agg(F.percentile_approx("id", [i / width for i in range(1, width)], 100 * width).alias("edges"))
        out = out.join(F.broadcast(materialise(edges, "range-edges")), "range", "left")
        out = out.withColumn("low", F.size(F.filter("edges", lambda x: x < F.col("id")))).withColumn("high", F.size(F.filter("edges", lambda x: x <= F.col("id"))))
        hot = F.col("high") > F.col("low") + 1
        spread = F.col("share") * (F.col("high") - F.col("low") + 1)
        at = F.when(hot, F.least(F.col("low") + F.floor(spread), F.col("high"))).otherwise(F.col("high"))
        rest = F.when(hot, spread - F.floor(spread)).otherwise(F.col("share"))
        out = out.withColumn("range", F.col("range") * width + at).withColumn("share", rest).drop("edges", "low", "high")
    first = F.least(F.floor(share * none), F.lit(none - 1)) - none
    return out.withColumn("range", F.when(F.col("id").isNull(), first).otherwise(F.col("range")).cast("long")).drop("share")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (id, text) as rows (range, place, id, text, next, ghost), in ascending order of id, then of a hash of the text.

    `next` is the text of the next row, of the last row the first one's. Each range also ends with a ghost, the first
    row of the next range, so that nothing else has to look across ranges.
    """
    rows = _ranges(docs.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1)))
    firsts = rows.groupBy("range").agg(F.min(F.struct("id", "h")).alias("first"))
    order = Window.orderBy("range")  # one row a range, whose number has a bound
    ends = firsts.select("range", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("first"))
    ends = ends.select(F.col("range").alias("of"), F.col("first.id").alias("end_id"), F.col("first.h").alias("end_h"))
    same = rows["id"].eqNullSafe(F.col("end_id")) & (rows["h"] == F.col("end_h"))
    ghosts = rows.select("id", "h", "text").join(F.broadcast(ends), same).groupBy("of").agg(F.min(F.struct("id", "h", "text")).alias("row"))
    ghosts = ghosts.select("row.id", "row.h", "row.text", F.col("of").alias("range"), F.lit(True).alias("ghost"))
    ghosts = ghosts.select("id", "h", "text", "range", "ghost")
    # written, so that what reads it twice below deals the texts once
    both = materialise(rows.select("id", "h", "text", "range", F.lit(False).alias("ghost")).union(ghosts), "ranged").filter("range IS NOT NULL")
    inner = Window.partitionBy("range").orderBy("ghost", "id", "h", "text")
    return both.select("range", F.row_number().over(inner).alias("place"), "id", "text", F.lead("text").over(inner).alias("next"), "ghost")


def _term_weights(texts: DataFrame, by: list[str], sides: list[str]) -> DataFrame:
    """Rows (by..., h, one log-weight per side, null where the term isn't in that text)."""
    sided = texts.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("text")) for i, c in enumerate(sides)])).alias("x"))
    pieces = F.regexp_extract_all("x.text", F.lit(f"{WORD[:-1]}{{1,{PIECE}}}"), F.lit(0))
    words = sided.select(*by, "x.side", F.explode(pieces).alias("word"))
    counts = [F.sum((F.col("side") == i).cast("long")).alias(f"n{i}") for i in range(len(sides))]
    terms = words.groupBy(*by, F.xxhash64("word").alias("h")).agg(*counts)
    return terms.select(*by, "h", *[F.when(F.col(f"n{i}") > 0, F.ln(f"n{i}")).alias(f"w{i}") for i in range(len(sides))])


def _sample(k: Column, weight: str) -> Column:
    """48 bits: what is to be least, in 32; and the low 16 bits of the term and its t."""
    unit = lambda bits, at: (F.shiftrightunsigned(bits, at).bitwiseAND(_MASK21) + 0.5) / float(1 << 21)
    a = F.xxhash64("h", k)
    b = F.xxhash64(a)
    r = -F.ln(unit(a, 0) * unit(a, 21))
    ln_c = F.ln(-F.ln(unit(a, 42) * unit(b, 0)))
    shift = unit(b, 21)
    t = F.floor(F.col(weight) / r + shift)
    least = ln_c - r * (t - shift + 1)
    return F.floor(least * float(1 << 24)) * 65536 + F.col("h").bitwiseXOR(t).bitwiseAND(65535)


def signatures(texts: DataFrame, by: list[str], sides: list[str]) -> DataFrame:
    """Rows (by..., one array of SAMPLES ints per side); none for rows whose texts have no words, null for such a side.

    Rows of one `by` are expected in one partition already (`by` holds what they are dealt by); then nothing is shuffled.
    """
    terms = _term_weights(texts, by, sides).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // A_ROW - 1))))
    cells = [(i, j) for i in range(len(sides)) for j in range(A_ROW)]
    least = terms.groupBy(*by, "turn").agg(*[F.min(_sample(F.col("turn") * A_ROW + j, f"w{i}")).alias(f"m{i}_{j}") for i, j in cells])
    packed = least.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("turn", *[f"m{i}_{j}" for i, j in cells]))).alias("all"))

    def side(i: int) -> Column:
        flat = F.flatten(F.transform("all", lambda x: F.array(*[x[f"m{i}_{j}"].bitwiseAND(65535).cast("int") for j in range(A_ROW)])))
        return F.when(F.get("all", 0)[f"m{i}_0"].isNotNull(), flat).alias(f"s{i}")

    return packed.select(*by, *[side(i) for i in range(len(sides))])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples; texts without words (null) are like each other and like no other text."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / SAMPLES
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(same)


def printed(signature: Column) -> Column:
    digits = F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 4, "0")))
    return F.coalesce(F.array_join(digits, ""), F.lit("-"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by the next document's first characters. The key must be a number;
    null keys come first, rows of equal keys in the order of a hash of their texts. Null texts count as empty ones; the fingerprint
    of a text without words is '-'. A lone document is its own successor. An empty table gives none.
    """
    if not isinstance(docs.schema[key].dataType, NumericType):
        raise ValueError(f"the key must be a number, not {docs.schema[key].dataType.simpleString()}")
    rows = with_next(docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("next", F.lit("")), F.lit(1), quarter))
    rows = rows.select("range", "place", "id", "ghost", "text", edited.alias("edited"))
    marks = signatures(rows, ["range", "place"], ["text", "edited"])
    facts = rows.select("range", "place", "id", "ghost", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    both = facts.join(marks, ["range", "place"], "left")
    # the successor's fingerprint; a struct, as that of a text without words is null
    after = F.lead(F.struct("s0")).over(Window.partitionBy("range").orderBy("place"))
    both = both.withColumn("after", after).filter("NOT ghost")
    return both.select(
        F.col("id").alias(key),
        "n_chars",
        "edited_sha256",
        printed(F.col("s0")).alias("fingerprint"),
        printed(F.col("s1")).alias("edited_fingerprint"),
        likeness(F.col("s0"), F.col("s1")).alias("near_edited"),
        likeness(F.col("s0"), F.col("after.s0")).alias("near_next"),
    )
