"""Look-alike skeletons and what is built on them: scripts of a text, classes of pairs, joins, groups, protected names."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import LEVELS, LOOKS, Forms, compiled, mapped, only
from ..functions.text import code_points, is_ascii, overlap, resolved, text_functions
from ..sources.unicode import characters, stretches, tree
from .bidi import BidiData, Levels, display, display_all

#: Classes of characters that can raise a level to an odd one.
_ODD = "[:bc=R:][:bc=AL:][:bc=AN:][:bc=RLE:][:bc=RLO:][:bc=RLI:]"


class Looks(NamedTuple):
    """The kernel of skeletons: normal form, display order, prototypes, normal form.

    `replaced` is a class of all characters that have a prototype, and of some that don't; most of a text isn't in it.
    """

    forms: Forms
    prototypes: dict[int, str]
    bidi: BidiData
    odd: str
    replaced: str

    def internal(self, text: str) -> str:
        plain = self.forms.nfd(text)
        looks = compiled(f"{self.replaced}+").sub(lambda m: m[0].translate(self.prototypes), plain)
        return looks if looks == plain else self.forms.nfd(looks)

    def keys(self, text: str) -> list[str]:
        """The skeleton of a name and that of its case-folded form."""
        folded = self.forms.folds(text)
        own = self.ltr(text)
        return [own, own if folded == text else self.ltr(folded)]

    def shown(self, text: str, direction: str) -> str:
        """The text in display order; left to right, one that can't reach an odd level is shown as it is written."""
        return text if direction == "ltr" and not compiled(self.odd).search(text) else display(text, self.bidi, direction)

    def shown_of_all(self, texts: list[str], direction: str) -> list[str]:
        """`shown` of each text, those that turn together."""
        turns = [i for i, x in enumerate(texts) if direction != "ltr" or compiled(self.odd).search(x)]
        out = list(texts)
        for i, x in zip(turns, display_all([texts[i] for i in turns], self.bidi, direction), strict=True):
            out[i] = x
        return out

    def ltr(self, text: str) -> str:
        return self.internal(self.shown(text, "ltr"))

    def rtl(self, text: str) -> str:
        return self.internal(self.shown(text, "rtl"))

    def auto(self, text: str) -> str:
        return self.internal(self.shown(text, "auto"))

    def shown_ltr(self, text: str) -> str:
        return self.shown(text, "ltr")

    def shown_rtl(self, text: str) -> str:
        return self.shown(text, "rtl")

    def shown_auto(self, text: str) -> str:
        return self.shown(text, "auto")

    def ltr_all(self, texts: list[str]) -> list[str]:
        return [self.internal(x) for x in self.shown_of_all(texts, "ltr")]

    def rtl_all(self, texts: list[str]) -> list[str]:
        return [self.internal(x) for x in self.shown_of_all(texts, "rtl")]

    def auto_all(self, texts: list[str]) -> list[str]:
        return [self.internal(x) for x in self.shown_of_all(texts, "auto")]

    def shown_ltr_all(self, texts: list[str]) -> list[str]:
        return self.shown_of_all(texts, "ltr")

    def shown_rtl_all(self, texts: list[str]) -> list[str]:
        return self.shown_of_all(texts, "rtl")

    def shown_auto_all(self, texts: list[str]) -> list[str]:
        return self.shown_of_all(texts, "auto")


class Skeletons:
    """Skeleton expressions bound to one session's Unicode data.

    Left to right, ASCII texts are answered in the JVM; all others go through one Arrow function.
    """

    def __init__(self, spark) -> None:
        self.spark, self.chars = spark, characters(spark)
        self._sent = self.chars.shipped("looks", self._looks)

    def _looks(self) -> Looks:
        own = stretches({c for c in self.chars.prototypes if c < "\U00010000"})
        replaced = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in own)
        return Looks(self.chars.forms, str.maketrans(self.chars.prototypes), self.chars.bidi, self.chars.pattern(_ODD), f"[{replaced}\\U00010000-\\U0010ffff]")

    def _ascii(self, text: Column) -> Column:
        """The skeleton of an ASCII text: characters for which one stands at once, the others one after the other."""
        looks = {c: s for c, s in self.chars.prototypes.items() if c < "\x80"}
        single = {c: s for c, s in looks.items() if len(s) == 1}
        several = {c: s for c, s in looks.items() if len(s) != 1}
        # what one replacement makes, no later one may take up
        order = sorted(several, key=lambda c: sum(c in s for s in several.values()), reverse=True)
        assert not set(order) & set("".join(single.values())) and not any(b in several[a] for i, a in enumerate(order) for b in order[i:])
        out = F.translate(text, "".join(single), "".join(single.values()))
        for c in order:
            out = F.replace(out, F.lit(c), F.lit(several[c]))
        return out

    def _kernel(self, method: str, kind: str = "string"):
        return mapped(method, kind, self._sent)

    def internal(self, text: Column) -> Column:
        """The skeleton without regard to display: decomposed, each character replaced by what it looks like."""
        return only(~is_ascii(text), text, self._kernel("internal"), self._ascii(text))

    def displayed(self, text: Column, direction: str = "ltr") -> Column:
        """The text in display order. Left to right, texts that can't reach an odd level stay out of Python."""
        turns = F.lit(True) if self._direction(direction) != "ltr" else ~is_ascii(text) & text.rlike(self.chars.regex(_ODD))
        return only(turns, text, self._kernel(f"shown_{direction}"), text)

    def levels(self, text: Column, direction: str = "ltr") -> Column:
        """struct<base, levels, order>: the paragraph level, each character's level (null if rule X9 removes it), and the
        places of the others in display order."""
        return mapped(f"text_{self._direction(direction)}", LEVELS, self.chars.shipped("levels", lambda: Levels(self.chars.bidi)))(text)

    def levels_of_classes(self, classes: Column, direction: str = "ltr") -> Column:
        """The same of one paragraph given by its bidi classes (array<string>), as BidiTest.txt has them."""
        return mapped(f"classes_{self._direction(direction)}", LEVELS, self.chars.shipped("levels", lambda: Levels(self.chars.bidi)))(classes)

    def skeleton(self, text: Column, direction: str | None = "ltr") -> Column:
        """Two texts look alike if these are equal. Null for null; an empty text's is empty."""
        if direction is None:
            return self.internal(text)
        if self._direction(direction) != "ltr":
            return self._kernel(direction)(text)
        return only(~is_ascii(text), text, self._kernel("ltr"), self._ascii(text))

    def username_keys(self, name: Column) -> Column:
        """The two keys of a name, from one kernel: its skeleton, and that of its case-folded form."""
        plain = F.array(self._ascii(name), self._ascii(F.lower(name)))
        return only(~is_ascii(name), name, self._kernel("keys", "array<string>"), plain)

    @staticmethod
    def _direction(direction: str) -> str:
        if direction not in ("ltr", "rtl", "auto"):
            raise ValueError(f"direction must be 'ltr', 'rtl', 'auto' or None, not {direction!r}")
        return direction


class ValuesOf:
    """The sorted distinct values of a text's characters, each looked up in a table of code points (number by code point,
    values). The table is bounded by Unicode, so it goes to every task and no row is shuffled."""

    def __init__(self, table) -> None:
        self.index, self.values = table
        self.known: dict[frozenset, list] = {}

    def of(self, text: str) -> list:
        own = frozenset(self.index[list(map(ord, set(text)))].tolist())
        if own not in self.known:
            self.known[own] = sorted(self.values[i] for i in own)
        return self.known[own]

    scripts = aliases = of


def _of_characters(chars, text: Column, name: str, kind: str, letters: Column, others: Column) -> Column:
    """The values of a text's characters; ASCII texts are answered in the JVM and stay out of Python."""
    sent = chars.shipped(name, lambda: ValuesOf(chars.script_table if name == "scripts" else chars.alias_table))
    plain = F.array_compact(F.array(F.when(text.rlike("[^A-Za-z]"), others), F.when(text.rlike("[A-Za-z]"), letters)))
    return only(~is_ascii(text), text, mapped(name, kind, sent), F.sort_array(plain))


def script_sets(spark, text: Column) -> Column:
    """The sorted distinct augmented script sets of a text's characters, array<array<string>>; null for null."""
    latin, every = (F.array(*[F.lit(x) for x in own]) for own in (["Hntl", "Latn"], ["ALL"]))
    return _of_characters(characters(spark), text, "scripts", "array<array<string>>", latin, every)


def with_scripts(df: DataFrame, text: str, out: str = "script_sets") -> DataFrame:
    """`df` with the script sets of each text's characters. A column of that name is replaced."""
    return df.withColumn(out, script_sets(df.sparkSession, F.col(text)))


def with_aliases(df: DataFrame, text: str, out: str = "aliases") -> DataFrame:
    """`df` with the sorted distinct script names, in capitals, of each text's characters; null for null."""
    return df.withColumn(out, aliases_of(df.sparkSession, F.col(text)))


class Masks:
    """Script sets as bits, 63 a word: the bits that all characters of a text share, all bits for characters of any script."""

    def __init__(self, table) -> None:
        self.index, values = table
        self.names = sorted({x for own in values for x in own} - {"ALL"})
        place = {x: i for i, x in enumerate(self.names)}
        every = (1 << len(self.names)) - 1
        self.masks = [every if own == ["ALL"] else sum(1 << place[x] for x in own) for own in values]
        self.words = -(-len(self.names) // 63)

    def mask(self, text: str) -> list[int]:
        shared = (1 << len(self.names)) - 1
        for i in set(self.index[list(map(ord, set(text)))].tolist()):
            shared &= self.masks[i]
        return self.split(shared)

    def split(self, mask: int) -> list[int]:
        return [(mask >> (63 * w)) & ((1 << 63) - 1) for w in range(self.words)]


def _masks(chars):
    return chars.shipped("masks", lambda: Masks(chars.script_table))


def script_mask(spark, text: Column) -> Column:
    """The scripts that all characters of a text share, as words of bits (array<long>); null for null.

    A group's, window's or stream's shared scripts are the bit_and of each word, see `shared_mask` and `mask_scripts`.
    """
    chars = characters(spark)
    sent = _masks(chars)
    masks = sent.value
    words = lambda x: F.array(*[F.lit(w).cast("long") for w in masks.split(x)])
    every, latin = (1 << len(masks.names)) - 1, sum(1 << masks.names.index(x) for x in ("Hntl", "Latn"))
    plain = F.when(text.rlike("[A-Za-z]"), words(latin)).otherwise(words(every))
    return only(~is_ascii(text), text, mapped("mask", "array<bigint>", sent), plain)


def shared_mask(spark, mask: Column) -> Column:
    """The aggregate of `script_mask` values: a column for GROUP BY, windows, streams and SQL. Nulls don't count."""
    return F.array(*[F.bit_and(mask[i]) for i in range(_masks(characters(spark)).value.words)])


def mask_scripts(spark, mask: Column) -> Column:
    """The scripts of a mask, sorted: ['ALL'] if every bit is set, [] if none is; null for null."""
    masks = _masks(characters(spark)).value
    every = masks.split((1 << len(masks.names)) - 1)
    names = F.array_compact(F.array(*[F.when(F.getbit(mask[i // 63], F.lit(i % 63)) == 1, F.lit(x)) for i, x in enumerate(masks.names)]))
    whole = mask[0] == F.lit(every[0]).cast("long")
    for i, w in enumerate(every[1:], 1):
        whole &= mask[i] == F.lit(w).cast("long")
    return F.when(mask[0].isNull(), None).when(whole, F.array(F.lit("ALL"))).otherwise(names)


def shared_scripts(df: DataFrame, by: list[str], text: str, out: str = "shared_scripts") -> DataFrame:
    """(by..., out) the scripts that all characters of all of a group's texts share; null if all texts are null.

    Masks are combined before the shuffle, so a group is a few words a task, however many texts it has.
    """
    spark = df.sparkSession
    own = df.select(*by, script_mask(spark, F.col(text)).alias("_mask")).groupBy(*by).agg(shared_mask(spark, F.col("_mask")).alias("_mask"))
    return own.select(*by, mask_scripts(spark, F.col("_mask")).alias(out))


def mixes_aliases(aliases: Column, allowed: tuple[str, ...] = ("COMMON",)) -> Column:
    """Whether a text uses more than one script name beside those allowed (in any case)."""
    return F.size(F.array_except(aliases, F.array(*[F.lit(a.upper()) for a in allowed]).cast("array<string>"))) > 1


class Homoglyphs:
    """Of each character that counts: its name of a script, and what looks like it. At most one entry a code point."""

    def __init__(self, looks: dict[str, tuple[str, list[dict]]]) -> None:
        self.looks = looks
        self.known = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in stretches(set(looks))) + "]" if looks else "(?:(?!))"

    def _item(self, c: str) -> dict:
        alias, own = self.looks[c]
        return {"character": c, "alias": alias, "homoglyphs": own}

    def first(self, text: str) -> list[dict]:
        m = compiled(self.known).search(text)
        return [self._item(m[0])] if m else []

    def all(self, text: str) -> list[dict]:
        return [self._item(c) for c in dict.fromkeys(compiled(self.known).findall(text))]


def _homoglyphs(chars, names: tuple[str, ...]):
    """(broadcast, Java class of the characters that count), made once a session and argument."""
    if names in chars.homoglyph_tables:
        return chars.homoglyph_tables[names]
    table = chars.homoglyphs.filter(F.length("character") == 1).select(F.ascii("character").alias("cp"), "homoglyphs")
    if names:
        part = table.select("cp", F.explode("homoglyphs").alias("h")).select("cp", F.explode(code_points(F.col("h.c"))).alias("c"))
        good = part.join(F.broadcast(chars.aliases.withColumnRenamed("cp", "of")), F.ascii("c") == F.col("of")).filter(F.col("alias").isin(list(names)))
        table = table.join(good.select("cp").distinct(), "cp", "left_semi")
    table = table.join(chars.aliases.select("cp", "alias"), "cp", "left").withColumn("alias", F.coalesce("alias", F.lit("Unknown")))
    table = table.filter(~F.col("alias").isin(list(names))) if names else table
    looks = {chr(r.cp): (r.alias, [{"c": h.c, "n": h.n} for h in r.homoglyphs]) for r in table.collect()}
    made = chars.shipped(("homoglyphs", names), lambda: Homoglyphs(looks)), tree(stretches(set(looks))) or "[a&&b]"
    chars.homoglyph_tables[names] = made
    return made


def homoglyphs_of(spark, text: Column, greedy: bool = False, preferred: tuple[str, ...] = ()) -> Column:
    """array<struct<character, alias, homoglyphs array<struct<c, n>>>> of a text's characters that look like others, in order.

    With `preferred` script names, only characters of other scripts that look like one of a preferred script count.
    Without `greedy`, the first alone is listed. Empty if there are none; null for null. No row is shuffled.
    """
    sent, known = _homoglyphs(characters(spark), tuple(sorted(a.upper() for a in preferred)))
    return only(text.rlike(known), text, mapped("all" if greedy else "first", LOOKS, sent), F.array().cast(LOOKS))


def homoglyph_report(df: DataFrame, text: str, greedy: bool = False, preferred: tuple[str, ...] = (), out: str = "homoglyphs") -> DataFrame:
    """`df` with `homoglyphs_of` a text. A column `out` is replaced."""
    return df.withColumn(out, homoglyphs_of(df.sparkSession, F.col(text), greedy, preferred))


def aliases_of(spark, text: Column) -> Column:
    """The sorted distinct script names, in capitals, of a text's characters; null for null."""
    return _of_characters(characters(spark), text, "aliases", "array<string>", F.lit("LATIN"), F.lit("COMMON"))


def dangerous(spark, text: Column, preferred: tuple[str, ...] = ()) -> Column:
    """Whether a text mixes script names and has a character that looks like another; null for null."""
    _, known = _homoglyphs(characters(spark), tuple(sorted(a.upper() for a in preferred)))
    return mixes_aliases(aliases_of(spark, text)) & text.rlike(known)


def is_dangerous(df: DataFrame, text: str, preferred: tuple[str, ...] = (), out: str = "is_dangerous") -> DataFrame:
    """`df` with whether a text is `dangerous`."""
    return df.withColumn(out, dangerous(df.sparkSession, F.col(text), preferred))


def match_class(skeletons_equal: Column, a_sets: Column, b_sets: Column) -> Column:
    """single-script, whole-script or mixed-script for texts that look alike; null for others."""
    a, b = resolved(a_sets), resolved(b_sets)
    kind = F.when(overlap(a, b), "single-script").when((F.size(a) > 0) & (F.size(b) > 0), "whole-script").otherwise("mixed-script")
    return F.when(skeletons_equal, kind)


def match_pairs(df: DataFrame, a: str, b: str, direction: str | None = "ltr", out: str = "match") -> DataFrame:
    """`df` with the class of how two of its columns look alike."""
    s = Skeletons(df.sparkSession)
    wide = df.select(F.struct(*df.columns).alias("row"), F.col(a).alias("a"), F.col(b).alias("b"))
    wide = with_scripts(with_scripts(wide, "a", "sets_a"), "b", "sets_b")
    own = match_class(s.skeleton(F.col("a"), direction) == s.skeleton(F.col("b"), direction), F.col("sets_a"), F.col("sets_b"))
    return wide.select(*[F.col("row")[c].alias(c) for c in df.columns if c != out], own.alias(out))


def is_mixed_match(match: Column) -> Column:
    """Whether a match class is one of mixed scripts, whole-script ones included; null where nothing matches."""
    return match != "single-script"


def is_mixed_script(df: DataFrame, text: str, out: str = "is_mixed_script") -> DataFrame:
    """`df` with whether no script is shared by all of a text's characters; null for null."""
    wide = with_scripts(df.select(F.struct(*df.columns).alias("row"), F.col(text).alias("text")), "text", "sets")
    return wide.select(*[F.col("row")[c].alias(c) for c in df.columns if c != out], (F.size(resolved(F.col("sets"))) == 0).alias(out))


def _keyed(df: DataFrame, on: str, side: str, direction: str | None) -> DataFrame:
    """Rows with their skeletons. A null text gets an empty one and a number of its own side that no other row has, so it
    matches nothing and nulls are dealt to many tasks. As the key is never null, Spark doesn't test it below the kernel."""
    look = F.coalesce(Skeletons(df.sparkSession).skeleton(F.col(on), direction), F.lit(""))
    row = F.struct(*df.columns)
    spread = F.pmod(F.xxhash64(row), F.lit(1 << 20)) + 1
    apart = F.when(F.col(on).isNull(), spread if side == "a" else -spread).otherwise(F.lit(0).cast("long"))
    return df.select(row.alias(f"row_{side}"), look.alias(f"look_{side}"), apart.alias(f"apart_{side}"))


def lookalike_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, direction: str | None = "ltr", how: str = "inner") -> DataFrame:
    """Rows of `left` and `right` whose texts look alike: an equi-join on skeletons, planned by Spark; nulls never match.

    With `how` 'left_semi' or 'left_anti', rows of `left` that do or don't look like any of `right`. Each side's skeletons
    are made once.
    """
    kept = {"left": (False, True), "leftouter": (False, True), "leftanti": (False, True), "right": (True, False), "rightouter": (True, False), "full": (False, False), "fullouter": (False, False), "outer": (False, False)}
    drops = kept.get(how.replace("_", ""), (True, True))
    left, right = left.filter(F.col(left_on).isNotNull()) if drops[0] else left, right.filter(F.col(right_on).isNotNull()) if drops[1] else right
    a, b = _keyed(left, left_on, "a", direction), _keyed(right, right_on, "b", direction)
    alike = (F.col("look_a") == F.col("look_b")) & (F.col("apart_a") == F.col("apart_b"))
    if how in ("left_semi", "left_anti"):
        return a.join(b.select("look_b", "apart_b").distinct(), alike, how).select("row_a.*")
    return a.join(b, alike, how).select("row_a.*", "row_b.*")


def lookalike_groups(df: DataFrame, text: str, direction: str | None = "ltr") -> DataFrame:
    """Skeletons that more than one distinct text has: skeleton, n_rows, n_texts, first_text, last_text."""
    keyed = df.select(F.col(text).alias("t"), Skeletons(df.sparkSession).skeleton(F.col(text), direction).alias("skeleton")).filter("t IS NOT NULL")
    once = keyed.groupBy("skeleton", "t").agg(F.count(F.lit(1)).alias("n"))
    out = once.groupBy("skeleton").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_texts"), F.min("t").alias("first_text"), F.max("t").alias("last_text"))
    return out.filter("n_texts > 1")


def protected(df: DataFrame, name: str, protected_names: list[str] | DataFrame, flag: str = "is_protected") -> DataFrame:
    """`df` with whether a name shares one of its two keys with a protected name; false for null.

    Few keys are compared in place, without a shuffle; of many, a filter of bits finds the names that can share one, and
    only their keys are joined (see `membership`).
    """
    from .membership import is_member

    spark, s = df.sparkSession, Skeletons(df.sparkSession)
    names = protected_names if isinstance(protected_names, DataFrame) else spark.createDataFrame([(x,) for x in protected_names], "name string")
    keys = names.select(F.explode(s.username_keys(F.col(names.columns[0]))).alias("key"))
    wide = df.select(F.struct(*df.columns).alias("_row"), s.username_keys(F.col(name)).alias("_keys"))
    found = is_member(wide, "_keys", keys, flag)
    return found.select(*[F.col("_row")[c].alias(c) for c in df.columns if c != flag], flag)


def checked_bidi_tests(tests: DataFrame) -> DataFrame:
    """Rows of `ucd.bidi_tests` or `bidi_character_tests` (direction 0, 1, 2; levels; order) with what is found: got, agrees."""
    s = Skeletons(tests.sparkSession)
    of, given = (s.levels_of_classes, F.col("classes")) if "classes" in tests.columns else (s.levels, F.col("text"))
    turn = F.col("direction")
    got = F.when(turn == 0, of(F.when(turn == 0, given), "ltr")).when(turn == 1, of(F.when(turn == 1, given), "rtl")).otherwise(of(F.when(turn == 2, given), "auto"))
    out = tests.withColumn("got", got)
    return out.withColumn("agrees", (F.col("got.levels") == F.col("levels")) & (F.col("got.order") == F.col("order")))


def spoof_report(df: DataFrame, text: str) -> DataFrame:
    """`df` with everything a reviewer asks of a text, as expressions of the same row. Columns of these names are replaced."""
    t, c, sets = text_functions(df.sparkSession), F.col("text"), F.col("sets")
    s = Skeletons(df.sparkSession)
    wide = with_scripts(df.select(F.struct(*df.columns).alias("row"), F.col(text).alias("text")), "text", "sets")
    report = {
        "skeleton": s.skeleton(c),
        "resolved_scripts": resolved(sets),
        "is_mixed_script": F.size(resolved(sets)) == 0,
        "restriction_level": t.restriction_level(c, sets),
        "is_allowed": t.is_allowed(c),
        "has_mixed_numbers": t.has_mixed_numbers(c),
        "has_unlikely_marks": t.has_unlikely_marks(c),
        "has_hidden_overlay": t.has_hidden_overlay(c),
        "invisible": t.find_invisible(c),
    }
    return wide.select(*[F.col("row")[x].alias(x) for x in df.columns if x not in report], *[x.alias(name) for name, x in report.items()])


__all__ = [n for n in globals() if not n.startswith("_") and n not in ("annotations", "Column", "DataFrame", "F", "is_ascii")]
