"""Character classes and tables, made by rule from the Unicode data that a session has.

By default that is the ICU library on Spark's own class path, brought nearer to Unicode 18 by rules and short tables of
fixed values. A session that names a folder of Unicode's own files in spark.spoofscan.unicode.dir follows those instead.
Classes are ICU set expressions, turned once into ranges on the driver; tables have at most one row per code point, so
they are small enough to broadcast whatever the input.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cached_property, lru_cache
from typing import TYPE_CHECKING
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed
from .fixed import EGYPTIAN_SELECTORS, EMOJI_OF_TWO_STYLES, VARIANTS
from .folder import DIRECTORY, Folder

if TYPE_CHECKING:
    from ..functions.kernels import Forms

#: UTS #39 section 5.1: the writing systems that span several scripts. Fixed values.
WRITING_SYSTEMS = {"Hani": ["Hanb", "Hntl", "Jpan", "Kore"], "Hira": ["Jpan"], "Kana": ["Jpan"], "Hang": ["Kore"], "Bopo": ["Hanb"], "Latn": ["Hntl"]}
#: UAX #31 table 5. Fixed values.
RECOMMENDED_SCRIPTS = (
    "Arab Armn Beng Cyrl Deva Ethi Geor Grek Gujr Guru Hang Hani Hebr Hira Kana Knda Khmr Laoo Latn Mlym Mymr Orya Sinh Taml Telu Thaa Thai Tibt"
).split()


def tree(ranges: tuple[tuple[int, int], ...]) -> str:
    """A Java regex character class of sorted ranges, '' of none.

    Java tests a class's ranges one after the other. Here they are halved again and again, and each half is tested behind
    the range that it spans, so a character costs a logarithm of their number.
    """
    one = lambda a, b: f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "")
    if len(ranges) <= 3:
        return f"[{''.join(one(a, b) for a, b in ranges)}]" if ranges else ""
    half = len(ranges) // 2
    return f"[{one(ranges[0][0], ranges[-1][1])}&&[{tree(ranges[:half])}{tree(ranges[half:])}]]"


def stretches(characters: set[str]) -> tuple[tuple[int, int], ...]:
    """Sorted (first, last) ranges of a set of characters."""
    out: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return tuple((a, b) for a, b in out)


def _set(ranges) -> str:
    """Ranges in the form of a set expression."""
    return "".join(f"\\U{a:08X}" + (f"-\\U{b:08X}" if b > a else "") for a, b in ranges)


class Characters:
    """The classes of one session's Unicode data."""

    def __init__(self, spark: SparkSession, directory: str | None = None) -> None:
        self.spark = spark
        self.icu = spark._jvm.com.ibm.icu
        self.folder = Folder(spark, directory) if directory else None
        self._shipped: dict = {}
        self.kernels: dict = {}
        self.homoglyph_tables: dict = {}

    @cached_property
    def version(self) -> str:
        """The Unicode version that answers follow; store it beside skeletons.

        The folder's, or the library's and, after a plus sign, that which the rules and fixed values bring it nearer to.
        """
        own = self.icu.lang.UCharacter.getUnicodeVersion().toString().removesuffix(".0")
        return (self.folder and self.folder.version) or f"{own}+{fixed.FOLLOWS}"

    def shipped(self, name, make):
        """A broadcast of what `make` gives, made once a session."""
        if name not in self._shipped:
            self._shipped[name] = self.spark.sparkContext.broadcast(make())
        return self._shipped[name]

    def _atom(self, m: re.Match) -> str:
        """A property in an expression, as the folder or the fixed values have it; else as it stands."""
        prop, value = m[1], m[2]
        if self.folder:
            found = self.folder.ranges(prop, value)
            return m[0] if found is None else f"[{_set(found)}]"
        restricted = _set([(int(x.split("-")[0], 16), int(x.split("-")[-1], 16)) for x in fixed.RESTRICTED.split()])
        # of the ideographs, those of the first repertoire are in common use, and a few others
        gone, come = f"[{restricted}[[:Unified_Ideograph:]-[\\u4E00-\\u9FA5]]]", f"[{fixed.ALLOWED}{fixed.HAN}]"
        if (prop, value) in (("Identifier_Status", "Allowed"), ("Identifier_Type", "Recommended")):
            return f"[[{m[0]}-{gone}]{come}]"
        if prop == "Identifier_Type" and value == "Uncommon_Use":
            return f"[{m[0]}[{gone}&[:Identifier_Type=Recommended:]]-{come}]"
        return f"[{m[0]}-{come}]" if prop == "Identifier_Type" else m[0]

    @lru_cache(maxsize=None)  # noqa: B019  (one object a session)
    def ranges(self, expression: str) -> tuple[tuple[int, int], ...]:
        """The (first, last) code points of an ICU set expression."""
        found = self.icu.text.UnicodeSet("[" + re.sub(r"\[:([A-Za-z_]+)(?:=([^:\]]+))?:\]", self._atom, expression) + "]")
        return tuple((found.getRangeStart(i), found.getRangeEnd(i)) for i in range(found.getRangeCount()))

    @lru_cache(maxsize=None)  # noqa: B019
    def regex(self, expression: str) -> str:
        """The same as a Java regex character class; of no characters, one that nothing matches."""
        return tree(self.ranges(expression)) or "[a&&b]"

    @lru_cache(maxsize=None)  # noqa: B019
    def pattern(self, expression: str) -> str:
        """The same as a Python regex character class; of no characters, one that nothing matches."""
        one = lambda a, b: f"\\U{a:08x}" + (f"-\\U{b:08x}" if b > a else "")
        return f"[{''.join(one(a, b) for a, b in self.ranges(expression))}]" if self.ranges(expression) else "(?:(?!))"

    def count(self, expression: str) -> int:
        return sum(b - a + 1 for a, b in self.ranges(expression))

    @cached_property
    def scripts(self) -> list[str]:
        """ISO 15924 codes of the scripts that characters have."""
        u = self.icu.lang.UScript
        codes = {u.getShortName(i) for i in range(u.CODE_LIMIT)}
        if self.folder and (told := self.folder.table("sc")):
            codes |= set(told[1])
        return sorted(c for c in codes if len(c) == 4 and c not in ("Zyyy", "Zinh", "Zzzz") and self._has(c))

    def _has(self, script: str) -> bool:
        known = self.icu.lang.UScript.getCodeFromName(script) >= 0 or (self.folder and self.folder.ranges("scx", script) is not None)
        return bool(known and self.ranges(f"[:scx={script}:]"))

    @cached_property
    def forms(self) -> Forms:
        """Normal forms and case folding, with the characters that Python's own tables lack."""
        from ..functions.kernels import Forms

        newer = lambda x: [chr(c) for a, b in self.ranges(x) for c in range(a, b + 1) if unicodedata.category(chr(c)) == "Cn"]
        normal, upper = self.icu.text.Normalizer, self.icu.lang.UCharacter
        made = {c: normal.decompose(c, False) for c in newer("[:NFD_QC=No:]")}
        classes = {c: upper.getCombiningClass(ord(c)) for c in newer("[^[:ccc=0:]]")}
        # what is made of three or more is made of one that is composed already, and the last
        halves = {c: normal.compose(d[:-1], False) + d[-1] for c, d in made.items() if len(d) > 1 and normal.compose(d, False) == c}
        pairs = {d: c for c, d in halves.items() if len(d) == 2}
        if self.folder and (told := self.folder.decompositions()):
            own, ranks, excluded = told
            unknown = lambda c: unicodedata.category(c) == "Cn"
            classes |= {c: n for c, n in ranks.items() if unknown(c)}
            pairs |= {d: c for c, d in own.items() if unknown(c) and len(d) == 2 and c not in excluded}

            def whole(text: str) -> str:
                return "".join(whole(own[c]) if c in own else c for c in text)

            made |= {c: whole(d) for c, d in own.items() if unknown(c)}
        folded = {c: upper.foldCase(c, True) for c in newer("[:Changes_When_Casefolded:]")}
        one = lambda found: f"[{''.join(f'\\U{a:08x}-\\U{b:08x}' for a, b in stretches(found))}]" if found else "(?:(?!))"
        marks = {chr(c) for a, b in self.ranges("[^[:lccc=0:]]") for c in range(a, b + 1)} | set(classes)
        apart = {*made, *classes, *"".join(pairs)}
        return Forms({ord(c): d for c, d in made.items()}, classes, pairs, {ord(c): f for c, f in folded.items()}, one(marks), one(apart), one(set(folded)), min({*apart, *folded}, default="\U0010ffff"))

    @cached_property
    def bidi(self):
        """The tables of display order."""
        from ..operators.bidi import bidi_data

        return bidi_data(self)

    @cached_property
    def variations(self) -> dict[str, str] | None:
        """The folder's variation sequences, as set expressions of bases by selector; None without a folder of them."""
        return self.folder.variations() if self.folder else None

    @cached_property
    def prototypes(self) -> dict[str, str]:
        """What each character looks like, if not itself; '' for characters that show as nothing.

        Those of the folder; or the library's (one call: the skeleton of all characters that decompose no further, a
        line each) with the fixed values, and by rule: what looks like a character that has a new prototype looks like
        that prototype; forms of another width, and fractions, look like what they decompose to.
        """
        nothing = {chr(c): "" for a, b in self.ranges("[:DI:]") for c in range(a, b + 1)}
        if self.folder and (told := self.folder.prototypes()) is not None:
            return told | nothing
        lines = [chr(c) for a, b in self.ranges("[:NFD_QC=Yes:]-[\\n]-[:Cs:]") for c in range(a, b + 1)]
        looks = self.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(lines)).split("\n")
        found = {c: s for c, s in zip(lines, looks, strict=True) if c != s} | fixed.PROTOTYPES
        looks_like = lambda text: unicodedata.normalize("NFD", "".join(found.get(c, c) for c in unicodedata.normalize("NFD", text)))
        found |= {c: looks_like(s) for c, s in found.items() if c not in fixed.PROTOTYPES}
        for a, b in self.ranges("[[:dt=Wide:][:dt=Narrow:][:dt=Small:][:dt=Fraction:]]"):
            for c in map(chr, range(a, b + 1)):
                if c not in found and (look := looks_like(unicodedata.normalize("NFKD", c))) != c:
                    found[c] = look
        for a, b in self.ranges("[:dt=Square:]"):
            for c in map(chr, range(a, b + 1)):
                if c not in found and self._squared_plainly(c):
                    found[c] = looks_like(unicodedata.normalize("NFKD", c))
        return {c: s for c, s in found.items() if s != c} | nothing

    @staticmethod
    def _squared_plainly(c: str) -> bool:
        """Whether a squared abbreviation shows letters on one line: no superscripts, no kana, no more than two ideographs."""
        parts = [chr(int(x, 16)) for x in unicodedata.decomposition(c).split()[1:]]
        names = [unicodedata.name(x, "") for x in parts]
        raised = any(unicodedata.decomposition(x).startswith("<super>") for x in parts)
        return bool(parts) and not raised and not any("KATAKANA" in x for x in names) and sum("IDEOGRAPH" in x for x in names) <= 2

    def _indexed(self, named: dict[str, str]) -> tuple[np.ndarray, list[tuple[str, ...]]]:
        """Of set expressions by name: for each code point, the number of the combination of names that it has."""
        index, numbers = np.zeros(0x110000, np.uint16), {(): 0}
        for name, expression in named.items():
            for a, b in self.ranges(expression):
                part, old = index[a : b + 1], list(numbers)
                for i in np.unique(part).tolist():
                    part[part == i] = numbers.setdefault((*old[i], name), len(numbers))
        return index, list(numbers)

    @cached_property
    def script_table(self) -> tuple[np.ndarray, list[list[str]]]:
        """(number of the set by code point, sets): augmented script extensions; ['ALL'] for common and inherited
        characters, ['Zzzz'] for unassigned ones."""

        def augmented(scripts: tuple[str, ...]) -> list[str]:
            if "Zyyy" in scripts or "Zinh" in scripts:
                return ["ALL"]
            return sorted({*scripts, *(x for s in scripts for x in WRITING_SYSTEMS.get(s, []))}) or ["Zzzz"]

        index, found = self._indexed({s: f"[:scx={s}:]" for s in [*self.scripts, "Zyyy", "Zinh"]})
        return index, [augmented(x) for x in found]

    @cached_property
    def alias_table(self) -> tuple[np.ndarray, list[str]]:
        """(number of the name by code point, names): the script's name in capitals, 'Unknown' for unassigned ones."""
        u = self.icu.lang.UScript
        index, found = self._indexed({s: f"[:sc={s}:]" for s in [*self.scripts, "Zyyy", "Zinh"]})
        long = {v: k for k, v in self.folder.aliases("sc").items()} if self.folder else {}
        name = lambda x: long.get(x) or (u.getName(code) if (code := u.getCodeFromName(x)) >= 0 else x)
        return index, [name(x[0]).upper() if x else "Unknown" for x in found]

    def _spread(self, table: tuple[np.ndarray, list], column: str) -> DataFrame:
        """A table as rows (cp, value), without the code points that have none."""
        index, values = table
        at = np.concatenate([[0], np.flatnonzero(np.diff(index)) + 1, [len(index)]])
        rows = [(int(a), int(b) - 1, values[index[a]]) for a, b in zip(at[:-1], at[1:], strict=True) if index[a]]
        kind = "array<string>" if isinstance(values[0], list) else "string"
        return self.spark.createDataFrame(rows, f"first int, last int, {column} {kind}").select(F.explode(F.sequence("first", "last")).alias("cp"), column)

    @cached_property
    def script_sets(self) -> DataFrame:
        """Rows (cp int, scripts array<string>) of `script_table`; code points without a row have ['Zzzz']."""
        return self.stored(self._spread(self.script_table, "scripts"), "script-sets")

    @cached_property
    def aliases(self) -> DataFrame:
        """Rows (cp int, alias string, category string): the script's name in capitals and the general category.

        Cased letters have the category L. Unassigned code points have no row.
        """
        kinds = "Lu Ll Lt Lm Lo Mn Me Mc Nd Nl No Zs Zl Zp Cc Cf Co Pd Ps Pe Pc Po Pi Pf Sm Sc Sk So".split()
        index, found = self._indexed({k: f"[:gc={k}:]" for k in kinds})
        names = ["" if not x else "L" if x[0] in ("Lu", "Ll", "Lt") else x[0] for x in found]
        return self.stored(self._spread(self.alias_table, "alias").join(self._spread((index, names), "category"), "cp"), "aliases")

    @cached_property
    def homoglyphs(self) -> DataFrame:
        """Rows (character string, homoglyphs array<struct<c, n>>): what looks like it, with names, both ways."""
        pairs = [(c, s) for c, s in self.prototypes.items() if s]
        pairs = self.spark.createDataFrame(pairs, "a string, b string")
        both = pairs.union(pairs.select("b", "a")).distinct()
        named = [(c, unicodedata.name(c, None) or self.icu.lang.UCharacter.getName(ord(c))) for c in sorted({c for a, b in self.prototypes.items() if b for c in a + b})]
        names = self.stored(self.spark.createDataFrame(named, "c string, n string").filter("n IS NOT NULL"), "names")
        parts = both.select("a", "b", F.posexplode(F.split("b", "")).alias("i", "c")).filter("c <> ''").join(names, "c")
        named = parts.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("x"))
        named = named.select("a", F.struct(F.col("b").alias("c"), F.array_join(F.transform("x", lambda x: x["n"]), ", ").alias("n")).alias("h"))
        return self.stored(named.groupBy(F.col("a").alias("character")).agg(F.sort_array(F.collect_list("h")).alias("homoglyphs")), "homoglyphs")

    def stored(self, table: DataFrame, name: str) -> DataFrame:
        """A table written once to the shared folder; it has at most one row per code point."""
        from .shared import materialise

        return materialise(table, name)


_SESSIONS: WeakKeyDictionary = WeakKeyDictionary()


def characters(spark: SparkSession) -> Characters:
    """The classes of a session and its folder of Unicode's files, if it names one, made on first use."""
    directory = spark.conf.get(DIRECTORY, None)
    held = _SESSIONS.setdefault(spark, {})
    if directory not in held or held[directory].spark.sparkContext._jsc is None:
        held[directory] = Characters(spark, directory)
    return held[directory]


__all__ = ["EGYPTIAN_SELECTORS", "EMOJI_OF_TWO_STYLES", "RECOMMENDED_SCRIPTS", "VARIANTS", "WRITING_SYSTEMS", "Characters", "characters", "stretches", "tree"]
