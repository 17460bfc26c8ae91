"""Properties from a folder of Unicode's own data files, of any version, in place of the library's.

A session names the folder in spark.spoofscan.unicode.dir. Each file that is there replaces what the library says of its
properties; files that are missing change nothing. Tables have at most one row a code point, whatever the input.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import ucd

DIRECTORY = "spark.spoofscan.unicode.dir"
#: Files with one property a file, by the property's short name.
WHOLE = {
    "sc": "Scripts.txt", "scx": "ScriptExtensions.txt", "Identifier_Status": "IdentifierStatus.txt", "Identifier_Type": "IdentifierType.txt",
    "gcb": "GraphemeBreakProperty.txt", "InSC": "IndicSyllabicCategory.txt", "jt": "DerivedJoiningType.txt", "bc": "DerivedBidiClass.txt",
    "gc": "DerivedGeneralCategory.txt", "ccc": "DerivedCombiningClass.txt",
}
#: Properties of files with several, by short name: file, name in the file, value ('' of a binary one).
PARTS = {
    "XIDS": ("DerivedCoreProperties.txt", "XID_Start"), "XIDC": ("DerivedCoreProperties.txt", "XID_Continue"),
    "DI": ("DerivedCoreProperties.txt", "Default_Ignorable_Code_Point"), "InCB": ("DerivedCoreProperties.txt", "InCB"),
    "VS": ("PropList.txt", "Variation_Selector"), "Bidi_C": ("PropList.txt", "Bidi_Control"), "Soft_Dotted": ("PropList.txt", "Soft_Dotted"),
    "Unified_Ideograph": ("PropList.txt", "Unified_Ideograph"), "Ideographic": ("PropList.txt", "Ideographic"),
    "Emoji": ("emoji-data.txt", "Emoji"), "Emoji_Presentation": ("emoji-data.txt", "Emoji_Presentation"),
    "Emoji_Component": ("emoji-data.txt", "Emoji_Component"), "Extended_Pictographic": ("emoji-data.txt", "Extended_Pictographic"),
}
_LONG = {"RI": "Regional_Indicator"}


class Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._tables: dict[str, tuple[np.ndarray, list[str]] | None] = {}
        self._lines: dict[str, list | None] = {}

    def file(self, name: str) -> str | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.toString() if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at) else None

    def lines(self, name: str) -> list | None:
        """(first, last, fields) of a file's data lines; None if there is no such file."""
        if name not in self._lines:
            path = self.file(name)
            self._lines[name] = None if path is None else [tuple(r) for r in ucd.lines(self.spark, path).collect()]
        return self._lines[name]

    @property
    def version(self) -> str | None:
        """The version that the first line of a file says."""
        for name in ["confusables.txt", *WHOLE.values()]:
            if path := self.file(name):
                head = " ".join(r.value for r in self.spark.read.text(path).limit(12).collect())
                if m := re.search(r"(?:-|Version: )(\d+\.\d+\.\d+)", head):
                    return m[1]
        return None

    def aliases(self, prop: str) -> dict[str, str]:
        """Long value names to short ones, as far as the folder's PropertyValueAliases.txt has them."""
        path = self.file("PropertyValueAliases.txt")
        return {r.long: r.short for r in ucd.value_aliases(self.spark, path, prop).collect()} if path else {}

    def _short_script(self, name: str) -> str:
        code = self.spark._jvm.com.ibm.icu.lang.UScript.getCodeFromName(name)
        return self.spark._jvm.com.ibm.icu.lang.UScript.getShortName(code) if code >= 0 else name

    def table(self, prop: str) -> tuple[np.ndarray, list[str]] | None:
        """(number by code point, values) of a property with a file of its own: defaults, then the lines."""
        if prop not in self._tables:
            self._tables[prop] = self._read(prop)
        return self._tables[prop]

    def _read(self, prop: str) -> tuple[np.ndarray, list[str]] | None:
        rows = self.lines(WHOLE[prop])
        if rows is None:
            return None
        if prop == "scx":  # scripts, where no extensions are listed
            if (scripts := self.table("sc")) is None:
                return None
            index, values = scripts[0].copy(), list(scripts[1])
        else:
            gaps = ucd.missing(self.spark, self.file(WHOLE[prop])).orderBy("place").collect()
            rows = [(r["first"], r["last"], [r["fields"][-1]]) for r in gaps] + rows
            index, values = np.zeros(0x110000, np.int32), [""]
        short = self.aliases("sc") if prop == "sc" else {}
        numbers = {v: i for i, v in enumerate(values)}
        for first, last, fields in rows:
            value = fields[0]
            if prop == "sc":
                value = short.get(value) or self._short_script(value)
            if value not in numbers:
                numbers[value] = len(values)
                values.append(value)
            index[first : last + 1] = numbers[value]
        return index, values

    def ranges(self, prop: str, value: str | None) -> list[tuple[int, int]] | None:
        """The (first, last) code points with a value; None if the folder doesn't say."""
        if value is None and re.fullmatch("[LMNPSZC][a-z]?", prop):
            prop, value = "gc", prop
        if prop in WHOLE and value is not None:
            if (found := self.table(prop)) is None:
                return None
            names = {value, _LONG.get(value, value)}
            fits = lambda x: not names.isdisjoint(x.split()) or (prop == "gc" and len(value) == 1 and x.startswith(value))
            mask = np.isin(found[0], [i for i, x in enumerate(found[1]) if fits(x)])
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            return [(int(a), int(b) - 1) for a, b in edges.reshape(-1, 2)]
        if prop in PARTS:
            file, name = PARTS[prop]
            if (rows := self.lines(file)) is None:
                return None
            own = [(a, b) for a, b, f in rows if f[0] == name and (value is None or f[1:2] == [value])]
            return own if own or any(f[0] == name for _, _, f in rows) else None
        return None

    def prototypes(self) -> dict[str, str] | None:
        """What each character of confusables.txt looks like."""
        path = self.file("confusables.txt")
        if path is None:
            return None
        return {chr(r["first"]): r["target"] for r in ucd.lines(self.spark, path).select("first", ucd.text_of(F.col("fields")[0]).alias("target")).collect()}

    def mirrors(self) -> dict[str, str] | None:
        """What each mirrored character of BidiMirroring.txt is shown as from right to left."""
        rows = self.lines("BidiMirroring.txt")
        return None if rows is None else {chr(a): chr(int(f[0], 16)) for a, _, f in rows}

    def brackets(self) -> list[tuple[str, str, bool]] | None:
        """(bracket, its pair, whether it opens) of BidiBrackets.txt."""
        rows = self.lines("BidiBrackets.txt")
        return None if rows is None else [(chr(a), chr(int(f[0], 16)), f[1] == "o") for a, _, f in rows]

    def variations(self) -> dict[str, str] | None:
        """Of each selector, the set expression of the bases that it varies."""
        paths = [p for x in ("StandardizedVariants.txt", "emoji-variation-sequences.txt") if (p := self.file(x))]
        if not paths:
            return None
        out: dict[str, set[str]] = {}
        for path in paths:
            for r in ucd.sequences(self.spark, path).filter(F.length("text") == 2).collect():
                out.setdefault(r["text"][1], set()).add(r["text"][0])
        return {s: "".join(f"\\U{ord(b):08X}" for b in sorted(bases)) for s, bases in out.items()}

    def decompositions(self) -> tuple[dict[str, str], dict[str, int], set[str]] | None:
        """(canonical decompositions, combining classes, characters that nothing composes to) of UnicodeData.txt."""
        path = self.file("UnicodeData.txt")
        if path is None:
            return None
        rows = ucd.unicode_data(self.spark, path).filter("combining > 0 OR decomposition <> ''").select("cp", "combining", "decomposition").collect()
        made = {chr(r["cp"]): "".join(chr(int(x, 16)) for x in r["decomposition"].split()) for r in rows if r["decomposition"] and not r["decomposition"].startswith("<")}
        excluded = {chr(c) for a, b, _ in self.lines("CompositionExclusions.txt") or [] for c in range(a, b + 1)}
        return made, {chr(r["cp"]): r["combining"] for r in rows if r["combining"]}, excluded
