"""The steps that need Python: small functions of one text, which Spark runs over Arrow batches.

They hold patterns and small tables made on the driver from the session's Unicode data; patterns are compiled once a worker.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple
from unicodedata import combining, normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

ZWNJ, ZWJ = "\u200c", "\u200d"
#: A noncharacter that stands, while a text is judged, for a character whose context allows it.
SETTLED = "\ufdd0"


@lru_cache(maxsize=None)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.S)


#: The kernels made so far, by the name that Spark knows them by.
NAMED: dict = {}


def mapped(of: str, kind: str, sent):
    """An Arrow function of a text column: a method, by name, of a broadcast value; null for null.

    A text that a batch repeats is asked once, and a method with a twin for lists, named with `_all`, is asked for all at
    once. The function's name tells which broadcast it asks, so kernels of several
    sessions or versions of the data stand side by side.
    """
    made = _arrow(kind)

    def run(texts: pa.Array) -> pa.Array:
        one, many = getattr(sent.value, of), getattr(sent.value, f"{of}_all", None)
        values, places = _distinct(texts)
        if many:
            given = iter(many([x for x in values if x is not None]))
            found = pa.array([None if x is None else next(given) for x in values], made)
        else:
            found = pa.array([None if x is None else one(x) for x in values], made)
        return found if places is None else found.take(places)

    run.__name__ = f"kernel_{of}_{sent._jbroadcast.id()}"
    NAMED[run.__name__] = F.arrow_udf(run, kind)
    return NAMED[run.__name__]


def mapped_with(of: str, kind: str, sent):
    """The same of a text column and a number column; null where one of them is."""
    made = _arrow(kind)

    def run(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        one = getattr(sent.value, of)
        return pa.array([None if x is None or n is None else one(x, n) for x, n in zip(_values(texts), numbers.to_pylist(), strict=True)], made)

    run.__name__ = f"kernel_{of}_{sent._jbroadcast.id()}"
    NAMED[run.__name__] = F.arrow_udf(run, kind)
    return NAMED[run.__name__]


def _distinct(column: pa.Array) -> tuple[list, pa.Array | None]:
    """A batch's distinct texts and each row's place among them (null for null); all values and None if nothing repeats."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        return _values(column), None
    once = column.dictionary_encode()
    if len(once.dictionary) == len(column):
        return _values(column), None
    return _values(once.dictionary), once.indices


def _values(column: pa.Array) -> list:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:  # a string of the JVM can hold bytes that aren't UTF-8
        return [None if x is None else x.decode(errors="replace") for x in column.cast(pa.binary()).to_pylist()]


#: The types of what find_invisible, grapheme_segments, homoglyphs and levels give.
FOUND, SEGMENTS = "array<struct<pos:int,kind:string>>", "array<struct<start:int,end:int,text:string>>"
LOOKS = "array<struct<character:string,alias:string,homoglyphs:array<struct<c:string,n:string>>>>"
LEVELS = "struct<base:int,levels:array<int>,order:array<int>>"


def _arrow(kind: str) -> pa.DataType:
    """The Arrow type of a Spark type."""
    return to_arrow_type(_parse_datatype_string(kind))


def only(condition: Column, text: Column, of, otherwise: Column) -> Column:
    """`of(text)` where `condition` holds, else `otherwise`; other texts aren't sent to Python. Null for null."""
    return F.when(condition, of(F.when(condition, text))).when(text.isNotNull(), otherwise)


#: From so many marks in a row on, their order is found here: the library's own sort takes the square of their number.
LONG_RUN = 24


class Forms(NamedTuple):
    """Normal forms and case folding (UAX #15): Python's own, and tables of characters that only the session's data knows.

    Normal forms of characters that are assigned never change, so the two agree on all others. `marks` is a class of all
    characters whose decompositions begin with a mark, `newer` of those that Python's tables lack or join otherwise, `folds`
    of those that fold otherwise; `lowest` is the first character of `newer` and `folds`.
    """

    decomposed: dict[int, str]
    classes: dict[str, int]
    composed: dict[str, str]
    folded: dict[int, str]
    marks: str
    newer: str
    unfolded: str
    lowest: str

    def _has(self, pattern: str, text: str) -> bool:
        return bool(compiled(f"[{self.lowest}-\U0010ffff]").search(text) and compiled(pattern).search(text))

    def rank(self, mark: str) -> int:
        return self.classes.get(mark) or combining(mark)

    def in_order(self, run: str) -> str:
        """Marks, decomposed, in canonical order: dealt to one pile a class, which keeps the order in each."""
        piles: dict[int, list[str]] = {}
        rank = {c: self.rank(c) for c in set(run)}
        for c in run:
            piles.setdefault(rank[c], []).append(c)
        return "".join("".join(piles[n]) for n in sorted(piles))

    def _settled(self, text: str) -> str:
        """The text with long runs of marks decomposed and in order, so that the library has nothing to move in them."""

        def settle(m) -> str:
            return self.in_order("".join(map(parts.__getitem__, m[0])))

        found = compiled(f"{self.marks}{{{LONG_RUN},}}")
        if not found.search(text):
            return text
        parts = {c: self.decomposed.get(ord(c)) or normalize("NFD", c) for c in set(text)}
        return found.sub(settle, text)

    def nfd(self, text: str) -> str:
        if not self._has(self.newer, text):
            return normalize("NFD", self._settled(text))
        plain = normalize("NFD", self._settled(text.translate(self.decomposed)))
        return compiled(f"{self.marks}{{2,}}").sub(lambda m: self.in_order(m[0]), plain)

    def _joined(self, first: str, second: str) -> str | None:
        """The one character that two make, if any."""
        if known := self.composed.get(first + second):
            return known
        made = normalize("NFC", first + second)
        return made if len(made) == 1 and first else None

    def _with_marks(self, letter: str, marks: str) -> tuple[str, str]:
        """A letter joined with its marks, and the marks that are left.

        Only the first mark that is left of a class bars others, those of its own class: marks stand in order of class.
        """
        left = []
        for _, same in groupby(marks, self.rank):
            same = deque(same)
            while same and (made := self._joined(letter, same[0])):
                letter = made
                same.popleft()
            left.extend(same)
        return letter, "".join(left)

    def nfc(self, text: str) -> str:
        if not self._has(self.newer, text):
            return normalize("NFC", self._settled(text))
        done: list[tuple[str, str]] = []  # (letter, marks left) of each segment
        for m in compiled(f"((?!{self.marks}).)?({self.marks}*)").finditer(self.nfd(text)):
            letter, marks = m[1] or "", m[2]
            if letter and done and not done[-1][1] and (made := self._joined(done[-1][0], letter)):
                letter = made
                done.pop()
            done.append(self._with_marks(letter, marks) if letter else ("", marks))
        return "".join(map("".join, done))

    def folds(self, text: str) -> str:
        if not self._has(self.unfolded, text):
            return text.casefold()
        return "".join(self.folded.get(ord(c)) or c.casefold() for c in text)


class Graphemes(NamedTuple):
    """Extended grapheme clusters by one pattern; `run` matches characters that are each a cluster by themselves."""

    cluster: str
    run: str

    def clusters(self, text: str) -> list[str]:
        return compiled(self.cluster).findall(text)

    def segments(self, text: str) -> list[dict]:
        return [{"start": m.start(), "end": m.end(), "text": m[0]} for m in compiled(self.cluster).finditer(text)]

    def count(self, text: str) -> int:
        found = compiled(f"({self.run})|{self.cluster}").finditer(text)
        return sum(m.end() - m.start() if m.lastindex else 1 for m in found)

    def cut(self, text: str, limits: tuple[int | None, ...]) -> str:
        """The longest start of whole clusters within the limits of clusters, characters, UTF-8 bytes and UTF-16 units."""
        sizes, kept = [0, 0, 0, 0], 0
        for m in compiled(self.cluster).finditer(text):
            c = m[0]
            for i, n in enumerate((1, len(c), len(c.encode()), len(c.encode("utf-16-le")) // 2)):
                sizes[i] += n
            if any(most is not None and n > most for n, most in zip(sizes, limits, strict=True)):
                break
            kept = m.end()
        return text[:kept]

    def cut_clusters(self, text: str, n: int) -> str:
        return self.cut(text, (n, None, None, None))

    def cut_points(self, text: str, n: int) -> str:
        return self.cut(text, (None, n, None, None))

    def cut_bytes(self, text: str, n: int) -> str:
        return self.cut(text, (None, None, n, None))

    def cut_units(self, text: str, n: int) -> str:
        return self.cut(text, (None, None, None, n))


class Invisible(NamedTuple):
    """Invisible and control characters, and the contexts in which some of them have a visible job.

    `joiners` are (class of the script's own characters, '' if it has none; what stands before, the control, what must
    follow); `variations` (bases, selectors); `kinds` (class, name), the first that fits. `known` holds, of each character
    met so far, the numbers of the joiners of its scripts.
    """

    forms: Forms
    candidates: str
    contextual: str
    joiners: list[tuple[str, str, str, str]]
    emoji: tuple[str, str]
    tags: list[str]
    variations: list[tuple[str, str]]
    kinds: list[tuple[str, str]]
    known: dict[str, list[int]]

    def _scripts_joiners(self, c: str) -> list[int]:
        if c not in self.known:
            self.known[c] = [i for i, (own, *_) in enumerate(self.joiners) if not own or compiled(own).match(c)]
        return self.known[c]

    def joined(self, text: str) -> str:
        """The text with the joining controls settled whose contexts need them.

        A script none of whose own characters stands in the text has no context there but those of all scripts. No context
        holds a control but its last character, so they don't touch each other and come one after the other.
        """
        if ZWNJ in text or ZWJ in text:
            for i in sorted({i for c in set(text) for i in self._scripts_joiners(c)}):
                _, before, control, rest = self.joiners[i]
                if control in text:
                    text = compiled(f"({before}){control}{rest}").sub(rf"\1{SETTLED}", text)
        return text

    def settled(self, text: str) -> str:
        """The text with every invisible character settled that has a visible job."""
        text = self.joined(text)
        picture, extend = self.emoji
        if ZWJ in text:
            text = compiled(f"({picture}{extend}*){ZWJ}(?={picture})").sub(rf"\1{SETTLED}", text)
        for flag in self.tags:
            text = text.replace(flag, flag[0] + SETTLED * (len(flag) - 1))
        for bases, selectors in self.variations:
            if compiled(selectors).search(text):
                text = compiled(f"({bases}){selectors}").sub(rf"\1{SETTLED}", text)
        return text

    def controls(self, text: str) -> list[bool]:
        """Of each joining control, in order, whether its context allows it."""
        return [c == SETTLED for c in self.joined(self.forms.nfc(text)) if c in (ZWNJ, ZWJ, SETTLED)]

    def allowed_controls_gone(self, text: str) -> str:
        return self.joined(self.forms.nfc(text)).replace(SETTLED, "")

    def _found(self, text: str) -> Iterator[re.Match]:
        every = compiled(self.candidates).finditer(text)
        if not compiled(self.contextual).search(text):
            return every
        # contexts are judged on the composed text; its n-th candidate is the n-th of the text as given
        judged = compiled(f"{self.candidates}|{SETTLED}").findall(self.settled(self.forms.nfc(text)))
        return (m for m, c in zip(every, judged, strict=False) if c != SETTLED)

    def find(self, text: str) -> list[dict]:
        return [{"pos": m.start(), "kind": self.kind(m[0])} for m in self._found(text)]

    def kind(self, c: str) -> str:
        return next(name for pattern, name in self.kinds if compiled(pattern).match(c))

    def any(self, text: str) -> bool:
        return next(iter(self._found(text)), None) is not None
