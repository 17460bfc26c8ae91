"""Ready-made acceptance policies: the first reason why a name can't be accepted, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skeletons import Skeletons, script_sets
from .text import TextFunctions, is_text, text_functions

#: What the policies say. Fixed values.
OUTSIDE, SCRIPTS, NUMBERS, PILED_OR_HIDDEN = (
    "a character outside the identifier profile",
    "scripts that are not used together",
    "digits from different number systems",
    "combining marks that pile up or hide",
)
NOT_TEXT, INVISIBLE, PILED, TOO_LONG, EXTENSION = (
    "not Unicode text",
    "an invisible or control character",
    "combining marks that pile up",
    "too long",
    "a reader would see a different extension",
)
HIGHLY_RESTRICTIVE = 3


def username_problem_of(t: TextFunctions, name: Column) -> Column:
    """The problem of a username, handle or slug; null if there is none or the name is null."""
    level = t.restriction_level(name, script_sets(t.chars.spark, name))
    return (
        F.when(~t.is_allowed(name), OUTSIDE)
        .when(level > HIGHLY_RESTRICTIVE, SCRIPTS)
        .when(t.has_mixed_numbers(name), NUMBERS)
        .when(t.has_unlikely_marks(name) | t.has_hidden_overlay(name), PILED_OR_HIDDEN)
    )


def username_problem(df: DataFrame, name: str, out: str = "problem") -> DataFrame:
    """`df` with `username_problem_of` a name. A column `out` is replaced."""
    return df.withColumn(out, username_problem_of(text_functions(df.sparkSession), F.col(name)))


def display_name_problem(t: TextFunctions, name: Column, raw: Column | None = None, graphemes: int = 50, utf8_bytes: int = 200) -> Column:
    """The problem of a display name. `raw`, its bytes as received, is tested for being text at all."""
    name = name if raw is None else F.when(is_text(raw), name)
    reason = F.when(t.has_invisible(name), INVISIBLE).when(t.has_unlikely_marks(name), PILED)
    reason = reason.when(t.truncate(name, graphemes, max_utf8_bytes=utf8_bytes) != name, TOO_LONG)
    return reason if raw is None else F.when(~is_text(raw), NOT_TEXT).otherwise(reason)


def filename_problem(t: TextFunctions, s: Skeletons, name: Column, raw: Column | None = None) -> Column:
    """The problem of an uploaded file's name: the extension that a reader sees must be the one it has."""
    name = name if raw is None else F.when(is_text(raw), name)
    dot = F.length(name) - F.length(F.substring_index(name, ".", -1))
    extension = F.substring(name, dot, F.length(name))
    hidden = name.contains(".") & ~F.endswith(s.skeleton(name), s.skeleton(extension))
    reason = F.when(t.has_invisible(name), INVISIBLE).when(hidden, EXTENSION)
    return reason if raw is None else F.when(~is_text(raw), NOT_TEXT).otherwise(reason)
