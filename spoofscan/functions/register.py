"""SQL names for the checks, made from the Column expressions themselves, and table functions.

A check becomes a temporary SQL function whose body is its expression written as SQL; the kernels in it are registered as
functions too. So SQL and Column users get the same answers from one implementation.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.skeletons import Skeletons, aliases_of, dangerous, homoglyphs_of, mask_scripts, match_class, mixes_aliases, script_mask, script_sets
from . import policy
from .kernels import LEVELS, LOOKS, NAMED, mapped_with
from .text import casefold, nfc, nfd, resolved, text_functions

_INFIX = {"=": "=", "<=>": "<=>", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "and": "AND", "or": "OR", "+": "+", "-": "-", "*": "*", "/": "/", "%": "%", "rlike": "RLIKE"}
_PREFIX = {"!": "NOT {}", "not": "NOT {}", "isNull": "{} IS NULL", "isNotNull": "{} IS NOT NULL", "negative": "- {}"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def sql_text(node) -> str:
    """A column's node as SQL."""
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        name, given = node.functionName(), [sql_text(x) for x in _items(node.arguments())]
        if name in _INFIX and len(given) == 2:
            return f"({given[0]} {_INFIX[name]} {given[1]})"
        return f"({_PREFIX[name].format(*given)})" if name in _PREFIX else f"{name}({', '.join(given)})"
    if kind == "CaseWhenOtherwise":
        cases = " ".join(f"WHEN {sql_text(x._1())} THEN {sql_text(x._2())}" for x in _items(node.branches()))
        return f"CASE {cases} {'ELSE ' + sql_text(node.otherwise().get()) if node.otherwise().isDefined() else ''} END"
    if kind == "Literal":
        return _literal(node.value())
    if kind == "Cast":
        return f"CAST({sql_text(node.child())} AS {node.dataType().sql()})"
    if kind == "Alias":
        return f"{sql_text(node.child())} AS {node.name().head()}"
    if kind == "LambdaFunction":
        names = [sql_text(x) for x in _items(node.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {sql_text(node.function())}"
    if kind == "UnresolvedExtractValue":
        inner = node.extraction()
        field = inner.getClass().getSimpleName() == "Literal" and isinstance(inner.value(), str)
        return f"{sql_text(node.child())}.{inner.value()}" if field else f"{sql_text(node.child())}[{sql_text(inner)}]"
    if kind == "UnresolvedNamedLambdaVariable":
        return node.name()
    if kind == "UnresolvedAttribute":
        return ".".join(_items(node.nameParts()))
    if kind == "ExpressionColumnNode":  # a kernel
        kernel = node.expression()
        return f"{kernel.name()}({', '.join(sql_text(x.node()) for x in _items(kernel.children()))})"
    raise ValueError(f"{kind} has no SQL form here")


def _checks(spark: SparkSession) -> dict[str, tuple[str, str, Column]]:
    """SQL name: (parameters, type, expression)."""
    t, s, c, a, b = text_functions(spark), Skeletons(spark), F.col("s"), F.col("a"), F.col("b")
    text, two = "s STRING", "a STRING, b STRING"
    sets = script_sets(spark, c)
    out = {
        "nfd": (text, "STRING", nfd(c)),
        "nfc": (text, "STRING", nfc(c)),
        "casefold": (text, "STRING", casefold(c)),
        "skeleton": (text, "STRING", s.skeleton(c)),
        "skeleton_rtl": (text, "STRING", s.skeleton(c, "rtl")),
        "skeleton_auto": (text, "STRING", s.skeleton(c, "auto")),
        "internal_skeleton": (text, "STRING", s.internal(c)),
        "display_order": (text, "STRING", s.displayed(c)),
        "script_sets": (text, "ARRAY<ARRAY<STRING>>", sets),
        "resolved_scripts": (text, "ARRAY<STRING>", resolved(sets)),
        "is_mixed_script": (text, "BOOLEAN", F.size(resolved(sets)) == 0),
        "restriction_level": (text, "INT", t.restriction_level(c, sets)),
        "match_class": (two, "STRING", match_class(s.skeleton(a) == s.skeleton(b), script_sets(spark, a), script_sets(spark, b))),
        "identifier_status": (text, "STRING", t.identifier_status(c)),
        "identifier_types": (text, "ARRAY<STRING>", t.identifier_types(c)),
        "is_xid_start": (text, "BOOLEAN", t.is_xid_start(c)),
        "is_xid_continue": (text, "BOOLEAN", t.is_xid_continue(c)),
        "is_allowed": (text, "BOOLEAN", t.is_allowed(c)),
        "is_allowed_with_joiners": (text, "BOOLEAN", t.is_allowed(c, joining_controls=True)),
        "joining_controls_in_context": (text, "ARRAY<BOOLEAN>", t.joining_controls_in_context(c)),
        "decimal_zeros": (text, "ARRAY<STRING>", t.decimal_zeros(c)),
        "has_mixed_numbers": (text, "BOOLEAN", t.has_mixed_numbers(c)),
        "has_repeated_mark": (text, "BOOLEAN", t.has_repeated_mark(c)),
        "has_unlikely_marks": (text, "BOOLEAN", t.has_unlikely_marks(c)),
        "has_hidden_overlay": (text, "BOOLEAN", t.has_hidden_overlay(c)),
        "find_invisible": (text, "ARRAY<STRUCT<pos: INT, kind: STRING>>", t.find_invisible(c)),
        "has_invisible": (text, "BOOLEAN", t.has_invisible(c)),
        "graphemes": (text, "ARRAY<STRING>", t.graphemes(c)),
        "count_graphemes": (text, "INT", t.count_graphemes(c)),
        "bidi_class": (text, "STRING", t.bidi_class(c)),
        "levels": (text, LEVELS, s.levels(c)),
        "levels_rtl": (text, LEVELS, s.levels(c, "rtl")),
        "levels_auto": (text, LEVELS, s.levels(c, "auto")),
        "class_levels": ("s ARRAY<STRING>", LEVELS, s.levels_of_classes(c)),
        "aliases": (text, "ARRAY<STRING>", aliases_of(spark, c)),
        "mixes_aliases": (text, "BOOLEAN", mixes_aliases(aliases_of(spark, c))),
        "homoglyphs": (text, LOOKS, homoglyphs_of(spark, c, greedy=True)),
        "is_dangerous": (text, "BOOLEAN", dangerous(spark, c)),
        "script_mask": (text, "ARRAY<BIGINT>", script_mask(spark, c)),
        "mask_scripts": ("s ARRAY<BIGINT>", "ARRAY<STRING>", mask_scripts(spark, c)),
        "username_keys": (text, "ARRAY<STRING>", s.username_keys(c)),
        "username_problem": (text, "STRING", policy.username_problem_of(t, c)),
        "display_name_problem": (text, "STRING", policy.display_name_problem(t, c)),
        "filename_problem": (text, "STRING", policy.filename_problem(t, s, c)),
    }
    sent = t.chars.shipped("graphemes", t._graphemes)
    for name, method in (("graphemes", "clusters"), ("points", "points"), ("utf8", "bytes"), ("utf16", "units")):
        out[f"truncate_{name}"] = ("s STRING, n INT", "STRING", mapped_with(f"cut_{method}", "string", sent)(c, F.greatest(F.col("n"), F.lit(0))))
    return out


def register(spark: SparkSession, prefix: str = "spoof_") -> list[str]:
    """Make the checks available to SQL under `prefix`, and the table functions; the names that were made.

    Table functions give rows: invisible_rows(text), grapheme_rows(text) and characters_of(text), each under the prefix.
    """
    made = []
    for name, (parameters, kind, column) in _checks(spark).items():
        body = sql_text(column._jc.node())
        for kernel in NAMED:
            if f"{kernel}(" in body:
                spark.udf.register(kernel, NAMED[kernel])
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
        made.append(prefix + name)
    t = text_functions(spark)
    invisible, clusters = t.chars.shipped("invisible", t._invisible), t.chars.shipped("graphemes", t._graphemes)

    @F.udtf(returnType="pos int, kind string")
    class InvisibleRows:
        def eval(self, text: str):
            for x in invisible.value.find(text or ""):
                yield x["pos"], x["kind"]

    @F.udtf(returnType="start int, end int, cluster string")
    class GraphemeRows:
        def eval(self, text: str):
            for x in clusters.value.segments(text or ""):
                yield x["start"], x["end"], x["text"]

    @F.udtf(returnType="pos int, character string, code_point int")
    class CharactersOf:
        def eval(self, text: str):
            for i, c in enumerate(text or ""):
                yield i, c, ord(c)

    for name, function in (("invisible_rows", InvisibleRows), ("grapheme_rows", GraphemeRows), ("characters_of", CharactersOf)):
        spark.udtf.register(prefix + name, function)
        made.append(prefix + name)
    return made
