"""The checks on a text column against plain versions, ICU's own algorithms, and laws; on texts made at random from a seed.

The few worked examples are those of the specifications, cited where they stand.
"""

import random
import re
import unicodedata
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from spoofscan.functions import policy
from spoofscan.functions.text import casefold, is_ascii, nfc, nfd, resolved, text_functions
from spoofscan.operators import skeletons as S
from spoofscan.operators.bidi import display, paragraph_levels, visual_order
from spoofscan.sources.unicode import characters

ZWNJ, ZWJ, ZWSP = "\u200c", "\u200d", "\u200b"
#: Characters by what they try: letters of several scripts, marks of several classes, emoji and what joins them, digits of
#: several systems, invisible and control characters, Hangul and Indic syllables, new characters.
ALPHABETS = {
    "letters": "abIl1mrn éßİаоαο\u05d0\u0645\u4e00\u3042\uac00",
    "marks": "aioı\u0301\u0300\u0307\u0323\u0327\u0338\u20ddḷé\u0345\u05b0\u05c1",
    "emoji": "a❤\ufe0f\ufe0e\u200d\U0001f600\U0001f468\U0001f3fd\U0001f1fa\U0001f1f8\u20e3#",
    "digits": "a1\u0661۱১１²①\U0001d7d9",
    "hidden": "a \t\n\x85\u00ad\u200b\u200c\u200d\u2066\u202e\u061c\ufeff\u3164\u180b\U000e0041\ufe0f",
    "syllables": "\u1100\u1161\u11a8\uac00\uac01\u0915\u094d\u0937\u093e\u0d15\u0d4d\u200d\u0e33\u0600\r\n",
    "new": "\U00016121\U0001611e\U00016129\U000105d2\u0307\U00016d63\U00016d67a\U00011382\U000113c9\u0301\U00010d50",
}


def samples(name, n=250, most=9, seed=1):
    r = random.Random(f"{name}{seed}")
    return ["".join(r.choices(ALPHABETS[name], k=r.randrange(0, most))) for _ in range(n)]


EVERY = [x for name in ALPHABETS for x in samples(name)]


def answers(spark, columns, texts):
    """Of each text, what each of the columns gives."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, s string").repartition(4)
    out = df.select("i", *[c(F.col("s")).alias(f"c{k}") for k, c in enumerate(columns)]).collect()
    rows = [r[1:] for r in sorted(out)]
    assert all(x is None for x in rows[-1]), "null for null"
    return rows[:-1]


# --- normal forms ---


def test_normal_forms_and_case_folding_are_icu_s(spark):
    icu = spark._jvm.com.ibm.icu
    got = answers(spark, [nfd, nfc, casefold], EVERY)
    for text, (d, c, folded) in zip(EVERY, got, strict=True):
        assert d == icu.text.Normalizer.decompose(text, False), ascii(text)
        assert c == icu.text.Normalizer.compose(text, False), ascii(text)
        assert folded == icu.lang.UCharacter.foldCase(text, True), ascii(text)


def test_filters_pass_below_the_checks(spark, tmp_path):
    """A filter on another column reaches the scan, whatever is made of the text."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, f"té{i}") for i in range(9)], "k long, s string").write.parquet(path)
    t, s, c = text_functions(spark), S.Skeletons(spark), F.col("s")
    wide = spark.read.parquet(path).select("k", nfd(c).alias("d"), s.skeleton(c).alias("x"), t.is_allowed(c).alias("a"), t.find_invisible(c).alias("i"), t.count_graphemes(c).alias("g"))
    for df in (wide, S.spoof_report(spark.read.parquet(path), "s"), policy.username_problem(spark.read.parquet(path), "s")):
        plan = df.filter("k = 5")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(k,5)" in plan, plan
        assert df.filter("k = 5").count() == 1


# --- numbers and marks ---


def plain_zeros(text):
    return list(dict.fromkeys(chr(ord(c) - unicodedata.decimal(c)) for c in text if unicodedata.category(c) == "Nd"))


def plain_runs(text):
    """The runs of nonspacing and enclosing marks of the decomposed text."""
    is_mark = lambda c: unicodedata.category(c) in ("Mn", "Me")
    return [list(run) for mark, run in groupby(unicodedata.normalize("NFD", text), is_mark) if mark]


def test_numbers_and_marks(spark):
    t = text_functions(spark)
    texts = samples("digits") + samples("marks") + samples("letters")
    got = answers(spark, [t.decimal_zeros, t.has_mixed_numbers, t.has_repeated_mark, t.has_unlikely_marks], texts)
    for text, (zeros, mixed, repeated, unlikely) in zip(texts, got, strict=True):
        assert zeros == plain_zeros(text) and mixed == (len(zeros) > 1), ascii(text)
        twice = any(len(set(run)) < len(run) for run in plain_runs(text))
        assert repeated == twice, ascii(text)
        assert unlikely == (twice or any(len(run) > 4 for run in plain_runs(text))), ascii(text)


def plain_overlay(text):
    """A dot above with no mark of class 0 or 230 between it and a character with a dot of its own, or one that looks so."""
    text = unicodedata.normalize("NFD", text)
    for k, c in enumerate(text):
        if c == "\u0307":
            j = k - 1
            while j >= 0 and unicodedata.combining(text[j]) not in (0, 230):
                j -= 1
            if j >= 0 and text[j] in "ijlıI1":
                return True
    return False


def test_hidden_overlay(spark):
    texts = [x for x in samples("marks", 400) + ["I\u0307", "1\u0307", "İ"]]
    got = answers(spark, [text_functions(spark).has_hidden_overlay], texts)
    assert [x for (x,) in got] == [plain_overlay(x) for x in texts] and 20 < sum(x for (x,) in got) < len(got)


# --- invisible characters ---


def plain_kinds(text):
    """Without contexts: every candidate."""
    out = []
    for i, c in enumerate(text):
        if unicodedata.category(c) == "Cc":
            out.append((i, "control"))
        elif c in "\u061c\u2066\u202e":
            out.append((i, "bidi-control"))
        elif c in "\u00ad\u200b\ufeff\u3164":
            out.append((i, "default-ignorable"))
        elif c in ZWNJ + ZWJ:
            out.append((i, "join-control"))
        elif c == "\U000e0041":
            out.append((i, "tag"))
        elif c in "\u180b\ufe0f":
            out.append((i, "variation-selector"))
    return out


def test_invisible_characters_without_contexts(spark):
    t, texts = text_functions(spark), samples("hidden", 400)
    got = answers(spark, [t.find_invisible, t.has_invisible], texts)
    for text, (found, any_) in zip(texts, got, strict=True):
        assert [(x.pos, x.kind) for x in found] == plain_kinds(text) and any_ == bool(found), ascii(text)


def flag(name):
    return "\U0001f3f4" + "".join(chr(0xE0000 + ord(c)) for c in name) + "\U000e007f"


def test_invisible_characters_with_a_job(spark):
    """Contexts of UTS #39 section 3.1.1.1 (A1, A2, B), of UAX #29 GB11, of UTS #51's flags, and variation sequences."""
    t = text_functions(spark)
    arabic, devanagari = "\u0628" + ZWNJ + "\u062d", "\u0926\u094d" + ZWNJ + "\u092f"
    good = [arabic, devanagari, "\u0936\u094d" + ZWJ, "\U0001f469" + ZWJ + "\U0001f680", "\U0001f469\U0001f3fd" + ZWJ + "\U0001f680", flag("gbsct"), "☃\ufe0f", "#\ufe0e", "\u9089\U000e0104", "\u1000\ufe00", "∩\ufe00", "\U0001f3e0\ufe0e", "：\ufe01", "\U00013091\ufe00", "\u4e0d\ufe00"]
    bad = {"\u0628" + ZWNJ + "x": 1, "\u0926" + ZWNJ + "\u092f": 1, "\u0936\u094d" + ZWJ + "\u093f": 1, "x" + ZWJ + "y": 1, "\U0001f469" + ZWJ: 1, flag("usca"): 5, "q\ufe0f": 1, "☃\ufe0f\ufe0f": 1, "\U0001f9ff\ufe0f": 1}
    got = answers(spark, [t.find_invisible, t.has_invisible, t.joining_controls_in_context], [*good, *bad])
    assert [(len(a), b) for a, b, _ in got[: len(good)]] == [(0, False)] * len(good)
    assert [len(a) for a, _, _ in got[len(good) :]] == list(bad.values()) and all(b for _, b, _ in got[len(good) :])
    assert got[0][2] == [True] and got[len(good)][2] == [False]
    allowed = answers(spark, [lambda c: t.is_allowed(c), lambda c: t.is_allowed(c, joining_controls=True)], [arabic, "a" + ZWNJ + "b", "ab"])
    assert allowed == [(False, True), (False, False), (True, True)]


def test_variation_sequences_of_every_base(spark):
    """Each compatibility ideograph's sequence, and emoji of both styles, are variation sequences."""
    t, per, texts = text_functions(spark), {}, []
    for cp in [*range(0xF900, 0xFB00), *range(0x2F800, 0x2FA20)]:
        base = unicodedata.normalize("NFD", chr(cp))
        if base != chr(cp):
            per[base] = per.get(base, 0) + 1
            texts.append(base + chr(0xFE00 + per[base] - 1))
    assert len(texts) > 900
    assert not any(x for (x,) in answers(spark, [t.has_invisible], texts))
    assert all(x for (x,) in answers(spark, [t.has_invisible], [b + chr(0xFE00 + n) for b, n in per.items()]))


# --- graphemes ---


def icu_clusters(spark, text):
    breaks = spark._jvm.com.ibm.icu.text.BreakIterator.getCharacterInstance()
    breaks.setText(text)
    units, out, a = text.encode("utf-16-le"), [], 0
    while (b := breaks.next()) != -1:
        out.append(units[2 * a : 2 * b].decode("utf-16-le"))
        a = b
    # newer rules join a consonant to a linker whatever stands before that (GB9c)
    joined = []
    for c in out:
        if joined and re.search("[\u094d\u0d4d]\u200d*$", joined[-1]) and c[0] in "\u0915\u0937\u0d15":
            joined[-1] += c
        else:
            joined.append(c)
    return joined


def test_graphemes_are_icu_s(spark):
    t = text_functions(spark)
    texts = [x for n in ("letters", "marks", "emoji", "syllables", "hidden") for x in samples(n, 120)]
    got = answers(spark, [t.graphemes, t.count_graphemes, lambda c: t.graphemes(c, 1, -1), lambda c: t.grapheme_segments(c, 1)], texts)
    for text, (clusters, n, inner, segments) in zip(texts, got, strict=True):
        assert clusters == icu_clusters(spark, text) and n == len(clusters), ascii(text)
        assert inner == icu_clusters(spark, text[1:-1]), ascii(text)
        assert [(x.start, x.end, x.text) for x in segments] == [(x.start, x.end, text[x.start : x.end]) for x in segments]
        assert [x.text for x in segments] == icu_clusters(spark, text[1:])


def plain_cut(clusters, graphemes=None, points=None, utf8=None, utf16=None):
    kept = ""
    for k, c in enumerate(clusters, 1):
        longer = kept + c
        sizes = (k, len(longer), len(longer.encode()), len(longer.encode("utf-16-le")) // 2)
        if any(most is not None and n > most for n, most in zip(sizes, (graphemes, points, utf8, utf16), strict=True)):
            break
        kept = longer
    return kept


@pytest.mark.parametrize("limits", [(0, None, None, None), (3, None, None, None), (None, 4, None, None), (None, None, 7, None), (None, None, None, 5), (4, 6, 9, 8)])
def test_truncate(spark, limits):
    t, texts = text_functions(spark), [x for n in ("letters", "emoji", "syllables") for x in samples(n, 80)] + ["plain text", "a\r\nb\r\n"]
    g, p, u8, u16 = limits
    got = answers(spark, [t.graphemes, lambda c: t.truncate(c, g, max_code_points=p, max_utf8_bytes=u8, max_utf16_units=u16)], texts)
    for text, (clusters, kept) in zip(texts, got, strict=True):
        assert kept == plain_cut(clusters, *limits), ascii(text)


def test_truncate_needs_sane_limits(spark):
    t = text_functions(spark)
    with pytest.raises(TypeError):
        t.truncate(F.col("s"))
    with pytest.raises(ValueError, match="negative"):
        t.truncate(F.col("s"), -1)


# --- display order ---

BIDI = "ab\u05d0\u05d1\u062712\u0661 +,.()[]!\u0301\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\t\x00"


def test_levels_are_icu_s(spark):
    """Levels and order of random paragraphs, against ICU's own engine."""
    data, java = characters(spark).bidi, spark._jvm
    r = random.Random(4)
    for k in range(500):
        text = "".join(r.choices(BIDI, k=r.randrange(1, 25)))
        for base, code in ((0, 0), (1, 1), (None, 126)):
            engine = java.com.ibm.icu.text.Bidi()
            engine.setPara(text, code, None)
            level, levels = paragraph_levels(text, data, base)
            assert level == engine.getParaLevel(), ascii(text)
            same = (lambda x: x) if engine.getDirection() == 2 else (lambda x: x % 2)  # of text all one way, ICU says the parity alone
            assert [same(x) for x in levels.tolist()] == [same(x) for x in engine.getLevels()], (k, base, ascii(text))
            assert visual_order(levels).tolist() == [x for x in engine.getVisualMap()], ascii(text)


def test_depth_and_bracket_limits(spark):
    """Isolates beyond the largest level stay in their run (X5a, BD13); with too many open brackets none is paired (BD16)."""
    data = characters(spark).bidi
    deep = "\u2067\u2066" * 63 + "\u05d01\u2066a\u2069b"
    _, levels = paragraph_levels(deep, data, 0)
    assert levels.max() <= 126 and len(set(levels[-5:].tolist())) <= 2
    at = lambda text: paragraph_levels(text, data, 1)[1].tolist()
    assert at("\u05d0(a)b" + "[" * 10)[1] == 1 and at("\u05d0(b)" + "[" * 64)[3] == at("\u05d0.b." + "[" * 64)[3]


def test_long_texts_take_linear_time(spark):
    import time

    data = characters(spark).bidi
    took = []
    for n in (4_000, 16_000):
        text = "\u2068\u05d0 (a) 12\u2069, b\u202b\u05d1\u202c [\u0661]" * (n // 20)
        began = time.perf_counter()
        assert len(display(text, data, "ltr")) == len(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.2


def test_display(spark):
    """Whole texts: paragraphs, mirrors and marks; UAX #9's introduction has the first example in capitals."""
    s = S.Skeletons(spark)
    hebrew = "\u05d0\u05d1\u05d2"
    shown = {"car means " + hebrew + ".": "car means " + hebrew[::-1] + ".", f"{hebrew}(1)": f"(1){hebrew[::-1]}", "x\n" + hebrew: "x\n" + hebrew[::-1], f"{hebrew}<b": f"{hebrew[::-1]}<b", f"\u05d0\u05b0\u05d1": "\u05d1\u05d0\u05b0", "plain (text)": "plain (text)"}
    got = answers(spark, [s.displayed, lambda c: s.displayed(c, "auto"), lambda c: s.displayed(c, "rtl")], list(shown))
    assert [x[0] for x in got] == list(shown.values())
    assert got[4][1] == got[4][2] == "\u05d1\u05d0\u05b0" and got[1][2] == f"(1){hebrew[::-1]}"
    with pytest.raises(ValueError, match="direction"):
        s.displayed(F.col("s"), "up")


# --- skeletons and classes of pairs ---


def test_skeleton_laws(spark):
    """Skeletons stay when taken again, and are the same for equivalent forms; ASCII texts in the JVM as in the kernel."""
    s = S.Skeletons(spark)
    wide = spark.createDataFrame([(x,) for x in EVERY], "s string").withColumn("k", s.internal(F.col("s")))
    d, c = s.internal(nfd(F.col("s"))), s.internal(nfc(F.col("s")))
    assert wide.filter((s.internal(F.col("k")) != F.col("k")) | (d != F.col("k")) | (c != F.col("k"))).count() == 0
    printable = "".join(map(chr, range(128)))
    kernel = s._kernel("ltr")
    pairs = [printable, *("".join(random.Random(i).choices(printable, k=12)) for i in range(100))]
    assert all(a == b for a, b in answers(spark, [s.skeleton, kernel], pairs))


def test_skeletons(spark):
    """Examples of UTS #39 section 4: paypal, and whole-script, mixed-script and single-script confusables."""
    s = S.Skeletons(spark)
    got = answers(spark, [s.skeleton, lambda c: s.skeleton(c, "rtl")], ["pаypаl", "ljeto", "ǉeto", "z\u200bero", "½", "(", "\u05d0("])
    assert got[0][0] == "paypal" and got[1][0] == got[2][0] and got[3][0] == "zero" and got[4][0] == "l/2" and got[5] == ("(", ")")
    pairs = [("ljeto", "ǉeto", "single-script"), ("scope", "ѕсоре", "whole-script"), ("paypal", "pаypаl", "mixed-script"), ("abc", "abd", None), (None, "a", None)]
    out = S.match_pairs(spark.createDataFrame([(*x, 0, "x") for x in pairs], "a string, b string, want string, _sa int, row string"), "a", "b")
    assert out.columns == ["a", "b", "want", "_sa", "row", "match"] and all(r.match == r.want for r in out.collect())
    assert {r.want: r.m for r in out.select("want", S.is_mixed_match(F.col("match")).alias("m")).collect()} == {"single-script": False, "whole-script": True, "mixed-script": True, None: None}


def test_mirrored_characters_in_a_right_to_left_paragraph(spark):
    """Every mirrored character looks, right to left, like its mirror left to right."""
    mirrors, s = characters(spark).bidi.mirrors, S.Skeletons(spark)
    pairs = spark.createDataFrame(sorted(mirrors.items()), "a string, b string")
    assert pairs.filter(s.skeleton(F.col("a"), "rtl") != s.skeleton(F.col("b"))).count() == 0 and len(mirrors) > 400


# --- scripts, levels, profile ---


def test_script_sets(spark):
    table = {r.cp: r.scripts for r in characters(spark).script_sets.filter(F.col("cp").isin(66, 50, 0x4E00, 0x30A2, 0x662)).collect()}
    assert table[66] == ["Hntl", "Latn"] and table[50] == ["ALL"] and table[0x4E00] == ["Hanb", "Hani", "Hntl", "Jpan", "Kore"]
    assert table[0x30A2] == ["Jpan", "Kana"] and "Arab" in table[0x662]
    df = spark.createDataFrame([("b\U000dfffe", 1), ("\u30a2\u4e00", 2), ("12", 3), (None, 4)], "s string, sets int")
    got = {r.sets: (r.r, r.m) for r in S.is_mixed_script(S.with_scripts(df, "s"), "s", "m").select("sets", resolved(F.col("script_sets")).alias("r"), "m").collect()}
    assert got == {1: ([], True), 2: (["Jpan"], False), 3: (["ALL"], False), 4: (None, None)}


def plain_level(text, allowed, scripts):
    """UTS #39 section 5.2, from the script set of each character."""
    if not allowed:
        return 6
    if text.isascii():
        return 1
    sets = [set(scripts[ord(c)]) for c in text if scripts[ord(c)] != ["ALL"]]
    if not sets or set.intersection(*sets):
        return 2
    rest = [x for x in sets if "Latn" not in x]
    if any(all(system in x for x in rest) for system in ("Kore", "Hanb", "Jpan")):
        return 3
    common = set.intersection(*rest) - {"Cyrl", "Grek"} if rest else set()
    return 4 if common & {"Arab", "Armn", "Beng", "Deva", "Hebr", "Thai", "Hang", "Hani", "Hira", "Kana"} else 5


def test_levels(spark):
    t = text_functions(spark)
    alphabet = "ab1éабα\u05d0\u0645\u0915\u4e00\u3042\uac00 _"
    r = random.Random(2)
    texts = ["".join(r.choices(alphabet, k=r.randrange(0, 4))) for _ in range(400)]
    scripts = {r.cp: r.scripts for r in characters(spark).script_sets.filter(F.col("cp").isin([ord(c) for c in alphabet])).collect()}
    df = S.with_scripts(spark.createDataFrame([(x,) for x in texts], "s string"), "s")
    rows = df.select("s", t.restriction_level(F.col("s"), F.col("script_sets")).alias("level"), t.is_allowed(F.col("s")).alias("ok")).collect()
    assert all(x.ok == (" " not in x.s) and x.level == plain_level(x.s, x.ok, scripts) for x in rows)
    assert {x.level for x in rows} == {1, 2, 3, 4, 5, 6}


def test_single_characters(spark):
    t = text_functions(spark)
    asks = [t.identifier_status, t.identifier_types, t.is_xid_start, t.is_xid_continue, t.bidi_class]
    texts = ["k", "7", "_", "\u05d1", "\u0663", " ", "\ue001", "\u3402", "\u4e8c"]
    got = dict(zip(texts, answers(spark, asks, texts), strict=True))
    assert got["k"] == ("Allowed", ["Recommended"], True, True, "L") and got["7"][2:] == (False, True, "EN")
    assert got["_"][3] and got["\u05d1"][4] == "R" and got["\u0663"][4] == "AN" and got[" "][0] == "Restricted" and got[" "][4] == "WS"
    assert got["\ue001"][1] == ["Not_Character"] and got["\u4e8c"][0] == "Allowed" and got["\u3402"][:2] == ("Restricted", ["Uncommon_Use"])


def test_profile_under_equivalence(spark):
    """What is allowed composed is allowed decomposed."""
    t = text_functions(spark)
    wide = spark.createDataFrame([(x,) for x in EVERY], "s string").withColumn("d", nfd(F.col("s"))).withColumn("e", nfc(F.col("s")))
    for check in (t.is_allowed, t.has_unlikely_marks, t.has_hidden_overlay, t.has_mixed_numbers, t.has_invisible):
        assert wide.filter(~check(F.col("d")).eqNullSafe(check(F.col("e")))).count() == 0, check


# --- script names and homoglyphs ---


def test_homoglyphs(spark):
    texts = [("xορ", 1), ("plain", 2), ("сат", 3), ("ü", 4), ("", 5), (None, 6)]
    df = spark.createDataFrame(texts, "s string, n int").withColumn("_row", F.lit(1))
    every = {r.n: r.homoglyphs for r in S.homoglyph_report(df, "s", greedy=True, preferred=("latin",)).collect()}
    assert [x.character for x in every[1]] == ["ο", "ρ"] and [x.alias for x in every[3]] == ["CYRILLIC"] * len(every[3])
    assert every[4] == [] and every[5] == [] and every[6] is None
    first = {r.n: r.homoglyphs for r in S.homoglyph_report(df, "s", preferred=("latin",)).collect()}
    assert first[1] == every[1][:1] and ("o", "LATIN SMALL LETTER O") in [(h.c, h.n) for h in first[1][0].homoglyphs]
    names = {r.n: r.aliases for r in S.with_aliases(df, "s").collect()}
    assert names[1] == ["GREEK", "LATIN"] and names[3] == ["CYRILLIC"] and names[5] == [] and names[6] is None
    danger = {r.n: r.is_dangerous for r in S.is_dangerous(df, "s", preferred=("latin",)).collect()}
    assert danger == {1: True, 2: False, 3: False, 4: False, 5: False, 6: None}
    alias = {r.cp: (r.alias, r.category) for r in characters(spark).aliases.filter(F.col("cp").isin(90, 46, 0x302, 0xA0, 0x379)).collect()}
    assert alias == {90: ("LATIN", "L"), 46: ("COMMON", "Po"), 0x302: ("INHERITED", "Mn"), 0xA0: ("COMMON", "Zs")}


# --- policies, joins, groups ---


def test_policies(spark):
    t, s = text_functions(spark), S.Skeletons(spark)
    users = [("mary-jane.7", None), ("no spaces", policy.OUTSIDE), ("mаry", policy.SCRIPTS), ("7१", policy.NUMBERS), ("j\u0307an", policy.PILED_OR_HIDDEN), (None, None)]
    df = spark.createDataFrame(users, "n string, want string").withColumn("sets", F.lit(1)).withColumn("row", F.lit(2))
    assert all(r.problem == r.want for r in policy.username_problem(df, "n").collect())
    shown = {"Zoë \U0001f468\u200d\U0001f469\u200d\U0001f467": None, "Zo\u2060e": policy.INVISIBLE, "e\u0302\u0302": policy.PILED, "y" * 51: policy.TOO_LONG}
    assert [x for (x,) in answers(spark, [lambda c: policy.display_name_problem(t, c)], list(shown))] == list(shown.values())
    files = {"notes.txt": None, "\u05d2\u05d3.doc": None, "song\u202e3pm.exe": policy.INVISIBLE, "\u05d2.\u05d3": policy.EXTENSION, "README": None}
    assert [x for (x,) in answers(spark, [lambda c: policy.filename_problem(t, s, c)], list(files))] == list(files.values())
    raw = spark.createDataFrame([(b"\xc3(",), (b"Zoe",)], "b binary").select(policy.display_name_problem(t, F.col("b").cast("string"), F.col("b")).alias("p")).collect()
    assert [r.p for r in raw] == [policy.NOT_TEXT, None]


def test_joins_groups_and_protected_names(spark):
    a = spark.createDataFrame([(1, "rоot", "x"), (2, "guest", "x"), (3, None, "x"), (1, "rоot", "x")], "i int, x string, look_a string")
    b = spark.createDataFrame([(7, "root"), (8, "r00t"), (9, None)], "j int, y string")
    assert sorted((r.i, r.j) for r in S.lookalike_join(a, b, "x", "y").collect()) == [(1, 7), (1, 7)]
    assert [r.i for r in S.lookalike_join(a, b, "x", "y", how="left_semi").collect()] == [1, 1]
    assert sorted(r.i for r in S.lookalike_join(a, b, "x", "y", how="left_anti").collect()) == [2, 3]
    groups = S.lookalike_groups(a.select("x").union(b.select("y")), "x").collect()
    assert [(r.skeleton, r.n_rows, r.n_texts) for r in groups] == [("root", 3, 2)]
    names = [("оps", True), ("OPS", True), ("opsy", False), (None, False)]
    df = spark.createDataFrame(names, "n string, want boolean").withColumn("key", F.lit("x")).withColumn("hit1", F.lit(3))
    assert all(r.is_protected == r.want for r in S.protected(df, "n", ["ops", "root"]).collect())


def test_report_keeps_odd_rows(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("a", 2), ("a", 2), ("x\u0301" * 3000, 3)], "s string, sets int").withColumn("_sets", F.lit("mine")).withColumn("text", F.lit(1))
    out = S.spoof_report(df, "s")
    assert out.count() == 5 and S.spoof_report(df.filter("false"), "s").count() == 0
    assert {r._sets for r in out.collect()} == {"mine"} and out.filter("s IS NULL").head().restriction_level is None


def test_is_ascii(spark):
    assert answers(spark, [is_ascii], ["abc", "é", ""]) == [(True,), (False,), (True,)]
