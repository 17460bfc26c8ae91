"""Kernels over batches: a repeated text is asked once, and the answers are those of each text by itself."""

import random
import re
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spoofscan.functions.kernels import NAMED, SETTLED, ZWJ, ZWNJ, mapped
from spoofscan.functions.text import text_functions
from spoofscan.operators import bidi
from spoofscan.operators.skeletons import Skeletons
from spoofscan.sources.unicode import characters


class Asked:
    def __init__(self):
        self.texts = []

    def size(self, text):
        self.texts.append(text)
        return [len(text)]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_repeated_texts_are_asked_once(spark, kind):
    asked = Asked()
    mapped("size", "array<int>", SimpleNamespace(value=asked, _jbroadcast=SimpleNamespace(id=lambda: f"asked-{kind}")))
    run = NAMED[f"kernel_size_asked-{kind}"].func
    assert run(pa.array(["ab", None, "", "ab", "c", None, "ab"], kind)).to_pylist() == [[2], None, [0], [2], [1], None, [2]]
    assert asked.texts == ["ab", "", "c"]
    assert run(pa.array(["x", "yz"], kind)).to_pylist() == [[1], [2]]
    assert run(pa.array([], kind)).to_pylist() == []


def test_texts_that_are_no_utf8(spark):
    asked = Asked()
    mapped("size", "array<int>", SimpleNamespace(value=asked, _jbroadcast=SimpleNamespace(id=lambda: "bytes")))
    broken = pa.Array.from_buffers(pa.string(), 2, pa.array([b"a\xff", b"a\xff"], pa.binary()).buffers())
    assert NAMED["kernel_size_bytes"].func(broken).to_pylist() == [[2], [2]] and asked.texts == ["a�"]


@pytest.fixture(scope="module")
def invisible(spark):
    return text_functions(spark)._invisible()


def test_joiners_of_the_texts_scripts_alone_are_tried(invisible):
    """All scripts' contexts at once give the same, but a text costs those of its own scripts."""
    every = {c: "|".join(f"(?:{before}(?={c}{rest}))" for _, before, control, rest in invisible.joiners if control == c) for c in (ZWNJ, ZWJ)}
    plain = {c: re.compile(f"({parts}){c}", re.S) for c, parts in every.items()}
    r, settled = random.Random(3), 0
    alphabets = [list("بحـًاab1"), list("क़्खा॑"), list("ක්ය়্কাক্ষx़")]
    for _ in range(3000):
        pool = [*r.choice(alphabets), *(r.choice(alphabets) if r.random() < 0.3 else ""), ZWNJ, ZWJ, ZWNJ, ZWJ]
        text = "".join(r.choice(pool) for _ in range(r.randrange(1, 30)))
        want = text
        for c in (ZWNJ, ZWJ):
            want = plain[c].sub(rf"\1{SETTLED}", want)
        assert invisible.joined(text) == want, ascii(text)
        settled += want != text
    assert settled > 100
    tried = lambda text: {i for c in text for i in invisible._scripts_joiners(c)}
    assert len(invisible.joiners) > 50 and len(tried(f"x{ZWNJ}y")) < 5 and 0 < len(tried("क्")) < 20


def test_variations_among_other_invisible_characters(invisible):
    assert [x["kind"] for x in invisible.find("\u2764\ufe0f a\ufe0f \u6f22\U000e0100 b\U000e0100 \u1820\u180b")] == ["variation-selector"] * 2


def random_texts(r, data, n, controls):
    kinds = [k for k in range(len(bidi.CLASSES)) if controls or not bidi.CONTROLS[k]]
    members = {k: [chr(c) for c in (data.classes == k).nonzero()[0][:200].tolist() if not 0xD800 <= c < 0xE000] for k in kinds}
    marks = [chr(c) for c in data.marks.nonzero()[0][:200].tolist()]
    more = [list(data.brackets), list(data.mirrors), marks, ["\r\n", "\n", "\r", " ", "\t"]]
    one = lambda: r.choice(r.choice(more) if r.random() < 0.4 else members[r.choice(kinds)])
    return ["".join(one() for _ in range(r.randrange(25))) for _ in range(n)]


@pytest.mark.parametrize("direction", ["ltr", "rtl", "auto"])
def test_texts_displayed_together_are_as_each_alone(spark, monkeypatch, direction):
    data, r = characters(spark).bidi, random.Random(11)
    mixed = random_texts(r, data, 300, False) + random_texts(r, data, 100, True)
    r.shuffle(mixed)
    want = [bidi.display(x, data, direction) for x in mixed]
    assert bidi.display_all(mixed, data, direction) == want and sum(a != b for a, b in zip(mixed, want, strict=True)) > 100
    monkeypatch.setattr(bidi, "MOST_AT_ONCE", 40)
    assert bidi.display_all(mixed, data, direction) == want
    assert bidi.display_all([], data, direction) == [] and bidi.display_all(["", ""], data, direction) == ["", ""]


def test_texts_without_controls_are_never_displayed_one_by_one(spark, monkeypatch):
    looks, names = Skeletons(spark)._sent.value, [f"(name {i}!" for i in range(500)]
    monkeypatch.setattr(bidi, "display", None)
    assert looks.shown_rtl_all(names) == [f"!name {i})" for i in range(500)]
    assert looks.shown_ltr_all(["a(b", "12 \u05d0\u05d1", ""]) == ["a(b", "12 \u05d1\u05d0", ""]


def test_null_and_repeated_texts_in_a_column(spark):
    rows = spark.createDataFrame([(0, "(a!"), (1, None), (2, "(a!"), (3, ""), (4, "\u05d0\u05d1 12")], "id int, t string").coalesce(1)
    got = rows.select("id", Skeletons(spark).displayed(F.col("t"), "rtl").alias("x")).orderBy("id").collect()
    assert [r.x for r in got] == ["!a)", None, "!a)", "", "12 \u05d1\u05d0"]
