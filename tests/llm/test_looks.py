from __future__ import annotations

import random
import unicodedata

import pyarrow as pa

from papyra.llm import glyphs
from papyra.llm.looks import look_classes, same_looks_pairs, with_consistent


def plain(s):
    """Character by character with the standard library."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(glyphs._looks(c) for c in unicodedata.normalize("NFD", s))))


def test_arrays_equal_plain_python():
    rng = random.Random(1)
    spans = ((32, 0x250), (0x300, 0x370), (0x370, 0x530), (0x1E00, 0x2100), (0xAC00, 0xD7A0), (0xFF00, 0xFFEF), (0x1100, 0x1200), (0x900, 0xD00), (0x3000, 0x9FFF))
    pool = [chr(rng.randrange(*rng.choice(spans))) for _ in range(4000)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))) for _ in range(3000)] + ["", "e" + "́" * 3000, "​", "a" * 100_000]
    got = glyphs.consistent(pa.array(texts)).to_pylist()
    assert got == [plain(t) for t in texts]
    assert glyphs.consistent(pa.array(got)).to_pylist() == got


def test_slices_nulls_and_empty_batches():
    a = pa.array([None, "ｘ", "", "é", None, "plain"])
    assert glyphs.consistent(a).to_pylist() == [None, "x", "", "é", None, "plain"]
    assert glyphs.consistent(a[3:5]).to_pylist() == ["é", None]
    assert glyphs.consistent(pa.array([], pa.string())).to_pylist() == []


SAME = [("ｆｕｌｌ　ｗｉｄｔｈ，", "full width,"), ("café", "café"), ("a​b­c﻿", "abc"), ("a b c", "a b c"), ("ѕсоре", "scope"), ("ﬁne", "fine"), ("⼈⺠", "人民"), ("non‑stop", "non-stop"), ("Ⅳ", "IV"), ("ｱ", "ア")]
APART = [("Polish", "polish"), ("exposé", "expose"), ("x²", "x2"), ("①", "1"), ("cannot", "can not"), ("“a”", '"a"'), ("10^2", "102"), ("–", "-")]


def test_what_looks_the_same():
    form = lambda t: glyphs.consistent(pa.array([t])).to_pylist()[0]
    assert [p for p in SAME if form(p[0]) != form(p[1])] == []
    assert [p for p in APART if form(p[0]) == form(p[1])] == []


def test_pairs(spark):
    rows = [("p", "a", "ｘ y"), ("p", "b", "x y"), ("p", "c", "x y"), ("p", "d", "x y"), ("q", "e", "x y"), ("p", "f", None), ("p", "g", ""), ("p", "h", ""), ("p", "i", "X y")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows * 2], "paper string, k string, t string, _form string, _id int")
    got = sorted((r["id_a"], r["id_b"]) for r in same_looks_pairs(look_classes(df, ["paper"], "k", "t"), ["paper"]).collect())
    assert got == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")]
    classes = {r["id"]: r for r in look_classes(df, ["paper"], "k", "t").collect()}
    assert {k: r["links"] for k, r in classes.items()} == {k: sum(k in p for p in got) for k in "abcd"}
    assert same_looks_pairs(look_classes(df.limit(0), ["paper"], "k", "t"), ["paper"]).count() == 0
    assert with_consistent(df, "t", "form").where("k = 'a'").first()["form"] == "x y"
