from __future__ import annotations

import random

import pytest

from papyra.llm import scanned

WORDS = "people government question answer history library economy children different important between morning evening language teacher student mountain river village market".split()
VERBS = "describe consider follow remember understand protect measure discover".split()


def sentence(rng):
    return f"The {rng.choice(WORDS)} will {rng.choice(VERBS)} the {rng.choice(WORDS)} of the {rng.choice(WORDS)} and {rng.choice(VERBS)} every {rng.choice(WORDS)} carefully."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    clean = [(f"c{i}", f"p{i % 40}", " ".join(sentence(rng) for _ in range(3))) for i in range(400)]
    noisy = []
    for i in range(80):
        words = " ".join(sentence(rng) for _ in range(3)).split(" ")
        lines, line = [], ""
        for w in words:
            if len(line) + len(w) > 46:
                if len(w) > 6:
                    lines.append(line + " " + w[:4] + rng.choice("-¬"))
                    line = w[4:]
                else:
                    lines.append(line)
                    line = w
            else:
                line = f"{line} {w}".strip()
        lines.append(line)
        lines[2:2] = [f"— {i} —", "MORNING SHEET  FORM B"]
        noisy.append((f"n{i}", f"p{i % 40}", "\n".join(lines).replace("people", "peop1e").replace("market", "rnarket")))
    return clean, noisy


def test_repairs_noise_and_leaves_the_rest(spark, corpus):
    clean, noisy = corpus
    code = [("k1", "p1", "Some text here about the market and the people of the village.\nfor (i = 0; i < n; i++)\n    s += a[i];\nreturn s;"), ("k2", "p2", "(1) The first item of the list is here.\n(2) The second item of the list is there.")]
    edge = [("e1", "p1", None), ("e2", "p1", ""), ("e3", None, "\n\n"), ("e4", None, "x"), ("e5", "p1", "The people will follow the market. " * 4000)]
    df = spark.createDataFrame([(*r, "clash") for r in clean + noisy + code + edge], "k string, paper string, t string, repaired string")
    headers = spark.createDataFrame([(f"{y} Mock Paper (A) {y}",) for y in range(20)], "t string")
    got = {r["k"]: r for r in scanned.read_scans(df, ["k"], "t", "paper", headers).collect()}
    flagged = {k for k, r in got.items() if r["furniture"] or r["split_word"] or r["misread"]}
    assert {"e1", "e2", "e3"}.isdisjoint(got)
    assert len(flagged & {k for k, *_ in noisy}) == len(noisy)
    assert flagged <= {k for k, *_ in noisy}
    assert [(k, got[k]["repaired"]) for k, _, t in clean + code if got[k]["repaired"] != t] == []
    whole = [k for k, *_ in noisy if "\n" not in got[k]["repaired"] and "—" not in got[k]["repaired"] and "FORM" not in got[k]["repaired"] and "peop1e" not in got[k]["repaired"] and "rnarket" not in got[k]["repaired"]]
    assert len(whole) >= 0.95 * len(noisy)


def test_every_printed_reading_of_an_ideograph_is_offered(spark):
    rng = random.Random(6)
    parts = "未来 土地 木材 道路 上面 农民 城市 河流 保护 土壤 森林 研究 发展 利用 北京 上海".split()
    clean = [(f"c{i}", f"p{i % 20}", "，".join("".join(rng.choice(parts) for _ in range(4)) for _ in range(5)) + "，保护未来的土地和木材在上面。") for i in range(300)]
    bad = [("b1", "p1", "保护末来的土地和木材，研究城市的发展。"), ("b2", "p1", "保护未来的士地和木材，研究城市的发展。"), ("b3", "p1", "保护末材的发展。"), ("b4", "p1", "木材在士面。")]
    df = spark.createDataFrame(clean + bad, "k string, paper string, t string")
    got = {r["k"]: r for r in scanned.read_scans(df, ["k"], "t", "paper").collect()}
    assert got["b1"]["repaired"] == got["b2"]["repaired"] == "保护未来的土地和木材，研究城市的发展。"
    assert (got["b3"]["repaired"], got["b4"]["repaired"]) == ("保护木材的发展。", "木材在上面。")
    assert not any(got[k]["misread"] for k, *_ in clean)


def test_two_letters_read_as_one_are_put_back(spark):
    rng = random.Random(7)
    words = "governance journals concern turnover modernised stubborn include decline".split()
    clean = [(f"c{i}", f"p{i % 20}", f"{sentence(rng)} It shows {rng.choice(words)} and {rng.choice(words)} in the {rng.choice(WORDS)}.") for i in range(400)]
    bad = [("b1", "p1", "The govemance of the village will protect the people."), ("b2", "p1", "The joumals consider the tumover of the market."), ("b3", "p1", "The dedine of the library is a concem.")]
    df = spark.createDataFrame(clean + bad, "k string, paper string, t string")
    got = {r["k"]: r for r in scanned.read_scans(df, ["k"], "t", "paper").collect()}
    assert got["b1"]["repaired"] == "The governance of the village will protect the people."
    assert got["b2"]["repaired"] == "The journals consider the turnover of the market."
    assert got["b3"]["repaired"] == "The decline of the library is a concern."
    assert all(got[k]["misread"] for k, *_ in bad)
    assert not any(got[k]["misread"] for k, *_ in clean)


def test_misreadings_of_no_list_are_learned(spark):
    rng = random.Random(9)
    words = "markets kitchen workshop blanket tracking speaker bookcase network backward thickness".split()
    clean = [(f"c{i}", f"p{i % 20}", f"{sentence(rng)} The {rng.choice(words)} and the {rng.choice(words)} stand by the {rng.choice(words)}.") for i in range(500)]
    bad = [(f"b{i}", f"p{i}", f"The {w.replace('k', 'x')} will protect the people of the village.") for i, w in enumerate(words)]
    assert ("x", "k") not in scanned.MISREAD
    df = spark.createDataFrame(clean + bad, "k string, paper string, t string")
    got = {r["k"]: r for r in scanned.read_scans(df, ["k"], "t", "paper").collect()}
    assert [got[f"b{i}"]["repaired"] for i in range(len(words))] == [f"The {w} will protect the people of the village." for w in words]
    assert not any(got[k]["misread"] for k, *_ in clean)


def test_long_words_and_lists_are_edited_too(spark):
    rng = random.Random(11)
    clean = [(f"c{i}", f"p{i % 20}", f"{sentence(rng)} Responsibilities and communication remain.") for i in range(400)]
    bad = [("b1", "p1", "The resp0nsi6ilitie5 of the vil1age remain."), ("b2", "p1", "(1) The library will remember the peop1e.\n(2) The teacher will follow the rnarket.")]
    df = spark.createDataFrame(clean + bad, "k string, paper string, t string")
    got = {r["k"]: r for r in scanned.read_scans(df, ["k"], "t", "paper").collect()}
    assert got["b1"]["repaired"] == "The responsibilities of the village remain."
    assert got["b2"]["repaired"] == "(1) The library will remember the people.\n(2) The teacher will follow the market."
    assert got["b1"]["misread"] and got["b2"]["misread"] and not got["b2"]["split_word"]


def test_every_form_that_edits_reach_is_found():
    rng = random.Random(2)
    rules = [("rn", "m"), ("m", "rn"), ("1", "l"), ("c", "e"), ("ii", "u")]
    vocabulary = {"".join(rng.choice("rnmelu") for _ in range(rng.randint(2, 6))): 5 for _ in range(300)}
    forms = scanned.Forms(scanned.Counts(vocabulary, __import__("numpy").zeros(0, "int64"), __import__("numpy").zeros(0)), rules)

    def brute(w):
        if not w:
            return {""}
        out = {w[0] + x for x in brute(w[1:])}
        for read, printed in rules:
            if w.startswith(read):
                out |= {printed + x for x in brute(w[len(read) :])}
        return out

    for _ in range(200):
        w = "".join(rng.choice("rnmc1ii") for _ in range(rng.randint(1, 7)))
        assert set(forms.of(w)) == (brute(w) & set(vocabulary)) - {w}
    assert scanned.operation("rn", "m") == "delete" and scanned.operation("m", "rn") == "insert" and scanned.operation("1", "l") == "replace"


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, paper string, t string")
    assert scanned.read_scans(df, ["k"], "t", "paper").count() == 0


def test_perceptron_learns_and_averages():
    data = [([f"x={i % 3}", f"y={i % 5}"], i % 3 == 1) for i in range(300)]
    p = scanned.Perceptron().fit(data)
    assert all((p.score(f) > 0) == y for f, y in data)
