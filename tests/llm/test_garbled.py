from __future__ import annotations

import pytest

from papyra.llm import garbled

EN = "The café in Zürich was naïve, they said — “quite so” for £40 … and no more."
ZH = "随着经济的发展，人们逐渐改变了对教育的看法，这一趋势表明社会正在进步。"


def broken(text, e, d, times=1):
    for _ in range(times):
        raw = text.encode(e)
        if d == "gb18030":
            text = raw.decode("gb18030", "replace")
        else:
            back: dict[int, str] = {}
            for o, b in garbled._bytes_of(d).items():
                back.setdefault(b, chr(o))
            text = "".join(back[b] for b in raw)
    return text


@pytest.mark.parametrize("chain", [c for c in garbled.CHAINS if c[1] == "utf-8" and c[2] not in ("gb18030",)], ids=lambda c: c[0])
def test_exact_round_trip(chain):
    name, e, d, times = chain
    for text in (EN, ZH):
        assert garbled.repair(broken(text, e, d, times), name) == text


def test_other_chains():
    assert garbled.repair(broken(ZH, "gb18030", "cp1252"), "gbk_cp1252") == ZH
    assert garbled.repair("a na茂ve r茅sum茅", "utf8_gbk") == "a naïve résumé"
    assert garbled.proposals("plain") == {} and garbled.proposals("betw\xad\xadeen") == {}
    assert garbled.repair("之前锟斤拷锟斤拷之后", "utf8_gbk") == "之前����之后"  # replacement characters read wrongly once more
    part = "前面的话" + ZH[:6].encode().decode("gb18030") + "后面的话"
    assert garbled.repair(part, "utf8_gbk") == "前面的话" + ZH[:6] + "后面的话"


def test_posteriors(spark):
    clean = [(f"c{i}", f"p{i % 5}", t) for i, t in enumerate([EN, ZH, EN.replace("café", "crèche"), ZH[::-1]] * 60)]
    bad = [("x1", "p1", broken(EN, "utf-8", "cp1252")), ("x2", "p2", ZH + broken(ZH, "utf-8", "mac_roman")), ("x3", "p1", "lost caf� here"), ("x4", "p3", broken(ZH, "gb18030", "cp1252")), ("x5", None, broken(EN, "utf-8", "cp1252", 2))]
    # Pairs of raised digits could be one ideograph each; few as they are, their posterior must stay below that of clean text.
    clean += [(f"d{i}", "p4", "F. 54 KB  G. ²¹%的公平") for i in range(3)] + [(f"q{i}", f"p{i}", "A. 10²  B. m³ 的体积") for i in range(4)]
    bad += [("x6", "p0", "锟斤拷锟斤拷" + ZH)]
    edge = [("n", "p1", None), ("e", "p1", ""), ("a", None, "ascii"), ("l", "p4", ZH * 3000)]
    df = spark.createDataFrame([(*r, "clash") for r in (clean + bad + edge) * 2], "k string, paper string, t string, chain string")
    got = {r["k"]: r["chain"] for r in garbled.posteriors(df, "k", "t", ["paper"]).collect() if r["chain"]}
    assert got == {"x1": "utf8_cp1252", "x2": "utf8_mac", "x3": "lost", "x4": "gbk_cp1252", "x5": "utf8_cp1252_twice", "x6": "utf8_gbk"}
    fixed = spark.createDataFrame([(t, got[k]) for k, _, t in bad], "t string, c string").select(garbled.repaired("t", "c").alias("r")).collect()
    assert [r["r"] for r in fixed][:2] == [EN, ZH + ZH]
    assert garbled.posteriors(df.limit(0), "k", "t", ["paper"]).count() == 0
