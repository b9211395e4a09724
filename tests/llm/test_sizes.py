"""Mixing and splitting, both in tokens of a public tokenizer."""

from __future__ import annotations

import bisect
import random

import pytest

from papyra.llm import mixing, splitting
from papyra.llm.tokens import encoding, with_tokens


def test_counts(spark):
    df = spark.createDataFrame([("one two",), ("",), (None,), ("<|endoftext|>",)], "t string")
    assert [r["n_tokens"] for r in with_tokens(df, "t").collect()][:3] == [2, 0, 0]


def test_pieces_rebuild_the_text_and_keep_the_limit():
    rng = random.Random(1)
    for k in range(12):
        words = [rng.choice(["river", "mountain", "a", "经济的发展", "x" * 40, "naïve"]) for _ in range(900)]
        text = "".join(w + rng.choice([" ", ". ", "。", "\n", "\n\n", ", "]) for w in words) if k else "x" * 9000 + "汉" * 3000
        got = splitting.pieces(text, 200, 20)
        end = 0
        for i, (a, b, n) in enumerate(got):
            assert n == len(encoding().encode_ordinary(text[a:b])) <= 200
            assert (a <= end) if i else a == 0
            if i:
                assert 18 <= len(encoding().encode_ordinary(text[a:end])) <= 26  # the overlap, to whole characters
            end = b
        assert end == len(text) and len(got) > 1


def test_gaps_left_whole_change_no_cut():
    """Cutting every gap at every boundary first gives the same pieces."""
    rng = random.Random(3)
    enc = encoding()
    for _ in range(20):
        text = "".join(rng.choice(["river", "the", "经济", "发展的", "wind"]) + rng.choice([" ", " ", " ", ", ", ". ", "。", "\n", "\n\n"]) for _ in range(rng.randint(50, 700)))
        _, first = enc.decode_with_offsets(enc.encode_ordinary(text))
        room = rng.choice([20, 60, 150])
        fine: dict[int, int] = {0: 9, len(first): 9}
        for strength, pattern in splitting._BOUNDARIES:
            for m in pattern.finditer(text):
                i = bisect.bisect_left(first, m.end())
                if i < len(first):
                    fine.setdefault(i, strength)
        if max(b - a for (a, _), (b, _) in zip(sorted(fine.items()), sorted(fine.items())[1:])) <= room:
            assert splitting.merge(splitting._atoms(text, first, room), room) == splitting.merge(sorted(fine.items()), room)


def test_tiny_limits_hold_or_fail():
    text = "😀汉字 tokens of many bytes 😀😀😀 and more. " * 20
    for limit in (8, 12, 30, 60):
        try:
            got = splitting.pieces(text, limit, limit // 4)
        except ValueError as e:
            assert "take more than" in str(e)
            continue
        assert all(n <= limit for *_, n in got) and got[-1][1] == len(text)


def test_weakest_boundaries_go_first():
    cuts = [(0, 9), (40, 3), (80, 5), (120, 3), (160, 9)]
    assert splitting.merge(cuts, 90) == [0, 80, 160]  # the paragraph stays a cut
    assert splitting.merge(cuts, 200) == [0, 160] and splitting.merge(cuts, 10) == [0, 40, 80, 120, 160]
    assert splitting.pieces("short") == [(0, 5, len(encoding().encode_ordinary("short")))]
    with pytest.raises(ValueError, match="overlap"):
        splitting.pieces("x", 100, 60)


def test_split_table(spark):
    rows = [(1, "river. " * 3000), (2, "short"), (3, None), (4, ""), (1, "river. " * 3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k long, t string, piece string")
    got = splitting.split_texts(df, "k", "t").collect()
    assert {r["k"] for r in got} == {1} and all(r["n_tokens"] <= 2000 for r in got)
    assert splitting.split_texts(df.limit(0), "k", "t").count() == 0


def test_mix_equals_plain_systematic_sampling(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice("aaabbc"), "word " * rng.choice([3, 10, 40])) for i in range(600)]
    docs += [(9001, None, "word"), (9002, "d", "word"), (9003, "a", None), (9004, "a", "")]
    targets = [("a", 0.5, 2), ("b", 0.2, 1), ("c", 0.2, 3), ("e", 0.1, 1), (None, 0.0, 1)]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "k long, source string, t string, copy string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    out, report = mixing.mix(d, t, "k", "t")
    decided = out.collect()
    small, mixing.CELL_ROWS = mixing.CELL_ROWS, 20  # many buckets keep the sums
    try:
        many = mixing.uses(mixing.mix(d, t, "k", "t")[0]).groupBy("source").count().collect()
    finally:
        mixing.CELL_ROWS = small
    assert all(abs(r["count"] - sum(x["copies"] for x in decided if x["source"] == r["source"])) <= 1 for r in many)
    rows, told = mixing.uses(out).collect(), {r["source"]: r for r in report.collect()}
    assert {r["k"] for r in rows}.isdisjoint({9001, 9002, 9003, 9004})
    cap = {"a": 2, "b": 1, "c": 3}
    assert all(r["copy"] <= cap[r["source"]] for r in rows)
    for s in "abc":
        n, copies, r = sum(x[1] == s for x in docs if x[0] < 9000), sum(x["source"] == s for x in rows), told[s]["copies_per_document"]
        assert abs(copies - n * r) <= 1  # one copy for each integer crossed
        assert told[s]["tokens"] == sum(x["n_tokens"] for x in rows if x["source"] == s)
    weights = {"a": 0.5 / 0.9, "b": 0.2 / 0.9, "c": 0.2 / 0.9}
    assert all(abs(told[s]["actual_share"] - w) < 0.02 for s, w in weights.items())
    assert (told["e"]["documents"], told["e"]["actual_share"]) == (0, 0.0)
    assert len(decided) == 600 and sum(r["copies"] for r in decided) == len(rows)
    again = mixing.uses(mixing.mix(d, t, "k", "t")[0])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert mixing.mix(d.limit(0), t, "k", "t")[0].count() == 0 and mixing.mix(d, t.limit(0), "k", "t")[0].count() == 0


def test_plan_respects_caps():
    assert mixing.plan({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 2)]) == {"a": 0.2, "b": 2.0}
    assert mixing.plan({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 2)], total=20) == {"a": 0.1, "b": 1.0}
    assert mixing.plan({}, [("a", 1.0, 1)]) == {}
