"""Read views, evidence operators and chunked order on small fixtures, with nulls, ties, empty tables and clashing names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from papyra.functions import text as fx
from papyra.operators import evidence, reading, sequence, tree


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


OPTIONS = "id string, question_id string, label string, source_label string, text string, default_position int, place int"


def options(spark):
    return spark.createDataFrame([("a", "q", "A.", "(1)", "x", 1, 9), ("b", "q", "B.", "(2)", None, 2, 9), ("c", "r", "A.", "(甲)", "y", 1, 9), ("d", "r", "A.", None, "z", 2, 9), ("e", "s", None, None, "w", 1, 9)], OPTIONS)


def test_labels_by_rule(spark):
    o = options(spark)
    assert dict(rows(reading.with_display_labels(o, F.lit(False)), "id", "display_label")) == {"a": "A.", "b": "B.", "c": "(甲)", "d": "A.", "e": None}
    assert dict(rows(reading.with_display_labels(o, F.col("question_id") == "r"), "id", "display_label"))["c"] == "A."
    mixed = reading.shuffled(o.drop("place"), "seed")
    assert rows(mixed, "question_id", "place") == [("q", 1), ("q", 2), ("r", 1), ("r", 2), ("s", 1)]
    shown = reading.with_display_labels(mixed, F.col("question_id") == "r", True, "place")
    assert sorted(x for q, x in rows(shown, "question_id", "display_label") if q == "q") == ["A.", "B."]
    assert rows(mixed) == rows(reading.shuffled(o.drop("place"), "seed"))
    with pytest.raises(ValueError, match="128"):
        reading.shuffled(o, "x" * 129)
    assert reading.with_display_labels(o.limit(0), F.lit(None)).count() == 0


def test_nested_views(spark):
    o = reading.with_display_labels(options(spark), F.lit(False))
    q = spark.createDataFrame([("q", "p", "1", "s1", "clash"), ("r", "p", "2", None, "clash"), ("lone", "p", None, None, "clash")], "id string, paper_id string, number string, stem string, options string")
    b = spark.createDataFrame([("q", "k2", 2, "stem", "t2"), ("q", "k1", 1, "figure", None)], "question_id string, id string, ordinal int, role string, text string")
    a = spark.createDataFrame([("q", "explicit")], "question_id string, status string")
    l = spark.createDataFrame([("q", 2, "late"), ("q", 1, "early")], "question_id string, ordinal int, label string")
    got = {r["id"]: r for r in reading.question_views(q, o, b, a, l).collect()}
    assert [x["id"] for x in got["q"]["options"]] == ["a", "b"] and [x["id"] for x in got["q"]["blocks"]] == ["k1", "k2"] and got["q"]["labels"] == ["early", "late"]
    assert (got["lone"]["options"], got["lone"]["blocks"], got["lone"]["answer_status"]) == ([], [], None)


def test_only_blocks_of_one_owner_are_shown(spark):
    cited = spark.createDataFrame([("q1", "d", "k1", 1), ("q1", "d", "k2", 2), ("q2", "d", "k2", 1), ("q2", "d", "k3", 2), ("q3", "d", "gone", 1), ("q4", "d", "k4", 1), ("q4", "d", "k4", 2), ("q5", "d", "k5", 1)], "question_id string, document_id string, local_id string, place int")
    blocks = spark.createDataFrame([("d", "k1", "1", None, "one"), ("d", "k2", "2", None, "two"), ("d", "k3", "3", None, "three"), ("d", "k4", "4", "duplicate", "four"), ("d", "k5", "5", None, None)], "paper_id string, local_id string, id string, status string, text string")
    assert rows(reading.exclusive_excerpts(cited, blocks)) == [("q1", "one", 1), ("q2", "three", 1)]
    assert reading.exclusive_excerpts(cited.limit(0), blocks).count() == 0


def test_foreign_tails_and_references(spark):
    cases = [("plain", 3, "plain"), ("x 3.【答案】B", 3, "x 3.【答案】B"), ("x *4.【参考答案】 AC ", 3, "x"), ("x 4.【答案】A", 3, None), ("x *4.【答案】A 5.【答案】B", 3, None), ("x *4.【答案】A and more", 3, None), ("x *4.【答案】A", None, None), (None, 3, None), ("", 3, "")]
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(cases)], "i int, t string, n int")
    assert [r["k"] for r in df.select("i", reading.without_foreign_tail(F.col("t"), F.col("n")).alias("k")).orderBy("i").collect()] == [w for *_, w in cases]
    more = [("三、 同第2题", "同第2题", "own", True), ("三、见下 同第2题", "同第2题", "own", False), ("12. 同  第2题", "同 第2题", "own", True), ("三、同第2题", "同第2题", "同第2题", False), ("x", "", "own", False), (None, "a", "b", False)]
    df = spark.createDataFrame([(i, *m[:3]) for i, m in enumerate(more)], "i int, s string, l string, a string")
    assert [r["k"] for r in df.select("i", reading.reference_only(F.col("s"), F.col("l"), F.col("a")).alias("k")).orderBy("i").collect()] == [m[3] for m in more]


def test_hidden_nodes_and_roots(spark):
    nodes = [("p", None, "paper"), ("q", "p", "question"), ("o", "q", "option"), ("a", "q", "answer"), ("s", "a", "subquestion")]
    df = spark.createDataFrame([(f"{k}{i}", None if u is None else f"{k}{u}", k, kind, t) for k, kind in (("x", "questions"), ("y", "complete"), ("z", "answers")) for i, u, t in nodes], "id string, parent_id string, paper_id string, kind string, node_type string")
    links = spark.createDataFrame([("xa", "xo"), ("ya", "yo"), ("za", "zo")], "from_id string, to_id string")
    seen = reading.visible_nodes(df, links)
    assert rows(seen.where("hidden"), "id") == sorted([("xa",), ("xs",), ("ya",), ("yo",), ("ys",), ("za",), ("zo",), ("zq",), ("zs",)])
    assert dict(rows(seen.where("node_type = 'paper'"), "id", "reason")) == {"xp": None, "yp": "unresolved_answer_boundary", "zp": "answer_document_requires_explicit_route"}
    assert reading.root_violations(df).count() == 0
    assert rows(reading.root_violations(df.where("id <> 'xp'").withColumn("parent_id", F.when(F.col("id") == "yp", "ys").otherwise(F.col("parent_id"))))) == [("x", 1), ("y", 0)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", None), ("a", "c")], "f string, t string")
    assert rows(tree.closure(edges, "f", "t", spark.createDataFrame([("a",)], "s string"), "s"), "reached", "steps") == [("a", 0), ("b", 1), ("c", 1)]
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(70)], "f string, t string")  # deeper than any fixed limit
    assert tree.closure(chain, "f", "t", spark.createDataFrame([("0",)], "s string"), "s").agg(F.max("steps")).first()[0] == 70


def test_private_names(spark):
    df = spark.createDataFrame([], "id string, meta struct<answer:string, deep:array<struct<secret:int, ok:int>>>, m map<string, struct<secret:int>>, answer_text string")
    assert reading.private_fields(df, {"answer", "secret"}) == ["meta.answer", "meta.deep[].secret", "m{}.secret"]
    t = spark.createDataFrame([('{"a": {"secret" : 1}, "t": "the word secret"}',), ('{"t": "{\\"answer\\": 2}"}',), (None,), ("x" * 300_000 + '"answer": 1',)], "j string")
    assert [r["k"] for r in t.select(reading.private_keys(F.col("j"), ["answer", "secret"]).alias("k")).collect()] == [["secret"], ["answer"], None, ["answer"]]


def test_guarded_exceptions(spark):
    target = spark.createDataFrame([(1, "x", None, "old"), (2, "y", 5, "old"), (3, "z", 6, "old"), (1, "x", 7, "old")], "k int, a string, b int, c string")
    proof = spark.createDataFrame([(1, "x", None, "new"), (2, "y", 9, "new"), (3, "z", 6, "new"), (3, "z", 6, "new")], "k int, a string, b int, v string")
    got = evidence.guarded_exception(target, ["k"], proof, ["a", "b"], "c", "v")
    assert rows(got) == sorted([(1, "x", 7, "old"), (1, "x", None, "new"), (2, "y", 5, "old"), (3, "z", 6, "old")], key=str)


def test_arrays_batches_and_questions(spark):
    pairs = [(["a", "c"], ["a", "b", "c"], True), (["c", "a"], ["a", "b", "c"], False), (["x"], ["a"], False), ([], ["a"], True)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    assert [r["k"] for r in df.select("i", evidence.subsequence(F.col("a"), F.col("b")).alias("k")).orderBy("i").collect()] == [w for *_, w in pairs]
    parts = spark.createDataFrame([(["one", "two [[2]] in line", "three"],), ([],)], "p array<string>").withColumn("t", evidence.batch_text(F.col("p")))
    got = parts.select(evidence.parsed_batch(F.col("t"), F.size("p")).alias("back"), evidence.parsed_batch(F.concat(F.lit("noise\n"), "t"), F.size("p")).alias("noisy"), evidence.parsed_batch(F.replace("t", F.lit("[[3]]"), F.lit("[[4]]")), F.size("p")).alias("skipped")).collect()
    assert got[0]["back"] == ["one", "two [[2]] in line", "three"] and got[0]["noisy"] is None and got[0]["skipped"] is None
    blocks = [("0", "p", 1, "heading", "Part"), ("1", "p", 2, "stem", "7. What?"), ("2", "p", 3, "option", "A. x"), ("3", "p", 4, "option", None), ("4", "p", 5, "stem", "no number"), ("5", "p", 6, "stem", "8. Why?")]
    df = spark.createDataFrame([(*b, "clash") for b in blocks], "id string, p string, ordinal int, role string, text string, part string")
    assert rows(evidence.printed_questions(df, "p", ["ordinal", "id"])) == [("p", 1, "7", "What?", "A. x", 4), ("p", 2, "8", "Why?", None, 1)]
    spans = spark.createDataFrame([("p", 11.0, 5.0, 1), ("p", 10.0, 9.0, 2), ("p", 40.0, 1.0, 3), ("p", None, 1.0, 4)], "p string, y double, x double, i int")
    assert rows(evidence.reading_order(spans, ["p"], "y", "x", "i", 5.0, 2), "i", "place", "paragraph") == [(1, 2, 0), (2, 3, 0), (3, 4, 1), (4, 1, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_order_by_chunks_equals_order_as_a_whole(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice(["g", "h", None]), i, rng.choice([None, "m", "x"]), rng.randint(0, 3)) for i in rng.sample(range(400), 150)]
    df = spark.createDataFrame(data, "g string, i int, v string, w int")
    chunk, mark = F.floor(F.col("i") / 37), F.col("v") == "m"
    for op in (lambda c: sequence.carry_forward(df, ["g"], ["i"], mark, "w", "out", c), lambda c: sequence.groups_by_gap(df, ["g"], ["i"], mark, "out", c), lambda c: sequence.previous(df, ["g"], ["i"], ["v", "w"], c)):
        assert rows(op(chunk)) == rows(op(None))
        assert op(chunk).columns == op(None).columns
    assert sequence.previous(df.limit(0), ["g"], ["i"], ["v"], chunk).count() == 0


def test_elements_by_selector(spark):
    m = '<div class="a b"><p>one <b>two</b></p><br><p class="b">three</div><p>four'
    df = spark.createDataFrame([(m,), (None,), ("",)], "m string")
    got = df.select(fx.selected(F.col("m"), "p").alias("p"), fx.selected(F.col("m"), of_class="b").alias("b"), fx.selected(F.col("m"), "p", within="div").alias("w")).collect()
    assert tuple(got[0]) == (["one two", "three", "four"], ["one two three", "three"], ["one two", "three"])
    assert tuple(got[1]) == (None, None, None) and tuple(got[2]) == ([], [], [])
