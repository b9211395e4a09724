"""Operators on small fixtures: what they give, what they refuse, and edge cases."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from papyra.operators import constraints, relate, sequence, tree


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_latest_ties_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "a", 0), (1, 5, "b", 0), (1, 5, "b", 0), (2, None, None, 1), (None, 1, "n", 2)], "k int, t int, _v string, extra int")
    assert sorted(map(tuple, relate.latest(df, ["k"], ["t"]).collect()), key=str) == sorted([(1, 5, "b", 0), (2, None, None, 1), (None, 1, "n", 2)], key=str)
    assert relate.latest(df.limit(0), ["k"], ["t"]).count() == 0


def test_lookup_refuses_ambiguity(spark):
    asked = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3"), ("n", None)], "id string, no string")
    offered = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "c"), ("1", "a"), (None, "q")], "no string, t string")
    assert rows(relate.classified_lookup(asked, "id", "no", offered, "no", "t")) == [("n", "unresolved", None), ("x", "resolved", "a"), ("y", "ambiguous", None), ("z", "unresolved", None)]


def test_inventory_differences_conflicts_ownership(spark):
    a = spark.createDataFrame([(1, "p", None), (2, "q", 1), (2, "q", 1)], "k int, v string, w int")
    b = spark.createDataFrame([(2, "q", 1), (3, "r", 2), (None, "s", 1)], "k int, v string, w int")
    assert rows(relate.inventory_diff(a, b, "k")) == [(1, "missing"), (3, "extra")]
    c = spark.createDataFrame([(1, "p", None), (2, "x", None)], "k int, v string, w int")
    assert rows(relate.field_differences(a.distinct(), c, "k", ["v", "w"])) == [(2, "v"), (2, "w")]
    assert rows(relate.conflicts(spark.createDataFrame([(1, None), (1, "a"), (2, "b"), (2, "b")], "k int, v string"), "k", ["v"])) == [(1, 2)]
    links = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), (None, 3)], "i string, o int")
    assert rows(relate.owned_once(links, "i", "o")) == [("a", 1)]
    assert rows(relate.outside_set(spark.createDataFrame([(1, ["x", "y"]), (2, [])], "k int, a array<string>"), "k", "a", spark.createDataFrame([("x",)], "x string"), "x")) == [(1, ["y"])]


def test_requested_and_staged_are_all_or_nothing(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert rows(relate.all_requested(df, "k", ["a"])) == [("a", 1)]
    with pytest.raises(Exception, match="do not exist"):
        relate.all_requested(df, "k", ["a", "zz"]).collect()
    good = spark.createDataFrame([("a", 9)], "k string, n int")
    assert rows(relate.attach_checked(df, "k", "v", good, "n", F.col("n") > 0)) == [("a", 9), ("b", 2)]
    for bad in ([("a", -1)], [("zz", 1)], [("a", 5), ("b", None)]):
        with pytest.raises(Exception, match="refused"):
            relate.attach_checked(df, "k", "v", spark.createDataFrame(bad, "k string, n int"), "n", F.col("n") > 0).collect()


def test_overlap_equals_brute_force(spark):
    rng = random.Random(1)
    a = [(i, x, x + rng.choice([0, 1, 30, 300])) for i in range(60) for x in [rng.randint(0, 500)]]
    b = [(i, x, x + rng.choice([0, 5, 80])) for i in range(60) for x in [rng.randint(0, 500)]]
    got = relate.overlapping(spark.createDataFrame(a + [(99, None, 4)], "i int, lo int, hi int"), spark.createDataFrame(b, "j int, p int, q int"), "lo", "hi", "p", "q", 25)
    assert rows(got, "i", "j") == sorted((i, j) for i, l, h in a for j, p, q in b if l <= q and p <= h)


def test_unique_anchor(spark):
    anchors = spark.createDataFrame([(1, "the quick brown fox"), (2, "short"), (3, "in both texts!")], "a int, t string")
    texts = spark.createDataFrame([("x", "see the quick brown fox, in both texts! twice in both texts!"), ("y", "in both texts!"), ("z", None)], "k string, b string")
    assert rows(relate.unique_anchor(anchors, "a", "t", texts, "k", "b")) == [(1, "x")]


def test_fan_out_and_alias(spark):
    df = spark.createDataFrame([(3, None), (1, "a"), (2, "a"), (4, None)], "id int, t string")
    assert rows(relate.fan_out(df, ["t"], F.col("id"), "id"), "id", "representative") == [(1, 1), (2, 1), (3, 3), (4, 3)]
    opts = spark.createDataFrame([(1, None, "X", "p"), (2, 1, None, "p"), (3, 1, None, "q"), (4, 9, None, "p")], "id int, ref int, v string, paper string")
    got = {r["id"]: r["resolved"] for r in relate.resolved_alias(opts, "id", "ref", "v", ["paper"]).collect()}
    assert got == {1: "X", 2: "X", 3: None, 4: None}


def test_as_of_ties_and_tolerance(spark):
    left = spark.createDataFrame([("g", 10), ("g", 20), ("h", 5), ("g", None)], "g string, at int")
    right = spark.createDataFrame([("g", 10, "a"), ("g", 15, "b"), ("g", 22, "c"), ("h", 6, "d")], "g string, at int, v string")
    got = {(r["g"], r["at"]): r["as_of_v"] for r in sequence.as_of(left, right, ["g"], "at", "v").collect()}
    assert got == {("g", 10): "a", ("g", 20): "b", ("h", 5): None, ("g", None): None}
    got = {(r["g"], r["at"]): r["as_of_v"] for r in sequence.as_of(left, right, ["g"], "at", "v", 3).collect()}
    assert got == {("g", 10): "a", ("g", 20): "c", ("h", 5): "d", ("g", None): None}


def test_sequences(spark):
    s = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 5, 3, 6, 6, 9])], "g string, i int, v int")
    assert rows(sequence.running_maxima(s, ["g"], ["i"], "v"), "v") == [(1,), (5,), (6,), (9,)]
    assert rows(sequence.islands(s, ["g"], ["i"], F.col("v") >= 5, 2), "start", "end", "length") == [(4, 6, 3)]
    assert rows(sequence.missing_between(s, ["g"], "v"), "v") == [(2,), (4,), (7,), (8,)]
    assert rows(sequence.not_contiguous(s, ["g"], "v"), "lo", "hi", "n") == [(1, 9, 6)]
    got = spark.createDataFrame([([3, 1, 2, 2, 5, 3],), ([],), (None,)], "a array<int>").select(sequence.consecutive_from_one(F.col("a")).alias("x")).collect()
    assert [r["x"] for r in got] == [[1, 2, 3], [], None]


def test_line_clusters_and_batches(spark):
    spans = spark.createDataFrame([(1, y, i) for i, y in enumerate([10.0, 11.0, 30.0, 10.5, 31.0, 50.0])], "page int, y double, i int")
    got = {r["i"]: r["line"] for r in sequence.line_clusters(spans, ["page"], "y", ["i"], 2.0).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0, 4: 1, 5: 2}
    work = spark.createDataFrame([("p", i, n, s) for i, (n, s) in enumerate([(10, False), (10, False), (10, True), (95, False), (10, False), (1, False), (1, False), (1, False)])], "p string, i int, n int, alone boolean")
    got = {r["i"]: r["batch"] for r in sequence.packed_batches(work, ["p"], ["i"], "n", "alone", 3, 100).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 3, 6: 3, 7: 4}


def test_trees(spark):
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x")], "id string, up string")
    got = rows(tree.descend(nodes, "id", "up", nodes.where("up is null"), "id"), "id", "depth")
    assert got == [("a", 1), ("b", 2), ("c", 2), ("r", 0)]
    assert rows(tree.descend(nodes, "id", "up", nodes.where("id = 'x'"), "id"), "id", "depth") == [("x", 0), ("y", 1)]  # a cycle ends
    assert rows(tree.hidden_below(nodes, "id", "up", nodes.where("id = 'a'"))) == [("a",), ("b",), ("c",)]
    links = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a"), ("u", "z")], "t string, o string")
    assert rows(tree.wholly_owned(links, "t", "o", spark.createDataFrame([("a",), ("b",)], "o string"), "o")) == [("t",)]
    toc = spark.createDataFrame([("p", "s", None, 1), ("p", "q", "s", 2), ("p", "w", "v", 3), ("p", "e", "l", 4), ("p", "l", None, 5)], "p string, k string, up string, at int")
    assert rows(tree.order_violations(toc, ["p"], "k", "up", "at"), "k") == [("e",), ("w",)]
    one = tree.nested(nodes.withColumn("l", F.upper("id")), "id", "up", "l", 2).collect()
    leaf = lambda k: {"id": k, "label": k.upper(), "children": []}
    assert [json.loads(r["tree"]) for r in one] == [{"id": "r", "label": "R", "children": [{"id": "a", "label": "A", "children": [leaf("b"), leaf("c")]}]}]


def test_constraints(spark):
    tables = {"c": spark.createDataFrame([(1, 1, 2), (1, 9, None), (2, None, 0)], "id int, up int, v int"), "p": spark.createDataFrame([(1,)], "id int")}
    rules = [constraints.Unique("c", ("id",)), constraints.Reference("c", "up", "p", "id"), constraints.Check("c", "v", "v > 0", "id")]
    assert rows(constraints.violations(tables.get, rules)) == [("check(v)", "c", "2"), ("unique(id)", "c", "1"), ("up->p.id", "c", "9")]
    assert rows(constraints.totals(tables["c"], {"n": 3, "s": 5}, {"n": "count(*)", "s": "sum(v)"})) == [("s", 5, 2)]
