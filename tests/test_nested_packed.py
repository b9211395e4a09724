from __future__ import annotations

import json
import random

from papyra.operators import nested
from papyra.operators.nested import enclosing_join, flatten, node_table
from papyra.operators.packed import resolve, skeletons, split_packed

ARRAYS = {"items", "parts", "hints"}


def brute(value, path="$", over="$", name="items_root"):
    """Plain recursion that knows the array fields by name."""
    out = []
    if isinstance(value, str) and name in ARRAYS | {"info"}:
        try:
            value = json.loads(value)
        except ValueError:
            return out
    if isinstance(value, dict) and name in ARRAYS:
        value = [value]
    if isinstance(value, list):
        for i, x in enumerate(value):
            if isinstance(x, dict):
                out.append((over, f"{path}[{i}]"))
                for k, v in x.items():
                    out += brute(v, f"{path}[{i}].{k}", f"{path}[{i}]", k)
    elif isinstance(value, dict):
        for k, v in value.items():
            out += brute(v, f"{path}.{k}", over, k)
    return out


def grow(rng, depth=0):
    out = {"id": rng.random(), "text": "[B] {not json"}
    if depth < 4:
        for name in ("items", "parts", "hints"):
            kids = [grow(rng, depth + 1) for _ in range(rng.randint(0, 2))]
            shape = rng.random()
            if kids and shape < 0.2:
                out[name] = kids[0]
            elif kids and shape < 0.35:
                out[name] = json.dumps(kids)
            elif shape < 0.9:
                out[name] = kids if shape < 0.8 else None
        if rng.random() < 0.3:
            out["info"] = {"parts": [grow(rng, depth + 3)]}
    return out


def test_paths_and_parents_equal_plain_recursion(spark):
    rng = random.Random(3)
    records = [grow(rng) for _ in range(60)]
    texts = [json.dumps(r) for r in records]
    texts[1] = "﻿" + texts[1]
    texts[2] = json.dumps(texts[2])
    df = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "id string, body string")
    nodes = flatten(df, "id", "body", "$")
    got = {(r["record_id"], r["parent_path"], r["node_path"]) for r in nodes.collect()}
    want = {(f"r{i}", p, n) for i, r in enumerate(records) for p, n in brute(r, name="")}
    assert got == want
    most, nested.MAX_SHAPES = nested.MAX_SHAPES, 1  # each record joined with its own doubtful fields
    try:
        assert {(r["record_id"], r["parent_path"], r["node_path"]) for r in flatten(df, "id", "body", "$").collect()} == want
    finally:
        nested.MAX_SHAPES = most
    # Interval containment finds the same parents again.
    up = enclosing_join(nodes, nodes).where("outer_depth = depth - 1").collect()
    assert {(r["record_id"], r["outer_node_path"], r["node_path"]) for r in up} == {g for g in got if g[1] != "$"}
    parts = node_table(nodes, "parts")
    assert parts.where("parent_pre >= 0").join(nodes.selectExpr("record_id", "pre as parent_pre"), ["record_id", "parent_pre"], "left_anti").isEmpty()


def test_names_that_carry_data_are_not_doubtful(spark):
    rows = [(str(i), json.dumps({f"key{i}": {"rows": [{"v": i}]}, f"list{i}": [{"v": 1}]})) for i in range(200)] + [("one", '{"key7": {"rows": {"v": 2}}}')]
    df = spark.createDataFrame(rows, "id string, body string")
    assert [tuple(r)[:2] for r in nested.doubtful(nested.shapes(df, "body", "$")).collect()] == [("key7", "rows")]
    got = flatten(df, "id", "body", "$")
    assert got.count() == 401 and got.where("record_id = 'one'").first()["node_path"] == "$.key7.rows[0]"


def test_nested_edge_cases(spark):
    rows = [("a", None), ("b", ""), ("c", "not json"), ("d", "[]"), ("e", '{"x": [1, 2]}'), ("f", '{"x": [{"y": 1}, null, {"y": 2}]}'), ("f", '{"x": [{"y": 1}, null, {"y": 2}]}')]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "id string, body string, node_path string, pre int")
    got = sorted((r["record_id"], r["node_path"]) for r in flatten(df, "id", "body", "$").collect())
    assert got == [("f", "$.x[0]"), ("f", "$.x[2]")]
    assert flatten(df.limit(0), "id", "body", "$").count() == 0
    deep = '{"p": [' * 300 + "{}" + "]}" * 300
    assert flatten(spark.createDataFrame([("z", deep)], "id string, body string"), "id", "body", "$").count() == 300


CASES = {
    "A，D": ["A", "D"], "A, C, E;": ["A", "C", "E"], "(3, 8) ;  5.37\n2,566;": ["(3, 8)", "5.37", "2,566"], "6/17": [], "5,790": [], "f(x, y)=3x+y": [],
    '"steadily, then all at once"': [], "“a;b”; “c”": ["a;b", "c"], '"x ""y"" z", w': ['x "y" z', "w"], "①甲;②乙 ③丙": ["甲", "乙", "丙"],
    "1) 甲\n2) 乙\n3、丙\n4) 丁": ["甲", "乙", "丙", "丁"], "(1) (2, 3)\n(2) y=4x": ["(2, 3)", "y=4x"], "加速仪器 / 延缓卫星": ["加速仪器", "延缓卫星"],
    "a || b": ["a", "b"], ";;a;;b;;": ["a", "b"], "随着公平, 打破了主体。": [], "For x, y; for z, w.": [], "甲（one, two）\t乙": ["甲（one, two）", "乙"], "'a/b'/c": ["a/b", "c"],
    "8,295;0.03|x=9|(7, 8)": ["8,295", "0.03", "x=9", "(7, 8)"], "the boys' list": [], "1、2、3": ["1", "2", "3"], "": [], "   ": [], ";": [],
}


def test_packed_cases(spark):
    rows = list(CASES) + [None]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)] * 2, "k int, t string, value string")
    got: dict[int, list] = {}
    for r in split_packed(df, "t", ["k"]).orderBy("k", "pos").collect():
        got.setdefault(r["k"], []).append(r["value"])
        assert r["pos"] == len(got[r["k"]])
    assert {t: got.get(i, []) for i, t in enumerate(rows) if t is not None} == CASES
    assert split_packed(df.limit(0), "t", ["k"]).count() == 0


def test_long_texts_and_skeletons(spark):
    long = "; ".join(f"word{'x' * (i % 7)} {i}" for i in range(5000)) + '; "' + "q, " * 20_000 + '"'
    df = spark.createDataFrame([(1, long)], "k int, t string")
    assert split_packed(df, "t", ["k"]).count() == 5001
    s = skeletons(spark.createDataFrame([(1, "ab, cd"), (2, "甲，乙"), (3, "xyz, w")], "k int, t string"), "t").collect()
    assert len({r["_skeleton"] for r in s}) == 2  # the words do not matter, the delimiter does
    assert resolve("w, w") == [(0, 1), (3, 4)] and resolve("wT") == []
