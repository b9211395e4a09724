"""Nested records to flat node tables by interval labels.

Every record is walked depth first; each object gets a pre-order and a post-order number, so
one node encloses another exactly if its interval does. Parent links come from the intervals
(a sweep in pre-order that pops intervals that have closed), not from the walk's stack, and
any ancestor can later be found by ``enclosing_join``.

Shape repairs, all read from the data: an object alone where other records hold an array is
element 0; JSON kept as text in place of an object or array counts as that object or array
(also of a whole record, also encoded more than once); a byte order mark is dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Set

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Doubtful (parent field, field) pairs that are collected; with more of them each record is given its own by a join.
MAX_SHAPES = 20_000

NODES = "record_id string, type string, pre int, post int, depth int, node_path string, parent_pre int, parent_path string, body string"


def _parse(text: object) -> object:
    """The value of JSON text; None if it is none. Text that encodes text is opened again."""
    value = text
    while isinstance(value, str):
        bare = value.lstrip("﻿ \t\r\n")
        if bare[:1] not in ("{", "[", '"'):
            return None
        try:
            value = json.loads(bare)
        except ValueError:
            return None
    return value if isinstance(value, (dict, list)) else None


def _opened(value: object) -> object:
    return _parse(value) if isinstance(value, str) and value.lstrip("﻿ \t\r\n")[:1] in ("{", "[", '"') else value


def _shapes_of(root: object, name: str) -> set[tuple[str, str, str]]:
    """(parent field, field, kind) with kind ``array`` (of objects), ``object``, or ``text`` that may hold JSON; ``inner`` for what stands within such text."""
    out, todo = set(), [("", name, root, False)]
    while todo:
        parent, field, v, within = todo.pop()
        if isinstance(v, str):
            v = _parse(v)
            if v is None:
                continue
            out.add((parent, field, "text"))
            for x in v if isinstance(v, list) else [v]:
                if isinstance(x, dict):
                    todo += [(field, k, y, True) for k, y in x.items() if isinstance(y, (dict, list, str))]
        elif isinstance(v, dict):
            out.add((parent, field, "inner" if within else "object"))
            todo += [(field, k, x, within) for k, x in v.items() if isinstance(x, (dict, list, str))]
        else:
            if not within and any(isinstance(x, dict) for x in v):
                out.add((parent, field, "array"))
            for x in v:
                if isinstance(x, dict):
                    todo += [(field, k, y, within) for k, y in x.items() if isinstance(y, (dict, list, str))]
                elif isinstance(x, str):
                    todo.append((parent, field, x, within))
    return out


def shapes(df: DataFrame, text: str, root: str) -> DataFrame:
    """Distinct (parent, field, kind) over all records: where arrays, objects and text that may hold JSON occur."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str, str]] = set()
        for b in batches:
            for t in b["_t"]:
                if (v := _parse(t)) is not None:
                    seen |= _shapes_of(v, root)
            if len(seen) > MAX_SHAPES:  # field names that carry data: pass them on
                yield pd.DataFrame(sorted(seen), columns=["parent", "field", "kind"])
                seen = set()
        yield pd.DataFrame(sorted(seen), columns=["parent", "field", "kind"])

    return df.select(F.col(text).alias("_t")).where("_t is not null").mapInPandas(run, "parent string, field string, kind string").distinct()


def doubtful(found: DataFrame) -> DataFrame:
    """(parent, field, is_array, is_object) of the fields that hold different kinds in different places.

    Only they need a look at other records; a field that is an array wherever it occurs is one, and so are
    names that carry data, which occur with one kind.
    """
    kinds = found.groupBy("parent", "field").agg(F.collect_set("kind").alias("_k"))  # four kinds at most
    has = lambda k: F.array_contains("_k", k)
    return kinds.where(F.size("_k") > 1).select("parent", "field", has("array").alias("is_array"), (has("object") & ~has("array")).alias("is_object"))


def label(root: object, name: str, arrays: Set[tuple[str, str]], objects: Set[tuple[str, str]]) -> list[list]:
    """[type, pre, post, depth, path, object] of each object that is an array element, in pre-order.

    Iterative, so nesting depth is not bounded by the interpreter's stack.
    """
    nodes: list[list] = []
    clock = 0
    todo: list = [("field", "", name, root, "$", 0)]
    while todo:
        item = todo.pop()
        if isinstance(item, list):  # a node whose descendants are done
            item[2] = clock
            clock += 1
            continue
        kind, parent, field, v, path, depth = item
        if kind == "field":
            known = (parent, field) in arrays
            if isinstance(v, str):
                v = _opened(v) if known or (parent, field) in objects else None
            if isinstance(v, dict) and known:
                v = [v]
            if isinstance(v, list):
                for i in range(len(v) - 1, -1, -1):
                    x = _opened(v[i]) if known and isinstance(v[i], str) else v[i]
                    if isinstance(x, (dict, list)):
                        todo.append(("element" if isinstance(x, dict) else "field", parent, field, x, f"{path}[{i}]", depth))
                continue
        elif isinstance(v, dict):
            node = [field, clock, -1, depth + 1, path, v]
            clock += 1
            depth += 1
            nodes.append(node)
            todo.append(node)
        if isinstance(v, dict):
            todo += [("field", field, k, x, f"{path}.{k}", depth) for k, x in reversed(v.items()) if isinstance(x, (dict, list, str))]
    return nodes


def _own(x: dict) -> str:
    """The scalar fields of an object as JSON; nested ones are nodes of their own or stay text."""
    return json.dumps({k: v for k, v in x.items() if not isinstance(v, list) or not any(isinstance(y, dict) for y in v)}, ensure_ascii=False)


def flatten(df: DataFrame, key: str, text: str, root: str, known: DataFrame | None = None, with_body: bool = True) -> DataFrame:
    """The node table: one row for each child record at any depth, with interval labels.

    ``record_id, type`` (the array's field), ``pre, post, depth, node_path, parent_pre``
    (-1 under the root), ``parent_path`` and ``body`` (its own fields as JSON; null without
    ``with_body``). Null, blank and malformed texts give no rows; rows repeated with the same key
    and text count once. ``known`` is a ``doubtful`` table over more records than ``df``; by default
    it is taken from ``df``. Columns of ``df`` other than the two named are ignored.

    The doubtful fields are collected up to MAX_SHAPES; where there are more, each record is joined with
    those of its own fields, so none is left out.
    """
    known = known if known is not None else doubtful(shapes(df, text, root))
    found = known.limit(MAX_SHAPES + 1).collect()
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t is not null")
    if len(found) > MAX_SHAPES:
        rows, arrays, objects = _with_own(rows, root, known), set(), set()
    else:
        arrays = {(r["parent"], r["field"]) for r in found if r["is_array"]}
        objects = {(r["parent"], r["field"]) for r in found if r["is_object"]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            own = b["_own"] if "_own" in b else [None] * len(b)
            for record, t, mine in zip(b["_k"], b["_t"], own, strict=True):
                if (v := _parse(t)) is None:
                    continue
                a, o = (arrays, objects) if mine is None else ({(x["parent"], x["field"]) for x in mine if x["is_array"]}, {(x["parent"], x["field"]) for x in mine if x["is_object"]})
                open_: list[list] = []
                for node in label(v, root, a, o):
                    kind, pre, post, depth, path, x = node
                    while open_ and open_[-1][2] < pre:  # its interval has closed: it encloses nothing more
                        open_.pop()
                    over = open_[-1] if open_ else None
                    out.append((record, kind, pre, post, depth, path, over[1] if over else -1, over[4] if over else "$", _own(x) if with_body else None))
                    open_.append(node)
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=_COLUMNS)
                    out = []
            yield pd.DataFrame(out, columns=_COLUMNS)

    return rows.mapInPandas(run, NODES).dropDuplicates(["record_id", "node_path", "pre"])


def _with_own(rows: DataFrame, root: str, known: DataFrame) -> DataFrame:
    """(_k, _t, _own): each record with the doubtful fields among those it holds, also in JSON kept as text."""

    def fields(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            seen: set[tuple[str, str]] = set()
            todo = [("", root, _parse(t))]
            while todo:
                parent, field, v = todo.pop()
                if isinstance(v, str):
                    v = _opened(v)
                if isinstance(v, dict):
                    seen.add((parent, field))
                    todo += [(field, k, x) for k, x in v.items() if isinstance(x, (dict, list, str))]
                elif isinstance(v, list):
                    seen.add((parent, field))
                    todo += [(parent, field, x) for x in v if isinstance(x, (dict, list, str))]
            out.append([{"parent": p, "field": f} for p, f in sorted(seen)])
        return pd.Series(out, dtype=object)

    listed = F.pandas_udf(fields, "array<struct<parent:string,field:string>>")
    distinct = rows.distinct()
    pairs = distinct.select("_k", F.xxhash64("_t").alias("_h"), F.explode(listed("_t")).alias("_f")).select("_k", "_h", "_f.*")
    own = pairs.join(known, ["parent", "field"]).groupBy("_k", "_h").agg(F.collect_list(F.struct("parent", "field", "is_array", "is_object")).alias("_own"))
    joined = distinct.withColumn("_h", F.xxhash64("_t")).join(own.select(F.col("_k").alias("_j"), F.col("_h").alias("_g"), "_own"), F.col("_k").eqNullSafe(F.col("_j")) & (F.col("_h") == F.col("_g")), "left")
    return joined.select("_k", "_t", F.coalesce("_own", F.array().cast("array<struct<parent:string,field:string,is_array:boolean,is_object:boolean>>")).alias("_own"))


_COLUMNS = [c.split()[0] for c in NODES.split(", ")]


def node_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The flat table of one type; (record_id, parent_pre) refers to (record_id, pre) of its parent."""
    return nodes.where(F.col("type") == kind).drop("type")


def enclosing_join(inner: DataFrame, outer: DataFrame, prefix: str = "outer_") -> DataFrame:
    """Each inner node with every outer node of the same record whose interval encloses it.

    Equi-join on the record with the interval test as residual; a record holds few nodes of one
    type, and nothing crosses records.
    """
    renamed = outer.select(*[F.col(c).alias(prefix + c) for c in outer.columns])
    on = (inner["record_id"] == renamed[prefix + "record_id"]) & (renamed[prefix + "pre"] < inner["pre"]) & (renamed[prefix + "post"] > inner["post"])
    return inner.join(renamed, on).drop(prefix + "record_id")
