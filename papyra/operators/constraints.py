"""A declarative registry of integrity rules, all reported as one table of violations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.relate import duplicate_keys, missing_parents


@dataclass(frozen=True)
class Unique:
    table: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    table: str
    column: str
    parent: str
    parent_key: str


@dataclass(frozen=True)
class Check:
    """``predicate`` is SQL; a row violates it only where it is false (null passes, as in SQL CHECK)."""

    table: str
    name: str
    predicate: str
    key: str


Rule = Unique | Reference | Check


def violations(tables: Callable[[str], DataFrame], rules: list[Rule]) -> DataFrame:
    """(rule, table_name, key) for every violation of every rule; each rule is its own small plan."""
    out = []
    for r in rules:
        df = tables(r.table)
        if isinstance(r, Unique):
            bad, name = duplicate_keys(df, list(r.keys)), f"unique({','.join(r.keys)})"
            key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in r.keys])
        elif isinstance(r, Reference):
            bad, name, key = missing_parents(df, r.column, tables(r.parent), r.parent_key), f"{r.column}->{r.parent}.{r.parent_key}", F.col(r.column).cast("string")
        else:
            bad, name, key = df.where(F.expr(f"not ({r.predicate})")), f"check({r.name})", F.col(r.key).cast("string")
        out.append(bad.select(F.lit(name).alias("rule"), F.lit(r.table).alias("table_name"), key.alias("key")))
    return reduce(DataFrame.unionByName, out)


def totals(df: DataFrame, expected: dict[str, int], actual: dict[str, str]) -> DataFrame:
    """(measure, expected, actual) for measures (SQL aggregates) that differ from what was announced."""
    row = df.agg(*[F.expr(e).cast("long").alias(n) for n, e in actual.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("measure"), F.lit(expected.get(n)).cast("long").alias("expected"), F.col(n).alias("actual")) for n in actual])
    return row.select(F.explode(pairs).alias("m")).select("m.*").where("not (expected <=> actual)")
