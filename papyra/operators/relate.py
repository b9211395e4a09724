"""Joins that refuse to guess, inventories, row comparison, duplicates and ownership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], same_ties: bool = False) -> DataFrame:
    """The last version of each key by ``order`` (nulls first); one aggregation, no sort of groups.

    Versions equal in ``order`` are told apart by their content, so the result is deterministic. With
    ``same_ties`` such versions are known to be copies; each column is then its own aggregate, and
    columns that nobody reads are pruned down to the scan.
    """
    rest = [c for c in df.columns if c not in keys]
    if same_ties:
        by = F.struct(*order)
        return df.groupBy(*keys).agg(*[F.max_by(c, by).alias(c) for c in rest]).select(*df.columns)
    best = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])).alias("_v")
    return df.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in df.columns])


def first_seen(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once; null keys are equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def inventory_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys on one side only: ``missing`` on the right, ``extra`` there. Nulls are no keys."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full_outer").where("_a is null or _b is null")
    return both.select(key, F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("side"))


def field_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) for every field that differs between rows of one key; null equals null."""
    r = right.select(F.col(key), *[F.col(f).alias(f"_r_{f}") for f in fields])
    named = F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_r_{f}")), F.lit(f)) for f in fields])
    return left.select(key, *fields).join(r, key).select(key, F.explode(F.filter(named, lambda x: x.isNotNull())).alias("field"))


def missing_parents(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose reference names no parent; a null reference names none and is no violation."""
    keys = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_pk"), "left_anti")


def classified_lookup(asked: DataFrame, key: str, on: str, offered: DataFrame, offered_on: str, target: str) -> DataFrame:
    """(key, outcome, target): ``resolved`` with its target for one match, ``unresolved`` for none, ``ambiguous`` for several.

    Candidates are counted before the join, so it never multiplies rows.
    """
    per = offered.where(F.col(offered_on).isNotNull()).groupBy(F.col(offered_on).alias("_on")).agg(F.count_distinct(target).alias("_n"), F.min(target).alias("_t"))
    joined = asked.select(key, F.col(on).alias("_on")).join(per, "_on", "left")
    outcome = F.when(F.coalesce("_n", F.lit(0)) == 0, "unresolved").when(F.col("_n") == 1, "resolved").otherwise("ambiguous")
    return joined.select(key, outcome.alias("outcome"), F.when(F.col("_n") == 1, F.col("_t")).alias("target"))


def owned_once(links: DataFrame, item: str, owner: str) -> DataFrame:
    """(item, owner) of items that exactly one owner holds."""
    per = links.where(F.col(item).isNotNull()).groupBy(item).agg(F.count_distinct(owner).alias("_n"), F.min(owner).alias(owner))
    return per.where("_n = 1").select(item, owner)


def outside_set(df: DataFrame, key: str, array: str, allowed: DataFrame, allowed_key: str) -> DataFrame:
    """(key, missing): elements of an array column that the allowed set does not hold, sorted."""
    items = df.select(key, F.explode(array).alias("_i"))
    bad = items.join(allowed.select(F.col(allowed_key).alias("_i")).distinct(), "_i", "left_anti")
    return bad.groupBy(key).agg(F.array_sort(F.collect_set("_i")).alias("missing"))


def conflicts(df: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """(key, versions) of keys that come with more than one payload; nulls count as a value."""
    body = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    return df.groupBy(key).agg(F.count_distinct(body).alias("versions")).where("versions > 1")


def all_requested(df: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """The rows of the wanted keys; fails while running if one of them does not exist."""
    spark = df.sparkSession
    asked = spark.createDataFrame([(w,) for w in wanted], f"_w {df.schema[key].dataType.simpleString()}").distinct()
    missing = asked.join(df.select(F.col(key).alias("_w")).distinct(), "_w", "left_anti").agg(F.count("*").alias("_m"))
    rows = df.join(F.broadcast(asked), F.col(key) == F.col("_w"), "left_semi")
    return rows.crossJoin(F.broadcast(missing)).where(F.when(F.col("_m") > 0, F.raise_error(F.lit("requested keys do not exist")).cast("boolean")).otherwise(F.lit(True))).drop("_m")


def fan_out(df: DataFrame, keys: list[str], order: Column, id_col: str) -> DataFrame:
    """Every row with the id of the first row of equal keys: work is done once and read by all."""
    first = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min_by(id_col, order).alias("representative"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(first, on).select(*df.columns, "representative")


def resolved_alias(df: DataFrame, id_col: str, alias: str, value: str, same: list[str], sources: DataFrame | None = None) -> DataFrame:
    """The value of each row, taken from the row its alias names if its own is null.

    The alias counts only if the two rows agree in all ``same`` columns. ``sources`` are the rows that may
    be named, one for each id and ``same``; by default those of ``df``.
    """
    source = (df if sources is None else sources).select(F.col(id_col).alias("_id"), F.col(value).alias("_v"), *[F.col(c).alias(f"_s_{c}") for c in same])
    agree = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in same], F.lit(True))
    joined = df.join(source, (F.col(alias) == F.col("_id")) & agree, "left")
    return joined.withColumn("resolved", F.coalesce(F.col(value), F.col("_v"))).drop("_id", "_v", *[f"_s_{c}" for c in same])


def overlapping(left: DataFrame, right: DataFrame, lo: str, hi: str, r_lo: str, r_hi: str, width: float, group: list[str] | None = None) -> DataFrame:
    """Pairs whose closed intervals overlap: equi-join on the buckets both touch, then the exact test.

    A pair is kept in the first bucket both share, so no distinct is needed. ``width`` should be near
    the usual length. Intervals with a null end overlap nothing.
    """
    group = group or []
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    a = left.where(F.col(lo) <= F.col(hi)).withColumn("_b", buckets(lo, hi))
    b = right.where(F.col(r_lo) <= F.col(r_hi)).withColumn("_b", buckets(r_lo, r_hi))
    joined = a.join(b, [*group, "_b"])
    first = F.greatest(F.floor(F.col(lo) / width), F.floor(F.col(r_lo) / width))
    return joined.where((F.col(lo) <= F.col(r_hi)) & (F.col(r_lo) <= F.col(hi)) & (F.col("_b") == first)).drop("_b")


def unique_anchor(anchors: DataFrame, anchor_id: str, anchor: str, texts: DataFrame, text_id: str, text: str, length: int = 12, group: list[str] | None = None) -> DataFrame:
    """(anchor_id, text_id) of anchors that exactly one text, of the same ``group``, contains.

    Candidates come from an equi-join of the anchor's first ``length`` characters with the windows of
    that length of every text; containment is then tested. Shorter anchors are not looked up.
    """
    group = group or []
    a = anchors.where(F.length(anchor) >= length).select(anchor_id, *group, F.col(anchor).alias("_a"), F.xxhash64(F.substring(F.col(anchor), 1, length)).alias("_h"))
    starts = F.sequence(F.lit(1), F.length("_t") - length + 1)
    t = texts.where(F.length(text) >= length).select(text_id, *group, F.col(text).alias("_t"))
    t = t.select(text_id, *group, "_t", F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring("_t", i, F.lit(length)))))).alias("_h"))
    hits = t.join(a, [*group, "_h"]).where(F.contains("_t", F.col("_a"))).select(anchor_id, text_id).distinct()
    return hits.groupBy(anchor_id).agg(F.count("*").alias("_n"), F.min(text_id).alias(text_id)).where("_n = 1").drop("_n")


def attach_checked(target: DataFrame, key: str, column: str, rows: DataFrame, value: str, valid: Column) -> DataFrame:
    """``target`` with ``column`` overridden by the staged rows: all of them or, if one is invalid or names no target, none.

    The query fails while running, with the number of refused rows.
    """
    known = rows.join(target.select(key).distinct().withColumn("_k", F.lit(1)), key, "left").withColumn("_ok", F.coalesce(valid, F.lit(False)) & F.col("_k").isNotNull())
    refused = known.agg(F.count_if(~F.col("_ok")).alias("_refused"))
    staged = rows.groupBy(key).agg(F.min(value).alias("_new"))
    out = target.join(staged, key, "left").withColumn(column, F.coalesce("_new", F.col(column))).drop("_new")
    guard = F.when(F.col("_refused") > 0, F.raise_error(F.concat(F.col("_refused"), F.lit(" staged rows refused"))).cast("boolean")).otherwise(F.lit(True))
    return out.crossJoin(F.broadcast(refused)).where(guard).drop("_refused")
