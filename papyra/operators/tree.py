"""Hierarchies as adjacency lists: descent, hiding, order checks, closures."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.session import cut


def descend(nodes: DataFrame, key: str, parent: str, roots: DataFrame, root_key: str) -> DataFrame:
    """(key, root, depth) of every node under the roots, the roots at depth 0.

    Level by level, to any depth; a node reached again under the same root is not followed, so cycles end
    and a node with several parents stands at its least depth. Only the frontier is joined at each level,
    and the lineage is cut by a checkpoint every eighth one.
    """
    edges = nodes.where(F.col(parent).isNotNull()).select(F.col(key).alias("_c"), F.col(parent).alias("_p"))
    frontier = roots.select(F.col(root_key).alias(key)).distinct().withColumn("root", F.col(key)).withColumn("depth", F.lit(0))
    found = frontier = cut(frontier)
    for d in itertools.count(1):
        step = frontier.join(edges, F.col(key) == F.col("_p")).select(F.col("_c").alias(key), "root").distinct()
        step = cut(step.join(found.select(key, "root"), [key, "root"], "left_anti").withColumn("depth", F.lit(d)))
        if step.isEmpty():
            return found
        found = found.unionByName(step)
        if d % 8 == 0:
            found = cut(found)
        frontier = step
    raise AssertionError


def closure(links: DataFrame, start: str, end: str, seeds: DataFrame, seed: str) -> DataFrame:
    """(seed, reached, steps) of everything the links lead to from each seed, itself at 0 steps; null ends lead nowhere."""
    found = descend(links.where(F.col(end).isNotNull()).select(F.col(end).alias("reached"), F.col(start).alias("_from")).distinct(), "reached", "_from", seeds, seed)
    return found.select(F.col("root").alias("seed"), "reached", F.col("depth").alias("steps"))


def hidden_below(nodes: DataFrame, key: str, parent: str, hidden: DataFrame) -> DataFrame:
    """Keys of hidden nodes and of everything under them."""
    return descend(nodes, key, parent, hidden, key).select(key).distinct()


def wholly_owned(links: DataFrame, target: str, owner: str, hidden: DataFrame, hidden_key: str) -> DataFrame:
    """Targets all of whose owners are hidden."""
    flags = hidden.select(F.col(hidden_key).alias(owner)).distinct().withColumn("_h", F.lit(True))
    per = links.join(flags, owner, "left").groupBy(target).agg(F.bool_and(F.coalesce("_h", F.lit(False))).alias("_all"))
    return per.where("_all").select(target)


def order_violations(toc: DataFrame, by: list[str], key: str, parent: str, position: str) -> DataFrame:
    """Entries whose parent does not exist in their group or does not stand before them."""
    p = toc.select(*by, F.col(key).alias("_k"), F.col(position).alias("_at"))
    joined = toc.where(F.col(parent).isNotNull()).withColumn("_k", F.col(parent)).join(p, [*by, "_k"], "left").select(*toc.columns, "_at")
    return joined.where(F.col("_at").isNull() | (F.col("_at") >= F.col(position))).drop("_at")


def shared_contexts(df: DataFrame, by: list[str], context: str, order: str, id_col: str) -> DataFrame:
    """(by, context_key, first_id, members) of contexts that several rows of a group have in common."""
    per = df.where(F.col(context).isNotNull()).groupBy(*by, F.sha2(context, 256).alias("context_key"))
    return per.agg(F.min_by(id_col, order).alias("first_id"), F.count("*").alias("members")).where("members > 1")


def nested(nodes: DataFrame, key: str, parent: str, label: str, levels: int) -> DataFrame:
    """Roots with their descendants nested to ``levels``, children ordered by key, as one JSON column.

    Bottom up: each level is one aggregation; nodes below ``levels`` are left out.
    """
    placed = descend(nodes, key, parent, nodes.where(F.col(parent).isNull()), key).where(F.col("depth") <= levels).join(nodes.select(key, parent, label), key)
    below = None
    for d in range(levels, -1, -1):
        level = placed.where(F.col("depth") == d).select("root", key, parent, label)
        if below is not None:
            level = level.join(below, [key, "root"], "left")
        else:
            level = level.withColumn("_kids", F.array().cast("array<string>"))
        quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(F.col(c).cast("string"))), r"(?s)\A\[(.*)\]\z", 1), F.lit("null"))
        kids = F.array_join(F.coalesce("_kids", F.array().cast("array<string>")), ",")
        body = F.concat(F.lit('{"id":'), quoted(key), F.lit(',"label":'), quoted(label), F.lit(',"children":['), kids, F.lit("]}"))
        if d == 0:
            return level.select(key, body.alias("tree"))
        below = level.groupBy(F.col(parent).alias("_pk"), "root").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), body.alias("b")))), lambda x: x["b"]).alias("_kids")).withColumnRenamed("_pk", key)
    raise AssertionError


def siblings(df: DataFrame, parent: str, order: str) -> DataFrame:
    """1-based order among siblings."""
    return df.withColumn("sibling", F.row_number().over(Window.partitionBy(parent).orderBy(order)))
