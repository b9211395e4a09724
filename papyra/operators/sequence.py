"""Operators on ordered rows: as-of, carry-forward, islands, gaps, ordinals, greedy groupings."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, tolerance: float = 0) -> DataFrame:
    """``left`` with the ``value`` of the last right row of the group at or before its position.

    Right rows up to ``tolerance`` after the position count too. Union and one window: no range join.
    The right position is ``at`` as well; rows with a null position find nothing.
    """
    pos = F.col(at).cast("double")
    a = left.withColumn("_pos", pos).withColumn("_side", F.lit(1))
    b = right.select(*by, (pos - tolerance).alias("_pos"), F.struct(pos.alias("p"), F.col(value).alias("v")).alias("_v")).withColumn("_side", F.lit(0)).where("_pos is not null")
    w = Window.partitionBy(*by).orderBy(F.col("_pos").asc_nulls_first(), "_side", F.col("_v.p").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    out = both.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, F.col("_found.v").alias(f"as_of_{value}"))


# Operators over a whole group take ``chunk``, a column that never falls along the order (say, the ordinal
# divided by 100,000): rows are then sorted within chunks only, and what passes from one chunk to the next
# goes through a table of one row a chunk, so a group that holds a third of all rows is many tasks.


def _before_chunk(ends: DataFrame, by: list[str], value: str, whole: str) -> DataFrame:
    """(by, _c, _in): for each chunk what the chunks before it hand on: the last non-null ``value``, or with ``whole`` ``sum`` their sum."""
    w = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    handed = F.coalesce(F.sum(value).over(w), F.lit(0)) if whole == "sum" else F.last(value, ignorenulls=True).over(w)
    return ends.select(*by, "_c", handed.alias("_in"))


def _joined(rows: DataFrame, handed: DataFrame, by: list[str]) -> DataFrame:
    """Rows with what their chunk is handed; null groups are groups."""
    renamed = handed.select(*[F.col(c).alias(f"_j_{c}") for c in [*by, "_c"]], "_in")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in [*by, "_c"]])
    return rows.join(renamed, on, "left").drop(*[f"_j_{c}" for c in [*by, "_c"]])


def carry_forward(df: DataFrame, by: list[str], order: list[str], when: Column, value: str, out: str, chunk: Column | None = None) -> DataFrame:
    """``out``: ``value`` of the last row so far where ``when`` held; null before the first."""
    marked = df.withColumn("_m", F.when(when, F.col(value)))
    if chunk is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return marked.withColumn(out, F.last("_m", ignorenulls=True).over(w)).drop("_m")
    rows = marked.withColumn("_c", chunk)
    w = Window.partitionBy(*by, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*by, "_c").agg(F.max_by("_m", F.when(F.col("_m").isNotNull(), F.struct(*order))).alias("_e"))
    handed = _before_chunk(ends, by, "_e", "last")
    return _joined(rows.withColumn("_l", F.last("_m", ignorenulls=True).over(w)), handed, by).withColumn(out, F.coalesce("_l", "_in")).drop("_m", "_l", "_c", "_in")


def previous(df: DataFrame, by: list[str], order: list[str], columns: list[str], chunk: Column | None = None, prefix: str = "before_") -> DataFrame:
    """Add ``before_*``: the columns of the row before; null at the first."""
    taken = F.struct(*columns)
    if chunk is None:
        rows = df.withColumn("_b", F.lag(taken).over(Window.partitionBy(*by).orderBy(*order)))
        return rows.select(*df.columns, *[F.col(f"_b.{c}").alias(prefix + c) for c in columns])
    rows = df.withColumn("_c", chunk)
    w = Window.partitionBy(*by, "_c").orderBy(*order)
    ends = rows.groupBy(*by, "_c").agg(F.max_by(taken, F.struct(*order)).alias("_e"))
    out = _joined(rows.withColumn("_b", F.lag(taken).over(w)), _before_chunk(ends, by, "_e", "last"), by)
    return out.withColumn("_b", F.coalesce("_b", "_in")).select(*df.columns, *[F.col(f"_b.{c}").alias(prefix + c) for c in columns])


def islands(df: DataFrame, by: list[str], order: list[str], flag: Column, least: int, size: Column | None = None, least_size: float = 0) -> DataFrame:
    """(by, start, end, length, size) of runs of at least ``least`` consecutive rows where ``flag`` holds; start and end are positions from 1.

    With ``size``, its sum over the run must reach ``least_size`` too; null sizes count 0.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_size", F.coalesce(size, F.lit(0)) if size is not None else F.lit(0)).withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_n", F.row_number().over(w))
    runs = rows.withColumn("_g", F.sum(F.when(~F.col("_f"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_f")
    found = runs.groupBy(*by, "_g").agg(F.min("_n").alias("start"), F.max("_n").alias("end"), F.count("*").alias("length"), F.sum("_size").alias("size"))
    kept = found.where((F.col("length") >= least) & (F.col("size") >= least_size)).drop("_g")
    return kept if size is not None else kept.drop("size")


def ordinals(df: DataFrame, by: list[str], order: list[str], out: str = "ordinal") -> DataFrame:
    """1-based position within the group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def groups_by_gap(df: DataFrame, by: list[str], order: list[str], gap: Column, out: str = "part", chunk: Column | None = None) -> DataFrame:
    """``out``: number of the part, a new one starting where ``gap`` holds. Without ``chunk`` the gap may use ``lag``; with it, ``previous``."""
    if chunk is None:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("_gap", gap).withColumn(out, F.sum(F.when(F.col("_gap"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")
    rows = df.withColumn("_c", chunk).withColumn("_gap", F.when(gap, 1).otherwise(0))
    w = Window.partitionBy(*by, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    handed = _before_chunk(rows.groupBy(*by, "_c").agg(F.sum("_gap").alias("_e")), by, "_e", "sum")
    return _joined(rows.withColumn("_s", F.sum("_gap").over(w)), handed, by).withColumn(out, F.col("_s") + F.coalesce("_in", F.lit(0))).drop("_gap", "_s", "_c", "_in")


def running_maxima(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value exceeds all before it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_top", F.max(value).over(w)).where(F.col("_top").isNull() | (F.col(value) > F.col("_top"))).drop("_top")


def missing_between(df: DataFrame, by: list[str], number: str, least: int = 1) -> DataFrame:
    """(by, number) of integers missing between a group's smallest and largest, for groups with ``least`` distinct numbers."""
    known = df.where(F.col(number).isNotNull()).select(*by, number).distinct()
    span = known.groupBy(*by).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    holes = span.where(F.col("_hi") - F.col("_lo") >= F.col("_n")).select(*by, F.explode(F.sequence("_lo", "_hi")).alias(number))
    return holes.join(known, [*by, number], "left_anti")


def not_contiguous(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """(by, lo, hi, n) of groups whose numbers are not exactly 1 to n."""
    got = df.groupBy(*by).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count(number).alias("n"), F.count_distinct(number).alias("_d"))
    return got.where("lo <> 1 or hi <> n or n <> _d").drop("_d")


def first_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return ordinals(df, by, order, "_n").where(F.col("_n") <= n).drop("_n")


def line_clusters(df: DataFrame, by: list[str], y: str, order: list[str], tolerance: float, out: str = "line") -> DataFrame:
    """``out``: number of the text line a span belongs to: the first of the last three open lines within ``tolerance`` of its y.

    Depends on earlier choices, so each page runs as one group; a page's spans are few.
    """
    schema = StructType([*df.schema.fields, StructField(out, IntegerType())])

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(order, kind="stable")
        open_: list[tuple[int, float]] = []
        lines = []
        for v in page[y]:
            hit = next((k for k, u in open_[-3:] if abs(u - v) <= tolerance), None)
            if hit is None:
                hit = open_[-1][0] + 1 if open_ else 0
                open_.append((hit, v))
            lines.append(hit)
        return page.assign(**{out: lines})

    return df.groupBy(*by).applyInPandas(run, schema)


def packed_batches(df: DataFrame, by: list[str], order: list[str], size: str, alone: str, most: int, limit: int, out: str = "batch") -> DataFrame:
    """``out``: number of the batch within the group, filled in order up to ``most`` rows and ``limit`` of ``size``; rows flagged ``alone`` get their own.

    Greedy, so each group is one task that holds its rows' keys and sizes; groups (a document's pieces of
    work) are small by nature.
    """
    schema = StructType([*df.schema.fields, StructField(out, IntegerType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        batch, n, total, closed, out_ = -1, 0, 0, True, []
        group = group.sort_values(order, kind="stable")
        for s, single in zip(group[size], group[alone], strict=True):
            if closed or single or n >= most or total + s > limit:
                batch, n, total, closed = batch + 1, 0, 0, False
            n, total, closed = n + 1, total + s, bool(single)
            out_.append(batch)
        return group.assign(**{out: out_})

    return df.groupBy(*by).applyInPandas(run, schema)


def consecutive_from_one(numbers: Column) -> Column:
    """The elements accepted one after another as 1, 2, 3, ...; others are passed over."""
    step = lambda acc, x: F.when(x == F.size(acc) + 1, F.concat(acc, F.array(x))).otherwise(acc)
    return F.aggregate(numbers, F.array().cast("array<int>"), step)
