"""Evidence before change: guarded exceptions, recovered orders, printed questions, batches that must parse back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded_exception(target: DataFrame, key: list[str], evidence: DataFrame, guards: list[str], column: str, value: str) -> DataFrame:
    """``target`` with ``column`` set to the evidence's ``value`` where one evidence row has its key and equals it in all ``guards`` (null equals null).

    Several evidence rows for a key, or a field that differs, change nothing; other rows stay as they are.
    """
    once = evidence.groupBy(*key).agg(F.count("*").alias("_n"), *[F.min(c).alias(f"_g_{c}") for c in guards], F.min(value).alias("_v")).where("_n = 1").drop("_n")
    renamed = once.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[c for c in once.columns if c.startswith("_")])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in key])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in guards], F.lit(True))
    out = target.join(renamed, on & same, "left")
    return out.withColumn(column, F.when(F.col(f"_k_{key[0]}").isNotNull(), F.col("_v")).otherwise(F.col(column))).select(*target.columns)


def subsequence(earlier: Column, later: Column) -> Column:
    """Whether the earlier array is a subsequence of the later one, both without repeats: nothing gone, order kept."""
    at = F.transform(earlier, lambda x: F.array_position(later, x))
    return F.forall(at, lambda i: i > 0) & (at == F.array_sort(at))


def printed_questions(blocks: DataFrame, by: str, order: list[str], chunk: Column | None = None) -> DataFrame:
    """(by, part, number, stem, options, blocks): runs of blocks, each begun by a numbered stem, as question records.

    ``blocks`` holds (id, role, text). What stands before a paper's first numbered stem belongs to no
    question; ``options`` is the text of the option blocks of the run in order, null without one.
    """
    from papyra.operators.reading import in_order
    from papyra.operators.sequence import groups_by_gap

    starts = (F.col("role") == "stem") & F.col("text").rlike(r"\A[0-9]+\. ")
    runs = groups_by_gap(blocks.select("id", by, *[c for c in order if c != "id"], "role", "text"), [by], order, F.coalesce(starts, F.lit(False)), chunk=chunk).where("part > 0")
    first = F.min_by(F.when(starts, F.col("text")), F.struct(*order))
    texts = F.array_join(in_order(order, F.when(F.col("role") == "option", F.col("text"))), " ")
    per = runs.groupBy(by, "part").agg(first.alias("_t"), texts.alias("_o"), F.count("*").alias("blocks"))
    return per.select(by, "part", F.regexp_extract("_t", r"\A([0-9]+)\. ", 1).alias("number"), F.regexp_replace("_t", r"\A[0-9]+\. ", "").alias("stem"), F.when(F.col("_o") != "", F.col("_o")).alias("options"), "blocks")


def reading_order(spans: DataFrame, by: list[str], y: str, x: str, tie: str, band: float, gap: int) -> DataFrame:
    """Add ``place`` and ``paragraph``: spans by bands of ``y``, then ``x``; a paragraph begins where more than ``gap`` bands lie between."""
    from papyra.operators.sequence import groups_by_gap, ordinals

    banded = spans.withColumn("_band", F.floor(F.col(y) / band))
    order = ["_band", x, tie]
    placed = ordinals(banded, by, order, "place")
    far = F.coalesce(F.col("_band") - F.lag("_band").over(Window.partitionBy(*by).orderBy(*order)) > gap, F.lit(False))
    return groups_by_gap(placed, by, order, far, "paragraph").drop("_band")


def batch_text(parts: Column) -> Column:
    """Texts as one: each after a line with its number from 1 in double brackets."""
    return F.array_join(F.transform(parts, lambda t, i: F.concat(F.lit("[["), (i + 1).cast("string"), F.lit("]]\n"), t)), "\n")


def parsed_batch(text: Column, n: Column) -> Column:
    """The texts of a batch, or null unless it holds exactly the numbers 1 to ``n``, once each and in order."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\[\[([0-9]+)\]\]$"), F.lit(1)), lambda x: x.cast("int"))
    parts = F.split(text, r"(?m)(?:^|\n)\[\[[0-9]+\]\]\n")
    return F.when((numbers == F.sequence(F.lit(1), n)) & (F.element_at(parts, 1) == ""), F.slice(parts, F.lit(2), F.size(parts)))
