"""Text that looks the same in print: consistent form, and pairs that differ in characters only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from papyra.llm.glyphs import consistent
from papyra.session import cut


@F.arrow_udf(StringType())
def consistent_text(texts: pa.Array) -> pa.Array:
    """The consistent form of a text column (see ``glyphs``); null stays null."""
    return consistent(texts)


def with_consistent(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, the consistent form of ``text``."""
    return df.withColumn(out, consistent_text(F.col(text)))


def look_classes(df: DataFrame, keys: list[str], id_col: str, text: str) -> DataFrame:
    """(keys, class, variant, id, variants, members, links): ids whose text looks like a different text of its group.

    ``class`` is the same for texts that look the same, ``variant`` for equal texts; ``links`` counts the
    ids that look the same but differ in characters. One row an id, whatever the size of a class: each
    text is carried as a 128-bit digest after the consistent form is made, so the shuffles hold no text,
    and members are counted by variant, so a class of many copies is summed up before it is shuffled.
    Null texts take no part; equal texts are no link, so empty ones have none; repeated rows count once;
    an id with several texts has a row for each; columns other than those named are ignored.
    """
    rows = df.select(*keys, F.col(id_col).alias("id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    rows = rows.withColumn("_form", consistent_text("_text"))
    digest = lambda c: F.struct(F.xxhash64(c).alias("a"), F.hash(c).alias("b"), F.length(c).alias("n"))
    rows = rows.select(*keys, digest(F.col("_form")).alias("class"), digest(F.col("_text")).alias("variant"), "id").distinct()
    rows = cut(rows)  # the forms are made once, for the sizes and for the members
    group = [*keys, "class"]
    sizes = rows.groupBy(*group, "variant").agg(F.count("*").alias("_own"))
    whole = sizes.groupBy(*group).agg(F.count("*").alias("variants"), F.sum("_own").alias("members")).where("variants > 1")
    counted = sizes.join(whole, group).withColumn("links", F.col("members") - F.col("_own")).drop("_own")
    return rows.join(counted, [*group, "variant"])


def same_looks_pairs(classes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id_a, id_b): the pairs of different ids that ``look_classes`` links, id_a < id_b.

    Their number is that of the links, which grows with the square of a class; members of one variant
    are never paired. A hot class is split by adaptive skew handling, as both sides are shuffled plainly.
    """
    group = [*keys, "class"]
    a = classes.select(*group, F.col("variant").alias("_own"), F.col("id").alias("id_a"))
    b = classes.select(*group, F.col("variant").alias("_other"), F.col("id").alias("id_b"))
    return a.join(b, group).where("_own <> _other and id_a < id_b").select(*keys, "id_a", "id_b").distinct()
