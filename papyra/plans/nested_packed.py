"""Queries of the nested-record and packed-field operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.nested import doubtful, enclosing_join, flatten, node_table, shapes
from papyra.operators.packed import split_packed
from papyra.session import cut, spread, table


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    papers = spread(table(spark, sf, "papers").select("id", "raw_json"))
    subs = spread(table(spark, sf, "questions").select("id", "subquestions_json"))
    known = cut(doubtful(shapes(papers, "raw_json", "$").unionByName(shapes(subs, "subquestions_json", "subquestions"))))
    return papers, subs, known


def p2_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Node table of both fields with interval labels and each node's own fields."""
    papers, subs, known = _both(spark, sf)
    a = flatten(papers, "id", "raw_json", "$", known)
    b = flatten(subs, "id", "subquestions_json", "subquestions", known)
    return a.withColumn("field_name", F.lit("papers.raw_json")).unionByName(b.withColumn("field_name", F.lit("questions.subquestions_json")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every child record of both fields with the place of its nearest enclosing child record."""
    papers, subs, known = _both(spark, sf)
    a = flatten(papers, "id", "raw_json", "$", known, with_body=False).withColumn("field_name", F.lit("papers.raw_json"))
    b = flatten(subs, "id", "subquestions_json", "subquestions", known, with_body=False).withColumn("field_name", F.lit("questions.subquestions_json"))
    return a.unionByName(b).select("field_name", "record_id", "parent_path", "node_path")


def p2_options_of_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Option nodes under their section nodes (two levels up), found by interval containment."""
    papers, _, known = _both(spark, sf)
    nodes = flatten(papers, "id", "raw_json", "$", known, with_body=False)
    joined = enclosing_join(node_table(nodes, "options"), node_table(nodes, "sections"))
    return joined.groupBy("record_id", F.col("outer_node_path").alias("section_path")).agg(F.count("*").alias("options"))


def p5_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of every solution that is a list, with its position."""
    return split_packed(table(spark, sf, "answers"), "solution", ["question_id"])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of the values of every solution that is a list."""
    return p5_values(spark, sf).select("question_id", "pos").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_nodes, p2_options_of_sections, p5_found, p5_values)}
SQL: dict[str, str] = {}
