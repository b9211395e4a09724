"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import garbled, language, looks, scanned
from papyra.llm.leak import find_leaks
from papyra.llm.mixing import mix, uses
from papyra.llm.splitting import split_texts
from papyra.session import spread, table


def _fields(spark: SparkSession, sf: str, *fields: tuple[str, str]) -> DataFrame:
    """(field_name, paper_id, id, text) of the named text fields."""
    parts = [
        table(spark, sf, t).select(F.lit(f"{t}.{c}").alias("field_name"), "paper_id", "id", F.col(c).alias("text"))
        for t, c in fields
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_P1_KEYS = ["field_name", "paper_id"]


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each id whose text looks like a different one of its field and paper: class, variant and number of links."""
    both = _fields(spark, sf, ("source_blocks", "text"), ("options", "text"))
    return looks.look_classes(spread(both), _P1_KEYS, "id", "text")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of ids of one field and paper whose texts differ in characters but look the same."""
    return looks.same_looks_pairs(p1_classes(spark, sf), _P1_KEYS).select("field_name", "id_a", "id_b")


def p1_consistent(spark: SparkSession, sf: str) -> DataFrame:
    """Every text of both fields in the one consistent form."""
    both = _fields(spark, sf, ("source_blocks", "text"), ("options", "text"))
    return looks.with_consistent(spread(both), "text", "form").select("field_name", "id", "form")


def p3_posteriors(spark: SparkSession, sf: str) -> DataFrame:
    """The most probable encoding chain of every block that some chain explains; null where clean is more probable."""
    blocks = table(spark, sf, "source_blocks").select("id", "paper_id", "text")
    return garbled.posteriors(blocks, "id", "text", ["paper_id"]).withColumnRenamed("id", "block_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks decoded, wholly or in part, with a wrong encoding."""
    return p3_posteriors(spark, sf).where("chain is not null").select("block_id")


def p3_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Garbled blocks with the text as it stands and as restored by their chain."""
    found = p3_posteriors(spark, sf).where("chain is not null").select("block_id", "chain")
    blocks = table(spark, sf, "source_blocks").select(F.col("id").alias("block_id"), "text").distinct()
    return blocks.join(found, "block_id").withColumn("restored", garbled.repaired("text", "chain"))


def p4_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Every block that is no header, and every stem: repaired text and the traces found in it."""
    blocks = table(spark, sf, "source_blocks")
    body = blocks.where("role is null or role <> 'header'").select(F.lit("source_blocks.text").alias("field_name"), F.col("id").alias("record_id"), "paper_id", "text")
    stems = table(spark, sf, "questions").select(F.lit("questions.stem").alias("field_name"), F.col("id").alias("record_id"), "paper_id", F.col("stem").alias("text"))
    headers = blocks.where("role = 'header'").select("text")
    return scanned.read_scans(body.unionByName(stems), ["field_name", "record_id"], "text", "paper_id", headers)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records with a word split across lines, misread characters, or page furniture within the text."""
    return p4_repaired(spark, sf).where("furniture or split_word or misread").select("field_name", "record_id").distinct()


_TRANSLATION = ["path", "paragraph_id", "source_hash"]


def p6_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Language, confidence and mixture of every translation, beside the declared language."""
    rows = table(spark, sf, "translations").select(*_TRANSLATION, "translation", "lang")
    rows = rows.withColumn("declared", language.declared(F.col("lang")))
    machines = language.train(rows, "translation", "lang")
    return language.label_texts(rows.select(*_TRANSLATION, "declared", "translation"), [*_TRANSLATION, "declared"], "translation", machines)


def p6_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every segment of every translation with its language and confidence."""
    rows = table(spark, sf, "translations").select(*_TRANSLATION, "translation", "lang")
    return language.label_segments(rows, _TRANSLATION, "translation", language.train(rows, "translation", "lang"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Translations whose declared language is missing, wrong or one of several; a row for each language in the text."""
    labels = p6_labels(spark, sf).where("main_lang is not null and (declared is null or mixed or declared <> main_lang)")
    return labels.select(*_TRANSLATION, F.explode("langs").alias("lang")).distinct()


def p7_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and test items with the overlap of the item's passage and question."""
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), "doc_id", "text", "item_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain a full sentence of a test item, with the item."""
    return p7_overlaps(spark, sf).where("sentences > 0").select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked test items with the number of documents that contain them."""
    return p7_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("documents"))


def p8_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Every document of a targeted source with the number of copies it has in the mix, 0 if none."""
    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), "doc_id", "text")[0]


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mix itself: one row for each use of a document."""
    return uses(p8_copies(spark, sf))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual token share of each source of the mix."""
    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), "doc_id", "text")[1]


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every document longer than 2,000 tokens."""
    return split_texts(table(spark, sf, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that had to be split."""
    return split_texts(table(spark, sf, "documents"), "doc_id", "text", with_text=False).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p1_consistent, p3_found, p3_posteriors, p3_repaired, p4_found, p4_repaired, p6_found, p6_labels, p6_segments, p7_found, p7_items, p7_overlaps, p8_mix, p8_copies, p8_shares, p9_found, p9_pieces)}
SQL: dict[str, str] = {}
