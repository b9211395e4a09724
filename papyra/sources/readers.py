"""Scans: JSON objects and lines with explicit schemas, listed and recursive files, bytes, markup text layers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_objects(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """One object a file; anything else in a file fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths)


def json_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """One object a line; fails on blank lines, lines that do not parse, missing keys and repeated keys."""
    lines = spark.read.text(path)
    parsed = lines.select(F.col("value"), F.from_json("value", schema).alias("_j"))
    rows = parsed.select("value", "_j.*")
    n = F.count("*").over(Window.partitionBy(key))
    why = F.when(F.trim("value") == "", "blank line").when(F.col(key).isNull(), "no key or not JSON").when(n > 1, "repeated key")
    checked = rows.withColumn("_why", why)
    return checked.where(F.when(F.col("_why").isNotNull(), F.raise_error(F.concat(F.col("_why"), F.lit(": "), F.substring("value", 1, 80))).cast("boolean")).otherwise(F.lit(True))).drop("_why", "value")


def listed_paths(root: str, names: list[str]) -> list[str]:
    """Full paths of a manifest's entries; absolute entries and those that leave the root are refused."""
    out = []
    for n in names:
        p = PurePosixPath(n)
        if p.is_absolute() or ".." in p.parts or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", n):
            raise ValueError(f"path leaves the root: {n}")
        out.append(f"{root.rstrip('/')}/{p}")
    return out


def recursive(spark: SparkSession, root: str, pattern: str, expected: int | None = None) -> DataFrame:
    """(path, modified, bytes, content) of all files under the root that match; fails if their number is not as expected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    files = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")
    if expected is not None and (n := files.count()) != expected:
        raise ValueError(f"{n} files, {expected} expected")
    return files


def fingerprints(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of every file."""
    return recursive(spark, root, pattern).select("path", "bytes", F.sha2("content", 256).alias("sha256"))


def first_of_sources(parts: list[DataFrame], key: str, authoritative: bool = False) -> DataFrame:
    """Rows of several manifests, one for each key: the first manifest wins, or with ``authoritative`` the last."""
    both = None
    for i, p in enumerate(parts):
        p = p.withColumn("_priority", F.lit(-i if authoritative else i))
        both = p if both is None else both.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_priority", *[F.col(c).asc_nulls_first() for c in both.columns if c not in (key, "_priority")])
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_priority")


_SPAN = re.compile(r"<text\b([^>]*)>(.*?)</text>", re.DOTALL)


def svg_spans(df: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, n, x, y, size, text) of the text elements, read by pattern: broken markup still gives what it holds."""
    attr = lambda name: F.regexp_extract("_m", rf"(?s)<text\b[^>]*\b{name}=\"([^\"]*)\"", 1)
    found = df.select(key, F.posexplode(F.regexp_extract_all(F.col(markup), F.lit(r"(?s)<text\b[^>]*>.*?</text>"), F.lit(0))).alias("n", "_m"))
    number = lambda c: F.regexp_replace(c, "[^0-9.+-]", "").try_cast("double")
    inner = F.regexp_replace(F.regexp_extract("_m", r"(?s)<text\b[^>]*>(.*?)</text>", 1), r"<[^>]*>", "")
    return found.select(key, (F.col("n") + 1).alias("n"), number(attr("x")).alias("x"), number(attr("y")).alias("y"), number(attr("font-size")).alias("size"), inner.alias("text"))


def svg_spans_strict(df: DataFrame, key: str, markup: str) -> DataFrame:
    """As ``svg_spans`` for well-formed markup, with transforms by translate() applied; malformed markup gives no rows."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, m in zip(b[key], b["_m"], strict=True):
                try:
                    root = ElementTree.fromstring(m)
                except ElementTree.ParseError:
                    continue
                todo = [(root, 0.0, 0.0)]
                n = 0
                while todo:
                    e, dx, dy = todo.pop()
                    if t := re.search(r"translate\(\s*([-\d.]+)[ ,]*([-\d.]+)?", e.get("transform", "")):
                        dx, dy = dx + float(t[1]), dy + float(t[2] or 0)
                    if e.tag.rpartition("}")[2] == "text":
                        n += 1
                        num = lambda name, e=e: float(re.sub(r"[^0-9.+-]", "", e.get(name, "")) or 0)
                        rows.append((k, n, num("x") + dx, num("y") + dy, num("font-size"), "".join(e.itertext())))
                        continue
                    todo += [(c, dx, dy) for c in reversed(e)]
            yield pd.DataFrame(rows, columns=[key, "n", "x", "y", "size", "text"])

    return df.where(F.col(markup).isNotNull()).select(key, F.col(markup).alias("_m")).mapInPandas(run, f"{key} {kind}, n int, x double, y double, size double, text string")
