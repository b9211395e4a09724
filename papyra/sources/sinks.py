"""Publication: staged writes, checks, one pointer switch; upserts; reports; drift checks.

Paths go through Hadoop's FileSystem, so a folder may be on any shared storage.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.relate import latest

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p, _ = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(b & 255 for b in stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside, then rename over: readers see the old or the new content."""
    fs, p, path_of = _fs(spark, path)
    beside = path_of(path + ".new")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    over = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(p), over)


def remove(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def current(spark: SparkSession, root: str) -> str | None:
    """The published version of a root, or None."""
    return read_text(spark, f"{root}/{POINTER}")


def publish(spark: SparkSession, root: str, version: str, tables: dict[str, DataFrame], checks: dict[str, DataFrame], expected: str | None = "any") -> str:
    """Write all tables under a new version, run the checks on what was written, then switch the pointer.

    A check is a DataFrame of violations over the staged tables (temporary views of their names); any
    row leaves the pointer as it was. ``expected`` is the version the caller built on: if another has
    been published since, nothing is switched. Comparing and switching happen under a lock file that only
    one writer can create, so of two writers one fails. What a failed publication has staged is removed;
    earlier versions stay.
    """
    stage = f"{root}/{version}"
    fs, at, _ = _fs(spark, stage)
    if fs.exists(at):
        raise ValueError(f"{stage} exists")
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{stage}/{name}")
            spark.read.parquet(f"{stage}/{name}").createOrReplaceTempView(name)
        for name, bad in checks.items():
            if rows := bad.limit(3).collect():
                raise ValueError(f"{name}: {rows}")
        with _lock(spark, f"{root}/{POINTER}.lock"):
            if expected != "any" and current(spark, root) != expected:
                raise ValueError(f"{root} is at {current(spark, root)}, not {expected}")
            put_text(spark, f"{root}/{POINTER}", version)
    except BaseException:
        fs.delete(at, True)
        raise
    return stage


@contextlib.contextmanager
def _lock(spark: SparkSession, path: str) -> Iterator[None]:
    """Held by whoever created the file; a lock left by a writer that died must be removed by hand."""
    fs, p, _ = _fs(spark, path)
    if not fs.createNewFile(p):
        raise ValueError(f"{path} is held by another writer")
    try:
        yield
    finally:
        fs.delete(p, False)


def upserted(state: DataFrame, news: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """State and news merged: the last version of each key by ``order``."""
    return latest(state.unionByName(news), keys, order)


def drifted(recorded: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """Recorded inputs that are gone or whose digest changed since."""
    return recorded.join(now.select(key, F.col(digest).alias("_d")), key, "left").where(~F.col(digest).eqNullSafe(F.col("_d"))).drop("_d")


def json_report(findings: DataFrame, path: str, by: str = "code") -> dict[str, int]:
    """Findings as JSON lines, and the count of each code (few codes by nature)."""
    findings.write.mode("overwrite").json(path)
    return {r[by]: r["count"] for r in findings.groupBy(by).count().collect()}


def markdown_report(spark: SparkSession, counts: dict[str, int], title: str, path: str) -> str:
    """The counts of a report as a Markdown table, the most frequent first, written to ``path``."""
    lines = [f"# {title}", "", "| code | count |", "| --- | --- |", *(f"| {k} | {n} |" for k, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])))]
    text = "\n".join(lines) + "\n"
    put_text(spark, path, text)
    return text


def responses(df: DataFrame, key: str) -> DataFrame:
    """(key, body): each row as one JSON object, nulls kept."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("body"))


def totals_text(counts: dict[str, int]) -> str:
    return json.dumps(counts, ensure_ascii=False, sort_keys=True)
