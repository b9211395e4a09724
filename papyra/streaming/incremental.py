"""Structured Streaming form of the restartable text pipeline, and windowed event counts.

Keyed by content hash: a changed text is a new piece of work, the same text is none. Streams run in
micro-batches whose sink is idempotent, so a replayed batch changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyra.sources.sinks import put_text, read_text, remove, upserted


def pending(work: DataFrame, done: DataFrame, quarantined: DataFrame, keys: list[str], eligible: Column) -> DataFrame:
    """Eligible work that is neither done nor quarantined under the same keys (the last key being the hash)."""
    return work.where(eligible).join(done.select(*keys).distinct(), keys, "left_anti").join(quarantined.select(*keys).distinct(), keys, "left_anti")


def accepted(results: DataFrame, source: str, output: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad with a reason): outputs that are empty, unchanged, without ideographs or with a leftover marker are bad."""
    why = F.when(F.coalesce(F.trim(output), F.lit("")) == "", "empty").when(F.col(output) == F.col(source), "unchanged").when(~F.col(output).rlike(r"[\x{3400}-\x{9fff}]"), "no ideographs").when(F.col(output).rlike("⟦"), "leftover marker")
    judged = results.withColumn("reason", why)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


MANIFEST = "MANIFEST"


def _manifest(spark: SparkSession, root: str) -> dict:
    text = read_text(spark, f"{root}/{MANIFEST}")
    return json.loads(text) if text else {"batch": -1, "buckets": {}}


def read_state(spark: SparkSession, root: str) -> DataFrame | None:
    """The merged state, or None before the first batch."""
    places = sorted(set(_manifest(spark, root)["buckets"].values()))
    return spark.read.parquet(*places).drop("_bucket") if places else None


def merge_stream(stream: DataFrame, root: str, keys: list[str], order: list[str], checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Upsert a stream into a folder of ``buckets`` hash buckets of the keys; see ``read_state``.

    A batch rewrites only the buckets its keys fall into and then switches one manifest, which names the
    folder of every bucket and the last batch. A batch that is run again after the switch does nothing;
    one that failed before it writes the same folders again. Folders that a batch replaces are kept
    until the next one, for readers under way.
    """

    def sink(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        now = _manifest(spark, root)
        if now["batch"] >= n:
            return
        news = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["_bucket"] for r in news.select("_bucket").distinct().collect()]  # at most ``buckets``
        old = [now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]]
        state = spark.read.schema(batch.schema).parquet(*old) if old else batch.limit(0)
        merged = upserted(state, batch, keys, order).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/b{n}")
        put_text(spark, f"{root}/{MANIFEST}", json.dumps({"batch": n, "buckets": now["buckets"] | {str(b): f"{root}/b{n}/_bucket={b}" for b in touched}, "replaced": old}))
        for place in now.get("replaced", []):
            remove(spark, place)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, kind: str, value: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their sum by kind and tumbling window; later than ``late`` is dropped once the stream has moved on."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def file_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 16) -> DataFrame:
    """New parquet files of a folder, at most ``per_trigger`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def stale(built: DataFrame, inputs: DataFrame, key: str, modified: str) -> DataFrame:
    """Built outputs with an input modified after them."""
    newest = inputs.groupBy(key).agg(F.max(modified).alias("_m"))
    return built.join(newest, key).where(F.col("_m") > F.col(modified)).drop("_m")
