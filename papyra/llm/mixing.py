"""Mixing sources to target token shares by systematic sampling.

Within a source every document has the same expected number of copies r; the running sum of
expected copies plus one random offset crosses an integer once per copy. Documents run in order of
size, so the copies spread evenly over sizes and the token share follows the target closely.

The running sum is not computed in one task per source: documents fall into cells (source, size
class, hash bucket), cell counts are summed up over a small table, and only ranks within a cell
need a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.tokens import TOKENIZER, with_tokens
from papyra.session import cut, maybe_broadcast, spread

#: Documents of one (source, size class) that share a hash bucket, about; larger classes have more buckets.
CELL_ROWS = 20_000
#: Rows of the target table; beyond it the targets are data, not a plan.
MAX_SOURCES = 10_000


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> dict[str, float]:
    """Expected copies per document of each source.

    ``total`` tokens are asked for; without it the largest total that all caps allow. Sources of
    the plan that hold no tokens are left out and their share is spread in proportion over the
    others; the report shows it as missing.
    """
    live = [(s, w, m) for s, w, m in targets if w and w > 0 and m and m > 0 and sizes.get(s, 0) > 0]
    if not live:
        return {}
    weight = sum(w for _, w, _ in live)
    most = min(m * sizes[s] * weight / w for s, w, m in live)
    total = min(total, most) if total is not None else most
    return {s: min(m, total * w / weight / sizes[s]) for s, w, m in live}


def mix(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str = "source", seed: int = 42, total: int | None = None, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(mix, report).

    mix: (key, source, n_tokens, copies) with one row for each eligible document: how often it is used,
    0 if it is left out, never above the source's max_repeats; ``uses`` emits the copies. report: (source, target_share, max_repeats, documents,
    tokens, actual_share, copies_per_document) with one row for each target, also those that no
    document serves.

    Documents without a source, of a source that has no target, and without tokens (null, empty) stay
    out. Equal texts under different keys are different documents. The same seed gives the same mix.
    """
    want = targets.select("source", "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    plan_rows = want.limit(MAX_SOURCES + 1).collect()
    if len(plan_rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    named = docs.select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.col(text).alias("_t"))
    named = named.join(maybe_broadcast(want.select(F.col("source").alias("_s")), 200), "_s", "left_semi").where(F.octet_length("_t") > 0)
    sized = cut(with_tokens(spread(named), "_t", "_n", path).select("_k", "_s", "_n").where("_n > 0"))
    classed = sized.withColumn("_c", F.floor(F.log2("_n") * 4).cast("int"))
    buckets = classed.groupBy("_s", "_c").agg(F.ceil(F.count("*") / CELL_ROWS).alias("_b"))
    cells = classed.join(maybe_broadcast(buckets, 100), ["_s", "_c"]).withColumn("_h", F.pmod(F.xxhash64("_k"), F.col("_b")).cast("int")).drop("_b")
    counts = cells.groupBy("_s", "_c", "_h").agg(F.count("*").alias("_d"), F.sum("_n").alias("_tokens"))
    sizes = {r["_s"]: r["t"] for r in counts.groupBy("_s").agg(F.sum("_tokens").alias("t")).collect()}  # a row for each target at most
    rates = plan(sizes, [(r["source"], r["target_share"], r["max_repeats"]) for r in plan_rows], total)
    spark = docs.sparkSession
    rate = spark.createDataFrame([(s, float(r)) for s, r in rates.items()], "_s string, _r double")
    before = Window.partitionBy("_s").orderBy("_c", "_h").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_d").over(before), F.lit(0))).join(F.broadcast(rate), "_s").select("_s", "_c", "_h", "_before", "_r")
    within = Window.partitionBy("_s", "_c", "_h").orderBy("_n", "_k")
    ranked = cells.withColumn("_i", F.row_number().over(within)).join(maybe_broadcast(starts, 120), ["_s", "_c", "_h"])
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("_s")), F.lit(1 << 30)) / float(1 << 30)
    upto = lambda i: F.floor(i * F.col("_r") + offset)
    copies = upto(F.col("_before") + F.col("_i")) - upto(F.col("_before") + F.col("_i") - 1)
    decided = ranked.withColumn("_copies", copies.cast("int"))
    used = decided.where("_copies > 0")
    out = decided.select(F.col("_k").alias(key), F.col("_s").alias("source"), F.col("_n").alias("n_tokens"), F.col("_copies").alias("copies"))
    per = used.groupBy(F.col("_s").alias("source")).agg(F.count("*").alias("documents"), F.sum(F.col("_n").cast("long") * F.col("_copies")).alias("tokens"))
    report = (
        want.join(per, "source", "left").join(rate.withColumnRenamed("_s", "source").withColumnRenamed("_r", "copies_per_document"), "source", "left")
        .withColumn("documents", F.coalesce("documents", F.lit(0))).withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("actual_share", F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())))
    )
    return out, report


def uses(mixed: DataFrame) -> DataFrame:
    """One row for each use of a document of a mix, ``copy`` counting from 1."""
    rest = [c for c in mixed.columns if c != "copies"]
    return mixed.where("copies > 0").select(*rest, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
