"""Sources, sinks and streams as queries: tables go out to files in the shared folder and come back through the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as fx
from papyra.operators import bank
from papyra.plans.registry import Registry, current
from papyra.session import shared_folder, table
from papyra.sources import readers, sinks
from papyra.streaming import incremental

query = Registry()


def _one_file_each(df: DataFrame, key: str, text: str, folder: str) -> str:
    """Each row's text as a file of its own folder."""
    df.select(F.col(key).alias("of"), F.col(text).alias("value")).repartition("of").write.partitionBy("of").text(folder)
    return folder


# Sources


@query("select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders")
def json_lines_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as JSON lines, read with a schema; blank lines and repeated keys would fail the scan."""
    o, folder = table(spark, sf, "orders"), shared_folder(spark, "lines")
    o.select(F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))).write.text(folder)
    return readers.json_lines(spark, folder, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string", "o_orderkey")


@query("select n_nationkey, n_name, n_regionkey from nation")
def json_object_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One object a file; a file that holds anything else would fail the scan."""
    n = table(spark, sf, "nation").withColumn("body", F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")))
    folder = _one_file_each(n, "n_nationkey", "body", shared_folder(spark, "objects"))
    return readers.json_objects(spark, [f"{folder}/*/*.txt"], "n_nationkey int, n_name string, n_regionkey int").select("n_nationkey", "n_name", "n_regionkey")


@query("select n_name as name, strlen(n_name) + 1 as bytes, sha256(n_name || chr(10)) as sha256 from nation")
def file_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Size and digest of every file under a folder, whose number must be that of the nations."""
    n = table(spark, sf, "nation")
    folder = _one_file_each(n, "n_name", "n_name", shared_folder(spark, "files"))
    files = readers.recursive(spark, folder, "*.txt", n.count())
    name = F.replace(F.regexp_extract("path", "/of=([^/]*)/", 1), F.lit("%20"), F.lit(" "))
    return files.select(name.alias("name"), "bytes", F.sha2("content", 256).alias("sha256"))


@query("select r_regionkey, r_name from region where r_regionkey in (1, 3)")
def manifest_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The parts that a manifest lists, and no others."""
    folder = shared_folder(spark, "parts")
    table(spark, sf, "region").withColumn("of", F.col("r_regionkey")).write.partitionBy("of").parquet(folder)
    return spark.read.parquet(*readers.listed_paths(folder, ["of=1", "of=3"])).select("r_regionkey", "r_name")


@query("select p_partkey, cast(p_size as double) as x, cast(p_retailprice as double) as y, p_type as text, p_size + 10.0 as moved from part")
def svg_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Text layers read by pattern and, with their group's shift, by element."""
    p = table(spark, sf, "part")
    span = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><g transform="translate(10, 0)"><text font-size="9" x="'), F.col("p_size").cast("string"), F.lit('" y="'), F.col("p_retailprice").cast("string"), F.lit('"><tspan>'), "p_type", F.lit("</tspan></text></g></svg>"))
    rows = p.select("p_partkey", span.alias("markup"))
    strict = readers.svg_spans_strict(rows, "p_partkey", "markup").select("p_partkey", F.col("x").alias("moved"))
    return readers.svg_spans(rows, "p_partkey", "markup").join(strict, "p_partkey").select("p_partkey", "x", "y", "text", "moved")


@query("""select c_custkey, c_name || ' & Co' as title, c_mktsegment as segment, 'https://shop.test/of/' || c_custkey as link, cast(null as varchar) as elsewhere, '<b>' || c_name || '</b> & &amp' as entities from customer""")
def html_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Elements chosen by tag, class and place; links of the same origin only; complete entities only."""
    c = table(spark, sf, "customer")
    markup = F.concat(F.lit('<div class="card"><h1>'), "c_name", F.lit(' &amp; Co</h1><p class="seg main">'), "c_mktsegment", F.lit('</p><script>x < 1</script></div><p>other</p>'))
    base, raw = F.lit("https://shop.test/list/a.htm"), F.concat(F.lit("&lt;b&gt;"), "c_name", F.lit("&lt;/b&gt; &amp; &amp"))
    rows = c.select("c_custkey", markup.alias("m"), F.concat(F.lit("../of/"), F.col("c_custkey").cast("string")).alias("u"), raw.alias("r"))
    first = lambda x: F.element_at(x, 1)
    return rows.select("c_custkey", first(fx.selected(F.col("m"), "h1")).alias("title"), first(fx.selected(F.col("m"), of_class="seg", within="div")).alias("segment"), fx.same_origin_link(base, F.col("u")).alias("link"), fx.same_origin_link(base, F.lit("https://else.test/x")).alias("elsewhere"), fx.unescape("r").alias("entities"))


@query("""with a as (select doc_id, category, source, 0 as p from documents where lang = 'zh' union all select doc_id, upper(category), source, 1 from documents where source is not null) select doc_id, category, source from (select *, row_number() over (partition by doc_id order by p) as n from a) where n = 1""")
def first_manifest_wins(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "category", "source", "lang")
    return readers.first_of_sources([d.where("lang = 'zh'").drop("lang"), d.where("source is not null").withColumn("category", F.upper("category")).drop("lang")], "doc_id")


# Sinks and streams


@query("select n.n_nationkey, r.r_name, true as refused from nation n join region r on r.r_regionkey = n.n_regionkey")
def published_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables published together, a second version refused by its check, and the first read through the pointer."""
    root = shared_folder(spark, "published")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    sinks.publish(spark, root, "one", {"nation": n, "region": r}, {"keys": n.groupBy("n_nationkey").count().where("count > 1")}, expected=None)
    refused = False
    try:
        sinks.publish(spark, root, "two", {"nation": n.limit(0)}, {"no rows": spark.range(1)}, expected="one")
    except ValueError:
        refused = True
    at = f"{root}/{sinks.current(spark, root)}"
    return spark.read.parquet(f"{at}/nation").join(spark.read.parquet(f"{at}/region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name", F.lit(refused).alias("refused"))


@query("""select path, paragraph_id, source_hash, provider, epoch_us(translated_at) as at from t""", "t")
def streamed_state(spark: SparkSession, sf: str) -> DataFrame:
    """Translations arriving as a stream of files, merged by key; what arrives twice changes nothing."""
    src, root = shared_folder(spark, "arrivals"), shared_folder(spark, "state")
    t = table(spark, sf, "translations")
    manual = F.coalesce(F.col("provider") == "manual", F.lit(False))
    for i, part in enumerate((t.where(manual), t.where(~manual), t.where(manual))):
        part.write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(t.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 4).parquet(src)
    incremental.merge_stream(stream, root, ["path", "paragraph_id", "source_hash"], ["translated_at"], shared_folder(spark, "offsets"), buckets=16).awaitTermination()
    return incremental.read_state(spark, root).select("path", "paragraph_id", "source_hash", "provider", F.unix_micros("translated_at").alias("at"))


@query("""with i as (select paper_id, max(ingested_at) as m from b group by paper_id) select p.id, epoch_us(p.ingested_at) as built from p join i on i.paper_id = p.id where i.m > p.ingested_at""", "pb")
def stale_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Papers that were taken in before the last of their blocks."""
    p, b = current(spark, sf, "papers").select("id", "ingested_at"), current(spark, sf, "source_blocks").select(F.col("paper_id").alias("id"), "ingested_at")
    return incremental.stale(p, b, "id", "ingested_at").select("id", F.unix_micros("ingested_at").alias("built"))


@query("""select id, '{"id":' || to_json(id) || ',"label":' || coalesce(to_json(label), 'null') || ',"text":' || coalesce(to_json(text), 'null') || ',"is_correct":' || coalesce(cast(is_correct as varchar), 'null') || '}' as body from o""", "o")
def json_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON objects in column order, nulls kept, characters as they are."""
    return sinks.responses(current(spark, sf, "options").select("id", "label", "text", "is_correct"), "id").select(F.get_json_object("body", "$.id").alias("id"), "body")


@query("""with x as (select case when text is null then 'no_text' when length(text) < 30 then 'short' else 'long' end as code from b) select code, count(*) as n from x group by code""", "b")
def reported_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings written as a JSON report and read again, counted by code."""
    b = current(spark, sf, "source_blocks")
    folder = shared_folder(spark, "report")
    counts = sinks.json_report(b.select("id", F.when(F.col("text").isNull(), "no_text").when(F.length("text") < 30, "short").otherwise("long").alias("code")), folder)
    sinks.markdown_report(spark, counts, "Findings", f"{folder}.md")
    return spark.read.schema("id string, code string").json(folder).groupBy("code").agg(F.count("*").alias("n"))


@query()
def bank_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Every table built from the papers' records, with its number of rows; records that do not fit the schema give what they hold of it."""
    text = F.regexp_replace("raw_json", "\\A\ufeff?\\s*", "")
    papers = current(spark, sf, "papers").select(F.from_json(text, bank.PAPER).alias("p")).select("p.*").where("id is not null")
    out = None
    for name, df in bank.build(papers).items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES, SQL = query.queries, query.sql
