"""Ordered-row operators, trees, incremental state and stream windows as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions import text as fx
from papyra.operators import relate, sequence, tree
from papyra.plans.registry import Registry, current
from papyra.sources.sinks import drifted, upserted
from papyra.session import table
from papyra.streaming.incremental import accepted, pending

query = Registry()
#: Blocks of one paper that are ordered in one task; a paper holds a tenth of all, so its order is made by parts.
CHUNK = 100_000


# As-of, carry-forward, islands, gaps


@query("""with l as (select event_id, user_id, ts from events where event_type = 'purchase'), r as (select user_id, ts, event_id as view_id from events where event_type = 'view')
 select l.event_id, r.view_id as as_of_view from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts""")
def last_view_before_purchase(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    views = e.where("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("view"))
    return sequence.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "at"), views, ["user_id"], "at", "view").select("event_id", "as_of_view")


@query("""with l as (select event_id, user_id, ts from events where event_type = 'error'), r as (select user_id, ts - interval 30 minute as ts, event_id as click_id from events where event_type = 'click')
 select l.event_id, r.click_id as as_of_click from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts""")
def nearest_click_with_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    clicks = e.where("event_type = 'click'").select("user_id", "at", F.col("event_id").alias("click"))
    return sequence.as_of(e.where("event_type = 'error'").select("event_id", "user_id", "at"), clicks, ["user_id"], "at", "click", 30 * 60 * 1e6).select("event_id", "as_of_click")


@query("select id, last_value(case when role = 'heading' then id end ignore nulls) over (partition by paper_id order by ordinal, id rows between unbounded preceding and current row) as section from b", "b")
def section_of_block(spark: SparkSession, sf: str) -> DataFrame:
    b = current(spark, sf, "source_blocks").select("id", "paper_id", "ordinal", "role")
    return sequence.carry_forward(b, ["paper_id"], ["ordinal", "id"], F.col("role") == "heading", "id", "section", F.floor(F.col("ordinal") / CHUNK)).select("id", "section")


@query("""with x as (select user_id, value, event_type = 'error' as f, row_number() over (partition by user_id order by ts, event_id) as n, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id) as g from events)
 select user_id, min(n) as "start", max(n) as "end", count(*) as length, round(sum(coalesce(value, 0)), 2) as size from x where f group by user_id, g having count(*) >= 3 and sum(coalesce(value, 0)) >= 28""")
def error_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of at least three errors whose values sum to 28 or more."""
    runs = sequence.islands(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 3, F.col("value"), 28)
    return runs.withColumn("size", F.round("size", 2))


@query("select id, row_number() over (partition by paper_id, number order by ordinal, id) as occurrence, row_number() over (partition by paper_id order by ordinal, id) as place from q", "q")
def occurrences(spark: SparkSession, sf: str) -> DataFrame:
    q = current(spark, sf, "questions").select("id", "paper_id", "number", "ordinal")
    one = sequence.ordinals(q, ["paper_id", "number"], ["ordinal", "id"], "occurrence")
    return sequence.ordinals(one, ["paper_id"], ["ordinal", "id"], "place").select("id", "occurrence", "place")


@query("""with n as (select l_orderkey, l_linenumber, l_partkey from lineitem), x as (select l_orderkey, l_linenumber, l_partkey, max(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey rows between unbounded preceding and 1 preceding) as top from n)
 select l_orderkey, l_linenumber, l_partkey from x where top is null or l_partkey > top""")
def running_maxima(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return sequence.running_maxima(li, ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey")


@query("""with x as (select l_orderkey, min(l_linenumber) as lo, max(l_linenumber) as hi from lineitem group by l_orderkey having count(distinct l_linenumber) >= 4), n as (select l_orderkey, unnest(range(lo, hi + 1)) as l_linenumber from x)
 select n.l_orderkey, n.l_linenumber from n where not exists (select 1 from lineitem l where l.l_orderkey = n.l_orderkey and l.l_linenumber = n.l_linenumber)""")
def missing_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.missing_between(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", 4)


@query("select l_orderkey, min(l_linenumber) as lo, max(l_linenumber) as hi, count(l_linenumber) as n from lineitem group by l_orderkey having min(l_linenumber) <> 1 or max(l_linenumber) <> count(*) or count(*) <> count(distinct l_linenumber)")
def numbering_check(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.not_contiguous(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""with x as (select user_id, event_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) > 3600000000 then 1 else 0 end as gap from events)
 select event_id, sum(gap) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as part from x""")
def sessions_by_gap(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("user_id").orderBy("at", "event_id")) > 3_600_000_000
    return sequence.groups_by_gap(e, ["user_id"], ["at", "event_id"], gap).select("event_id", "part")


@query("""with x as (select id, paper_id, ordinal, text, sum(case when role = 'stem' then 1 else 0 end) over (partition by paper_id order by ordinal, id rows between unbounded preceding and current row) as g from b where role <> 'header')
 select paper_id, g as part, string_agg(text, ' ' order by ordinal, id) as joined from x where g > 0 and text is not null group by paper_id, g""", "b")
def marker_groups(spark: SparkSession, sf: str) -> DataFrame:
    b = current(spark, sf, "source_blocks").where("role <> 'header'").select("id", "paper_id", "ordinal", "role", "text")
    parts = sequence.groups_by_gap(b, ["paper_id"], ["ordinal", "id"], F.col("role") == "stem", chunk=F.floor(F.col("ordinal") / CHUNK)).where("part > 0 and text is not null")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id", "text"))), lambda x: x["text"])
    return parts.groupBy("paper_id", "part").agg(F.array_join(joined, " ").alias("joined"))


@query("select id, lag(role) over (partition by paper_id order by ordinal, id) as before, coalesce(lag(page) over (partition by paper_id order by ordinal, id) is distinct from page, true) as new_page from b", "b")
def previous_row(spark: SparkSession, sf: str) -> DataFrame:
    b = current(spark, sf, "source_blocks").select("id", "paper_id", "ordinal", "role", "page")
    x = sequence.previous(b, ["paper_id"], ["ordinal", "id"], ["role", "page"], F.floor(F.col("ordinal") / CHUNK))
    return x.select("id", F.col("before_role").alias("before"), (~F.col("before_page").eqNullSafe(F.col("page"))).alias("new_page"))


@query("""with x as (select user_id, event_type, event_id, ts, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events)
 select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from x where n = 1) where k <= 3""")
def most_recent_three(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    once = relate.first_seen(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return once.withColumn("_k", F.row_number().over(w)).where("_k <= 3").select("user_id", "event_type", "event_id")


@query("select id from q where number is not null order by id limit 25", "q")
def capped_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Lexicographic id order with a cap, the feature itself."""
    return current(spark, sf, "questions").where("number is not null").select("id").orderBy("id").limit(25)


@query("select l_orderkey, max_by(l_suppkey, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) as last_supplier, count(*) as n from lineitem group by l_orderkey")
def last_writer_wins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_suppkey", F.col("l_linenumber") * 10000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("last_supplier"), F.count("*").alias("n"))


@query("""with x as (select paper_id, list(try_cast(number as integer) order by ordinal, id) filter (where try_cast(number as integer) is not null) as ns from q group by paper_id)
 select paper_id, coalesce(len(ns), 0) as listed, coalesce(list_max(ns), 0) as top from x""", "q")
def listed_numbers(spark: SparkSession, sf: str) -> DataFrame:
    q = current(spark, sf, "questions").withColumn("_n", F.col("number").try_cast("int"))
    return q.groupBy("paper_id").agg(F.count("_n").alias("listed"), F.coalesce(F.max("_n"), F.lit(0)).alias("top"))


@query("""with x as (select paper_id, list(try_cast(number as integer) order by ordinal, id) filter (where try_cast(number as integer) is not null) as ns from q group by paper_id having count(try_cast(number as integer)) > 0)
 select paper_id, list_reduce(list_prepend(0, ns), lambda a, v: case when v = a + 1 then v else a end) as accepted, len(ns) as numbers from x""", "q")
def accepted_numbering(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers taken one after another from 1; others are passed over."""
    q = current(spark, sf, "questions").withColumn("_n", F.col("number").try_cast("int")).where("_n is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id", "_n"))), lambda x: x["_n"])
    return q.groupBy("paper_id").agg(F.size(sequence.consecutive_from_one(ordered)).alias("accepted"), F.count("*").alias("numbers"))


@query("""with n as (select unnest(range(1, 48)) as number), x as (select cast(l_quantity as integer) as number, count(*) as uses from lineitem where l_quantity <= 60 group by 1)
 select coalesce(n.number, x.number) as number, coalesce(x.uses, 0) as uses, n.number is not null as wanted from n full join x on x.number = n.number""")
def exact_coverage(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.range(1, 48).select(F.col("id").cast("int").alias("number"), F.lit(True).alias("_w"))
    x = table(spark, sf, "lineitem").where("l_quantity <= 60").groupBy(F.col("l_quantity").cast("int").alias("number")).agg(F.count("*").alias("uses"))
    return n.join(x, "number", "full_outer").select("number", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("_w", F.lit(False)).alias("wanted"))


@query("select paper_id, section_kind from q where number is not null group by paper_id, section_kind having list_has_all(list(distinct cast(number as varchar)), ['1', '2'])", "q")
def complete_slots(spark: SparkSession, sf: str) -> DataFrame:
    q = current(spark, sf, "questions").where("number is not null").groupBy("paper_id", "section_kind").agg(F.collect_set("number").alias("_n"))
    return q.where(F.size(F.array_except(F.array(F.lit("1"), F.lit("2")), "_n")) == 0).select("paper_id", "section_kind")


@query("""with recursive w as (select path, paragraph_id, source_hash, length(translation) + length(regexp_replace(translation, '[^\\x{10000}-\\x{10ffff}]', '', 'g')) as units, contains(translation, '__') as alone, row_number() over (partition by path order by paragraph_id, source_hash) as i from t where translation is not null),
 r as (select path, i, units as total, 1 as n, 0 as batch, alone as closed from w where i = 1 union all select w.path, w.i, case when fresh then w.units else r.total + w.units end, case when fresh then 1 else r.n + 1 end, case when fresh then r.batch + 1 else r.batch end, w.alone
 from r join (select *, i - 1 as before from w) w on w.path = r.path and w.before = r.i, lateral (select r.closed or w.alone or r.n >= 6 or r.total + w.units > 5000 as fresh) f)
 select w.path, paragraph_id, source_hash, units, w.alone, batch from w join r on r.path = w.path and r.i = w.i""", "t")
def packed_work(spark: SparkSession, sf: str) -> DataFrame:
    """Translations packed in order into batches of 6 and 5,000 UTF-16 units."""
    t = current(spark, sf, "translations").where("translation is not null")
    work = t.select("path", "paragraph_id", "source_hash", fx.utf16_units(F.col("translation")).alias("units"), F.contains("translation", F.lit("__")).alias("alone"))
    return sequence.packed_batches(work, ["path"], ["paragraph_id", "source_hash"], "units", "alone", 6, 5000)


@query("""with recursive w as (select p_brand, p_size, p_partkey, p_retailprice as y, row_number() over (partition by p_brand, p_size order by p_retailprice, p_partkey) as i from part),
 r as (select p_brand, p_size, i, [y] as tops, 0 as line from w where i = 1 union all select w.p_brand, w.p_size, w.i, case when hit is null then list_append(r.tops, w.y) else r.tops end, coalesce(hit, len(r.tops))
 from r join (select *, i - 1 as before from w) w on w.p_brand = r.p_brand and w.p_size = r.p_size and w.before = r.i, lateral (select list_min(list_filter(range(greatest(len(r.tops) - 3, 0), len(r.tops)), lambda k: abs(r.tops[k + 1] - w.y) <= 5.0)) as hit) f)
 select w.p_brand, w.p_size, w.p_partkey, w.y, r.line from w join r on r.p_brand = w.p_brand and r.p_size = w.p_size and r.i = w.i""")
def clustered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Spans (here: parts of one brand and size, placed by price) clustered into lines against the last three."""
    p = table(spark, sf, "part").select("p_brand", "p_size", "p_partkey", F.col("p_retailprice").alias("y"))
    return sequence.line_clusters(p, ["p_brand", "p_size"], "y", ["y", "p_partkey"], 5.0)


# Trees


@query("""with recursive n as (select 'r' || r_regionkey as id, null as parent from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
 d as (select id, id as root, 0 as depth from n where parent is null union all select n.id, d.root, d.depth + 1 from d join n on n.parent = d.id where d.depth < 8) select id, root, depth from d""")
def tree_descent(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _places(spark, sf)
    return tree.descend(nodes, "id", "parent", nodes.where("parent is null"), "id")


def _places(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return r.unionByName(n).unionByName(c)


@query("""with n as (select 'n' || n_nationkey as id from nation where n_regionkey = 1 union all select 'c' || c_custkey from customer join nation on n_nationkey = c_nationkey where n_regionkey = 1 union all select 'r1')
 select id from n""")
def hidden_subtree(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _places(spark, sf)
    return tree.hidden_below(nodes, "id", "parent", nodes.where("id = 'r1'"))


@query("""with h as (select c_custkey from customer where c_mktsegment <> 'BUILDING') select l_partkey as part from (select l.l_partkey, h.c_custkey is not null as hidden from lineitem l join orders o on o.o_orderkey = l.l_orderkey left join h on h.c_custkey = o.o_custkey) group by l_partkey having bool_and(hidden)""")
def wholly_hidden_targets(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part")).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("owner")), "l_orderkey")
    hidden = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey")
    return tree.wholly_owned(links, "part", "owner", hidden, "c_custkey")


@query("""with e as (select x.paper_id, x.id, x.section_kind, x.ordinal, (select min(y.id) from q y where y.paper_id = x.paper_id and y.section_kind = x.section_kind and y.number = '1') as parent from q x)
 select e.id from e left join q p on p.paper_id = e.paper_id and p.id = e.parent where e.parent is not null and (p.ordinal is null or p.ordinal >= e.ordinal)""", "q")
def toc_order(spark: SparkSession, sf: str) -> DataFrame:
    q = current(spark, sf, "questions").select("paper_id", "id", "section_kind", "number", "ordinal")
    heads = q.where("number = '1'").groupBy("paper_id", "section_kind").agg(F.min("id").alias("parent"))
    return tree.order_violations(q.join(heads, ["paper_id", "section_kind"], "left"), ["paper_id"], "id", "parent", "ordinal").select("id")


@query("select q.id, coalesce(lag(q.id) over w, '') as previous, coalesce(lead(q.id) over w, '') as next from q window w as (partition by paper_id order by ordinal, id)", "q")
def linked_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("paper_id").orderBy("ordinal", "id")
    return current(spark, sf, "questions").select("id", F.coalesce(F.lag("id").over(w), F.lit("")).alias("previous"), F.coalesce(F.lead("id").over(w), F.lit("")).alias("next"))


@query("""with c as (select c_nationkey as k, string_agg('{"id":"c' || c_custkey || '","label":"C' || c_custkey || '","children":[]}', ',' order by 'c' || c_custkey) as kids from customer group by 1),
 n as (select n_regionkey as k, string_agg('{"id":"n' || n_nationkey || '","label":"N' || n_nationkey || '","children":[' || coalesce(c.kids, '') || ']}', ',' order by 'n' || n_nationkey) as kids from nation left join c on c.k = n_nationkey group by 1)
 select 'r' || r_regionkey as id, '{"id":"r' || r_regionkey || '","label":"R' || r_regionkey || '","children":[' || coalesce(n.kids, '') || ']}' as tree from region left join n on n.k = r_regionkey""")
def nested_places(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _places(spark, sf).withColumn("label", F.upper("id"))
    return tree.nested(nodes, "id", "parent", "label", 2)


# Incremental state

_KEYS = ["path", "paragraph_id", "source_hash"]


@query("""select path, paragraph_id, source_hash from t where length(source_hash) = 64 and translation is not null and provider is distinct from 'manual' and not exists (select 1 from documents d where d.source = 'none' and d.text = t.translation)
 and (path, paragraph_id, source_hash) not in (select path, paragraph_id, source_hash from t where provider = 'memory')""", "t")
def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    t = current(spark, sf, "translations")
    eligible = (F.length("source_hash") == 64) & F.col("translation").isNotNull()
    return pending(t, t.where("provider = 'memory'"), t.where("provider = 'manual'"), _KEYS, eligible).select(*_KEYS)


@query("select path, paragraph_id, source_hash, provider, epoch_us(translated_at) as at from t", "t")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "translations")
    manual = F.coalesce(F.col("provider") == "manual", F.lit(False))
    merged = upserted(t.where(~manual), t.where(manual), _KEYS, ["translated_at"])
    return merged.select(*_KEYS, "provider", F.unix_micros("translated_at").alias("at"))


@query("""with x as (select doc_id, text from documents where text is not null) select x.doc_id, (select min(y.doc_id) from x y where y.text = x.text) as representative from x""")
def representative_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("_h"))
    return relate.fan_out(d, ["_h"], F.col("doc_id"), "doc_id").select("doc_id", "representative")


@query("""select path, paragraph_id, case when translation is null or trim(translation) = '' then 'empty' when not regexp_matches(translation, '[\\x{3400}-\\x{9fff}]') then 'no ideographs' when contains(translation, '⟦') then 'leftover marker' end as reason
 from t where translation is null or trim(translation) = '' or not regexp_matches(translation, '[\\x{3400}-\\x{9fff}]') or contains(translation, '⟦')""", "t")
def quarantined_results(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(current(spark, sf, "translations"), "source_hash", "translation")[1].select("path", "paragraph_id", "reason")


@query("select id from b where text is not null and sha256(text) <> sha256(regexp_replace(text, '\\r\\n', '\n', 'g'))", "b")
def input_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks whose recorded digest no longer holds once line ends are made uniform."""
    b = current(spark, sf, "source_blocks").where("text is not null")
    recorded = b.select("id", F.sha2("text", 256).alias("h"))
    now = b.select("id", F.sha2(F.regexp_replace("text", "\r\n", "\n"), 256).alias("h"))
    return drifted(recorded, now, "id", "h").select("id")


@query("""select coalesce(m.path, a.path) as path, coalesce(m.paragraph_id, a.paragraph_id) as paragraph_id, coalesce(m.translation, a.translation) as published from (select * from t where provider = 'manual') m full join (select * from t where provider is distinct from 'manual') a on a.path = m.path and a.paragraph_id = m.paragraph_id and a.source_hash = m.source_hash""", "t")
def override_published(spark: SparkSession, sf: str) -> DataFrame:
    t = current(spark, sf, "translations")
    m, a = t.where("provider = 'manual'").select(*_KEYS, F.col("translation").alias("_m")), t.where("not (provider <=> 'manual')").select(*_KEYS, F.col("translation").alias("_a"))
    return m.join(a, _KEYS, "full_outer").select("path", "paragraph_id", F.coalesce("_m", "_a").alias("published"))


@query("""select event_type, epoch_us(date_trunc('hour', ts)) as window_start, count(*) as n, round(sum(value), 2) as total from events group by 1, 2""")
def hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: tumbling windows, the batch form of ``streaming.windowed_counts``."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select("event_type", F.unix_micros("w.start").alias("window_start"), "n", "total")


QUERIES, SQL = query.queries, query.sql
