"""Scans, projections, joins, aggregation, sets and integrity rules over the corpus and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions.text import answer_letters, chinese_number, has_all_terms, search_key
from papyra.operators import relate
from papyra.operators.constraints import Check, Reference, Unique, totals, violations
from papyra.plans.registry import Registry, current
from papyra.session import table

query = Registry()
# The catalog's category order.
CATEGORIES = ["kaoyan", "math3", "cs408", "politics", "cet6", "cet4", "tem4", "tem8", "none_yet"]
_LIST = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"


# Scans, projections, predicates


@query("select id as paper_id, title, category, year, list_position(" + _LIST + ", category) as category_rank from p where kind = 'questions' and year >= 2010", "p")
def catalog_listing(spark: SparkSession, sf: str) -> DataFrame:
    p = current(spark, sf, "papers").where("kind = 'questions' and year >= 2010")
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("int")
    return p.select(F.col("id").alias("paper_id"), "title", "category", "year", rank.alias("category_rank")).orderBy("category_rank", F.desc("year"), "paper_id")


@query("select id from p where contains(lower(title), '六级') and contains(lower(title), '真题') and year >= 2005", "p")
def catalog_search_terms(spark: SparkSession, sf: str) -> DataFrame:
    p = current(spark, sf, "papers").where("year >= 2005")
    return p.where(has_all_terms(search_key(F.col("title")), ["六级", "真题"])).select("id")


@query("select id, ordinal, (select count(*) from p) as total from p order by ordinal, id limit 60", "p")
def catalog_second_page(spark: SparkSession, sf: str) -> DataFrame:
    p = current(spark, sf, "papers")
    total = p.agg(F.count("*").alias("total"))
    return p.select("id", "ordinal").orderBy("ordinal", "id").limit(60).crossJoin(F.broadcast(total))


@query("select c as category, count(p.id) as papers from (select unnest(" + _LIST + ") as c) left join p on p.category = c group by c", "p")
def facet_counts_with_zero(spark: SparkSession, sf: str) -> DataFrame:
    dim = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counts = current(spark, sf, "papers").groupBy("category").agg(F.count("*").alias("papers"))
    return F.broadcast(dim).join(counts, "category", "left").select("category", F.coalesce("papers", F.lit(0)).alias("papers"))


@query("select id, page, role from b where role in ('stem', 'option') and length(text) >= 40 and not regexp_matches(text, 'https?://')", "b")
def filtered_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = current(spark, sf, "source_blocks")
    return b.where(F.col("role").isin("stem", "option") & (F.length("text") >= 40) & ~F.col("text").rlike("https?://")).select("id", "page", "role")


@query("select id, paper_id || ':' || local_id as global_id, number, question_type from q", "q")
def allowed_projection(spark: SparkSession, sf: str) -> DataFrame:
    q = current(spark, sf, "questions").withColumn("global_id", F.concat_ws(":", "paper_id", "local_id"))
    allow = ["id", "global_id", "number", "question_type", "not_there"]
    return q.select(*[c for c in allow if c in q.columns])


@query("""select id, case when context_json is null then null when json_extract_string(context_json, '$.kind') = 'wordBank' then json_extract_string(context_json, '$.blankNumber')
 when json_extract_string(context_json, '$.kind') = 'passage' then 'passage' end as shown from q""", "q")
def projection_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get_json_object("context_json", "$.kind")
    shown = F.when(kind == "wordBank", F.get_json_object("context_json", "$.blankNumber")).when(kind == "passage", "passage")
    return current(spark, sf, "questions").select("id", shown.alias("shown"))


@query("""with m as (select id, ordinal, min(case when role = 'answer' then ordinal end) over (partition by paper_id, source_page_index) as stop from b)
 select id from m where stop is null or ordinal < stop""", "b")
def before_first_marker(spark: SparkSession, sf: str) -> DataFrame:
    b = current(spark, sf, "source_blocks").select("id", "paper_id", "source_page_index", "ordinal", "role")
    w = Window.partitionBy("paper_id", "source_page_index")
    return b.withColumn("_stop", F.min(F.when(F.col("role") == "answer", F.col("ordinal"))).over(w)).where("_stop is null or ordinal < _stop").select("id")


@query("""select id, case when role = 'figure' or text is null then 'figure' when regexp_matches(text, '[{};]\\s*$') then 'code' when contains(text, '$') then 'formula'
 when role = 'instruction' then 'instruction' when length(text) > 120 then 'paragraph' else 'other' end as kind from b""", "b")
def block_kinds(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    kind = F.when((F.col("role") == "figure") | t.isNull(), "figure").when(t.rlike(r"[{};]\s*\z"), "code").when(F.contains(t, F.lit("$")), "formula")
    kind = kind.when(F.col("role") == "instruction", "instruction").when(F.length(t) > 120, "paragraph").otherwise("other")
    return current(spark, sf, "source_blocks").select("id", kind.alias("kind"))


@query("select doc_id, source from documents where source in ('essay_samples', 'ocr_scans')")
def requested_documents(spark: SparkSession, sf: str) -> DataFrame:
    return relate.all_requested(table(spark, sf, "documents"), "source", ["essay_samples", "ocr_scans"]).select("doc_id", "source")


# Joins


@query("select q.id, q.number, a.status as answer_status from q join a on a.question_id = q.id where q.in_bank = 1", "qa")
def questions_with_answers(spark: SparkSession, sf: str) -> DataFrame:
    q, a = current(spark, sf, "questions"), current(spark, sf, "answers")
    return q.where("in_bank = 1").join(a, q.id == a.question_id).select(q.id, q.number, a.status.alias("answer_status"))


@query("""select p.id as paper_id, count(*) as marked from p join q on q.paper_id = p.id join a on a.question_id = q.id join o on o.question_id = q.id
 where a.status = 'explicit' and o.is_correct = 1 and q.question_type in ('single_choice', 'multiple_choice') and p.year > 2000 group by p.id""", "pqao")
def four_way_join(spark: SparkSession, sf: str) -> DataFrame:
    p = current(spark, sf, "papers").where("year > 2000").select(F.col("id").alias("paper_id"))
    q = current(spark, sf, "questions").where("question_type in ('single_choice', 'multiple_choice')").select(F.col("id").alias("question_id"), "paper_id")
    a = current(spark, sf, "answers").where("status = 'explicit'").select("question_id")
    o = current(spark, sf, "options").where("is_correct = 1").select("question_id")
    return q.join(p, "paper_id").join(a, "question_id").join(o, "question_id").groupBy("paper_id").agg(F.count("*").alias("marked"))


@query("""select p.id, p.question_count, count(q.id) as found, sum(case when q.status = 'partial' then 1 else 0 end) as partial from p left join q on q.paper_id = p.id and q.in_bank = 1
 group by p.id, p.question_count having count(q.id) <> p.question_count or p.question_count is null or sum(case when q.status = 'partial' then 1 else 0 end) > 1""", "pq")
def paper_count_check(spark: SparkSession, sf: str) -> DataFrame:
    p, q = current(spark, sf, "papers").select("id", "question_count"), current(spark, sf, "questions").where("in_bank = 1").select("paper_id", F.col("id").alias("_q"), "status")
    got = p.join(q, q.paper_id == p.id, "left").groupBy("id", "question_count").agg(F.count("_q").alias("found"), F.sum(F.when(F.col("status") == "partial", 1).otherwise(0)).alias("partial"))
    return got.where("found <> question_count or question_count is null or partial > 1")


@query("select b.id from b where b.role = 'stem' and not exists (select 1 from q where q.id = b.question_id)", "bq")
def unrepresented_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b, q = current(spark, sf, "source_blocks").where("role = 'stem'"), current(spark, sf, "questions")
    return b.join(q, b.question_id == q.id, "left_anti").select("id")


@query("select q.id from q where exists (select 1 from o where o.question_id = q.id and o.is_correct is null)", "qo")
def questions_with_unknown_marks(spark: SparkSession, sf: str) -> DataFrame:
    q, o = current(spark, sf, "questions"), current(spark, sf, "options").where("is_correct is null")
    return q.join(o, o.question_id == q.id, "left_semi").select("id")


@query("""with c as (select paper_id || '#' || number as k, count(distinct id) as n, min(id) as t from q where number is not null group by 1),
 s as (select id, paper_id || '#' || regexp_extract(text, '^([0-9]+)\\.', 1) as k from b where role = 'stem' and text is not null)
 select s.id, case when coalesce(c.n, 0) = 0 then 'unresolved' when c.n = 1 then 'resolved' else 'ambiguous' end as outcome, case when c.n = 1 then c.t end as target from s left join c on c.k = s.k""", "qb")
def cardinality_lookup(spark: SparkSession, sf: str) -> DataFrame:
    q = current(spark, sf, "questions").where("number is not null").select(F.concat("paper_id", F.lit("#"), "number").alias("_k"), F.col("id").alias("target"))
    b = current(spark, sf, "source_blocks").where("role = 'stem' and text is not null")
    asked = b.select("id", F.concat("paper_id", F.lit("#"), F.regexp_extract("text", r"^([0-9]+)\.", 1)).alias("_k"))
    return relate.classified_lookup(asked, "id", "_k", q, "_k", "target")


@query("""select q.id, coalesce(string_agg(o.label || o.text, ';' order by o.default_position, o.id) filter (where o.text is not null), '') as options, count(o.id) as n from q left join o on o.question_id = q.id group by q.id""", "qo")
def decorrelated_children(spark: SparkSession, sf: str) -> DataFrame:
    q, o = current(spark, sf, "questions").select("id"), current(spark, sf, "options")
    child = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("default_position", F.col("id").alias("i"), F.concat("label", "text").alias("s")))))
    per = o.groupBy(F.col("question_id").alias("id")).agg(F.array_join(F.transform(child, lambda x: x["s"]), ";").alias("options"), F.count("*").alias("n"))
    return q.join(per, "id", "left").select("id", F.coalesce("options", F.lit("")).alias("options"), F.coalesce("n", F.lit(0)).alias("n"))


@query("select q.id, d.name as type_name from q left join (values ('single_choice', '单选'), ('multiple_choice', '多选'), ('fill_blank', '填空'), ('free_response', '解答')) d(k, name) on d.k = q.question_type", "q")
def dictionary_join(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("single_choice", "单选"), ("multiple_choice", "多选"), ("fill_blank", "填空"), ("free_response", "解答")], "question_type string, type_name string")
    return current(spark, sf, "questions").join(F.broadcast(names), "question_type", "left").select("id", "type_name")


@query("""select s.s_suppkey, c.c_custkey from supplier s join customer c on s.s_nationkey = c.c_nationkey where s.s_acctbal - 20 <= c.c_acctbal + 5 and c.c_acctbal - 5 <= s.s_acctbal + 20""")
def range_overlap(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") - 20).alias("lo"), (F.col("s_acctbal") + 20).alias("hi"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") - 5).alias("r_lo"), (F.col("c_acctbal") + 5).alias("r_hi"))
    return relate.overlapping(s, c, "lo", "hi", "r_lo", "r_hi", 50, ["nation"]).select("s_suppkey", "c_custkey")


@query("""select a.p_partkey as a, b.p_partkey as b from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_partkey < b.p_partkey
 and a.p_size <= b.p_size + 2 and b.p_size <= a.p_size + 2 and a.p_retailprice <= b.p_retailprice + 3 and b.p_retailprice <= a.p_retailprice + 3""")
def rectangle_intersection(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", F.col("p_retailprice").alias("y0"), (F.col("p_retailprice") + 3).alias("y1"), F.col("p_size").alias("x0"), (F.col("p_size") + 2).alias("x1"))
    right = p.select("p_brand", "p_type", F.col("p_partkey").alias("b"), F.col("y0").alias("v0"), F.col("y1").alias("v1"), F.col("x0").alias("u0"), F.col("x1").alias("u1"))
    hits = relate.overlapping(p, right, "y0", "y1", "v0", "v1", 10, ["p_brand", "p_type"])
    return hits.where("p_partkey < b and x0 <= u1 and u0 <= x1").select(F.col("p_partkey").alias("a"), "b")


@query("""with x as (select distinct o.id as anchor, b.id as block from o join b on b.paper_id = o.paper_id and contains(b.text, o.text) where length(o.text) >= 12 and b.role = 'option')
 select anchor, min(block) as block from x group by anchor having count(*) = 1""", "ob")
def unique_anchor_blocks(spark: SparkSession, sf: str) -> DataFrame:
    o, b = current(spark, sf, "options"), current(spark, sf, "source_blocks").where("role = 'option'")
    anchors = o.select(F.col("id").alias("anchor"), "paper_id", F.col("text").alias("_x"))
    return relate.unique_anchor(anchors, "anchor", "_x", b.select(F.col("id").alias("block"), "paper_id", "text"), "block", "text", 12, ["paper_id"])


# Aggregation


@query("select question_type, count(*) as n, count(*) filter (where status = 'partial') as partial, count(distinct paper_id) as papers from q group by question_type", "q")
def question_counts(spark: SparkSession, sf: str) -> DataFrame:
    return current(spark, sf, "questions").groupBy("question_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "partial").alias("partial"), F.count_distinct("paper_id").alias("papers"))


@query("select q.question_type, count(*) filter (where o.is_correct = 1) as yes, count(*) filter (where o.is_correct = 0) as no, count(*) filter (where o.id is not null and o.is_correct is null) as unknown from q left join o on o.question_id = q.id group by q.question_type", "qo")
def tri_state_marks(spark: SparkSession, sf: str) -> DataFrame:
    q, o = current(spark, sf, "questions").select("id", "question_type"), current(spark, sf, "options").select(F.col("question_id").alias("id"), F.col("id").alias("_o"), "is_correct")
    j = q.join(o, "id", "left").groupBy("question_type")
    return j.agg(F.count_if(F.col("is_correct") == 1).alias("yes"), F.count_if(F.col("is_correct") == 0).alias("no"), F.count_if(F.col("_o").isNotNull() & F.col("is_correct").isNull()).alias("unknown"))


@query("""select 'papers' as tab, id as key, count(*) as n from papers group by id having count(*) > 1 union all select 'questions', id, count(*) from questions group by id having count(*) > 1
 union all select 'options', id, count(*) from options group by id having count(*) > 1 union all select 'answers', question_id, count(*) from answers group by question_id having count(*) > 1
 union all select 'source_blocks', id, count(*) from source_blocks group by id having count(*) > 1""")
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for t, k in (("papers", "id"), ("questions", "id"), ("options", "id"), ("answers", "question_id"), ("source_blocks", "id")):
        part = relate.duplicate_keys(table(spark, sf, t), [k]).select(F.lit(t).alias("tab"), F.col(k).alias("key"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("select paper_id, text, min(question_id) as question_id from o where text is not null group by paper_id, text having count(distinct question_id) = 1", "o")
def options_owned_once(spark: SparkSession, sf: str) -> DataFrame:
    o = current(spark, sf, "options").where("text is not null").withColumn("_i", F.struct("paper_id", "text"))
    return relate.owned_once(o, "_i", "question_id").select("_i.paper_id", "_i.text", "question_id")


@query("""with m as (select l_returnflag, l_shipdate, count(*) as n from lineitem group by all), x as (select l_returnflag, min(l_shipdate) as d from (select *, max(n) over (partition by l_returnflag) as top from m) where n = top group by l_returnflag)
 select l.l_returnflag, median(l.l_quantity) as median_quantity, round(avg(l.l_discount), 3) as mean_discount, min(strftime(x.d, '%Y-%m-%d')) as mode_day from lineitem l join x on x.l_returnflag = l.l_returnflag group by l.l_returnflag""")
def mode_median_mean(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    days = li.groupBy("l_returnflag", "l_shipdate").agg(F.count("*").alias("n"))
    mode = days.groupBy("l_returnflag").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("l_shipdate").alias("d"))).alias("m"))
    stats = li.groupBy("l_returnflag").agg(F.median("l_quantity").alias("median_quantity"), F.round(F.avg("l_discount"), 3).alias("mean_discount"))
    return stats.join(mode, "l_returnflag").select("l_returnflag", "median_quantity", "mean_discount", F.date_format("m.d", "yyyy-MM-dd").alias("mode_day"))


@query("""with k as (select question_id, list_sort(list(left(label, 1))) as marked from o where is_correct = 1 group by question_id),
 v as (select question_id, list_sort(string_split(regexp_replace(upper(value), '[\\s,，、;；/|.]+', '', 'g'), '')) as chosen from a where regexp_matches(upper(value), '^[A-Z\\s,，、;；/|.]+$'))
 select v.question_id, case when k.marked is null then null else k.marked = v.chosen end as right_answer from v left join k on k.question_id = v.question_id""", "oa")
def set_equality_score(spark: SparkSession, sf: str) -> DataFrame:
    letters = F.filter(F.split(F.regexp_replace(F.upper("value"), r"[\s,，、;；/|.]+", ""), ""), lambda x: x != "")
    v = current(spark, sf, "answers").where(F.upper("value").rlike(r"\A[A-Z\s,，、;；/|.]+\z")).select("question_id", F.array_sort(letters).alias("chosen"))
    k = current(spark, sf, "options").where("is_correct = 1").groupBy("question_id").agg(F.array_sort(F.collect_list(F.substring("label", 1, 1))).alias("marked"))
    return v.join(k, "question_id", "left").select("question_id", (F.col("marked") == F.col("chosen")).alias("right_answer"))


@query("select o_custkey, count(distinct o_orderpriority) as versions from orders group by o_custkey having count(distinct o_orderpriority) > 1")
def payload_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return relate.conflicts(table(spark, sf, "orders"), "o_custkey", ["o_orderpriority"])


# Sets


@query("select source, lang from documents where lang is not null and source is not null except select source, 'en' from mix_targets union all select source, 'zh' from mix_targets where source not in (select source from documents where lang = 'zh' and source is not null)")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("lang is not null and source is not null").select("source", "lang").distinct()
    m = table(spark, sf, "mix_targets")
    left = d.exceptAll(m.select("source", F.lit("en").alias("lang")))
    right = m.select("source", F.lit("zh").alias("lang")).join(d.where("lang = 'zh'").select("source"), "source", "left_anti")
    return left.unionByName(right)


@query("""with x as (select paper_id, list(distinct question_type) as types from q group by paper_id) select paper_id, len(list_intersect(types, ['fill_blank', 'free_response'])) > 0 as written,
 list_has_all(['single_choice', 'multiple_choice', 'fill_blank', 'free_response', 'answer'], types) as known from x""", "q")
def set_predicates(spark: SparkSession, sf: str) -> DataFrame:
    x = current(spark, sf, "questions").groupBy("paper_id").agg(F.collect_set("question_type").alias("types"))
    lits = lambda *v: F.array(*map(F.lit, v))
    known = F.size(F.array_except("types", lits("single_choice", "multiple_choice", "fill_blank", "free_response", "answer"))) == 0
    return x.select("paper_id", F.arrays_overlap("types", lits("fill_blank", "free_response")).alias("written"), known.alias("known"))


@query("""select paper_id, string_agg(section_kind, '>' order by f) as kinds, string_agg(section_kind, '>' order by f) = 'choice' as only_choice from (select paper_id, section_kind, min(ordinal) as f from q where section_kind is not null group by all) group by paper_id""", "q")
def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    q = current(spark, sf, "questions").where("section_kind is not null").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "section_kind"))).alias("_s"))
    kinds = F.array_distinct(F.transform("_s", lambda x: x["section_kind"]))
    return q.select("paper_id", F.array_join(kinds, ">").alias("kinds"), (kinds == F.array(F.lit("choice"))).alias("only_choice"))


# Integrity

_RULES = [
    Unique("papers", ("id",)), Unique("questions", ("paper_id", "local_id")), Unique("options", ("question_id", "default_position")),
    Reference("options", "question_id", "questions", "id"), Reference("answers", "question_id", "questions", "id"), Reference("questions", "paper_id", "papers", "id"),
    Check("options", "mark", "is_correct in (0, 1)", "id"), Check("questions", "ordinal", "ordinal > 0", "id"), Check("papers", "year", "year between 1980 and 2023", "id"), Check("source_blocks", "status", "status in ('source_only')", "id"),
]


@query("""select 'unique(id)' as rule, 'papers' as table_name, id as key from papers group by id having count(*) > 1
 union all select 'unique(paper_id,local_id)', 'questions', paper_id || '|' || local_id from questions group by paper_id, local_id having count(*) > 1
 union all select 'unique(question_id,default_position)', 'options', question_id || '|' || default_position from options group by question_id, default_position having count(*) > 1
 union all select 'question_id->questions.id', 'options', question_id from options where question_id not in (select id from questions)
 union all select 'question_id->questions.id', 'answers', question_id from answers where question_id not in (select id from questions)
 union all select 'paper_id->papers.id', 'questions', paper_id from questions where paper_id not in (select id from papers)
 union all select 'check(mark)', 'options', id from options where not (is_correct in (0, 1)) union all select 'check(ordinal)', 'questions', id from questions where not (ordinal > 0)
 union all select 'check(year)', 'papers', id from papers where not (year between 1980 and 2023) union all select 'check(status)', 'source_blocks', id from source_blocks where not (status in ('source_only'))""")
def rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    return violations(lambda t: table(spark, sf, t), _RULES)


@query("select question_id from a where (status = 'explicit' and value is null and solution is null) or (status = 'missing' and value is not null)", "a")
def answer_coherence(spark: SparkSession, sf: str) -> DataFrame:
    return current(spark, sf, "answers").where("(status = 'explicit' and value is null and solution is null) or (status = 'missing' and value is not null)").select("question_id")


@query("""select q.id, case when q.status <> 'complete' then 'incomplete_question' when a.status is null or a.status = 'missing' then 'answer_missing' when a.status = 'ambiguous' then 'answer_ambiguous'
 when coalesce(m.n, 0) = 0 then 'no_marks' else 'scoreable' end as reason from q left join a on a.question_id = q.id left join (select question_id, count(*) as n from o where is_correct = 1 group by question_id) m on m.question_id = q.id where q.in_bank = 1""", "qao")
def scoreability(spark: SparkSession, sf: str) -> DataFrame:
    q = current(spark, sf, "questions").where("in_bank = 1").select("id", "status")
    a = current(spark, sf, "answers").select(F.col("question_id").alias("id"), F.col("status").alias("_a"))
    m = current(spark, sf, "options").where("is_correct = 1").groupBy(F.col("question_id").alias("id")).agg(F.count("*").alias("_m"))
    why = F.when(F.col("status") != "complete", "incomplete_question").when(F.col("_a").isNull() | (F.col("_a") == "missing"), "answer_missing").when(F.col("_a") == "ambiguous", "answer_ambiguous").when(F.coalesce("_m", F.lit(0)) == 0, "no_marks").otherwise("scoreable")
    return q.join(a, "id", "left").join(m, "id", "left").select("id", why.alias("reason"))


# Read views


@query("select category, count(*) as papers, sum(question_count) as questions, sum(block_count) as blocks, min(year) as first_year, max(year) as last_year from p group by category", "p")
def metadata_view(spark: SparkSession, sf: str) -> DataFrame:
    return current(spark, sf, "papers").groupBy("category").agg(F.count("*").alias("papers"), F.sum("question_count").alias("questions"), F.sum("block_count").alias("blocks"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("select a.question_id, case when a.status = 'explicit' then a.value end as value, case when a.status = 'explicit' then coalesce(k.ids, '') end as correct_ids from a left join (select question_id, string_agg(id, '|' order by id) as ids from o where is_correct = 1 group by question_id) k on k.question_id = a.question_id", "ao")
def answer_view(spark: SparkSession, sf: str) -> DataFrame:
    k = current(spark, sf, "options").where("is_correct = 1").groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list("id")), "|").alias("_ids"))
    explicit = F.col("status") == "explicit"
    return current(spark, sf, "answers").join(k, "question_id", "left").select("question_id", F.when(explicit, F.col("value")).alias("value"), F.when(explicit, F.coalesce("_ids", F.lit(""))).alias("correct_ids"))


@query("select q.id, case left(section_title, 1) when '一' then 1 when '二' then 2 when '三' then 3 when '四' then 4 when '五' then 5 when '六' then 6 when '七' then 7 when '八' then 8 when '九' then 9 end as section_number from q where section_title is not null", "q")
def section_numbers(spark: SparkSession, sf: str) -> DataFrame:
    head = F.regexp_extract("section_title", "\\A([一二三四五六七八九十]+)、", 1)
    return current(spark, sf, "questions").where("section_title is not null").select("id", chinese_number(head).alias("section_number"))


@query("""with l as (select question_id, list(left(label, 1)) as labels from o group by question_id), x as (select a.question_id, regexp_replace(upper(a.value), '[\\s,，、;；/|.]+', '', 'g') as v, q.question_type, l.labels from a join q on q.id = a.question_id left join l on l.question_id = a.question_id)
 select question_id, case when regexp_matches(v, '^[A-Z]+$') and len(list_distinct(string_split(v, ''))) = length(v) and list_has_all(labels, string_split(v, '')) and (question_type <> 'single_choice' or length(v) = 1) then array_to_string(list_sort(string_split(v, '')), '') end as letters from x""", "oaq")
def answer_letter_parse(spark: SparkSession, sf: str) -> DataFrame:
    labels = current(spark, sf, "options").groupBy("question_id").agg(F.collect_set(F.substring("label", 1, 1)).alias("labels"))
    q = current(spark, sf, "questions").select(F.col("id").alias("question_id"), "question_type")
    x = current(spark, sf, "answers").join(q, "question_id").join(labels, "question_id", "left")
    letters = answer_letters(F.col("value"), F.coalesce("labels", F.array().cast("array<string>")), F.col("question_type") == "single_choice")
    return x.select("question_id", F.array_join(letters, "").alias("letters"))


@query("""with s as (select paper_id, id, '$.questions[' || (row_number() over (partition by paper_id order by ordinal, id) - 1) || '].stem' as path from q) select id, path from s""", "q")
def provenance_paths(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("paper_id").orderBy("ordinal", "id")
    return current(spark, sf, "questions").select("id", F.concat(F.lit("$.questions["), (F.row_number().over(w) - 1).cast("string"), F.lit("].stem")).alias("path"))


QUERIES, SQL = query.queries, query.sql
