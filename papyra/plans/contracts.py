"""Attachment, evidence and conservation contracts as queries; each is fed with cases that break it as well as with ones that hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions import text as fx
from papyra.operators import evidence, relate, sequence
from papyra.operators.reading import in_order
from papyra.plans.registry import Registry, current
from papyra.session import table

query = Registry()


# Questions and answers


@query("""with m as (select id, paper_id, ordinal, role, text, sum(case when role = 'stem' and regexp_matches(text, '^[0-9]+\\. ') then 1 else 0 end) over (partition by paper_id order by ordinal, id rows between unbounded preceding and current row) as part from b)
 select paper_id, part, min(case when role = 'stem' and regexp_matches(text, '^[0-9]+\\. ') then regexp_extract(text, '^([0-9]+)\\. ', 1) end) as number, min(case when role = 'stem' and regexp_matches(text, '^[0-9]+\\. ') then regexp_replace(text, '^[0-9]+\\. ', '') end) as stem,
 string_agg(text, ' ' order by ordinal, id) filter (where role = 'option') as options, count(*) as blocks from m where part > 0 group by paper_id, part""", "b")
def printed_questions(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.printed_questions(current(spark, sf, "source_blocks"), "paper_id", ["ordinal", "id"], F.floor(F.col("ordinal") / 100_000))


_LETTERS = "regexp_replace(upper(a.value), '[\\s,，、;；/|.]+', '', 'g')"


@query(f"""with l as (select question_id, list(left(label, 1)) as labels from o group by question_id), k as (select q.paper_id, q.number, {_LETTERS} as v, q.id from a join q on q.id = a.question_id where a.value is not null and q.number is not null),
 c as (select paper_id, number, count(distinct id) as n, min(id) as target from q where in_bank = 1 and number is not null group by all), x as (select k.*, coalesce(c.n, 0) as n, c.target from k left join c on c.paper_id = k.paper_id and c.number = k.number)
 select x.paper_id, case when n = 0 then 'unmatched' when n > 1 then 'ambiguous' when not regexp_matches(v, '^[A-Z]+$') then 'noLetters' when labels is null or not list_has_all(labels, string_split(v, '')) then 'optionMismatch' else 'attached' end as outcome, count(*) as n from x left join l on l.question_id = x.target group by all""", "oaq")
def attachment_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Keys attached to bank questions by paper and number, counted by outcome; nothing is guessed."""
    q, a = current(spark, sf, "questions"), current(spark, sf, "answers").where("value is not null").select("question_id", "value")
    key = lambda d: d.withColumn("_k", F.concat_ws("#", "paper_id", "number"))
    keys = key(q.where("number is not null")).join(a, q.id == a.question_id).select(F.struct("id", "paper_id", "value").alias("_r"), "_k")
    found = relate.classified_lookup(keys, "_r", "_k", key(q.where("in_bank = 1 and number is not null")).select("_k", F.col("id").alias("target")), "_k", "target")
    labels = current(spark, sf, "options").groupBy(F.col("question_id").alias("target")).agg(F.collect_set(F.substring("label", 1, 1)).alias("_l"))
    bare = F.regexp_replace(F.upper("_r.value"), r"[\s,，、;；/|.]+", "")
    letters = F.filter(F.split(bare, ""), lambda x: x != "")
    outcome = F.when(F.col("outcome") == "unresolved", "unmatched").when(F.col("outcome") == "ambiguous", "ambiguous").when(~bare.rlike(r"\A[A-Z]+\z"), "noLetters").when(F.col("_l").isNull() | (F.size(F.array_except(letters, "_l")) > 0), "optionMismatch").otherwise("attached")
    return found.join(labels, "target", "left").groupBy(F.col("_r.paper_id").alias("paper_id"), outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""select a.question_id, case when d.id is not null or a.source_document_id is null then a.status else 'ambiguous' end as status, case when d.id is not null or a.source_document_id is null then a.value end as value, case when d.id is not null or a.source_document_id is null then a.solution end as solution
 from a left join (select id from p where year >= 2010) d on d.id = a.source_document_id""", "ap")
def unverified_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers from documents that are not verified (here: papers before 2010) become ambiguous, their fields empty."""
    known = current(spark, sf, "papers").where("year >= 2010").select(F.col("id").alias("_d"))
    a = current(spark, sf, "answers").join(known, F.col("source_document_id") == F.col("_d"), "left")
    ok = F.col("_d").isNotNull() | F.col("source_document_id").isNull()
    return a.select("question_id", F.when(ok, F.col("status")).otherwise("ambiguous").alias("status"), *[F.when(ok, F.col(c)).alias(c) for c in ("value", "solution")])


@query("""with e as (select l_orderkey as o, l_linenumber as n, 1 + sum(case when l_linenumber <= p then 1 else 0 end) over (partition by s order by l_orderkey, l_linenumber) as form, s from (select l_orderkey, l_linenumber, o_custkey as s, lag(l_linenumber) over (partition by o_custkey order by l_orderkey, l_linenumber) as p from (select distinct l_orderkey, l_linenumber from lineitem) join orders on o_orderkey = l_orderkey))
 select s as custkey, form, count(*) as numbers from e group by all""")
def number_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers that begin again open a new form (here: the line numbers of a customer's orders)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    rows = li.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("custkey")), "l_orderkey")
    again = F.col("l_linenumber") <= F.lag("l_linenumber").over(Window.partitionBy("custkey").orderBy("l_orderkey", "l_linenumber"))
    forms = sequence.groups_by_gap(rows, ["custkey"], ["l_orderkey", "l_linenumber"], F.coalesce(again, F.lit(False)))
    return forms.groupBy("custkey", (F.col("part") + 1).alias("form")).agg(F.count("*").alias("numbers"))


# Evidence

_GUARDS = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"""with e as (select * replace (case when l_discount > 0.08 then l_suppkey + 1 else l_suppkey end as l_suppkey) from lineitem where l_quantity > 40 qualify count(*) over (partition by l_orderkey, l_linenumber) = 1)
 select l.l_orderkey, l.l_linenumber, l.l_partkey, case when e.l_orderkey is not null then 'Z' else l.l_returnflag end as l_returnflag from lineitem l left join e on e.l_orderkey = l.l_orderkey and e.l_linenumber = l.l_linenumber and {" and ".join(f"l.{c} is not distinct from e.{c}" for c in _GUARDS)}""")
def guarded_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    """Large lines flagged by evidence rows that equal them in nine fields; evidence with a wrong supplier changes nothing."""
    li = table(spark, sf, "lineitem")
    proof = li.where("l_quantity > 40").withColumn("l_suppkey", F.when(F.col("l_discount") > 0.08, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey"))).withColumn("_new", F.lit("Z"))
    return evidence.guarded_exception(li, ["l_orderkey", "l_linenumber"], proof, _GUARDS, "l_returnflag", "_new").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query("""select path, paragraph_id, case when not regexp_matches(source_hash, '^[0-9a-f]{64}$') then 'digest' when translation is null then 'no text' when length(translation) not between 10 and 400 then 'length' when not contains(paragraph_id, split_part(split_part(path, '/', 3), '.', 1)) then 'place' end as broken from t
 where not regexp_matches(source_hash, '^[0-9a-f]{64}$') or translation is null or length(translation) not between 10 and 400 or not contains(paragraph_id, split_part(split_part(path, '/', 3), '.', 1))""", "t")
def broken_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence rows with a field out of its range: digest, text, length, or a place its paragraph does not name; the first fault counts."""
    n, name = F.length("translation"), F.split_part(F.split_part("path", F.lit("/"), F.lit(3)), F.lit("."), F.lit(1))
    why = F.when(~F.col("source_hash").rlike(r"\A[0-9a-f]{64}\z"), "digest").when(F.col("translation").isNull(), "no text").when(~n.between(10, 400), "length").when(~F.contains("paragraph_id", name), "place")
    return current(spark, sf, "translations").select("path", "paragraph_id", why.alias("broken")).where("broken is not null")


@query("""with r as (select paper_id, list_sort(list(distinct try_cast(number as integer)) filter (where try_cast(number as integer) is not null)) as got from q where record_type = 'question' group by paper_id) select p.id, coalesce(len(r.got), 0) as found, coalesce(r.got, []) = range(1, coalesce(p.question_count, 0) + 1) as complete from p left join r on r.paper_id = p.id""", "pq")
def recovered_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the question numbers recovered from a paper are exactly 1 to its question count."""
    q = current(spark, sf, "questions").where("record_type = 'question'").groupBy(F.col("paper_id").alias("id")).agg(F.array_sort(F.collect_set(F.col("number").try_cast("int"))).alias("_n"))
    got, count = F.coalesce("_n", F.array().cast("array<int>")), F.coalesce("question_count", F.lit(0))
    want = F.when(count < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(count, F.lit(1))))
    return current(spark, sf, "papers").select("id", "question_count").join(q, "id", "left").select("id", F.size(got).alias("found"), (got == want).alias("complete"))


@query("""with x as (select p_brand, p_partkey, floor(p_retailprice / 5.0) as band, row_number() over w as place, floor(p_retailprice / 5.0) - lag(floor(p_retailprice / 5.0)) over w as step from part window w as (partition by p_brand order by floor(p_retailprice / 5.0), p_size, p_partkey))
 select p_brand, p_partkey, place, sum(case when step > 2 then 1 else 0 end) over (partition by p_brand order by place rows between unbounded preceding and current row) as paragraph from x""")
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """Spans (here: parts of a brand, placed by price and size) in reading order, with paragraphs at vertical gaps."""
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("y"), F.col("p_size").alias("x"))
    return evidence.reading_order(p, ["p_brand"], "y", "x", "p_partkey", 5.0, 2).select("p_brand", "p_partkey", "place", "paragraph")


@query("""with c as (select p_brand, p_size >= 25 as right_column, p_retailprice, p_partkey, p_type, sum(case when starts_with(p_type, 'STANDARD') then 1 else 0 end) over (partition by p_brand, p_size >= 25 order by p_retailprice, p_partkey rows between unbounded preceding and current row) as g from part)
 select p_brand, right_column, g as part, string_agg(p_type, ' | ' order by p_retailprice, p_partkey) as joined from c where g > 0 group by all""")
def column_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Spans split into two columns by their x, then grouped from marker to marker down each column."""
    p = table(spark, sf, "part").select("p_brand", (F.col("p_size") >= 25).alias("right_column"), "p_retailprice", "p_partkey", "p_type")
    g = sequence.groups_by_gap(p, ["p_brand", "right_column"], ["p_retailprice", "p_partkey"], F.startswith("p_type", F.lit("STANDARD"))).where("part > 0")
    return g.groupBy("p_brand", "right_column", "part").agg(F.array_join(in_order(["p_retailprice", "p_partkey"], F.col("p_type")), " | ").alias("joined"))


@query("""with o2 as (select question_id, string_agg(default_position || '-' || left(label, 1), ' ' order by default_position, id) as t, count(*) as n from o group by question_id), x as (select question_id, t, n, regexp_extract_all(t, '([0-9]+)-([A-Z])', 2) as ls, regexp_extract_all(t, '([0-9]+)-([A-Z])', 1) as ns from o2)
 select question_id, t as tokens, len(ls) = 4 and len(list_distinct(ls)) = 4 and list_transform(ns, lambda v: cast(v as integer)) = [1, 2, 3, 4] as valid from x""", "o")
def slot_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens "n-L" that must be four, numbered 1 to 4 in order, with letters that do not repeat."""
    t = current(spark, sf, "options").groupBy("question_id").agg(F.array_join(in_order(["default_position", "id"], F.concat_ws("-", "default_position", F.substring("label", 1, 1))), " ").alias("tokens"))
    part = lambda k: F.regexp_extract_all("tokens", F.lit("([0-9]+)-([A-Z])"), F.lit(k))
    slots = F.transform(part(1), lambda v: v.cast("int")) == F.array(*map(F.lit, range(1, 5)))
    return t.select("question_id", "tokens", (slots & (F.size(F.array_distinct(part(2))) == 4)).alias("valid"))


@query("""with w as (select paper_id, list(id order by ordinal, id) as ids from q where in_bank = 1 group by paper_id), l as (select q.paper_id, list(q.id order by q.ordinal, q.id) as ids from q where exists (select 1 from a where a.question_id = q.id and a.status <> 'missing') group by q.paper_id),
 r as (select w.paper_id, w.ids as earlier, l.ids as later, list_filter(list_transform(l.ids, lambda x: list_position(w.ids, x)), lambda i: i > 0) as places from w join l on l.paper_id = w.paper_id)
 select paper_id, len(places) = len(later) and places = list_sort(places) as kept, sha256(array_to_string(later, '|')) as digest from r""", "qa")
def order_preserved(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the answered questions of a paper are a subsequence of its bank questions, with a digest of the list."""
    q, a = current(spark, sf, "questions"), current(spark, sf, "answers").where("status <> 'missing'")
    ids = in_order(["ordinal", "id"], F.col("id"))
    bank = q.where("in_bank = 1").groupBy("paper_id").agg(ids.alias("_all"))
    answered = q.join(a, q.id == a.question_id, "left_semi").groupBy("paper_id").agg(ids.alias("_some"))
    return bank.join(answered, "paper_id").select("paper_id", evidence.subsequence(F.col("_some"), F.col("_all")).alias("kept"), F.sha2(F.array_join("_some", "|"), 256).alias("digest"))


# Conservation


@query("""with c as (select q.id, unnest(string_split(q.stem, '')) as ch, 1 as s from q where q.stem is not null union all select b.question_id, unnest(string_split(regexp_replace(b.text, '^[0-9]+\\. ?', ''), '')), -1 from b where b.role = 'stem' and b.text is not null and b.question_id is not null)
 select id, ch, sum(s) as surplus from c where ch <> '' and id in (select id from q where stem is not null) and id in (select question_id from b where role = 'stem' and text is not null and question_id is not null) group by id, ch having sum(s) <> 0""", "qb")
def character_conservation(spark: SparkSession, sf: str) -> DataFrame:
    """Characters that a stem has more or less of than its printed block: both multisets compared, nothing where they are equal."""
    q = current(spark, sf, "questions").where("stem is not null").select("id", F.col("stem").alias("_t"))
    b = current(spark, sf, "source_blocks").where("role = 'stem' and text is not null and question_id is not null").select(F.col("question_id").alias("id"), F.regexp_replace("text", r"\A[0-9]+\. ?", "").alias("_t"))
    chars = lambda d, s: d.select("id", F.explode(F.split("_t", "")).alias("ch"), F.lit(s).alias("_s"))
    both = chars(q.join(b, "id", "left_semi"), 1).unionByName(chars(b.join(q, "id", "left_semi"), -1)).where("ch <> ''")
    return both.groupBy("id", "ch").agg(F.sum("_s").alias("surplus")).where("surplus <> 0")


@query("""select 'blocks' as measure, p.id, coalesce(p.block_count, -1) as expected, count(b.id) as actual from p left join b on b.paper_id = p.id group by all having coalesce(p.block_count, -1) <> count(b.id)
 union all select 'represented', p.id, count(distinct b.id), count(distinct b.id) filter (where b.question_id in (select id from q)) from p join b on b.paper_id = p.id and b.role = 'stem' group by p.id having count(distinct b.id) <> count(distinct b.id) filter (where b.question_id in (select id from q))
 union all select 'marked', q.paper_id, count(distinct q.id), count(distinct o.question_id) from q left join o on o.question_id = q.id and o.is_correct = 1 where q.in_bank = 1 and q.question_type in ('single_choice', 'multiple_choice') group by q.paper_id having count(distinct q.id) <> count(distinct o.question_id)""", "pbqo")
def conservation(spark: SparkSession, sf: str) -> DataFrame:
    """Papers whose announced blocks, represented stems or marked questions are not as many as there are."""
    p, b, q, o = (current(spark, sf, t) for t in ("papers", "source_blocks", "questions", "options"))
    row = lambda d, name: d.select(F.lit(name).alias("measure"), "id", "expected", "actual").where("expected <> actual")
    blocks = p.select("id", F.coalesce("block_count", F.lit(-1)).cast("long").alias("expected")).join(b.groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("_n")), "id", "left").withColumn("actual", F.coalesce("_n", F.lit(0)))
    known = q.select(F.col("id").alias("question_id"), F.lit(1).alias("_q"))
    stems = b.where("role = 'stem'").join(p.select(F.col("id").alias("paper_id")), "paper_id", "left_semi").join(known, "question_id", "left").groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("expected"), F.count("_q").alias("actual"))
    marked = o.where("is_correct = 1").select(F.col("question_id").alias("id"), F.lit(1).alias("_m")).distinct()
    choice = q.where("in_bank = 1 and question_type in ('single_choice', 'multiple_choice')").join(marked, "id", "left").groupBy("paper_id").agg(F.count("*").alias("expected"), F.count("_m").alias("actual")).withColumnRenamed("paper_id", "id")
    return row(blocks, "blocks").unionByName(row(stems, "represented")).unionByName(row(choice, "marked"))


@query("""with h as (select paper_id, count(*) as printed from b where role = 'heading' group by paper_id), s as (select paper_id, count(distinct section_kind) as listed from q where question_type in ('single_choice', 'multiple_choice') group by paper_id)
 select coalesce(h.paper_id, s.paper_id) as paper_id, coalesce(printed, 0) as printed, coalesce(listed, 0) as listed from h full join s on s.paper_id = h.paper_id where coalesce(printed, 0) <> coalesce(listed, 0)""", "bq")
def contents_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Papers whose printed headings are not as many as the kinds of section that hold choice questions."""
    h = current(spark, sf, "source_blocks").where("role = 'heading'").groupBy("paper_id").agg(F.count("*").alias("printed"))
    s = current(spark, sf, "questions").where("question_type in ('single_choice', 'multiple_choice')").groupBy("paper_id").agg(F.count_distinct("section_kind").alias("listed"))
    return h.join(s, "paper_id", "full_outer").select("paper_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("printed", "listed")]).where("printed <> listed")


_FIELDS = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(f"""with k as (select * from lineitem qualify count(*) over (partition by l_orderkey, l_linenumber) = 1), r as (select * replace (round(l_tax, 1) as l_tax, case when l_quantity > 45 then 45 else l_quantity end as l_quantity, case when l_linestatus = 'F' then null else l_returnflag end as l_returnflag) from k)
 select f as field, count(*) as n from (select unnest([{", ".join(f"case when k.{c} is distinct from r.{c} then '{c}' end" for c in _FIELDS)}]) as f from k join r on r.l_orderkey = k.l_orderkey and r.l_linenumber = k.l_linenumber) where f is not null group by f""")
def row_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Fields in which rows differ from a second record of them, in which one field was capped, one rounded and one lost."""
    once = relate.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).drop("n")
    k = table(spark, sf, "lineitem").join(once, ["l_orderkey", "l_linenumber"], "left_anti").withColumn("_id", F.struct("l_orderkey", "l_linenumber"))
    r = k.withColumn("l_tax", F.round("l_tax", 1)).withColumn("l_quantity", F.least("l_quantity", F.lit(45))).withColumn("l_returnflag", F.when(F.col("l_linestatus") != "F", F.col("l_returnflag")))
    return relate.field_differences(k, r, "_id", _FIELDS).groupBy("field").agg(F.count("*").alias("n"))


@query("""select 'documents' as child, d.paper_id as key, count(*) as n from documents d where d.paper_id is not null and d.paper_id not in (select id from papers where year >= 2012) group by d.paper_id
 union all select 'source_blocks', question_id, count(*) from source_blocks where question_id is not null and question_id not in (select id from questions where in_bank = 1) group by question_id
 union all select 'lineitem', cast(l_orderkey as varchar), count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P') group by l_orderkey
 union all select 'orders', cast(o_custkey as varchar), count(*) from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0) group by o_custkey""")
def reference_violations(spark: SparkSession, sf: str) -> DataFrame:
    """References to parents that are absent once some have been retired."""
    out = None
    for child, key, parent, parent_key, live in (("documents", "paper_id", "papers", "id", "year >= 2012"), ("source_blocks", "question_id", "questions", "id", "in_bank = 1"), ("lineitem", "l_orderkey", "orders", "o_orderkey", "o_orderstatus <> 'P'"), ("orders", "o_custkey", "customer", "c_custkey", "c_acctbal > 0")):
        bad = relate.missing_parents(table(spark, sf, child), key, table(spark, sf, parent).where(live), parent_key)
        part = bad.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(child).alias("child"), "key", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""with x as (select distinct paper_id as id from source_blocks where role = 'figure'), y as (select distinct id from papers where year >= 2012)
 select coalesce(x.id, y.id) as id, case when y.id is null then 'missing' else 'extra' end as side from x full join y on x.id = y.id where x.id is null or y.id is null""")
def inventory_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Papers with figures against papers of 2012 and later: what either side has alone."""
    left = table(spark, sf, "source_blocks").where("role = 'figure'").select(F.col("paper_id").alias("id"))
    return relate.inventory_diff(left, table(spark, sf, "papers").where("year >= 2012"), "id")


@query("""with x as (select a.question_id, unnest(cast(json_extract_string(a.source_blocks_json, '$[*]') as varchar[])) as l, q.paper_id from a join q on q.id = a.question_id where a.source_blocks_json is not null)
 select x.question_id, count(*) as missing from x where not exists (select 1 from b where b.paper_id = x.paper_id and b.local_id = x.l and b.role = 'answer') group by x.question_id""", "aqb")
def answer_source_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that cite blocks which are no answer blocks of their paper."""
    a, q, b = current(spark, sf, "answers"), current(spark, sf, "questions").select(F.col("id").alias("question_id"), "paper_id"), current(spark, sf, "source_blocks").where("role = 'answer'").select("paper_id", "local_id")
    named = a.join(q, "question_id").select("question_id", "paper_id", F.explode(F.from_json("source_blocks_json", "array<string>")).alias("local_id"))
    return named.join(b, ["paper_id", "local_id"], "left_anti").groupBy("question_id").agg(F.count("*").alias("missing"))


@query("select question_id, min(v) as lo, max(v) as hi, count(v) as n from (select question_id, case when is_correct = 1 then default_position else source_position end as v from o) group by question_id having min(v) <> 1 or max(v) <> count(v) or count(v) <> count(distinct v)", "o")
def option_order_check(spark: SparkSession, sf: str) -> DataFrame:
    """Questions whose positions are not 1 to n, where a mark has taken an option out of its source order."""
    v = F.when(F.col("is_correct") == 1, F.col("default_position")).otherwise(F.col("source_position"))
    return sequence.not_contiguous(current(spark, sf, "options").select("question_id", v.alias("v")), ["question_id"], "v")


@query("select o.question_id, count(o.is_correct) as marks, min(a.status) as status from o join a on a.question_id = o.question_id join q on q.id = o.question_id group by o.question_id having count(o.is_correct) > 0 and (min(a.status) <> 'explicit' or min(q.question_type) not in ('single_choice'))", "oaq")
def marks_without_answer(spark: SparkSession, sf: str) -> DataFrame:
    """Marked questions without an explicit answer, or of a type that allows no marks (here: all but single choice)."""
    o = current(spark, sf, "options").groupBy("question_id").agg(F.count("is_correct").alias("marks")).where("marks > 0")
    a, q = current(spark, sf, "answers").select("question_id", "status"), current(spark, sf, "questions").select(F.col("id").alias("question_id"), "question_type")
    return o.join(a, "question_id").join(q, "question_id").where("status <> 'explicit' or question_type not in ('single_choice')").select("question_id", "marks", "status")


@query("""with x as (select p.category, q.number, q.id, unnest(cast(json_extract_string(q.source_pages_json, '$[*]') as varchar[])) as page from q join p on p.id = q.paper_id where q.number is not null and q.source_pages_json is not null)
 select category, number, count(distinct id) as n, array_to_string(list_sort(list(distinct id)), '|') as members, array_to_string(list_sort(list(distinct page)), ',') as pages from x group by category, number having count(distinct id) > 1""", "qp")
def duplicate_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers used more than once within a category, with their questions and the set of their pages."""
    q = current(spark, sf, "questions").where("number is not null and source_pages_json is not null").select("id", "paper_id", "number", F.explode(F.from_json("source_pages_json", "array<string>")).alias("_page"))
    x = q.join(current(spark, sf, "papers").select(F.col("id").alias("paper_id"), "category"), "paper_id").groupBy("category", "number")
    got = x.agg(F.count_distinct("id").alias("n"), F.array_sort(F.collect_set("id")).alias("members"), F.array_sort(F.collect_set("_page")).alias("pages"))
    return got.where("n > 1").select("category", "number", "n", F.array_join("members", "|").alias("members"), F.array_join("pages", ",").alias("pages"))


@query("""select 'source_blocks' as tab, id as key, count(*) as versions from (select distinct id, captured_at, text, role, page, question_id from source_blocks) group by id having count(*) > 1 union all select 'questions', id, count(*) from (select distinct id, stem, subquestions_json, context_json from questions) group by id having count(*) > 1
 union all select 'orders', cast(o_custkey as varchar), count(*) from (select distinct o_custkey, o_orderpriority, o_orderstatus from orders) group by o_custkey having count(*) > 1""")
def conflicting_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Keys whose rows are no copies of one another: none in the corpus tables, many where a key names several rows (customers of orders)."""
    out = None
    for t, k, body in (("source_blocks", "id", ["captured_at", "text", "role", "page", "question_id"]), ("questions", "id", ["stem", "subquestions_json", "context_json"]), ("orders", "o_custkey", ["o_orderpriority", "o_orderstatus"])):
        part = relate.conflicts(table(spark, sf, t), k, body).select(F.lit(t).alias("tab"), F.col(k).cast("string").alias("key"), "versions")
        out = part if out is None else out.unionByName(part)
    return out


@query("select p.id, p.record_count, count(q.id) as records from p left join q on q.paper_id = p.id and q.in_bank = 1 group by p.id, p.record_count having p.record_count <> count(q.id)", "pq")
def count_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Papers that announce more records than the bank returns; ``guarded_counts`` fails on them."""
    p, n = current(spark, sf, "papers").select("id", "record_count"), current(spark, sf, "questions").where("in_bank = 1").groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("records"))
    return p.join(n, "id", "left").withColumn("records", F.coalesce("records", F.lit(0))).where("record_count <> records")


@query("""with s as (select id, paper_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from b where text is not null and contains(text, chr(10))), x as (select id, n, line, lead(line) over (partition by id order by n) as line2 from s)
 select id, n, sha256(line || ' ' || line2) as merged from x where line2 is not null and sha256(line) <> sha256(line2) and not regexp_matches(line, '[.。？?！!;；]\\s*$') and regexp_matches(line2, '^[a-z]')""", "b")
def adjacent_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive lines of a block that are one sentence, merged: the first does not end, the second begins in lower case, and their digests differ."""
    b = current(spark, sf, "source_blocks").where("text is not null and contains(text, '\n')").select("id", F.posexplode(F.split("text", "\n")).alias("_p", "line"))
    x = b.withColumn("line2", F.lead("line").over(Window.partitionBy("id").orderBy("_p")))
    x = x.where((F.sha2("line", 256) != F.sha2("line2", 256)) & ~F.col("line").rlike(r"[.。？?！!;；]\s*\z") & F.col("line2").rlike(r"\A[a-z]"))
    return x.select("id", (F.col("_p") + 1).alias("n"), F.sha2(F.concat_ws(" ", "line", "line2"), 256).alias("merged"))


@query("""with e as (select p.id as paper_id, unnest(range(1, 13)) as n from p), r as (select paper_id, try_cast(number as integer) as n, count(*) as records, count(*) filter (where source_pages_json is not null and len(cast(json_extract_string(source_pages_json, '$[*]') as varchar[])) > 0) as paged from q where number is not null group by all)
 select e.paper_id, e.n as number, coalesce(r.records, 0) as records, coalesce(r.paged, 0) as paged from e left join r on r.paper_id = e.paper_id and r.n = e.n where coalesce(r.records, 0) <> 1 or coalesce(r.paged, 0) <> 1""", "pq")
def expected_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers 1 to 12 of every paper that are not there exactly once and with a page."""
    e = current(spark, sf, "papers").select(F.col("id").alias("paper_id"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("number"))
    pages = F.size(F.from_json("source_pages_json", "array<string>")) > 0
    r = current(spark, sf, "questions").where("number is not null").groupBy("paper_id", F.col("number").try_cast("int").alias("number")).agg(F.count("*").alias("records"), F.count_if(F.col("source_pages_json").isNotNull() & pages).alias("paged"))
    return e.join(r, ["paper_id", "number"], "left").select("paper_id", "number", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "paged")]).where("records <> 1 or paged <> 1")


@query("""select 'questions' as measure, sum(question_count) as expected, (select count(*) from q where record_type = 'question') as actual from p having sum(question_count) is distinct from (select count(*) from q where record_type = 'question')
 union all select 'records', sum(record_count), (select count(*) from q where in_bank = 1) from p having sum(record_count) is distinct from (select count(*) from q where in_bank = 1) union all select 'blocks', sum(block_count), (select count(*) from b) from p having sum(block_count) is distinct from (select count(*) from b)""", "pqb")
def audit_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals that the papers announce and that the tables do not hold; nothing is written in, both come from the data."""
    p = current(spark, sf, "papers").agg(F.sum("question_count").alias("questions"), F.sum("record_count").alias("records"), F.sum("block_count").alias("blocks"))
    q = current(spark, sf, "questions").agg(F.count_if(F.col("record_type") == "question").alias("questions"), F.count_if(F.col("in_bank") == 1).alias("records"))
    b = current(spark, sf, "source_blocks").agg(F.count("*").alias("blocks"))
    flat = lambda d, side: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias(side)) for c in d.columns])).alias("_r")).select("_r.*")
    return flat(p, "expected").join(flat(q, "actual").unionByName(flat(b, "actual")), "measure").where("not (expected <=> actual)")


# Batches and results


@query("""with x as (select path, count(*) as n, sum(length(translation) + length(regexp_replace(translation, '[^\\x{10000}-\\x{10ffff}]', '', 'g'))) as units, count(*) filter (where length(translation) > 300) as alone from t where translation is not null group by path)
 select path, n, units, cast(greatest(ceil(n / 6.0), ceil(units / 5000.0), alone) as bigint) as requests from x""", "t")
def request_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """The fewest requests a path can take: by rows, by UTF-16 units, and by rows that go alone."""
    t = current(spark, sf, "translations").where("translation is not null")
    x = t.groupBy("path").agg(F.count("*").alias("n"), F.sum(fx.utf16_units(F.col("translation"))).alias("units"), F.count_if(F.length("translation") > 300).alias("_alone"))
    return x.select("path", "n", "units", F.greatest(F.ceil(F.col("n") / 6), F.ceil(F.col("units") / 5000), "_alone").alias("requests"))


@query("""with x as (select path, list(regexp_replace(trim(translation), '\\s+', ' ', 'g') order by paragraph_id, source_hash) as parts from t where translation is not null and regexp_matches(translation, '\\S') group by path)
 select path, len(parts) as n, sha256(array_to_string(parts, chr(1))) as digest, true as exact, true as refused from x""", "t")
def parsed_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of a path packed into one numbered batch and parsed back; a batch short of its last number is refused."""
    t = current(spark, sf, "translations").where(F.col("translation").rlike(r"\S"))
    x = t.groupBy("path").agg(in_order(["paragraph_id", "source_hash"], F.regexp_replace(F.trim("translation"), r"\s+", " ")).alias("_p")).withColumn("_t", evidence.batch_text(F.col("_p"))).withColumn("n", F.size("_p"))
    back = evidence.parsed_batch(F.col("_t"), F.col("n"))
    return x.select("path", "n", F.sha2(F.array_join(back, "\x01"), 256).alias("digest"), (back == F.col("_p")).alias("exact"), evidence.parsed_batch(F.col("_t"), F.col("n") + 1).isNull().alias("refused"))


@query("""with bad as (select distinct source_hash, sha256(translation) as h from t where provider = 'webtext' and translation is not null and (lang is null or lang in ('und', '?', 'unknown', ''))) select path, paragraph_id, provider from t where translation is not null and (source_hash, sha256(translation)) not in (select source_hash, h from bad)""", "t")
def without_known_bad(spark: SparkSession, sf: str) -> DataFrame:
    """Results whose exact pair of source and output digest is not on the list of bad ones (here: web results without a language)."""
    t = current(spark, sf, "translations").where("translation is not null").withColumn("_h", F.sha2("translation", 256))
    bad = t.where("provider = 'webtext' and (lang is null or lang in ('und', '?', 'unknown', ''))").select("source_hash", "_h").distinct()
    return t.join(bad, ["source_hash", "_h"], "left_anti").select("path", "paragraph_id", "provider")


@query("""with m as (select source_hash, max(sha256(translation)) as h from t where provider = 'memory' and translation is not null group by source_hash having count(distinct translation) = 1)
 select t.path, t.paragraph_id, m.h is not null as known, m.h is not distinct from sha256(t.translation) and m.h is not null as kept from t left join m on m.source_hash = t.source_hash where t.translation is not null""", "t")
def kept_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results kept only where both digests, of source and of output, are those in memory."""
    t = current(spark, sf, "translations").where("translation is not null").withColumn("_h", F.sha2("translation", 256))
    m = t.where("provider = 'memory'").groupBy("source_hash").agg(F.max("_h").alias("_m"), F.count_distinct("_h").alias("_n")).where("_n = 1").drop("_n")
    return t.join(m, "source_hash", "left").select("path", "paragraph_id", F.col("_m").isNotNull().alias("known"), (F.col("_m").isNotNull() & (F.col("_m") == F.col("_h"))).alias("kept"))


@query("""with x as (select path, paragraph_id, source_hash, translation as first, provider, case when translation is null or trim(translation) = '' then 'empty' when not regexp_matches(translation, '[\\x{3400}-\\x{9fff}]') then 'no ideographs' when contains(translation, '⟦') then 'leftover marker' end as why from t),
 m as (select path, paragraph_id, max(translation) as again from t where provider = 'manual' and regexp_matches(translation, '[\\x{3400}-\\x{9fff}]') and not contains(translation, '⟦') group by all)
 select x.path, x.paragraph_id, case when why is null then first else again end as published, case when why is null then 0 when again is not null then 1 else 2 end as tries, case when why is not null and again is null then why end as quarantined from x left join m on m.path = x.path and m.paragraph_id = x.paragraph_id""", "t")
def partial_success(spark: SparkSession, sf: str) -> DataFrame:
    """Good results kept, bad ones tried once more alone (here: the paragraph's manual result), the rest put in quarantine with the first reason."""
    from papyra.streaming.incremental import accepted

    t = current(spark, sf, "translations").select("path", "paragraph_id", "source_hash", "translation", "provider")
    good, bad = accepted(t, "source_hash", "translation")
    again = accepted(t.where("provider = 'manual'"), "source_hash", "translation")[0].groupBy("path", "paragraph_id").agg(F.max("translation").alias("_again"))
    retried = bad.join(again, ["path", "paragraph_id"], "left")
    out = retried.select("path", "paragraph_id", F.col("_again").alias("published"), F.when(F.col("_again").isNotNull(), 1).otherwise(2).alias("tries"), F.when(F.col("_again").isNull(), F.col("reason")).alias("quarantined"))
    return good.select("path", "paragraph_id", F.col("translation").alias("published"), F.lit(0).alias("tries"), F.lit(None).cast("string").alias("quarantined")).unionByName(out)


@query("""with p2 as (select doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x, ' ')), lambda x: x <> '')) as t, generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x, ' ')), lambda x: x <> ''), 1) as n from documents where text is not null)
 select doc_id, n, '$.paragraphs[' || (n - 1) || ']' as path, sha256(t) as source_hash, case when length(t) < 40 then 'short' when not regexp_matches(t, '[A-Za-z]{3}') then 'no words' else 'eligible' end as state from p2""")
def paragraph_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Every paragraph of every document with its place, the digest of its source and whether it is to be worked on."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(fx.paragraphs(F.col("text"))).alias("_p", "_t"))
    state = F.when(F.length("_t") < 40, "short").when(~F.col("_t").rlike("[A-Za-z]{3}"), "no words").otherwise("eligible")
    return d.select("doc_id", (F.col("_p") + 1).alias("n"), F.concat(F.lit("$.paragraphs["), F.col("_p").cast("string"), F.lit("]")).alias("path"), F.sha2("_t", 256).alias("source_hash"), state.alias("state"))


@query("""with e as (select s, l_orderkey, l_linenumber as n, 1 + sum(case when l_linenumber <= p then 1 else 0 end) over (partition by s order by l_orderkey, l_linenumber) as form from (select l_orderkey, l_linenumber, o_custkey as s, lag(l_linenumber) over (partition by o_custkey order by l_orderkey, l_linenumber) as p from (select distinct l_orderkey, l_linenumber from lineitem) join orders on o_orderkey = l_orderkey)),
 m as (select s, n, count(*) as k, min(l_orderkey) as target from e where form <= 2 group by all)
 select case when coalesce(m.k, 0) = 0 then 'unresolved' when m.k = 1 then 'resolved' else 'ambiguous' end as outcome, case when m.k = 1 then m.target end as target, count(*) as n from e left join m on m.s = e.s and m.n = e.n where e.form > 2 group by all""")
def form_references(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of later forms that refer to the same number in the first two: resolved only where one of them has it."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    rows = li.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("s")), "l_orderkey")
    again = F.col("l_linenumber") <= F.lag("l_linenumber").over(Window.partitionBy("s").orderBy("l_orderkey", "l_linenumber"))
    e = sequence.groups_by_gap(rows, ["s"], ["l_orderkey", "l_linenumber"], F.coalesce(again, F.lit(False))).withColumn("_k", F.concat_ws("#", "s", "l_linenumber"))
    found = relate.classified_lookup(e.where("part > 1").withColumn("_r", F.struct("l_orderkey", "l_linenumber")), "_r", "_k", e.where("part <= 1"), "_k", "l_orderkey")
    return found.groupBy("outcome", "target").agg(F.count("*").alias("n"))


# Texts


@query("""with d as (select list_value('一','二','三','四','五','六','七','八','九') as c), n as (select unnest(range(1, 100)) as number), w as (select number, case when number < 10 then c[number] else (case when number // 10 > 1 then c[number // 10] else '' end) || '十' || (case when number % 10 > 0 then c[number % 10] else '' end) end as written from n, d)
 select q.id, w.number as read_as from q join w on w.number = q.ordinal union all select 'alone ' || written, number from w union all select 'not ' || written, null from w""", "q")
def chinese_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinals written in Chinese digits and read again, every number to 99, and none that a further sign spoils."""
    digits = F.array(*map(F.lit, "一二三四五六七八九"))
    part = lambda k: F.when(k > 0, F.element_at(digits, F.greatest(k, F.lit(1)))).otherwise("")
    n = spark.range(1, 100).select(F.col("id").cast("int").alias("n"))
    tens = (F.col("n") / 10).cast("int")
    w = n.withColumn("t", F.when(tens == 0, part(F.col("n") % 10)).otherwise(F.concat(F.when(tens > 1, part(tens)).otherwise(""), F.lit("十"), part(F.col("n") % 10))))
    read = lambda c: fx.chinese_number(c).alias("read_as")
    q = current(spark, sf, "questions").select("id", F.col("ordinal").alias("n")).join(w, "n").select("id", read(F.col("t")))
    return q.unionByName(w.select(F.concat(F.lit("alone "), "t").alias("id"), read(F.col("t")))).unionByName(w.select(F.concat(F.lit("not "), "t").alias("id"), read(F.concat("t", F.lit("零")))))


_BAD = "，，|。。|、、|\\.\\.\\.\\.|,,|\\x{FFFD}"


@query(f"""with x as (select id, text, length(regexp_extract(text, '(?s)^(.*?)({_BAD})', 1)) + 1 as place from b where regexp_matches(text, '{_BAD}')) select id, place, substr(text, greatest(place - 35, 1), least(place, 36) + 35) as around from x""", "b")
def suspicious_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The first repeated mark or replacement character of a block with 35 characters on either side."""
    b = current(spark, sf, "source_blocks").where(fx.suspicious(F.col("text")))
    return b.select("id", F.regexp_instr("text", F.lit(r"，，|。。|、、|\.\.\.\.|,,|\x{FFFD}")).alias("place"), fx.suspicious_context(F.col("text")).alias("around"))


@query("""with u as (select q.id, json_extract_string(q.context_json, '$.kind') as kind, json_extract_string(q.context_json, '$.blankNumber') as blank, string_agg(b.text, ' ' order by b.ordinal, b.id) filter (where b.text is not null) as text, count(b.id) as matches from q left join b on b.paper_id = q.paper_id and b.local_id = json_extract_string(q.context_json, '$.sourceBlocks[0]') where q.context_json is not null group by all)
 select id, kind, blank, text, matches from u""", "qb")
def updated_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts with the text of their first source block put in under its key, and how many blocks matched."""
    q = current(spark, sf, "questions").where("context_json is not null").select("id", "paper_id", "context_json", F.get_json_object("context_json", "$.sourceBlocks[0]").alias("local_id"))
    b = current(spark, sf, "source_blocks").groupBy("paper_id", "local_id").agg(F.array_join(in_order(["ordinal", "id"], F.col("text")), " ").alias("_t"), F.count("*").alias("_n"))
    m = F.from_json("context_json", "map<string,string>")
    put = F.map_concat(F.map_filter(m, lambda k, v: k != "text"), F.create_map(F.lit("text"), F.nullif(F.col("_t"), F.lit(""))))
    x = q.join(b, ["paper_id", "local_id"], "left").withColumn("_u", F.to_json(put, {"ignoreNullFields": "false"}))
    return x.select("id", *[F.get_json_object("_u", f"$.{c}").alias(a) for c, a in (("kind", "kind"), ("blankNumber", "blank"), ("text", "text"))], F.coalesce("_n", F.lit(0)).alias("matches"))


QUERIES, SQL = query.queries, query.sql
