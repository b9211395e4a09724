"""Read views, semantic trees and what they must not show, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as fx
from papyra.operators import reading, relate, tree
from papyra.plans.registry import Registry, current
from papyra.session import table

query = Registry()

_REFERENCED = "('wordBank', 'matching_table', 'ordering_diagram')"
_LABELS = f"""d as (select o.*, json_extract_string(q.context_json, '$.kind') as kind, (select count(distinct p.label) < count(p.label) from o p where p.question_id = o.question_id) as twice from o join q on q.id = o.question_id),
 s as (select *, case when kind in {_REFERENCED} then label when twice then coalesce(source_label, label) else label end as shown from d)"""


def _shown(spark: SparkSession, sf: str, shuffled: bool = False) -> DataFrame:
    kind = current(spark, sf, "questions").select(F.col("id").alias("question_id"), F.get_json_object("context_json", "$.kind").alias("_kind"))
    o = current(spark, sf, "options").join(kind, "question_id")
    if shuffled:
        o = reading.shuffled(o, "demo")
    return reading.with_display_labels(o, F.col("_kind").isin("wordBank", "matching_table", "ordering_diagram"), shuffled, "place" if shuffled else "default_position").drop("_kind")


@query(f"with {_LABELS} select id, shown from s", "qo")
def display_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(spark, sf).select("id", F.col("display_label").alias("shown"))


@query(f"""with {_LABELS}, k as (select id, case when kind in {_REFERENCED} then label else chr(64 + cast(row_number() over (partition by question_id order by sha256('demo:' || question_id || ':' || id)) as integer)) || '.' end as shown from s) select id, shown from k""", "qo")
def shuffled_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Options shuffled by a seed: ids stay, letters follow the places unless the text refers to them."""
    return _shown(spark, sf, shuffled=True).select("id", F.col("display_label").alias("shown"))


@query(f"""with {_LABELS}, v as (select question_id, string_agg(shown || coalesce(text, ''), ';' order by default_position, id) as options from s group by question_id),
 x as (select question_id, string_agg(id || ' ' || role, ';' order by ordinal, id) as blocks from b where question_id is not null and role in ('passage', 'stem', 'figure') group by question_id)
 select q.id, q.number, q.stem, a.status as answer_status, coalesce(v.options, '') as options, coalesce(x.blocks, '') as blocks, coalesce(q.section_title, '') as labels
 from q left join a on a.question_id = q.id left join v on v.question_id = q.id left join x on x.question_id = q.id where q.in_bank = 1""", "qoba")
def nested_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with options, blocks and labels nested in order; shown as text for the comparison."""
    q = current(spark, sf, "questions").where("in_bank = 1")
    blocks = current(spark, sf, "source_blocks").where("role in ('passage', 'stem', 'figure')").select("question_id", "id", "ordinal", "role", "text")
    labels = q.where("section_title is not null").select(F.col("id").alias("question_id"), F.lit(1).alias("ordinal"), F.col("section_title").alias("label"))
    v = reading.question_views(q, _shown(spark, sf), blocks, current(spark, sf, "answers"), labels)
    joined = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    return v.select("id", "number", "stem", "answer_status", joined("options", lambda x: F.concat(x["display_label"], F.coalesce(x["text"], F.lit("")))), joined("blocks", lambda x: F.concat_ws(" ", x["id"], x["role"])), joined("labels", lambda x: x))


_CITED = "x as (select a.question_id, coalesce(a.source_document_id, q.paper_id) as d, unnest(cast(json_extract_string(a.source_blocks_json, '$[*]') as varchar[])) as l, generate_subscripts(cast(json_extract_string(a.source_blocks_json, '$[*]') as varchar[]), 1) as n from a join q on q.id = a.question_id where a.source_blocks_json is not null)"


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    """(question_id, document_id, local_id, place) of the blocks that answers cite."""
    a, q = current(spark, sf, "answers"), current(spark, sf, "questions").select(F.col("id").alias("question_id"), "paper_id")
    ids = F.posexplode(F.from_json("source_blocks_json", "array<string>")).alias("_p", "local_id")
    return a.where("source_blocks_json is not null").join(q, "question_id").select("question_id", F.coalesce("source_document_id", "paper_id").alias("document_id"), ids).withColumn("place", F.col("_p") + 1).drop("_p")


@query(f"""with {_CITED}, w as (select d, l from x group by d, l having count(distinct question_id) = 1), y as (select x.question_id, x.n, x.l, b.id, b.text, b.text is not null and coalesce(b.status, '') not in ('duplicate', 'source_only') as usable from x join w on w.d = x.d and w.l = x.l left join b on b.paper_id = x.d and b.local_id = x.l)
 select question_id, string_agg(text, chr(10) order by n, l) filter (where usable) as excerpt, cast(count(*) filter (where usable) as integer) as blocks from y group by question_id having bool_and(id is not null) and count(*) filter (where usable) > 0""", "aqb")
def owned_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return reading.exclusive_excerpts(_cited(spark, sf), current(spark, sf, "source_blocks"))


@query(f"""with {_CITED} select x.question_id, string_agg(x.l || '=' || coalesce(b.role, '?'), '|' order by x.n) as bridge from x left join b on b.paper_id = x.d and b.local_id = x.l group by x.question_id""", "aqb")
def ordered_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """Link table of answers and blocks joined in link order."""
    b = current(spark, sf, "source_blocks").select(F.col("paper_id").alias("document_id"), "local_id", "role")
    rows = _cited(spark, sf).join(b, ["document_id", "local_id"], "left")
    return rows.groupBy("question_id").agg(F.array_join(reading.in_order(["place"], F.concat_ws("=", "local_id", F.coalesce("role", F.lit("?")))), "|").alias("bridge"))


@query("""with x as (select b.id, try_cast(q.number as integer) as n, b.text from b join q on q.id = b.question_id where b.role = 'stem' and b.text is not null and try_cast(q.number as integer) < 300),
 f as (select id, n, 'plain' as form, text as t from x union all select id, n, 'own', text || ' ' || n || '.【答案】AB' from x union all select id, n, 'next', text || ' *' || (n + 1) || '.【参考答案】 c ' from x union all select id, n, 'unsure', text || ' ' || (n + 1) || '.【答案】B' from x)
 select id, form, case form when 'next' then rtrim(text) when 'unsure' then null else t end as kept from f join x using (id, n)""", "bq")
def foreign_tails(spark: SparkSession, sf: str) -> DataFrame:
    """Stems as printed, and with keys of their own and of the next question put behind them: only a sure foreign key is cut off."""
    q = current(spark, sf, "questions").select(F.col("id").alias("question_id"), F.col("number").try_cast("int").alias("n")).where("n < 300")
    x = current(spark, sf, "source_blocks").where("role = 'stem' and text is not null").select("id", "question_id", "text").join(q, "question_id")
    n = lambda k: (F.col("n") + k).cast("string")
    forms = {"plain": F.col("text"), "own": F.concat("text", F.lit(" "), n(0), F.lit(".【答案】AB")), "next": F.concat("text", F.lit(" *"), n(1), F.lit(".【参考答案】 c ")), "unsure": F.concat("text", F.lit(" "), n(1), F.lit(".【答案】B"))}
    rows = x.select("id", "n", F.explode(F.create_map(*[y for k, v in forms.items() for y in (F.lit(k), v)])).alias("form", "t"))
    return rows.select("id", "form", reading.without_foreign_tail(F.col("t"), F.col("n")).alias("kept"))


@query("""with x as (select a.question_id, q.number, trim(regexp_replace(a.explanation, '\\s+', ' ', 'g')) as l, a.solution from a join q on q.id = a.question_id where a.status = 'explicit' and a.explanation is not null and trim(a.explanation) <> '' and regexp_matches(q.number, '^[0-9]+$'))
 select question_id, solution is not null and trim(solution) <> l as bare, false as prose from x""", "aq")
def references_only(spark: SparkSession, sf: str) -> DataFrame:
    """Printed answers that hold a number and the words of a reference, against the same words within prose."""
    q = current(spark, sf, "questions").where(F.col("number").rlike(r"\A[0-9]+\z")).select(F.col("id").alias("question_id"), "number")
    x = current(spark, sf, "answers").where("status = 'explicit' and trim(explanation) <> ''").join(q, "question_id")
    bare, prose = F.concat("number", F.lit("、 "), "explanation"), F.concat("number", F.lit("、原文 "), "explanation")
    return x.select("question_id", reading.reference_only(bare, F.col("explanation"), F.col("solution")).alias("bare"), reading.reference_only(prose, F.col("explanation"), F.col("solution")).alias("prose"))


# Trees

_NODES = """n as (select id, null as parent_id, id as paper_id, 'paper' as node_type from p union all select distinct paper_id || '#s:' || coalesce(section_kind, ''), paper_id, paper_id, 'section' from q
 union all select id, paper_id || '#s:' || coalesce(section_kind, ''), paper_id, 'question' from q union all select o.id, o.question_id, o.paper_id, 'option' from o union all select a.question_id || '#a', a.question_id, q.paper_id, 'answer' from a join q on q.id = a.question_id),
 k as (select id as paper_id, case category when 'politics' then 'answers' when 'cs408' then 'complete' else kind end as kind from p)"""


def _nodes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of all papers; papers of politics stand for papers of answers, those of cs408 for mixed ones."""
    p, q, o, a = (current(spark, sf, t) for t in ("papers", "questions", "options", "answers"))
    section = F.concat("paper_id", F.lit("#s:"), F.coalesce("section_kind", F.lit("")))
    node = lambda df, i, parent, kind: df.select(i.alias("id"), parent.alias("parent_id"), "paper_id", F.lit(kind).alias("node_type"))
    papers = p.select(F.col("id").alias("paper_id"), F.when(F.col("category") == "politics", "answers").when(F.col("category") == "cs408", "complete").otherwise(F.col("kind")).alias("kind"))
    owner = a.join(q.select(F.col("id").alias("question_id"), "paper_id"), "question_id")
    out = node(papers, F.col("paper_id"), F.lit(None).cast("string"), "paper").unionByName(node(q.select("paper_id", "section_kind").distinct(), section, F.col("paper_id"), "section")).unionByName(node(q, F.col("id"), section, "question"))
    out = out.unionByName(node(o, F.col("id"), F.col("question_id"), "option")).unionByName(node(owner, F.concat("question_id", F.lit("#a")), F.col("question_id"), "answer"))
    links = o.where("is_correct = 1").select(F.concat("question_id", F.lit("#a")).alias("from_id"), F.col("id").alias("to_id"))
    return out.join(papers, "paper_id"), links


@query(f"""with {_NODES}, h as (select n.*, k.kind, node_type = 'answer' or (kind = 'answers' and node_type <> 'paper') or (kind = 'complete' and node_type = 'option' and n.id in (select id from o where is_correct = 1)) as hidden from n join k using (paper_id))
 select paper_id, count(*) filter (where not hidden) as shown, count(*) filter (where hidden) as hidden, case any_value(kind) when 'answers' then 'answer_document_requires_explicit_route' when 'complete' then 'unresolved_answer_boundary' end as reason from h group by paper_id""", "pqoa")
def semantic_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Shown and hidden nodes of each paper, with the reason for what stays hidden."""
    seen = reading.visible_nodes(*_nodes(spark, sf))
    return seen.groupBy("paper_id").agg(F.count_if(~F.col("hidden")).alias("shown"), F.count_if("hidden").alias("hidden"), F.max("reason").alias("reason"))


@query(f"""with {_NODES}, j as (select id, parent_id, paper_id, node_type, '{{"id":"' || id || '","label":"' || node_type || '","children":[' as head from n),
 c as (select parent_id, string_agg(head || ']}}', ',' order by id) as kids from j where node_type = 'question' group by parent_id), s as (select j.parent_id, string_agg(head || coalesce(kids, '') || ']}}', ',' order by j.id) as kids from j left join c on c.parent_id = j.id where node_type = 'section' group by j.parent_id)
 select j.id, head || coalesce(kids, '') || ']}}' as tree from j left join s on s.parent_id = j.id where node_type = 'paper'""", "pqoa")
def paper_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Each paper with its sections and their questions nested in order of their ids."""
    nodes = _nodes(spark, sf)[0]
    return tree.nested(nodes, "id", "parent_id", "node_type", 2)


@query(f"""with {_NODES}, m as (select n.id, case when n.node_type = 'section' and k.kind = 'answers' then null when n.node_type = 'question' and k.kind = 'complete' then 'gone' else n.parent_id end as parent_id, n.paper_id, n.node_type from n join k using (paper_id))
 select m.paper_id, count(*) as roots from m where not exists (select 1 from m x where x.id = m.parent_id and x.paper_id = m.paper_id) group by m.paper_id having count(*) <> 1 or count(*) filter (where m.node_type = 'paper') <> 1""", "pqoa")
def root_check(spark: SparkSession, sf: str) -> DataFrame:
    """Papers without exactly one root, where some sections have lost their parent and some questions name one that is absent."""
    nodes = _nodes(spark, sf)[0]
    parent = F.when((F.col("node_type") == "section") & (F.col("kind") == "answers"), None).when((F.col("node_type") == "question") & (F.col("kind") == "complete"), "gone").otherwise(F.col("parent_id"))
    return reading.root_violations(nodes.withColumn("parent_id", parent))


@query("""with recursive e as (select distinct q.paper_id as f, a.source_document_id as t from a join q on q.id = a.question_id where a.source_document_id is not null), c as (select id as seed, id as reached, 0 as steps from p where year >= 2015 union select c.seed, e.t, c.steps + 1 from c join e on e.f = c.reached where c.steps < 12)
 select seed, reached, min(steps) as steps from c group by seed, reached""", "aqp")
def paper_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Papers of 2015 and later with every document their answers come from, directly or through others."""
    a, q = current(spark, sf, "answers"), current(spark, sf, "questions").select(F.col("id").alias("question_id"), "paper_id")
    return tree.closure(a.join(q, "question_id").select("paper_id", "source_document_id"), "paper_id", "source_document_id", current(spark, sf, "papers").where("year >= 2015"), "id")


@query("""with f as (select paper_id, id, ordinal, sha256(regexp_replace(context_json, '"(blankNumber|sourceBlocks|sourcePages)"\\s*:\\s*("[^"]*"|null|[0-9]+|\\[[^\\]]*\\])\\s*,?\\s*', '', 'g')) as context_key from q where context_json is not null)
 select paper_id, context_key, min_by(id, ordinal) as first_id, count(*) as members from f group by paper_id, context_key having count(*) > 1""", "q")
def shared_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts that questions of a paper share, whatever blank each asks for and wherever it is printed."""
    bare = F.regexp_replace("context_json", r'"(blankNumber|sourceBlocks|sourcePages)"\s*:\s*("[^"]*"|null|[0-9]+|\[[^\]]*\])\s*,?\s*', "")
    q = current(spark, sf, "questions").select("paper_id", "id", "ordinal", bare.alias("context"))
    return tree.shared_contexts(q, ["paper_id"], "context", "ordinal", "id")


# What must not leak

_PRIVATE = ["answer", "audit", "sourceDocumentId", "commentary"]


@query(r"""select id, array_to_string(list_sort(list_intersect(list_distinct(regexp_extract_all(raw_json, '"([A-Za-z_][A-Za-z0-9_]*)\\*"\s*:', 1)), ['answer', 'audit', 'sourceDocumentId', 'commentary'])), ',') as leaked from p""", "p")
def leaked_fields(spark: SparkSession, sf: str) -> DataFrame:
    return current(spark, sf, "papers").select("id", F.array_join(reading.private_keys(F.col("raw_json"), _PRIVATE), ",").alias("leaked"))


@query("""select id, json_extract_string(context_json, '$.kind') as "layoutKind", json_extract_string(context_json, '$.blankNumber') as blank, (json_extract_string(context_json, '$.kind') is not null)::int + (json_exists(context_json, '$.blankNumber'))::int as kept from q where context_json is not null""", "q")
def context_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts as maps: keys outside the list dropped, kept ones renamed."""
    m = F.map_filter(F.from_json("context_json", "map<string,string>"), lambda k, v: k.isin("kind", "blankNumber"))
    named = F.transform_keys(m, lambda k, v: F.when(k == "kind", "layoutKind").otherwise("blank"))
    return current(spark, sf, "questions").where("context_json is not null").select("id", named["layoutKind"].alias("layoutKind"), named["blank"].alias("blank"), F.size(named).alias("kept"))


# Aliases and lookups with outcomes


@query("""with r as (select source_hash, min(paragraph_id) as alias from t group by source_hash), j as (select t.*, r.alias from t join r on r.source_hash = t.source_hash)
 select j.path, j.paragraph_id, j.source_hash, coalesce(j.translation, u.translation) as resolved from j left join (select paragraph_id, source_hash, max(translation) as translation from t group by all) u on u.paragraph_id = j.alias and u.source_hash = j.source_hash""", "t")
def alias_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Translations taken over from the first paragraph of the same source, which must have the same digest."""
    t = current(spark, sf, "translations")
    first = t.groupBy("source_hash").agg(F.min("paragraph_id").alias("alias"))
    known = t.groupBy("paragraph_id", "source_hash").agg(F.max("translation").alias("translation"))
    return relate.resolved_alias(t.join(first, "source_hash"), "paragraph_id", "alias", "translation", ["source_hash"], known).select("path", "paragraph_id", "source_hash", "resolved")


@query("""with c as (select paper_id, number, count(distinct id) as n from q where number is not null group by all), s as (select b.id, b.paper_id, regexp_extract(text, '^([0-9]+)\\.', 1) as k from b where role = 'stem' and text is not null)
 select s.paper_id, case when coalesce(c.n, 0) = 0 then 'unresolved' when c.n = 1 then 'resolved' else 'ambiguous' end as outcome, count(*) as n from s left join c on c.paper_id = s.paper_id and c.number = s.k group by all""", "qb")
def lookup_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """How many stems of each paper name one question, none, or several."""
    key = lambda c: F.concat("paper_id", F.lit("#"), c)
    q = current(spark, sf, "questions").where("number is not null").select(key("number").alias("_k"), F.col("id").alias("target"))
    b = current(spark, sf, "source_blocks").where("role = 'stem' and text is not null").select(F.struct("id", "paper_id").alias("id"), key(F.regexp_extract("text", r"^([0-9]+)\.", 1)).alias("_k"))
    return relate.classified_lookup(b, "id", "_k", q, "_k", "target").groupBy("id.paper_id", "outcome").agg(F.count("*").alias("n"))


@query("""with m as (select paper_id, max(ordinal) as last_bank from q where json_extract_string(context_json, '$.kind') = 'wordBank' group by paper_id), x as (select q.id, row_number() over (partition by q.paper_id order by q.ordinal, q.id) as n from q join m on m.paper_id = q.paper_id where q.ordinal > m.last_bank) select id from x where n <= 10""", "q")
def first_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten questions after the last word bank of each paper."""
    from papyra.operators.sequence import first_n

    q = current(spark, sf, "questions").select("id", "paper_id", "ordinal", F.get_json_object("context_json", "$.kind").alias("_kind"))
    last = q.where("_kind = 'wordBank'").groupBy("paper_id").agg(F.max("ordinal").alias("_last"))
    return first_n(q.join(last, "paper_id").where("ordinal > _last"), ["paper_id"], ["ordinal", "id"], 10).select("id")


@query("""with w as (select id, paper_id, ordinal, round(case when length(text) // 12 < 1 then 1.0 else len(list_filter(list_transform(range(0, greatest(length(text) // 12, 1)), lambda i: substr(text, i * 12 + 1, 12)), lambda y: contains(stem, y))) / (length(text) // 12) end, 3) as coverage
 from (select b.id, b.paper_id, b.ordinal, b.text, q.stem from b join q on q.id = b.question_id where b.text is not null and q.stem is not null)), r as (select *, row_number() over (partition by paper_id order by ordinal, id) as n from w where coverage < 0.32) select paper_id, id, coverage from r where n <= 5""", "bq")
def low_coverage_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first five blocks of a paper, in order of the page, of which little stands in their question's stem."""
    from papyra.operators.sequence import first_n

    q = current(spark, sf, "questions").where("stem is not null").select(F.col("id").alias("question_id"), "stem")
    b = current(spark, sf, "source_blocks").where("text is not null").select("id", "paper_id", "ordinal", "text", "question_id").join(q, "question_id")
    low = b.withColumn("coverage", F.round(fx.shingle_coverage(F.col("text"), F.col("stem"), 12), 3)).where("coverage < 0.32")
    return first_n(low, ["paper_id"], ["ordinal", "id"], 5).select("paper_id", "id", "coverage")


@query("select t as stamp, regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$') as is_utc from (select strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as t from events)")
def utc_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """Instants as ISO text in UTC, as ``fx.utc_text`` writes the present one too."""
    t = table(spark, sf, "events").select(fx.utc_text(F.col("ts").cast("timestamp")).alias("stamp"))
    return t.select("stamp", F.col("stamp").rlike(r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z").alias("is_utc"))


QUERIES, SQL = query.queries, query.sql
