"""Text functions, similarity, findings and evidence checks as queries."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions import text as fx
from papyra.operators import relate
from papyra.plans.registry import Registry, current
from papyra.session import table

query = Registry()
_S = "[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\x{1680}\\x{2028}\\x{2029}\\x{85}\\x{0b}]+"


# What SQL needs to fold compatibility characters: every one that folds to a single character, and the Latin ligatures.
_FOLDS = {chr(o): t for o in range(0xA0, 0x10000) if not 0xD800 <= o < 0xE000 for t in [unicodedata.normalize("NFKC", chr(o))] if len(t) == 1 and t != unicodedata.normalize("NFC", chr(o)) and t.isalnum()}
_FOLDED = f"translate(text, '{''.join(_FOLDS)}', '{''.join(_FOLDS.values())}')"
for _c in map(chr, range(0xFB00, 0xFB07)):
    _FOLDED = f"replace({_FOLDED}, '{_c}', '{unicodedata.normalize('NFKC', _c)}')"


@query(f"select doc_id, length(t) as n, sha256(t) as digest from (select doc_id, regexp_replace(lower(nfc_normalize({_FOLDED})), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as t from documents where text is not null)")
def normalised_texts(spark: SparkSession, sf: str) -> DataFrame:
    """NFKC, lower case, letters and digits only."""
    t = fx.letters_digits(fx.nfkc_if_needed(F.col("text")))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.length(t).alias("n"), F.sha2(t, 256).alias("digest"))


@query("select id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as k from o where text is not null", "o")
def ascii_keys(spark: SparkSession, sf: str) -> DataFrame:
    return current(spark, sf, "options").where("text is not null").select("id", fx.ascii_key(F.col("text")).alias("k"))


@query(f"select id, sha256(regexp_replace(text, '{_S}', '', 'g')) as compacted, length(trim(regexp_replace(text, '{_S}', ' ', 'g'))) as squeezed from b where text is not null", "b")
def white_space_forms(spark: SparkSession, sf: str) -> DataFrame:
    b = current(spark, sf, "source_blocks").where("text is not null")
    return b.select("id", F.sha2(fx.compact(F.col("text")), 256).alias("compacted"), F.length(fx.squeeze(F.col("text"))).alias("squeezed"))


@query("select doc_id, sha256(text) as digest, octet_length(encode(text)) as bytes, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10ffff}]', '', 'g')) as units from documents where text is not null")
def text_lineage(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2(t, 256).alias("digest"), F.octet_length(t).alias("bytes"), fx.utf16_units(t).alias("units"))


@query("""with s as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where text is not null)
 select doc_id, row_number() over (partition by doc_id order by n) as ordinal, sha256(trim(line, ' ')) as digest from s where trim(line, ' ') <> ''""")
def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(lines).alias("_p", "_l"))
    return d.select("doc_id", (F.col("_p") + 1).alias("ordinal"), F.sha2("_l", 256).alias("digest"))


@query("select doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x, ' ')), lambda x: x <> '')) as paragraphs from documents where text is not null")
def paragraph_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(fx.paragraphs(F.col("text"))).alias("paragraphs"))


@query("select doc_id, array_to_string(regexp_extract_all(text, '[0-9]+%|[12][0-9]{3}'), ',') as numbers from documents where regexp_matches(text, '[0-9]+%|[12][0-9]{3}')")
def extracted_numbers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where(F.col("text").rlike("[0-9]+%|[12][0-9]{3}"))
    return d.select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit("[0-9]+%|[12][0-9]{3}"), F.lit(0)), ",").alias("numbers"))


@query("select id, try_cast(nullif(regexp_extract(title, '(19|20)[0-9]{2}'), '') as integer) as title_year, try_cast(left(split_part(id, ':', 2), 4) as integer) as id_year from p", "p")
def years_in_text(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract("title", "(?:19|20)[0-9]{2}", 0)
    return current(spark, sf, "papers").select("id", F.when(found != "", found).cast("int").alias("title_year"), F.substring(F.split_part("id", F.lit(":"), F.lit(2)), 1, 4).try_cast("int").alias("id_year"))


@query("select id, text from b where regexp_matches(text, '，，|。。|、、|\\.\\.\\.\\.|,,|\\x{FFFD}')", "b")
def suspicious_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return current(spark, sf, "source_blocks").where(fx.suspicious(F.col("text"))).select("id", "text")


@query("select doc_id, regexp_matches(text, '[\\x{3400}-\\x{9fff}]') as han, round(length(regexp_replace(text, '[^\\x{3400}-\\x{9fff}]', '', 'g')) / greatest(length(text), 1), 4) as share from documents where text is not null")
def script_shares(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", fx.has_han(F.col("text")).alias("han"), F.round(fx.han_share(F.col("text")), 4).alias("share"))


@query("select id, try_cast(regexp_extract(text, '([0-9]+)\\s*$', 1) as integer) is not distinct from source_page_index as page_footer, trim(regexp_replace(text, '[0-9]+\\s*$', '')) as rest from b where role = 'header' and text is not null", "b")
def page_footers(spark: SparkSession, sf: str) -> DataFrame:
    b = current(spark, sf, "source_blocks").where("role = 'header' and text is not null")
    return b.select("id", F.regexp_extract("text", r"([0-9]+)\s*\z", 1).try_cast("int").eqNullSafe(F.col("source_page_index")).alias("page_footer"), F.trim(F.regexp_replace("text", r"[0-9]+\s*\z", "")).alias("rest"))


_PAIRS = "x as (select q.id, q.stem, b.id as block, b.text from q join b on b.question_id = q.id where q.stem is not null and b.text is not null and b.role in ('stem', 'option', 'answer'))"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    q = current(spark, sf, "questions").where("stem is not null").select("id", "stem")
    b = current(spark, sf, "source_blocks").where("text is not null and role in ('stem', 'option', 'answer')").select(F.col("question_id").alias("id"), F.col("id").alias("block"), "text")
    return q.join(b, "id")


@query(f"""with {_PAIRS}, y as (select id, block, stem, text, case when regexp_matches(stem, '[\\x{{3400}}-\\x{{9fff}}]') then 12 else 24 end as w from x), s as (select id, block, w, length(stem) // w as n, list_transform(range(0, greatest(length(stem) // w, 1)), lambda i: substr(stem, i * w + 1, w)) as sh, text from y)
 select id, block, case when n < 1 then 1.0 else round(len(list_filter(sh, lambda v: contains(text, v))) / n, 3) end as coverage from s""", "qb")
def shingle_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("id", "block", F.round(fx.script_coverage(F.col("stem"), F.col("text")), 3).alias("coverage"))


@query(f"""with {_PAIRS}, g as (select id, block, stem, text, list_distinct(list_transform(range(1, greatest(length(stem) - 3, 1)), lambda i: substr(stem, i, 5))) as a, list_distinct(list_transform(range(1, greatest(length(text) - 3, 1)), lambda i: substr(text, i, 5))) as b from x),
 r as (select id, block, case when stem = '' or contains(text, stem) then 1.0 else round(len(list_intersect(a, b)) / greatest(len(a), 1), 3) end as score from g)
 select id, block, score from (select *, row_number() over (partition by id order by score desc, block) as n from r) where n <= 3""", "qb")
def similar_blocks(spark: SparkSession, sf: str) -> DataFrame:
    scored = _pairs(spark, sf).select("id", "block", F.round(fx.containment(F.col("stem"), F.col("text"), 5), 3).alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "block")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n <= 3").drop("_n")


@query(f"""with {_PAIRS}, w as (select id, block, list_distinct(regexp_extract_all(lower(stem), '[a-z]{{3,}}')) as a, list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')) as b, regexp_replace(stem, '[^\\x{{3400}}-\\x{{9fff}}]', '', 'g') as c, regexp_replace(text, '[^\\x{{3400}}-\\x{{9fff}}]', '', 'g') as d from x),
 g as (select id, block, a, b, list_distinct(list_transform(range(1, greatest(length(c) - 2, 1)), lambda i: substr(c, i, 4))) as c4, list_distinct(list_transform(range(1, greatest(length(d) - 2, 1)), lambda i: substr(d, i, 4))) as d4 from w)
 select id, block, round(len(list_intersect(a, b)) / greatest(len(a), 1), 3) as overlap, round(len(list_intersect(c4, d4)) / greatest(len(c4), 1), 3) as han_overlap from g""", "qb")
def word_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("id", "block", F.round(fx.word_overlap(F.col("stem"), F.col("text")), 3).alias("overlap"), F.round(fx.han_overlap(F.col("stem"), F.col("text")), 3).alias("han_overlap"))


@query()
def matching_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Ratcliff-Obershelp ratio of stems and their blocks; SQL has no such function."""
    return _pairs(spark, sf).where("length(stem) = length(text)").select("id", "block", fx.matching_ratio("stem", "text").alias("ratio"))


@query("select doc_id, sha256(text) as joined, true as within from documents where text is not null")
def lossless_round_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Documents split without loss and joined again: digest of what comes back, and no part over 5,000 UTF-16 units."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", fx.split_lossless("text", F.lit(5000)).alias("_p"))
    return d.select("doc_id", F.sha2(F.array_join("_p", ""), 256).alias("joined"), F.forall("_p", lambda x: fx.utf16_units(x) <= 5000).alias("within"))


@query()
def lossless_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of at most 500 UTF-16 units of every document, numbered."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(fx.split_lossless("text", F.lit(500))).alias("part", "body"))


@query()
def parsed_options(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled options read from option blocks."""
    b = current(spark, sf, "source_blocks").where("role = 'option' and text is not null")
    return b.select("id", F.explode(fx.labelled_options("text")).alias("_o")).select("id", "_o.label", "_o.text")


@query("select id, len(regexp_extract_all(stem, '_{2,}|\\$[^$]+\\$|\\{\\{[^}]*\\}\\}|\\[\\d+\\]')) as kept, true as exact, len(regexp_extract_all(stem, '_{2,}|\\$[^$]+\\$|\\{\\{[^}]*\\}\\}|\\[\\d+\\]')) = 0 as survives from q where stem is not null", "q")
def protection_round_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Stems masked and restored exactly; with the first mask struck out, only stems without any come back."""
    q = current(spark, sf, "questions").where("stem is not null").select("id", "stem", fx.protect("stem").alias("_p"))
    struck = fx.restore(F.replace("_p.masked", F.lit("⟦0⟧"), F.lit("")), "_p.kept")
    return q.select("id", F.size("_p.kept").alias("kept"), (fx.restore("_p.masked", "_p.kept") == F.col("stem")).alias("exact"), struck.isNotNull().alias("survives"))


@query()
def protected_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Stems with formulas masked, and restored again."""
    q = current(spark, sf, "questions").where("stem is not null").select("id", "stem", fx.protect("stem").alias("_p"))
    return q.select("id", "_p.masked", (fx.restore("_p.masked", "_p.kept") == F.col("stem")).alias("exact"))


@query(r"select id, regexp_replace(stem, '\\frac\{(\w+)\}\{(\w+)\}', '\1/\2', 'g') as plain from q where contains(stem, '\frac')", "q")
def fractions_spelt_out(spark: SparkSession, sf: str) -> DataFrame:
    q = current(spark, sf, "questions").where(F.contains("stem", F.lit("\\frac")))
    return q.select("id", fx.plain_fractions("stem").alias("plain"))


@query("select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events")
def json_property(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("select id, json_extract_string(context_json, '$.kind') as kind, json_extract_string(context_json, '$.sourceBlocks[0]') as first_block from q where context_json is not null", "q")
def json_contexts(spark: SparkSession, sf: str) -> DataFrame:
    c = F.from_json("context_json", "kind string, blankNumber string, text string, sourceBlocks array<string>")
    return current(spark, sf, "questions").where("context_json is not null").select("id", c["kind"].alias("kind"), F.try_element_at(c["sourceBlocks"], F.lit(1)).alias("first_block"))


@query("select id, json_extract_string(context_json, '$.blankNumber') as blank from q where context_json is not null", "q")
def json_variant(spark: SparkSession, sf: str) -> DataFrame:
    """Open JSON read as a variant; keys nobody declared stay reachable."""
    v = F.try_parse_json("context_json")
    return current(spark, sf, "questions").where("context_json is not null").select("id", F.try_variant_get(v, "$.blankNumber", "string").alias("blank"))


@query("""select id, 'repeated_punctuation' as code from b where regexp_matches(text, '，，|。。|、、|\\.\\.\\.\\.|,,|\\x{FFFD}') union all select id, 'short_stem' from b where role = 'stem' and length(text) < 30 union all select id, 'no_text' from b where text is null
 union all select question_id, 'missing_answer' from a where status = 'missing'""", "ba")
def findings(spark: SparkSession, sf: str) -> DataFrame:
    b, a = current(spark, sf, "source_blocks"), current(spark, sf, "answers")
    code = lambda df, c: df.select("id", F.lit(c).alias("code"))
    out = code(b.where(fx.suspicious(F.col("text"))), "repeated_punctuation").unionByName(code(b.where("role = 'stem' and length(text) < 30"), "short_stem"))
    return out.unionByName(code(b.where("text is null"), "no_text")).unionByName(code(a.where("status = 'missing'").withColumnRenamed("question_id", "id"), "missing_answer"))


@query("""select case when text is null then 'figure_only' when length(text) < 20 then 'fragment' when regexp_matches(text, '^[0-9]+\\.') then 'numbered' else 'prose' end as reason, count(*) as n from b where question_id is null or role = 'stem' group by 1""", "b")
def classified_candidates(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    reason = F.when(t.isNull(), "figure_only").when(F.length(t) < 20, "fragment").when(t.rlike(r"^[0-9]+\."), "numbered").otherwise("prose")
    return current(spark, sf, "source_blocks").where("question_id is null or role = 'stem'").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


# Evidence and attachments


@query("""with x as (select paper_id, number, count(*) as n, list_distinct(flatten(list(cast(json_extract_string(source_pages_json, '$[*]') as varchar[])))) as pages, sum(len(cast(json_extract_string(source_pages_json, '$[*]') as varchar[]))) as total from q where source_pages_json is not null and number is not null group by paper_id, number)
 select paper_id, number, n, len(pages) = total as pages_disjoint from x""", "q")
def page_set_disambiguation(spark: SparkSession, sf: str) -> DataFrame:
    q = current(spark, sf, "questions").where("source_pages_json is not null and number is not null").withColumn("_p", F.from_json("source_pages_json", "array<string>"))
    x = q.groupBy("paper_id", "number").agg(F.count("*").alias("n"), F.flatten(F.collect_list("_p")).alias("_all"))
    return x.select("paper_id", "number", "n", (F.size(F.array_distinct("_all")) == F.size("_all")).alias("pages_disjoint"))


@query("""select o.id, strpos(b.text, o.text) as place from o join b on b.question_id = o.question_id and b.role = 'option' where contains(b.text, o.text) and length(o.text) >= 4""", "ob")
def anchored_options(spark: SparkSession, sf: str) -> DataFrame:
    o = current(spark, sf, "options").where("length(text) >= 4").select("id", "question_id", "text")
    b = current(spark, sf, "source_blocks").where("role = 'option'").select("question_id", F.col("text").alias("_t"))
    hits = o.join(b, "question_id").withColumn("place", F.position(F.col("text"), F.col("_t")))
    return hits.where("place > 0").select("id", "place")


@query("""select b.id, strpos(b.text, left(q.stem, 20)) as place from b join q on q.id = b.question_id where b.role = 'stem' and length(q.stem) >= 20 and strpos(b.text, left(q.stem, 20)) > 1 and length(b.text) - length(replace(b.text, left(q.stem, 20), '')) = 20""", "bq")
def unique_anchor_cut(spark: SparkSession, sf: str) -> DataFrame:
    q = current(spark, sf, "questions").where("length(stem) >= 20").select(F.col("id").alias("question_id"), F.substring("stem", 1, 20).alias("_a"))
    x = current(spark, sf, "source_blocks").where("role = 'stem'").select("id", "question_id", "text").join(q, "question_id").withColumn("place", F.position(F.col("_a"), F.col("text")))
    once = F.length("text") - F.length(F.replace(F.col("text"), F.col("_a"), F.lit(""))) == 20
    return x.where((F.col("place") > 1) & once).select("id", "place")


@query("""with e as (select id, paper_id, unnest(cast(json_extract_string(context_json, '$.sourceBlocks[*]') as varchar[])) as l, generate_subscripts(cast(json_extract_string(context_json, '$.sourceBlocks[*]') as varchar[]), 1) as n from q where context_json is not null),
 u as (select paper_id, l from e group by paper_id, l having count(distinct id) > 1), j as (select e.*, b.id as bid, b.ordinal, b.text, lag(b.ordinal) over (partition by e.id order by e.n) as before, u.l is not null as again from e left join b on b.paper_id = e.paper_id and b.local_id = e.l left join u on u.paper_id = e.paper_id and u.l = e.l)
 select id, sha256(string_agg(coalesce(text, ''), chr(10) order by n)) as digest, count(bid) as found, count(*) as listed, bool_and(before is null or ordinal > before) as in_order, bool_or(again) as reused from j group by id""", "qb")
def rebuilt_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts rebuilt from their blocks: digest of the text, whether all blocks exist, stand in order, and are used by no other question."""
    q = current(spark, sf, "questions").where("context_json is not null").select("id", "paper_id", F.posexplode(F.from_json("context_json", "sourceBlocks array<string>")["sourceBlocks"]).alias("n", "local_id"))
    b = current(spark, sf, "source_blocks").select("paper_id", "local_id", F.col("id").alias("_b"), "text", "ordinal")
    used = q.groupBy("paper_id", "local_id").agg((F.count_distinct("id") > 1).alias("_again"))
    rows = q.join(b, ["paper_id", "local_id"], "left").join(used, ["paper_id", "local_id"])
    rows = rows.withColumn("_before", F.lag("ordinal").over(Window.partitionBy("id").orderBy("n")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    ordered = F.bool_and(F.col("_before").isNull() | (F.col("ordinal") > F.col("_before")))
    return rows.groupBy("id").agg(F.sha2(F.array_join(parts, "\n"), 256).alias("digest"), F.count("_b").alias("found"), F.count("*").alias("listed"), ordered.alias("in_order"), F.bool_or("_again").alias("reused"))


@query("""with p2 as (select paper_id, source_page_index as page, sha256(string_agg(coalesce(text, '') || coalesce(status, ''), '|' order by ordinal, id)) as h from b group by all) select paper_id, sha256(string_agg(h, '|' order by page nulls first)) as revision from p2 group by paper_id""", "b")
def composite_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """A digest for each paper over the digests of its pages, so no paper's whole text meets in one place."""
    ordered = lambda order, v: F.transform(F.array_sort(F.collect_list(F.struct(*order, v.alias("t")))), lambda x: x["t"])
    b = current(spark, sf, "source_blocks").withColumn("_t", F.concat(F.coalesce("text", F.lit("")), F.coalesce("status", F.lit(""))))
    pages = b.groupBy("paper_id", "source_page_index").agg(F.sha2(F.array_join(ordered(["ordinal", "id"], F.col("_t")), "|"), 256).alias("_h"))
    return pages.groupBy("paper_id").agg(F.sha2(F.array_join(ordered(["source_page_index"], F.col("_h")), "|"), 256).alias("revision"))


@query("""select a.question_id, coalesce(k.letters, a.value) as value from a left join (select question_id, min(left(label, 1)) as letters from o where is_correct = 1 group by question_id having count(*) = 1) k on k.question_id = a.question_id""", "ao")
def staged_attachment(spark: SparkSession, sf: str) -> DataFrame:
    """Single marked options attached as answers: all staged rows hold a letter and name a known answer, or the query fails."""
    a = current(spark, sf, "answers").select("question_id", "value")
    k = current(spark, sf, "options").where("is_correct = 1").groupBy("question_id").agg(F.count("*").alias("_n"), F.min(F.substring("label", 1, 1)).alias("letters")).where("_n = 1")
    return relate.attach_checked(a, "question_id", "value", k, "letters", F.col("letters").rlike(r"\A[A-Z]\z")).select("question_id", "value")


@query("""with l as (select id, unnest([source_original, source_reflow, json_path]) as link from p), f as (select distinct 'svg/' || split_part(id, ':', 2) || '.htm' as file from p) select l.id, l.link from l where l.link is not null and l.link not in (select file from f)""", "p")
def broken_links(spark: SparkSession, sf: str) -> DataFrame:
    p = current(spark, sf, "papers")
    links = p.select("id", F.explode(F.array("source_original", "source_reflow", "json_path")).alias("link")).where("link is not null")
    files = p.select(F.concat(F.lit("svg/"), F.split_part("id", F.lit(":"), F.lit(2)), F.lit(".htm")).alias("link")).distinct()
    return links.join(files, "link", "left_anti").select("id", "link")


@query("select title, count(*) as n from p group by title having count(*) > 1 union all select json_path, count(*) from p group by json_path having count(*) > 1", "p")
def registry_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    p = current(spark, sf, "papers")
    return relate.duplicate_keys(p, ["title"]).unionByName(relate.duplicate_keys(p, ["json_path"]).withColumnRenamed("json_path", "title"))


@query("""with m as (select l_linenumber % 5 as i, cast(l_quantity as integer) % 5 as j, count(*) as v from lineitem group by all) select a.i, b.j, sum(a.v * b.v) as v from m a join m b on b.i = a.j group by a.i, b.j""")
def matrix_square(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") % 5).alias("i"), (F.col("l_quantity").cast("int") % 5).alias("j")).agg(F.count("*").alias("v"))
    right = m.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("u"))
    return m.join(right, "j").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("u")).alias("v")).withColumnRenamed("k", "j")


@query("""with x as (select a.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(cast(x[1] as double) - cast(x[2] as double)))) / len(a.embedding) as d from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select vec_id, round(d, 4) as mean_difference, 100 * round(d, 4) > 8 as beyond from x""")
def mean_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Mean absolute difference of neighbours, and whether it lies beyond 8 hundredths."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    gaps = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    mean = F.round(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size("a"), 4)
    return e.join(after, "vec_id").select("vec_id", mean.alias("mean_difference"), (100 * mean > 8).alias("beyond"))


@query("""with x as (select id, kind as notice, 0 as r, 0 as at from p union all select d.paper_id, '来源：' || d.source, 1, min(d.doc_id) from documents d where d.source is not null and d.paper_id in (select id from p) group by 1, 2)
 select id, string_agg(notice, '|' order by r, x.at, notice) as notices from x group by id""", "p")
def merged_notices(spark: SparkSession, sf: str) -> DataFrame:
    """A paper's own notice, then those of its documents with a prefix, each once, in order of first appearance."""
    p, d = current(spark, sf, "papers"), table(spark, sf, "documents").where("source is not null")
    linked = d.join(p.select(F.col("id").alias("paper_id")), "paper_id", "left_semi").groupBy(F.col("paper_id").alias("id"), F.concat(F.lit("来源："), "source").alias("notice")).agg(F.min("doc_id").alias("at")).withColumn("r", F.lit(1))
    own = p.select("id", F.col("kind").alias("notice"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("r"))
    return own.unionByName(linked).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "at", "notice"))), lambda v: v["notice"]), "|").alias("notices"))


@query("""with x as (select id, text, regexp_replace(text, '^[0-9]+\\. ?', '') as rest from b where role = 'stem' and text is not null) select x.id, x.rest = q.stem as exact_remainder from x join b on b.id = x.id join q on q.id = b.question_id where q.stem is not null""", "bq")
def exact_remainders(spark: SparkSession, sf: str) -> DataFrame:
    b = current(spark, sf, "source_blocks").where("role = 'stem' and text is not null").select("id", "question_id", F.regexp_replace("text", r"\A[0-9]+\. ?", "").alias("rest"))
    q = current(spark, sf, "questions").where("stem is not null").select(F.col("id").alias("question_id"), "stem")
    return b.join(q, "question_id").select("id", (F.col("rest") == F.col("stem")).alias("exact_remainder"))


QUERIES, SQL = query.queries, query.sql
