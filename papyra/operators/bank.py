"""Paper documents to relational tables: one plan a table, marks that stay unknown unless sure.

Input is one row a paper with the schema below (``sources.readers.json_objects``). Every table is a
projection of it, so Spark reads only the fields a table needs; ids are composite
(``paper:local``), ordinals are positions from 1. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import answer_letters, paragraphs
from papyra.operators.relate import classified_lookup

_OPTION = "struct<label:string,sourceLabel:string,text:string,sourceOrder:int>"
_ANSWER = "struct<value:string,solution:string,explanation:string,commentary:string,knowledge:string,status:string,sourceDocumentId:string,sourceBlocks:array<string>,sourcePages:array<string>>"
_CONTEXT = "struct<kind:string,blankNumber:string,text:string,sourceBlocks:array<string>,sourcePages:array<string>>"
_LABEL = "struct<id:string,kind:string,text:string,sourceTitle:string,sourceBlockId:string>"
_QUESTION = (
    f"struct<id:string,number:string,sectionKind:string,sectionTitle:string,recordType:string,questionType:string,status:string,stem:string,sourceBlocks:array<string>,sourcePages:array<string>,"
    f"options:array<{_OPTION}>,answer:{_ANSWER},context:{_CONTEXT},labels:array<{_LABEL}>,subquestions:array<struct<number:string,text:string,sourceBlockId:string>>,"
    "continuations:array<struct<questionNumber:string,sourceMarker:string,sourceBlockId:string,sourcePage:string>>>"
)
_BLOCK = "struct<id:string,page:string,sourcePageIndex:int,sourceBlockIndex:int,role:string,text:string,status:string,questionId:string,formulas:array<string>,images:array<string>>"
PAPER = (
    "schema string, id string, title string, category string, categoryLabel string, kind string, year int, template string, source struct<original:string,reflow:string>, pages int, "
    f"blocks array<{_BLOCK}>, questions array<{_QUESTION}>, toc array<struct<id:string,kind:string,label:string,parentId:string>>"
)
CHOICE = ("single_choice", "multiple_choice")
# Words by which an answer refers to another question of its paper.
REFERENCE = "(?:见|同|参见)第[0-9]{1,3}题"


def build(papers: DataFrame) -> dict[str, DataFrame]:
    """Every table by name. Null arrays count as empty; ids are unique only if the papers' are (see the checks)."""
    p = papers.withColumnRenamed("id", "paper_id")
    each = lambda column, *keep: p.select("paper_id", *keep, F.posexplode(column).alias("_i", "x")).withColumn("ordinal", F.col("_i") + 1)
    gid = lambda c: F.concat_ws(":", "paper_id", c)
    q = each("questions").select("paper_id", "ordinal", gid("x.id").alias("id"), "x.id", "x.*").toDF("paper_id", "ordinal", "question_id", "local_id", "_id", *[f.name for f in papers.schema["questions"].dataType.elementType.fields][1:])
    b = each("blocks").select("paper_id", "ordinal", gid("x.id").alias("id"), F.col("x.id").alias("local_id"), F.col("x.page").alias("page"), F.col("x.sourcePageIndex").alias("source_page_index"), F.col("x.sourceBlockIndex").alias("source_block_index"), F.col("x.role").alias("role"), F.col("x.text").alias("text"), F.col("x.status").alias("status"), F.col("x.formulas").alias("formulas"), F.col("x.images").alias("images"))
    in_bank = (F.col("recordType") == "question").cast("int")
    labels_of = F.transform("options", lambda o: F.regexp_extract(o["label"], "([A-Z])", 1))
    sure = (F.col("answer.status") == "explicit") & F.col("questionType").isin(*CHOICE) & (F.col("status") == "complete") & (F.size(F.array_distinct(labels_of)) == F.size(labels_of))
    marked = F.when(sure, answer_letters(F.col("answer.value"), labels_of, F.col("questionType") == "single_choice"))
    o = q.select("paper_id", "question_id", marked.alias("_m"), F.posexplode("options").alias("_i", "o"))
    letter = F.regexp_extract("o.label", "([A-Z])", 1)
    options = o.select(F.concat("question_id", F.lit(":o-"), (F.col("_i") + 1).cast("string")).alias("id"), "question_id", "paper_id", F.col("o.label").alias("label"), F.col("o.sourceLabel").alias("source_label"), F.col("o.text").alias("text"), (F.col("_i") + 1).alias("default_position"), F.col("o.sourceOrder").alias("source_position"), F.array_contains("_m", letter).cast("int").alias("is_correct"))
    bridge = lambda array: q.select("paper_id", "question_id", F.posexplode(array).alias("_i", "_b")).select("question_id", (F.col("_i") + 1).alias("ordinal"), F.concat_ws(":", "paper_id", "_b").alias("source_block_id"))
    context = q.where("context is not null").withColumn("_key", F.sha2(F.to_json(F.col("context").dropFields("blankNumber"), {"ignoreNullFields": "false"}), 256))
    nodes_of = lambda kind, df, key, parent: df.select(key.alias("id"), parent.alias("parent_id"), F.lit(kind).alias("node_type"))
    sections = q.groupBy("paper_id", "sectionTitle").agg(F.min("ordinal").alias("_at"))
    section_id = F.concat("paper_id", F.lit("#s:"), F.coalesce("sectionTitle", F.lit("")))
    subs = q.select("question_id", F.posexplode("subquestions").alias("_i", "s"))
    nodes = nodes_of("paper", p, F.col("paper_id"), F.lit(None).cast("string")).unionByName(nodes_of("section", sections, section_id, F.col("paper_id"))).unionByName(nodes_of("question", q, F.col("question_id"), section_id))
    nodes = nodes.unionByName(nodes_of("option", options, F.col("id"), F.col("question_id"))).unionByName(nodes_of("answer", q, F.concat("question_id", F.lit("#answer")), F.col("question_id"))).unionByName(nodes_of("subquestion", subs, F.concat("question_id", F.lit("#p:"), (F.col("_i") + 1).cast("string")), F.col("question_id")))
    first = context.groupBy("paper_id", "_key").agg(F.min_by("question_id", "ordinal").alias("_first"), F.count("*").alias("_n"))
    nodes = nodes.unionByName(nodes_of("context", first, F.concat("_first", F.lit("#context")), F.col("_first")))
    links = context.join(first, ["paper_id", "_key"]).select(F.col("question_id").alias("from_id"), F.concat("_first", F.lit("#context")).alias("to_id"), F.lit("shared_context").alias("link_type"), F.lit(1).alias("ordinal"))
    later = q.select("paper_id", "question_id", F.posexplode("continuations").alias("_i", "c")).join(q.select("paper_id", F.col("number").alias("_n"), F.col("question_id").alias("_to")), "paper_id").where("c.questionNumber = _n")
    links = links.unionByName(later.select(F.col("question_id").alias("from_id"), F.col("_to").alias("to_id"), F.lit("continuation").alias("link_type"), (F.col("_i") + 1).alias("ordinal")))
    units = q.select("question_id", F.concat(F.lit("$.questions["), (F.col("ordinal") - 1).cast("string"), F.lit("].stem")).alias("json_path"), F.posexplode(paragraphs(F.col("stem"))).alias("_i", "text")).select("json_path", F.concat("question_id", F.lit("#u:"), (F.col("_i") + 1).cast("string")).alias("id"), "question_id", (F.col("_i") + 1).alias("ordinal"), "text")
    marks = options.groupBy("question_id").agg(F.count_if(F.col("is_correct") == 1).alias("_marks"))
    reason = F.when(F.col("status") != "complete", "incomplete_question").when(F.coalesce(F.col("answer.status"), F.lit("missing")) == "missing", "answer_missing").when(F.col("answer.status") == "ambiguous", "answer_ambiguous").when(F.coalesce("_marks", F.lit(0)) == 0, "no_marks")
    score = q.where(in_bank == 1).join(marks, "question_id", "left").select("question_id", reason.isNull().cast("int").alias("scoreable"), reason.alias("reason"))
    repeated = options.groupBy("question_id", "label").agg(F.count("*").alias("_n")).where("_n > 1").select("question_id", F.lit("duplicate_option_label").alias("code"))
    unsure = q.where((F.col("answer.status") == "explicit") & F.col("questionType").isin(*CHOICE) & (F.col("status") == "complete") & (F.size("options") > 0) & marked.isNull()).select("question_id", F.lit("unsafe_choice_mapping").alias("code"))
    labels = q.select("question_id", F.posexplode("labels").alias("_i", "l"))
    issues = repeated.unionByName(unsure)
    # Numbers that begin again open a form; options that several questions of a paper share are one set.
    at = Window.partitionBy("paper_id").orderBy("ordinal")
    number = F.col("number").try_cast("int")
    forms = q.where(in_bank == 1).withColumn("_again", F.coalesce(number <= F.lag(number).over(at), F.lit(False)).cast("int")).withColumn("form", 1 + F.sum("_again").over(at)).withColumn("form_id", F.concat("paper_id", F.lit("#f:"), F.col("form").cast("string")))
    texts = F.transform("options", lambda x: F.coalesce(x["text"], F.lit("")))
    sets = q.where("size(options) > 0").withColumn("set_id", F.concat("paper_id", F.lit("#c:"), F.sha2(F.to_json(texts), 256)))
    of_set = sets.groupBy("paper_id", "set_id").agg(F.min_by("options", "ordinal").alias("_o"), F.count("*").alias("questions"))
    # Answers that name another question of their paper; a target counts only if exactly one question has the number.
    named = q.select("paper_id", "question_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"answer.{c}").alias("t")) for c in ("value", "solution", "explanation", "commentary")])).alias("_a"))
    named = named.select("paper_id", "question_id", "_a.field", F.posexplode(F.regexp_extract_all("_a.t", F.lit(REFERENCE), F.lit(0))).alias("_i", "literal_text"))
    asked = named.select(F.struct("question_id", "field", (F.col("_i") + 1).alias("ordinal"), "literal_text").alias("_r"), F.concat_ws("#", "paper_id", F.regexp_extract("literal_text", "[0-9]+", 0)).alias("_k"))
    offered = q.where((in_bank == 1) & F.col("number").isNotNull()).select(F.concat_ws("#", "paper_id", "number").alias("_k"), F.col("question_id").alias("target"))
    references = classified_lookup(asked, "_r", "_k", offered, "_k", "target").select("_r.*", F.col("outcome").alias("status"), F.col("target").alias("target_question_id"))
    return {
        "papers": p.select("paper_id", "title", "category", F.col("categoryLabel").alias("category_label"), "kind", "year", "template", "source.original", "source.reflow", "pages", F.size(F.coalesce("questions", F.array().cast(papers.schema["questions"].dataType))).alias("record_count"), F.size(F.coalesce("blocks", F.array().cast(papers.schema["blocks"].dataType))).alias("block_count")),
        "questions": q.select(F.col("question_id").alias("id"), "paper_id", "local_id", "ordinal", "number", F.col("questionType").alias("question_type"), F.col("recordType").alias("record_type"), F.col("sectionKind").alias("section_kind"), F.col("sectionTitle").alias("section_title"), "stem", "status", in_bank.alias("in_bank")),
        "options": options,
        "answers": q.select("question_id", "answer.value", "answer.solution", "answer.explanation", "answer.commentary", "answer.knowledge", F.coalesce("answer.status", F.lit("missing")).alias("status"), F.col("answer.sourceDocumentId").alias("source_document_id")),
        "source_blocks": b,
        "source_spans": b.select(F.col("id").alias("block_id"), "page", "source_page_index", "source_block_index"),
        "question_source_blocks": bridge("sourceBlocks"),
        "context_source_blocks": bridge("context.sourceBlocks"),
        "labels": labels.select(F.col("l.id").alias("id"), F.col("l.kind").alias("kind"), F.col("l.text").alias("text")).distinct(),
        "question_labels": labels.select("question_id", (F.col("_i") + 1).alias("ordinal"), F.col("l.id").alias("label_id")),
        "semantic_nodes": nodes,
        "semantic_links": links,
        "content_units": units.drop("json_path"),
        "unit_provenance": units.select(F.col("id").alias("unit_id"), F.sha2("text", 256).alias("source_hash"), "json_path"),
        "scoreability": score,
        "quality_issues": issues,
        "quality_issue_source_spans": issues.join(bridge("sourceBlocks"), "question_id").select("question_id", "code", "source_block_id"),
        "paper_forms": forms.groupBy("form_id", "paper_id", "form").agg(F.count("*").alias("questions")),
        "question_paper_forms": forms.select("question_id", "form_id"),
        "choice_sets": of_set.select(F.col("set_id").alias("id"), "paper_id", F.size("_o").alias("options"), "questions"),
        "choice_set_options": of_set.select("set_id", F.posexplode("_o").alias("_i", "o")).select(F.concat("set_id", F.lit(":"), (F.col("_i") + 1).cast("string")).alias("id"), "set_id", (F.col("_i") + 1).alias("position"), "o.label", "o.text"),
        "question_choice_sets": sets.select("question_id", "set_id"),
        "answer_references": references,
        "input_hashes": papers.select(F.col("id").alias("paper_id"), F.sha2(F.to_json(F.struct(*papers.columns), {"ignoreNullFields": "false"}), 256).alias("sha256")),
        "meta": papers.groupBy("schema").agg(F.count("*").alias("papers")).select(F.lit("schema").alias("key"), F.col("schema").alias("value"), "papers"),
    }


def checks(tables: dict[str, DataFrame], audit: dict[str, int]) -> dict[str, DataFrame]:
    """Violations by rule, over written tables: keys, order, references, conservation and announced totals."""
    from papyra.operators.constraints import Check, Reference, Unique, totals, violations
    from papyra.operators.relate import inventory_diff
    from papyra.operators.sequence import not_contiguous

    rules = [Unique("papers", ("paper_id",)), Unique("questions", ("id",)), Unique("options", ("question_id", "source_position")), Unique("source_blocks", ("id",)), Reference("options", "question_id", "questions", "id"), Reference("question_source_blocks", "source_block_id", "source_blocks", "id"), Reference("semantic_links", "to_id", "semantic_nodes", "id"), Unique("semantic_nodes", ("id",)), Check("questions", "ordinal", "ordinal > 0", "id")]
    bank = tables["questions"].where("in_bank = 1")
    return {
        "integrity": violations(tables.__getitem__, rules),
        "option order": not_contiguous(tables["options"], ["question_id"], "default_position"),
        "question records": totals(tables["questions"], {"records": audit["questionRecords"]}, {"records": "count(*)"}),
        "source blocks": totals(tables["source_blocks"], {"blocks": audit["sourceBlocks"]}, {"blocks": "count(*)"}),
        "form members": inventory_diff(bank.select("id"), tables["question_paper_forms"].select(F.col("question_id").alias("id")), "id"),
        "score rows": inventory_diff(bank.select("id"), tables["scoreability"].select(F.col("question_id").alias("id")), "id"),
        "spans": totals(tables["source_spans"], {"spans": audit["sourceBlocks"]}, {"spans": "count(*)"}),
    }
