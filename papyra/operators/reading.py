"""Read views over the relational tables: options as shown, owned excerpts, trees without what must stay hidden.

Children are collected by one aggregation for each child table and joined to their parents, never
fetched row by row. Default views hold no marks and no answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a printed key of some question: an optional star, its number, a stop, and the word for "answer" in brackets.
KEY_MARK = r"(?<![0-9])(\*?)\s*([0-9]{1,3})\s*[.．、]\s*【(?:参考)?答案】"


def in_order(order: list[str], value: Column) -> Column:
    """Aggregate: the values of a group ordered by the given columns; null values are left out."""
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct(*order, value.alias("_value"))))
    return F.transform(F.array_sort(pairs), lambda x: x["_value"])


def with_display_labels(options: DataFrame, referenced: Column, shuffled: bool = False, place: str = "default_position") -> DataFrame:
    """Add ``display_label``: the label where the text refers to letters (``referenced``), else letters by
    ``place`` when shuffled, else the printed label where labels repeat within the question, else the label.

    A missing printed label falls back to the label; a null label stays null.
    """
    labels = options.groupBy("question_id").agg((F.count_distinct("label") < F.count("label")).alias("_repeated"))
    printed = F.when(F.col("_repeated"), F.coalesce("source_label", "label")).otherwise(F.col("label"))
    shown = F.when(F.coalesce(referenced, F.lit(False)), F.col("label")).otherwise(F.concat(F.char(F.col(place) + 64), F.lit(".")) if shuffled else printed)
    return options.join(labels, "question_id").withColumn("display_label", shown).drop("_repeated")


def shuffled(options: DataFrame, seed: str) -> DataFrame:
    """Add ``place``: the 1-based place of an option in its question, by a digest of seed and ids, so it is the same on every run."""
    from papyra.operators.sequence import ordinals

    if len(seed) > 128:
        raise ValueError("a seed has at most 128 characters")
    keyed = options.withColumn("_key", F.sha2(F.concat(F.lit(f"{seed}:"), "question_id", F.lit(":"), "id"), 256))
    return ordinals(keyed, ["question_id"], ["_key"], "place").drop("_key")


def question_views(questions: DataFrame, options: DataFrame, blocks: DataFrame, answers: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, number, stem, options, blocks, labels, answer_status): one row a question with its children nested in order.

    ``options`` holds (id, display_label, text), ``blocks`` (id, role, text), ``labels`` texts; a question
    without children has empty arrays. Answers give their status only. ``blocks`` and ``labels`` are keyed by question_id.
    """
    o = options.groupBy(F.col("question_id").alias("id")).agg(in_order(["default_position", "id"], F.struct("id", "display_label", "text")).alias("options"))
    b = blocks.groupBy(F.col("question_id").alias("id")).agg(in_order(["ordinal", "id"], F.struct("id", "role", "text")).alias("blocks"))
    l = labels.groupBy(F.col("question_id").alias("id")).agg(in_order(["ordinal"], F.col("label")).alias("labels"))
    a = answers.select(F.col("question_id").alias("id"), F.col("status").alias("answer_status"))
    out = questions.select("id", "paper_id", "number", "stem").join(a, "id", "left").join(o, "id", "left").join(b, "id", "left").join(l, "id", "left")
    return out.select("id", "paper_id", "number", "stem", "answer_status", *[F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("options", "blocks", "labels")])


def exclusive_excerpts(cited: DataFrame, blocks: DataFrame) -> DataFrame:
    """(question_id, excerpt, blocks): the cited blocks that no other question cites, in cited order, their texts joined by line breaks.

    ``cited`` holds (question_id, document_id, local_id, place). A question one of whose own blocks does
    not exist gets none, as do those left without a usable block; duplicates and bare sources are passed over.
    """
    owners = cited.groupBy("document_id", "local_id").agg(F.count_distinct("question_id").alias("_owners"))
    own = cited.join(owners.where("_owners = 1"), ["document_id", "local_id"]).drop("_owners")
    found = blocks.select(F.col("paper_id").alias("document_id"), "local_id", F.col("id").alias("_id"), "status", "text")
    joined = own.join(found, ["document_id", "local_id"], "left")
    usable = F.col("text").isNotNull() & ~F.coalesce(F.col("status").isin("duplicate", "source_only"), F.lit(False))
    parts = in_order(["place", "local_id"], F.when(usable, F.col("text")))
    per = joined.groupBy("question_id").agg(F.bool_and(F.col("_id").isNotNull()).alias("_all"), parts.alias("_parts"))
    return per.where("_all and size(_parts) > 0").select("question_id", F.array_join("_parts", "\n").alias("excerpt"), F.size("_parts").alias("blocks"))


def without_foreign_tail(text: Column, number: Column) -> Column:
    """The text without the key of another question at its end, or null where no sure boundary exists.

    Text without foreign marks stays as it is. One starred foreign mark followed by nothing but up to four
    option letters is cut off with them; anything else is no sure boundary. A null number makes every mark
    foreign and none sure.
    """
    marks = F.regexp_extract_all(text, F.lit(KEY_MARK), F.lit(2))
    foreign = F.filter(marks, lambda m: ~F.coalesce(m.cast("int") == number, F.lit(False)))
    tail = rf"(?s)\A(.*?)(?<![0-9])\*\s*([0-9]{{1,3}})\s*[.．、]\s*【(?:参考)?答案】\s*[A-Da-d]{{1,4}}\s*\z"
    ends = text.rlike(tail) & (F.element_at(marks, -1).cast("int") != number)
    cut = F.rtrim(F.regexp_replace(text, rf"(?s)(?<![0-9])\*\s*[0-9]{{1,3}}\s*[.．、]\s*【(?:参考)?答案】\s*[A-Da-d]{{1,4}}\s*\z", ""))
    return F.when(F.size(foreign) == 0, text).when(number.isNotNull() & (F.size(foreign) == 1) & ends, cut)


def reference_only(source: Column, literal: Column, solution: Column) -> Column:
    """Whether a printed answer only refers elsewhere: a number, then the words of the reference, while the solution says something else."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    s, l = squeezed(source), squeezed(literal)
    head = F.trim(F.substring(s, F.lit(1), F.length(s) - F.length(l)))
    return F.coalesce((l != "") & F.endswith(s, l) & head.rlike(r"\A[一二三四五六七八九十百零\d]+[、.．]?\z") & (F.trim(solution) != l), F.lit(False))


def visible_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with ``hidden`` and ``reason``: answers, all below them, and what only hidden nodes link to.

    ``nodes`` holds (id, parent_id, paper_id, kind, node_type), ``links`` (from_id, to_id). A paper of
    answers shows its root only. ``reason`` stands at the root of papers of answers and of mixed ones.
    """
    from papyra.operators.tree import hidden_below, wholly_owned

    answers = nodes.where("node_type = 'answer' or kind = 'answers' and node_type <> 'paper'")
    below = hidden_below(nodes, "id", "parent_id", answers)
    targets = wholly_owned(links.select("from_id", "to_id"), "to_id", "from_id", below, "id").select(F.col("to_id").alias("id"))
    targets = targets.join(nodes.where("kind = 'complete'").select("id"), "id", "left_semi")
    hidden = below.unionByName(hidden_below(nodes, "id", "parent_id", targets)).distinct().withColumn("_h", F.lit(True))
    reason = F.when(F.col("node_type") != "paper", None).when(F.col("kind") == "answers", "answer_document_requires_explicit_route").when(F.col("kind") == "complete", "unresolved_answer_boundary")
    return nodes.join(hidden, "id", "left").withColumn("hidden", F.coalesce("_h", F.lit(False))).withColumn("reason", reason).drop("_h")


def root_violations(nodes: DataFrame) -> DataFrame:
    """(paper_id, roots) of papers that do not have exactly one root, the paper itself; a node whose parent is absent is a root."""
    parents = nodes.select(F.col("id").alias("_p"), F.col("paper_id").alias("_in"))
    joined = nodes.join(parents, (F.col("parent_id") == F.col("_p")) & (F.col("paper_id") == F.col("_in")), "left")
    per = joined.groupBy("paper_id").agg(F.count_if(F.col("_p").isNull()).alias("roots"), F.count_if(F.col("_p").isNull() & (F.col("node_type") == "paper")).alias("_papers"))
    return per.where("roots <> 1 or _papers <> 1").select("paper_id", "roots")


def private_fields(df: DataFrame, private: set[str]) -> list[str]:
    """Paths in the schema, at any depth, that bear a private name."""
    out: list[str] = []
    todo = [("", df.schema)]
    while todo:
        path, kind = todo.pop()
        if kind.typeName() == "struct":
            for f in kind.fields:
                here = f"{path}.{f.name}".lstrip(".")
                out += [here] if f.name in private else []
                todo.append((here, f.dataType))
        elif kind.typeName() == "array":
            todo.append((path + "[]", kind.elementType))
        elif kind.typeName() == "map":
            todo += [(path + "{}", kind.keyType), (path + "{}", kind.valueType)]
    return sorted(out)


def private_keys(json: Column, private: list[str]) -> Column:
    """The private names that stand as keys in a JSON text, at any depth and also in JSON kept as text, sorted.

    A quoted word with a colon behind it within a text value is taken for a key too: better one too many.
    """
    keys = F.regexp_extract_all(json, F.lit(r'"([A-Za-z_][A-Za-z0-9_]*)\\*"\s*:'), F.lit(1))
    return F.array_sort(F.array_intersect(F.array_distinct(keys), F.array(*map(F.lit, private))))
