"""Several values packed in one field: delimiter skeletons, one splitting rule per skeleton.

Each text is cut into tokens (quoted value, bracket group, enumerator, number, delimiter,
blank, terminator, ordinary run) by one pattern in the JVM, and each token is masked to one
symbol. The resulting skeleton says nothing about the words, so many texts share one. A rule,
i.e. the token ranges that hold values, is resolved once per distinct skeleton and joined back
(broadcast only when the rule table's measured size allows); values are then taken by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.session import cut, maybe_broadcast

# The delimiters that separate packed values.
DELIMITERS = ";；|/、，,\t\n\r"
# Sentence ends.
TERMINATORS = "。！？!?"

_CIRCLED = "①-⑳"
_TOKENS = (
    ("Q", r"\"[^\"]*+(?:\"\"[^\"]*+)*+\"|“[^”]*”|「[^」]*」|『[^』]*』|'[^']+'(?=\s*(?:[;；|/、，,]|\z|\s[^a-z]))"),
    ("E", rf"[(（]\d{{1,2}}[)）]|[{_CIRCLED}]"),
    ("B", r"\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]|\$[^$]*\$"),
    ("9", r"\d{1,3}(?:,\d{3})+(?!\d)(?:\.\d+)?|\d+/\d+(?![/\d])|\d+\.\d+"),
    ("E", r"\d{1,2}[)）、]|\d{1,2}[.．](?![\d.．])"),
    ("S", r"\|\||[;；|/、，,\t\n\r]"),
    ("T", rf"[{TERMINATORS}]|\.(?=\s|\z)"),
    (" ", r"[  　]+"),
    ("w", r"[A-Za-zÀ-ɏ]+(?:'[A-Za-z]+)*|\d+|[^;；|/、，,\t\n\r。！？!?  　\"“「『'(（\[$\d①-⑳A-Za-zÀ-ɏ.]+|(?s:.)"),
)
TOKEN = "|".join(f"(?:{p})" for _, p in _TOKENS)
#: Enumerators keep their number: 1 is U+E001, 2 is U+E002, ...; those that end in a delimiter ("1、") are 0x100 higher.
_ENUM = 0xE000


def _symbol(t: Column) -> Column:
    """One symbol for a token: its class, the delimiter itself, or an enumerator's number."""
    whole = lambda p: t.rlike(rf"\A(?:{p})\z")
    number = F.when(t.rlike(rf"\A[{_CIRCLED}]\z"), F.ascii(t) - 0x2460 + 1).otherwise(F.regexp_extract(t, r"\d+", 0).cast("int"))
    out = F.when(whole(_TOKENS[0][1]), "Q").when(whole(f"{_TOKENS[1][1]}|{_TOKENS[4][1]}"), F.decode(F.unhex(F.lpad(F.hex(F.lit(_ENUM) + number + F.when(F.endswith(t, F.lit("、")), 0x100).otherwise(0)), 4, "0")), "UTF-16BE"))
    for kind, pattern in (_TOKENS[2], _TOKENS[3]):
        out = out.when(whole(pattern), kind)
    out = out.when(t == "||", "|").when(t.rlike(rf"\A[{re.escape(DELIMITERS)}]\z"), t)
    return out.when(t.rlike(rf"\A[{TERMINATORS}.]\z"), "T").when(t.rlike(r"\A[  　]+\z"), " ").otherwise("w")


def _maybe_list(text: Column) -> Column:
    """False only where the skeleton would show prose or a single value: no delimiter, or a sentence end outside quotes, brackets and enumerators.

    Texts with a straight single quote, which may be an apostrophe, are left to the skeleton.
    """
    bare = F.regexp_replace(text, r"\"[^\"]*+\"|“[^”]*+”|「[^」]*+」|『[^』]*+』|\([^()]*+\)|（[^（）]*+）|\[[^\[\]]*+\]|\$[^$]*+\$|\d{1,2}[.．](?![\d.．])", "")
    prose = bare.rlike(rf"[{TERMINATORS}]|\.(?=\s|\z)") & ~F.contains(text, F.lit("'"))
    return text.rlike(rf"[{re.escape(DELIMITERS)}{_CIRCLED}()（）]") & ~prose


def skeletons(df: DataFrame, text: str) -> DataFrame:
    """Add ``_tokens`` (array) and ``_skeleton`` (one symbol a token); null text gives nulls."""
    tokens = F.regexp_extract_all(F.trim(F.col(text)), F.lit(TOKEN), F.lit(0))
    return df.withColumn("_tokens", tokens).withColumn("_skeleton", F.array_join(F.transform("_tokens", _symbol), ""))


def resolve(skeleton: str) -> list[tuple[int, int]]:
    """Token ranges [from, to) of the values of a list; fewer than two mean it is no list.

    A terminator outside quotes makes it prose. Enumerators count only if they run 1, 2, 3, ...
    and each has content; otherwise they are part of a value (or "1、2" is numbers and a delimiter).
    """
    s = skeleton
    if "T" in s:
        return []
    enums = [i for i, c in enumerate(s) if _ENUM <= ord(c) < _ENUM + 0x200]
    numbers = [ord(s[i]) - _ENUM & 0xFF for i in enums]
    content = lambda a, b: any(c not in DELIMITERS and c != " " for c in s[a:b])
    run = bool(enums) and numbers == list(range(1, len(numbers) + 1)) and all(content(i + 1, j) for i, j in zip(enums, [*enums[1:], len(s)], strict=True))
    numbered = set(enums) if run else set()
    out, start = [], 0
    for i, c in enumerate(s + ";"):
        number_then_delimiter = not run and _ENUM + 0x100 <= ord(c) < _ENUM + 0x200
        if c in DELIMITERS or i in numbered or number_then_delimiter:
            a, b = start, i + number_then_delimiter
            while a < b and s[a] == " ":
                a += 1
            while b > a and s[b - 1] == " ":
                b -= 1
            if a < b:
                out.append((a, b))
            start = i + 1
    return out if len(out) > 1 else []


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ranges = [resolve(s) for s in batch["_skeleton"]]
        keep = [bool(r) for r in ranges]
        yield pd.DataFrame({"_skeleton": batch["_skeleton"][keep], "_ranges": [[{"a": a, "b": b} for a, b in r] for r in ranges if r]})


def split_packed(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row (keys, pos, value) for each value of every ``text`` that is a list of two or more.

    Null, blank, prose and single-valued texts give no rows; empty slots take no position; a
    quoted value is one value, without its quotes and with doubled quotes undone. Rows repeated
    with the same keys and text count once. Other columns of ``df`` are ignored, whatever their
    names. Empty input gives an empty table.
    """
    rows = df.select(*keys, F.col(text).alias("_text")).where(F.col("_text").rlike(r"\S") & _maybe_list(F.trim("_text"))).distinct()
    cut_up = skeletons(rows, "_text").where(F.length("_skeleton") > 2)
    rules = cut_up.select("_skeleton").distinct().mapInPandas(_rules, "_skeleton string, _ranges array<struct<a:int,b:int>>")
    rules = maybe_broadcast(cut(rules), 400)
    value = F.array_join(F.slice(F.col("_tokens"), F.col("_r.a") + 1, F.col("_r.b") - F.col("_r.a")), "")
    bare = F.regexp_extract(F.col("value"), r"(?s)\A(?:\"(.*)\"|“(.*)”|「(.*)」|『(.*)』|'(.*)')\z", 0) != ""
    undone = F.replace(F.substring("value", 2, F.length("value") - F.lit(2)), F.lit('""'), F.lit('"'))
    return (
        cut_up.join(rules, "_skeleton")
        .select(*keys, "_tokens", F.posexplode("_ranges").alias("_p", "_r"))
        .select(*keys, (F.col("_p") + 1).cast("int").alias("pos"), value.alias("value"))
        .withColumn("value", F.when(bare, undone).otherwise(F.regexp_replace("value", r"、\z", "")))
    )
