"""Text expressions. Built-in expressions wherever they exist; Arrow-batched UDFs for the rest.

Nulls give null unless said otherwise.
"""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType


def squeeze(c: Column) -> Column:
    """White space of any kind collapsed to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def compact(c: Column) -> Column:
    """All white space removed."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def letters_digits(c: Column) -> Column:
    """Lower case, letters and digits of every script only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def ascii_key(c: Column) -> Column:
    """Lower case, a-z and 0-9 only."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; no built-in exists."""
    return s.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else None)


def nfkc_if_needed(c: Column) -> Column:
    """NFKC; texts of ASCII only skip the UDF."""
    return F.when(c.rlike(r"\A[\x00-\x7f]*\z"), c).otherwise(nfkc(c))


def search_key(c: Column) -> Column:
    """NFKC, lower case, squeezed."""
    return squeeze(F.lower(nfkc_if_needed(c)))


def has_all_terms(text: Column, terms: list[str]) -> Column:
    """Every term occurs in the text; no terms match every text."""
    return reduce(lambda a, t: a & F.contains(text, F.lit(t)), terms, F.lit(True))


def utc_text(at: Column | None = None) -> Column:
    """An instant, or the present one, as ISO text in UTC, whatever the session's time zone."""
    at = F.current_timestamp() if at is None else at
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utf16_units(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def paragraphs(c: Column) -> Column:
    """The non-blank paragraphs between blank lines, trimmed."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def suspicious(c: Column) -> Column:
    """Repeated punctuation or a replacement character."""
    return c.rlike(r"，，|。。|、、|\.\.\.\.|,,|\x{FFFD}")


def suspicious_context(c: Column, reach: int = 35) -> Column:
    """The first suspicious place with ``reach`` characters on either side."""
    at = F.regexp_instr(c, F.lit(r"，，|。。|、、|\.\.\.\.|,,|\x{FFFD}"))
    return F.when(at > 0, F.substring(c, F.greatest(at - reach, F.lit(1)), F.least(at, F.lit(reach + 1)) + reach))


def has_han(c: Column) -> Column:
    return c.rlike(r"[\x{3400}-\x{9fff}]")


def han_share(c: Column) -> Column:
    """Share of ideographs among the characters; 0 for an empty text."""
    return F.length(F.regexp_replace(c, r"[^\x{3400}-\x{9fff}]", "")) / F.greatest(F.length(c), F.lit(1))


# Chinese digits.
_DIGITS = "一二三四五六七八九"


def chinese_number(c: Column) -> Column:
    """1 to 99 written in Chinese digits; null for anything else."""
    digit = lambda x: F.instr(F.lit(_DIGITS), x)
    tens = F.regexp_extract(c, rf"\A([{_DIGITS}]?)十([{_DIGITS}]?)\z", 1)
    ones = F.regexp_extract(c, rf"\A([{_DIGITS}]?)十([{_DIGITS}]?)\z", 2)
    both = F.when(tens == "", 1).otherwise(digit(tens)) * 10 + F.when(ones == "", 0).otherwise(digit(ones))
    return F.when(c.rlike(rf"\A[{_DIGITS}]\z"), digit(c)).when(c.rlike(rf"\A[{_DIGITS}]?十[{_DIGITS}]?\z"), both).cast("int")


def answer_letters(value: Column, labels: Column, single: Column) -> Column:
    """The letters of an answer key, sorted, or null if it cannot be read for sure.

    Separators are dropped; one letter for a single choice, at least one for several; all
    distinct and all among the labels.
    """
    bare = F.regexp_replace(F.upper(value), r"[\s,，、;；/|.]+", "")
    letters = F.filter(F.split(bare, ""), lambda x: x != "")
    ok = bare.rlike(r"\A[A-Z]+\z") & (F.size(F.array_distinct(letters)) == F.size(letters)) & (F.size(F.array_except(letters, labels)) == 0) & (~single | (F.size(letters) == 1))
    return F.when(ok, F.array_sort(letters))


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams; a text shorter than n has none."""
    size = F.length(c) - n + 1
    return F.when(size < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))))


def containment(part: Column, whole: Column, n: int = 5) -> Column:
    """Share of the part's n-grams that the whole has; 1 for an empty part or a plain substring."""
    a, b = grams(part, n), grams(whole, n)
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    return F.when((part == "") | F.contains(whole, part), 1.0).otherwise(share)


def shingle_coverage(part: Column, whole: Column, width: int) -> Column:
    """Share of the part's consecutive shingles that occur in the whole; 1 for a text shorter than one."""
    n = F.floor(F.length(part) / width).cast("int")
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(part, i * width + 1, F.lit(width)))
    hits = F.size(F.filter(shingles, lambda s: F.contains(whole, s)))
    return F.when(n < 1, 1.0).otherwise(hits / n)


def script_coverage(part: Column, whole: Column) -> Column:
    """Shingle coverage, in shingles of 12 characters for a text with ideographs and of 24 for any other."""
    return F.when(has_han(part), shingle_coverage(part, whole, 12)).otherwise(shingle_coverage(part, whole, 24))


def han_overlap(a: Column, b: Column) -> Column:
    """Share of the overlapping 4-grams of ideographs of ``a`` that ``b`` has; other characters are left out first."""
    han = lambda c: grams(F.regexp_replace(c, r"[^\x{3400}-\x{9fff}]", ""), 4)
    return F.size(F.array_intersect(han(a), han(b))) / F.greatest(F.size(han(a)), F.lit(1))


def word_overlap(a: Column, b: Column) -> Column:
    """Share of the words of three letters or more of ``a`` that ``b`` has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)))
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(words(a)), F.lit(1))


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; edit distance is not the same."""
    return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype=float)


# Elements that begin on a line of their own.
_BLOCKS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "section")


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style", "template")
        self.links += [v for k, v in attrs if k in ("href", "src") and v]
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style", "template") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def _parsed(markup: str) -> _Visible:
    p = _Visible()
    p.feed(markup)
    p.close()
    return p


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("links", ArrayType(StringType()))]))
def visible(markup: pd.Series) -> pd.DataFrame:
    """(visible text with blank runs squeezed, link targets) of HTML; malformed markup is read as far as it goes."""
    got = [_parsed(m) if isinstance(m, str) else None for m in markup]
    text = ["\n".join(x for x in (re.sub(r"\s+", " ", y).strip() for y in "".join(p.out).split("\n")) if x) if p else None for p in got]
    return pd.DataFrame({"text": pd.Series(text, dtype=object), "links": pd.Series([p.links if p else None for p in got], dtype=object)})


class _Elements(HTMLParser):
    _EMPTY = ("br", "img", "hr", "input", "meta", "link", "wbr")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[int] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in _BLOCKS:
            self.handle_data(" ")
        self.found.append({"tag": tag, "id": a.get("id"), "classes": (a.get("class") or "").split(), "text": "", "parents": [self.found[i]["tag"] for i in self.open]})
        if tag not in self._EMPTY:
            self.open.append(len(self.found) - 1)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.found[self.open[k]]["tag"] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        for i in self.open:
            self.found[i]["text"] += data


def _elements(markup: str) -> list[dict]:
    p = _Elements()
    p.feed(markup)
    p.close()
    return [e | {"text": re.sub(r"\s+", " ", e["text"]).strip()} for e in p.found]


_ELEMENT = StructType([StructField("tag", StringType()), StructField("id", StringType()), StructField("classes", ArrayType(StringType())), StructField("text", StringType()), StructField("parents", ArrayType(StringType()))])


@F.pandas_udf(ArrayType(_ELEMENT))
def elements(markup: pd.Series) -> pd.Series:
    """The elements of HTML in document order, with what selectors ask for: tag, id, classes, text, and the tags around them."""
    return pd.Series([_elements(m) if isinstance(m, str) else None for m in markup], dtype=object)


def selected(markup: Column, tag: str | None = None, of_class: str | None = None, within: str | None = None) -> Column:
    """Texts of the elements of a tag, of a class, and within another tag, as far as named, in document order."""
    def ok(e: Column) -> Column:
        tests = [F.lit(True)] + ([e["tag"] == tag] if tag else []) + ([F.array_contains(e["classes"], of_class)] if of_class else []) + ([F.array_contains(e["parents"], within)] if within else [])
        return reduce(lambda a, b: a & b, tests)

    return F.transform(F.filter(elements(markup), ok), lambda e: e["text"])


def strip_tags(c: Column) -> Column:
    """Tags removed by pattern, entities kept; see ``unescape``."""
    return F.regexp_replace(c, r"<[^>]*>", "")


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Entities decoded, complete ones only (``&amp`` without its semicolon stays)."""
    return s.map(lambda t: re.sub(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", lambda m: html.unescape(m.group()), t) if isinstance(t, str) else None)


@F.pandas_udf(ArrayType(StringType()))
def split_lossless(s: pd.Series, limit: pd.Series) -> pd.Series:
    """Parts of at most ``limit`` UTF-16 units that join to the text: cut after sentences, else blanks, else characters."""
    return pd.Series([_split(t, int(n)) if isinstance(t, str) else None for t, n in zip(s, limit, strict=True)], dtype=object)


def _units(t: str) -> int:
    return len(t) + sum(c > "￿" for c in t)


def _split(text: str, limit: int) -> list[str]:
    out: list[str] = []
    while _units(text) > limit:
        size, at = 0, 0
        while at < len(text) and size + 1 + (text[at] > "￿") <= limit:
            size += 1 + (text[at] > "￿")
            at += 1
        at = max(1, at)
        head = text[:at]
        ends = [m.end() for m in re.finditer(r"[.!?。！？]\s*|\n", head)] or [m.end() for m in re.finditer(r"\s+", head)]
        cut = ends[-1] if ends else at
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text] if text or not out else out


_PROTECT = re.compile(r"_{2,}|\$[^$]+\$|\{\{[^}]*\}\}|\[\d+\]")


@F.pandas_udf(StructType([StructField("masked", StringType()), StructField("kept", ArrayType(StringType()))]))
def protect(s: pd.Series) -> pd.DataFrame:
    """Blanks, formulas and markers replaced by numbered tokens, with what they held."""
    kept = [_PROTECT.findall(t) if isinstance(t, str) else None for t in s]
    masked = []
    for t in s:
        numbers = iter(range(10**9))
        masked.append(_PROTECT.sub(lambda m, n=numbers: f"⟦{next(n)}⟧", t) if isinstance(t, str) else None)
    return pd.DataFrame({"masked": pd.Series(masked, dtype=object), "kept": pd.Series(kept, dtype=object)})


@F.pandas_udf(StringType())
def restore(masked: pd.Series, kept: pd.Series) -> pd.Series:
    """The protected text back; null unless every token is there once and in order."""
    out = []
    for t, k in zip(masked, kept, strict=True):
        if not isinstance(t, str) or k is None or [int(x) for x in re.findall(r"⟦(\d+)⟧", t)] != list(range(len(k))):
            out.append(None)
        else:
            out.append(re.sub(r"⟦(\d+)⟧", lambda m, k=k: k[int(m.group(1))], t))
    return pd.Series(out, dtype=object)


_OPTION = StructType([StructField("label", StringType()), StructField("text", StringType())])


@F.pandas_udf(ArrayType(_OPTION))
def labelled_options(s: pd.Series) -> pd.Series:
    """The options of "A. ... B. ..." if the labels run A, B, C, ... without a gap, else an empty list.

    Formulas between dollar signs are masked first, so a label inside one is none.
    """
    out = []
    for t in s:
        if not isinstance(t, str):
            out.append(None)
            continue
        bare = re.sub(r"\$[^$]*\$", lambda m: "\x00" * len(m.group()), t)
        found = [(m.start(), m.end(), m.group(1)) for m in re.finditer(r"(?:(?<=\s)|^)[\[(（]?([A-Z])[\])）.．、]\s*", bare)]
        if not found or [x for *_, x in found] != [chr(65 + i) for i in range(len(found))]:
            out.append([])
            continue
        ends = [a for a, *_ in found[1:]] + [len(t)]
        out.append([{"label": x, "text": t[b:e].strip()} for (_, b, x), e in zip(found, ends, strict=True)])
    return pd.Series(out, dtype=object)


@F.pandas_udf(StringType())
def same_origin_link(base: pd.Series, link: pd.Series) -> pd.Series:
    """The link resolved against its base, or null if it leaves the base's origin."""
    out = []
    for b, x in zip(base, link, strict=True):
        if not isinstance(b, str) or not isinstance(x, str):
            out.append(None)
            continue
        full = urljoin(b, x)
        out.append(full if urlparse(full)[:2] == urlparse(b)[:2] else None)
    return pd.Series(out, dtype=object)


def _argument(t: str, i: int) -> tuple[str, int]:
    """The braced or single-character argument at i and the place after it."""
    if t[i : i + 1] != "{":
        return t[i : i + 1], i + 1
    depth = 0
    for j in range(i, len(t)):
        depth += (t[j] == "{") - (t[j] == "}")
        if not depth:
            return t[i + 1 : j], j + 1
    return t[i + 1 :], len(t)


def _fractions(t: str) -> str:
    out, i = "", 0
    while (j := t.find("\\frac", i)) >= 0:
        a, k = _argument(t, j + 5)
        b, k = _argument(t, k)
        wrap = lambda x: x if re.fullmatch(r"\w+", x) else f"({x})"
        out += t[i:j] + f"{wrap(_fractions(a))}/{wrap(_fractions(b))}"
        i = k
    return out + t[i:]


@F.pandas_udf(StringType())
def plain_fractions(s: pd.Series) -> pd.Series:
    """TeX fractions, nested ones too, written as a/b."""
    return s.map(lambda t: _fractions(t) if isinstance(t, str) else None)


@F.pandas_udf(BooleanType())
def exact_round_trip(s: pd.Series, limit: pd.Series) -> pd.Series:
    """Whether the lossless parts of a text join to it again."""
    return pd.Series(["".join(_split(t, int(n))) == t if isinstance(t, str) else None for t, n in zip(s, limit, strict=True)], dtype=object)
