"""Noise of scanned pages: an averaged-perceptron character editor and a line classifier.

Stages, each an averaged perceptron trained here on noise put into the table's own clean texts (a
bounded sample): furniture lines (running headers, page numbers) by features of their position on the
page and of how often the line recurs over papers; line joins (a hyphenated word, a wrapped line, a
line break that stays); and character edits (keep, replace, delete, insert).

A character edit turns what was read into what was printed. Which segments are read for which is a
fixed list of look-alikes plus what the table itself shows: rare words that differ from a far more
frequent one in one segment, the same segment in many words. The forms of a word are all known words
that any number of such edits reaches, found by walking the sorted vocabulary; the perceptron's score
decides between them, keeping the word being score 0.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.glyphs import to_codes
from papyra.session import cut, spread

# Misreadings of Latin print, read -> printed.
MISREAD = (
    ("rn", "m"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("vv", "w"), ("nn", "m"), ("ri", "n"), ("lc", "k"),
    ("1", "l"), ("0", "o"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("2", "z"), ("|", "l"),
    ("c", "e"), ("l", "i"), ("f", "t"), ("h", "b"), ("e", "c"), ("i", "l"), ("t", "f"), ("1", "i"), ("q", "g"), ("y", "v"),
)
# Two printed letters read as one, read -> printed: the inverse of the pairs above that read one letter as two.
MERGED = tuple((printed, read) for read, printed in MISREAD if len(read) > len(printed))
# Ideographs taken for one another, read>printed; a character read may have been printed as one of several.
MISREAD_HAN: dict[str, list[str]] = {}
for _pair in (
    "淮>准 埋>理 仳>化 衣>农 恩>思 枝>技 坏>环 休>体 景>影 巾>市 冶>治 糸>系 厉>历 白>自 自>白 沟>构 士>土 土>士 末>未 未>末 太>大 大>太 津>律 "
    "没>设 设>没 纺>统 己>已 已>己 入>人 人>入 科>料 料>科 间>问 问>间 日>曰 曰>日 千>干 干>千 天>夫 夫>天 王>玉 玉>王 午>牛 牛>午 住>往 往>住 "
    "侯>候 候>侯 待>侍 侍>待 拔>拨 拨>拔 析>折 折>析 辨>辩 辩>辨 崇>祟 祟>崇 戊>戌 戌>戊 刀>力 力>刀 兔>免 免>兔 鸟>乌 乌>鸟 网>冈 元>无 无>元 "
    "本>木 木>本 目>日 甲>申 申>甲 由>田 田>由 北>比 比>北 今>令 令>今 代>伐 伐>代 情>清 清>情 晴>睛 晴>情 渴>喝 喝>渴 栽>裁 裁>栽 贷>货 货>贷 "
    "徽>微 微>徽 崖>涯 杨>扬 扬>杨 提>堤 堤>提 师>帅 帅>师 仑>仓 仓>仑 于>千 千>于 士>上 上>土 主>王 工>土 丁>了 了>丁 几>九 九>几 八>入 "
    "风>凤 凤>风 汁>计 计>汁 训>驯 抗>坑 坑>抗 找>我 我>找 末>木 来>末 束>東 束>来 苦>若 若>苦 茶>荼 幕>墓 墓>幕 慕>幕 暮>幕 密>蜜 蜜>密"
).split():
    MISREAD_HAN.setdefault(_pair[0], []).append(_pair[2])
_DOUBTFUL_HAN = re.compile("[" + "".join(MISREAD_HAN) + "]")
# Characters printed for a hyphen at a line end.
HYPHENS = "-¬‐‑­"
#: Clean texts taken for training, at most.
TRAIN_TEXTS = 1500
#: Header lines taken as patterns of furniture in training, at most.
TRAIN_HEADERS = 400
#: Most frequent words from which further misreadings are learned, at most.
LEARN_WORDS = 60_000
#: Words and ideograph sequences that make up less of all are not known; so at most 1 / share of them are.
WORD_SHARE, HAN_SHARE = 1e-6, 1e-7
DIMS = 1 << 18
#: Shares of papers that tell how much a line recurs; shares, so that they mean the same at every size.
SEEN = (0.002, 0.01, 0.05)
_WORD = re.compile(r"[A-Za-zÀ-ÿ0-9|]+")
_WHOLE_WORD = re.compile(r"(?<![^\W\d_一-鿿])[A-Za-z0-9|]+(?![^\W\d_一-鿿])")  # not part of a word that holds other letters
_HAN = re.compile(r"[一-鿿]")
_NUMBER_LINE = re.compile(
    r"\s*(?:[-—–~·*\[(（【<|]*\s*\d{1,4}\s*[-—–~·*\])）】>|]*|\d{1,4}\s*[/／]\s*\d{1,4}|(?:p|pp|page)\.?\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|"
    r"第?\s*\d{1,4}\s*页\s*[（(,，/]?\s*(?:共\s*\d{1,4}\s*页)?\s*[)）]?)\s*", re.IGNORECASE)  # fmt: skip
_CODE = re.compile(r"[{}]\s*$|^\s*(?:for|while|if|switch)\s*\(.*\)\s*\{?\s*$|;\s*(?:/\*.*\*/)?\s*$|^\s*(?:#include|def |return\b|else\b|//|/\*)|^\s{4}")
_LIST = re.compile(r"\s*(?:[(（]\d{1,2}[)）]|\d{1,2}[.)、．]|[①-⑳]|[A-H][.．、)]|[-•*]\s)")
_SILENT = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_END = re.compile(r"[.。！？!?；;：:][”’\"')）」』]*\s*$")


def _mask(line: str) -> str:
    return re.sub(r"\d+", "0", re.sub(r"\s+", " ", line.strip()))


def _line_key(masked: str) -> int:
    """As Spark's xxhash64 of the line."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(masked.encode("utf-8", "replace"), 42))))


def _han_keys(*columns: np.ndarray) -> np.ndarray:
    """Two or three ideographs as one number, without collisions."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        out = (out << 21) | c.astype(np.int64)
    return out


class Counts:
    """Log-counts of words (lower case) and of ideograph pairs and triples; what is not known counts 0."""

    def __init__(self, words: dict[str, int], keys: np.ndarray, n: np.ndarray):
        self.vocabulary = sorted(words)
        self.of = np.log2(1 + np.array([words[w] for w in self.vocabulary], np.float64)).round().astype(np.int8)
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], np.log2(1 + n[order].astype(np.float64)).round().astype(np.int8)

    def word(self, w: str) -> int:
        w = w.lower()
        i = bisect_left(self.vocabulary, w)
        return int(self.of[i]) if i < len(self.vocabulary) and self.vocabulary[i] == w else 0

    def han(self, *chars: str) -> int:
        key = 0
        for c in chars:
            if not "\u4e00" <= c <= "\u9fff":
                return -1
            key = (key << 21) | ord(c)
        i = int(self.keys.searchsorted(key))
        return int(self.logs[i]) if i < len(self.keys) and self.keys[i] == key else 0


def tally(rows: DataFrame) -> tuple[Counts, dict[str, int]]:
    """Counts over every text of (_text), lines as they stand, and the counts of the vocabulary.

    One pass over the texts, summed exactly by key; only what reaches its share of all comes to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words: Counter[str] = Counter()
            for t in b["_text"]:
                words.update(_WORD.findall(t.lower()))
            codes, _ = to_codes(pa.array(re.sub(r"[^\S\x01]+", "", "\x01".join(b["_text"])).split("\x01"), pa.string()))
            han = (codes >= 0x4E00) & (codes <= 0x9FFF)
            two = han[:-1] & han[1:]
            three = two[:-1] & han[2:]
            both = np.concatenate([_han_keys(codes[:-1][two], codes[1:][two]), _han_keys(codes[:-2][three], codes[1:-1][three], codes[2:][three])])
            keys, n = np.unique(both, return_counts=True)
            yield pd.DataFrame({"word": [*words, *[None] * len(keys)], "key": np.concatenate([np.zeros(len(words), np.int64), keys]), "n": [*words.values(), *n.tolist()]})

    sums = cut(rows.mapInPandas(run, "word string, key long, n long").groupBy("word", "key").agg(F.sum("n").alias("n")))
    size = sums.groupBy(F.col("word").isNull().alias("han")).agg(F.sum("n").alias("n")).collect()
    of = {r["han"]: r["n"] for r in size}
    known = sums.where((F.col("word").isNotNull() & (F.col("n") >= WORD_SHARE * of.get(False, 0))) | (F.col("word").isNull() & (F.col("n") >= HAN_SHARE * of.get(True, 0))))
    got = known.toArrow()
    names, keys, n = got["word"].to_pylist(), got["key"].to_numpy(), got["n"].to_numpy()
    is_han = np.array([w is None for w in names], bool)
    words = {w: int(x) for w, x in zip(names, n, strict=True) if w is not None}
    return Counts(words, keys[is_han], n[is_han]), words


def learned(words: dict[str, int], most: int = LEARN_WORDS, least: int = 5, rarer: int = 16, sure: float = 0.8) -> list[tuple[str, str]]:
    """(read, printed) segments of one or two letters in which rare words differ from a far more frequent one.

    A segment pair counts with at least ``least`` words of which a share of ``sure`` is ``rarer`` times less
    frequent than the word it resembles; endings that words simply take in turn are about as frequent as
    one another and fall out. Words of six letters or more, of which four at least agree.
    """
    top = sorted((w for w in words if len(w) > 5 and not w.isdigit()), key=lambda w: (-words[w], w))[:most]
    groups: dict[int, list[tuple[str, str]]] = defaultdict(list)
    for w in top:
        for size in (1, 2):
            for i in range(len(w) - size + 1):
                if len(w) - size >= 4:
                    groups[hash((w[:i], w[i + size :]))].append((w, w[i : i + size]))
    rare, even = Counter(), Counter()
    for members in groups.values():
        if len(members) > 1:
            best, printed = members[0]  # in order of frequency
            for w, read in members[1:]:
                if read != printed and read[0] != printed[0] and read[-1] != printed[-1]:
                    (rare if words[best] >= rarer * words[w] else even)[read, printed] += 1
    return sorted(r for r, n in rare.items() if n >= least and n >= sure * (n + even[r] + even[r[::-1]]))


def recurring_lines(rows: DataFrame) -> dict[int, float]:
    """In which share of the papers a line (digits masked) stands within a text of several lines, for lines of three papers and the least share that tells anything."""
    lines = rows.where(F.col("_text").contains("\n")).select("_group", F.explode(F.split("_text", r"\r?\n")).alias("_l"))
    masked = F.regexp_replace(F.trim(F.regexp_replace("_l", r"\s+", " ")), r"\d+", "0")
    per = lines.select("_group", F.xxhash64(masked).alias("key")).distinct().groupBy("key").agg(F.count("*").alias("n"))
    papers = max(1, rows.select("_group").distinct().count())
    got = per.where((F.col("n") > 2) & (F.col("n") >= SEEN[0] * papers)).toArrow()  # at most 1 / SEEN[0] times the lines of a paper
    return dict(zip(got["key"].to_pylist(), (got["n"].to_numpy() / papers).tolist(), strict=True))


class Perceptron:
    """Binary averaged perceptron over hashed features."""

    def __init__(self) -> None:
        self.w = np.zeros(DIMS, np.float64)

    @staticmethod
    def ids(features: list[str]) -> list[int]:
        return [zlib.crc32(f.encode()) & (DIMS - 1) for f in features]

    def fit(self, examples: list[tuple[list[str], bool]], epochs: int = 8, seed: int = 1, batch: int = 4, margin: tuple[float, float] = (0.5, 0.5)) -> Perceptron:
        """Train on small batches; examples of either kind (false, true) must clear their margin."""
        if not examples:
            return self
        ids = [self.ids(f) for f, _ in examples]
        width = max(map(len, ids))
        table = np.full((len(ids), width), DIMS, np.int64)  # the last weight belongs to no feature
        for i, x in enumerate(ids):
            table[i, : len(x)] = x
        y = np.array([1.0 if t else -1.0 for _, t in examples])
        need = np.where(y > 0, margin[1], margin[0])
        w, total, t = np.zeros(DIMS + 1), np.zeros(DIMS + 1), 1
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                x = table[at]
                wrong = np.flatnonzero(y[at] * w[x].sum(1) <= need[at])
                if len(wrong):
                    step = np.repeat(y[at][wrong], width)
                    np.add.at(w, x[wrong].ravel(), step)
                    np.add.at(total, x[wrong].ravel(), step * t)
                    w[DIMS] = total[DIMS] = 0.0
                t += 1
        self.w = (w - total / t)[:DIMS]
        return self

    def score(self, features: list[str]) -> float:
        return float(sum(self.w[i] for i in self.ids(features)))


def without_doubtful(sure: list[tuple[list[str], bool]], doubtful: list[list[str]], margin: tuple[float, float]) -> list[tuple[list[str], bool]]:
    """``sure`` and those of the ``doubtful`` false examples that are not taken for true by a perceptron trained without them.

    Words seen once or twice in texts taken for clean may be misread ones; each half of them is judged by what the rest teaches.
    """
    out = list(sure)
    halves = [[f for i, f in enumerate(doubtful) if i % 2 == h] for h in (0, 1)]
    for h in (0, 1):
        judge = Perceptron().fit(sure + [(f, False) for f in halves[1 - h]], margin=margin)
        out += [(f, False) for f in halves[h] if judge.score(f) <= 0]
    return out


# Features of a line: where it stands on the page and what it is like.


def line_features(lines: list[str], i: int, recurs: float) -> list[str]:
    s, n = lines[i].strip(), len(lines)
    others = sorted(len(x.strip()) for j, x in enumerate(lines) if j != i and x.strip()) or [1]
    width = others[len(others) // 2]
    before = next((lines[j].rstrip() for j in range(i - 1, -1, -1) if lines[j].strip()), "")
    after = next((lines[j].strip() for j in range(i + 1, n) if lines[j].strip()), "")
    number, seen = bool(_NUMBER_LINE.fullmatch(s)), sum(recurs >= x for x in SEEN)
    place = "first" if not before else "last" if not after else "inner"
    mid = bool(before) and not _END.search(before)
    letters = [c for c in s if c.isalpha()]
    latin = sum(c.isascii() for c in letters) * 2 > len(letters)
    kind = "code" if _CODE.search(lines[i]) else "list" if _LIST.match(s) else "number" if number else "text"
    stops = any(c in s for c in "，。；,;") or bool(_END.search(s))
    short = min(4, int(4 * len(s) / max(1, width)))
    start = "none" if not letters else "lower" if s[:1].islower() else "upper" if s[:1].isupper() else "other"
    name = sum(w[:1].isupper() for w in re.findall(r"[A-Za-z]+", s)) * 2 > len(re.findall(r"[A-Za-z]+", s))
    cut = bool(before) and before[-1] in HYPHENS
    goes = bool(after) and after[:1].islower()
    f = [f"kind={kind}", f"kind={kind},place={place}", f"seen={seen},kind={kind}", f"seen={seen},stops={stops}", f"seen={seen},start={start},mid={mid}", f"start={start},mid={mid},goes={goes}"]
    f += [f"seen={seen},name={name},latin={latin}", f"short={short},kind={kind},seen={seen}", f"place={place},seen={seen}", f"blank_next={i + 1 < n and not lines[i + 1].strip()},seen={seen}"]
    return [*f, f"cut={cut},start={start}", f"gap={bool(re.search(r'  +', s))},seen={seen}", f"end={bool(_END.search(s))},seen={seen}", "bias"]


# Features of a line break: what stands on either side.


def join_features(left: str, right: str, counts: Counts, lines: list[str]) -> list[str]:
    a, b = left.rstrip(), right.lstrip()
    hyphen = a[-1:] in tuple(HYPHENS) and a[-2:-1].isalpha()
    head = re.search(r"[A-Za-zÀ-ÿ]*\Z", a[:-1] if hyphen else a).group()
    tail = re.match(r"[A-Za-zÀ-ÿ]*", b).group()
    whole = min(6, counts.word(head + tail)) if head and tail else -1
    kind = "code" if _CODE.search(left) or _CODE.search(right) else "list" if _LIST.match(right) and not re.match(r"\s*\d+[.,]\d", right) else "text"
    sides = ("h" if _HAN.match(a[-1:]) else "l" if a[-1:].isalpha() else "p") + ("h" if _HAN.match(b[:1]) else "L" if b[:1].isupper() else "l" if b[:1].isalpha() else "p")
    mark = "plain" if a[-1:] == "-" else "other" if hyphen else "none"
    return [f"hyphen={mark},tail={b[:1].islower()}", f"hyphen={hyphen},whole={whole}", f"hyphen={hyphen},head={min(6, counts.word(head))},tail={min(6, counts.word(tail))}" if hyphen else "unbroken", f"kind={kind}", f"kind={kind},sides={sides}", f"end={bool(_END.search(a))},kind={kind},up={b[:1].isupper()}", f"n={min(3, len(lines))},kind={kind}", "bias"]


# Candidates of the character editor. A decision depends on the word, or for ideographs on two neighbours each side, so it is made once for each.

Edits = tuple[tuple[int, str, str], ...]


class Forms:
    """Known words that edits by the given (read, printed) rules reach, also where a letter of what was read is itself misread."""

    def __init__(self, counts: Counts, rules: list[tuple[str, str]]):
        single = [(r, p) for r, p in rules if len(r) == len(p) == 1]
        twice = [(read[:i] + r + read[i + 1 :], printed) for read, printed in rules if len(read) > 1 for i in range(len(read)) for r, p in single if p == read[i]]
        self.counts, self.rules = counts, sorted({(r, p) for r, p in [*rules, *twice] if r != p})
        self.at: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for read, printed in self.rules:
            self.at[read[0]].append((read, printed))

    def of(self, w: str) -> dict[str, Edits]:
        """form -> its fewest edits (place in ``w``, read, printed), of any number; without ``w`` itself."""
        v = self.counts.vocabulary
        out: dict[str, Edits] = {}
        todo: list[tuple[int, str, Edits, int, int]] = [(0, "", (), 0, len(v))]
        while todo:
            i, done, edits, lo, hi = todo.pop()
            if i == len(w):
                if edits and lo < len(v) and v[lo] == done and (done not in out or len(edits) < len(out[done])):
                    out[done] = edits
                continue
            for read, printed in [(w[i], w[i]), *self.at.get(w[i], ())]:
                if read is not w[i] and not w.startswith(read, i):
                    continue
                now = done + printed
                a = bisect_left(v, now, lo, hi)
                if a < hi and v[a].startswith(now):
                    z = bisect_left(v, now + "\uffff", a, hi)
                    todo.append((i + len(read), now, edits if read == printed else (*edits, (i, read, printed)), a, z))
        out.pop(w, None)
        return out


def operation(read: str, printed: str) -> str:
    return "replace" if len(read) == len(printed) else "delete" if len(read) > len(printed) else "insert"


def edit_features(w: str, form: str, edits: Edits, now: int, then: int) -> list[str]:
    """Features of taking ``form`` for the word ``w``; ``now`` and ``then`` are their log-counts, of which only the difference enters."""
    gain = max(-3, min(9, then - now))
    letters, digit = sum(c.isalpha() for c in w), any(c.isdigit() for c in w)
    size = letters if letters < 5 else 5 if letters < 7 else 7
    n = min(4, len(edits))
    f = [f"gain={gain}", f"gain={gain},n={n}", f"size={size},digit={digit},gain={gain}", f"size={size},n={n}", "bias"]
    for at, read, printed in edits:
        rule, z = f"{read}>{printed}", at + len(read)
        f += [f"op={operation(read, printed)},gain={gain}", f"r={rule}", f"r={rule},gain={gain}", f"r={rule},l={w[max(0, at - 2) : at]}", f"r={rule},x={w[z : z + 2]}"]
    return f


def han_features(window: str, printed: str, counts: Counts) -> list[str]:
    """``window`` holds two characters before, the character read, and two after (blanks outside the text)."""
    p2, p, c, n, n2 = window
    rule = f"{c}>{printed}"
    now = (counts.han(p, c), counts.han(c, n), counts.han(p, c, n))
    then = (counts.han(p, printed), counts.han(printed, n), counts.han(p, printed, n))
    wide = (counts.han(p2, p, c), counts.han(c, n, n2)), (counts.han(p2, p, printed), counts.han(printed, n, n2))
    gain = [max(-4, min(4, y - x)) for x, y in zip(now, then, strict=True)]
    best = max(gain[0], gain[1])
    all_ = max(-6, min(6, sum(y - x for x, y in zip((*now, *wide[0]), (*then, *wide[1]), strict=True)) // 2))
    low = min(5, max(now[0], now[1]))
    least = max(-4, min(gain[0], gain[1]))
    return [f"best={best},least={least}", f"least={least},all={all_}", f"r={rule}", f"g={gain[0]},{gain[1]}", f"best={best},low={low}", f"tri={gain[2]},low={low}", f"all={all_},low={low}", f"all={all_}", f"r={rule},all={all_}", f"r={rule},p={p}", f"r={rule},n={n}", "bias"]


def _known(window: str, middle: str, counts: Counts) -> int:
    """How well the neighbours know ``middle``."""
    p2, p, _, n, n2 = window
    return sum(counts.han(*x) for x in ((p, middle), (middle, n), (p2, p, middle), (p, middle, n), (middle, n, n2)))


class Editor:
    """The trained stages; ``read`` gives the repaired text and what was found."""

    def __init__(self, counts: Counts, recurs: dict[int, float], rules: list[tuple[str, str]]):
        self.counts, self.recurs, self.forms = counts, recurs, Forms(counts, rules)
        self.line, self.join, self.edit, self.han = Perceptron(), Perceptron(), Perceptron(), Perceptron()
        self._words: dict[str, str] = {}
        self._windows: dict[str, str] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_words": {}, "_windows": {}}

    def seen(self, line: str) -> float:
        return self.recurs.get(_line_key(_mask(line)), 0.0)

    def _word(self, w: str) -> str:
        """The word as printed: the form with the highest score above that of keeping it, 0."""
        if w in self._words:
            return self._words[w]
        out, low = w, w.lower()
        if not w.isdigit() and sum(c.isalpha() for c in w) > 1:
            now, best = self.counts.word(low), 0.0
            for form, edits in sorted(self.forms.of(low).items()):
                score = self.edit.score(edit_features(low, form, edits, now, self.counts.word(form)))
                if score > best:
                    best, out = score, _with_case(w, edits)
            if out != w and self.counts.word(out) > now:  # the form may itself be a common misreading
                out = self._word(out)
        if len(self._words) > 200_000:
            self._words.clear()
        self._words[w] = out
        return out

    def _ideograph(self, window: str) -> str:
        """The middle ideograph as printed: of the readings that score above keeping it, 0, the one its neighbours know best."""
        if window not in self._windows:
            if len(self._windows) > 200_000:
                self._windows.clear()
            c, taken = window[2], []
            for printed in MISREAD_HAN[c]:
                if (score := self.han.score(han_features(window, printed, self.counts))) > 0:
                    taken.append((_known(window, printed, self.counts), score, printed))
            self._windows[window] = max(taken)[2] if taken else c
        return self._windows[window]

    def read(self, text: str, scanned: bool | None = None) -> tuple[str, bool, bool, bool]:
        """(repaired text, furniture found, split word found, misreading found).

        Characters are edited in every text, also where no line joins another.
        """
        lines = re.split(r"\r?\n|\r", text)
        keep, furniture = lines, False
        if len(lines) > 1 and not all(_CODE.search(x) or _LIST.match(x) for x in lines[1:] if x.strip()):
            marks = []
            for i, x in enumerate(lines):
                if not x.strip():
                    marks.append(None)
                    continue
                if i and x.strip()[0].islower() and x.strip()[0].isascii() and not _NUMBER_LINE.fullmatch(x.strip()):
                    marks.append(False)  # running on from the line before
                    continue
                marks.append(self.line.score(line_features(lines, i, self.seen(x))) > 0)
            furniture = any(marks) and not all(m for m in marks if m is not None)
            if furniture:  # a blank line beside furniture belongs to it
                keep = [x for i, x in enumerate(lines) if not marks[i] and not (marks[i] is None and (i and marks[i - 1] or i + 1 < len(lines) and marks[i + 1]))]
        out, split = keep[0].rstrip() if len(keep) > 1 else keep[0], False
        wrapped = False
        for i in range(1, len(keep)):
            right = keep[i].strip() if i + 1 < len(keep) else keep[i].lstrip()
            tail = out[-80:]
            if not right or not tail or self.join.score(join_features(keep[i - 1], keep[i], self.counts, keep)) <= 0:
                out += "\n" + keep[i].rstrip()
                continue
            wrapped = True
            if tail[-1] in HYPHENS and tail[-2:-1].isalpha() and right[:1].isalpha():
                head, rest = re.search(r"[A-Za-zÀ-ÿ]*\Z", tail[:-1]).group(), re.match(r"[A-Za-zÀ-ÿ]*", right).group()
                apart = tail[-1] == "-" and min(self.counts.word(head), self.counts.word(rest)) > self.counts.word(self._word(head + rest)) + 1
                out = out + right if apart else out[:-1] + right
                split = split or not apart
            else:
                glue = "" if out.count("$") % 2 or _HAN.match(tail[-1]) or _HAN.match(right[0]) or tail[-1] in "，。；：、！？（“‘$" or right[0] in "，。；：、！？）”’$" else " "
                out += glue + right
        if not wrapped and not furniture:
            out = text
        out = _SILENT.sub("", out)  # zero-width characters would hide a word's neighbours
        fixed, misread = out, False
        words = self._outside(out)
        if any(self._word(w) != w for w in set(_WHOLE_WORD.findall(words))):
            misread, fixed = True, self._inside(out, _WHOLE_WORD.sub(lambda m: self._word(m.group()), words))
        padded = "  " + fixed + "  "
        edits = [(m.start(), c) for m in _DOUBTFUL_HAN.finditer(fixed) if (c := self._ideograph(padded[m.start() : m.start() + 5])) != m.group()]
        if edits:
            chars = list(fixed)
            for i, c in edits:
                chars[i] = c
            misread, fixed = True, "".join(chars)
        return fixed, furniture, split, misread

    # Formulas between dollar signs are not words.
    @staticmethod
    def _outside(text: str) -> str:
        return re.sub(r"\$[^$]*\$", lambda m: "\x02" * len(m.group()), text) if "$" in text else text

    @staticmethod
    def _inside(text: str, fixed: str) -> str:
        if "$" not in text:
            return fixed
        formulas = iter(re.findall(r"\$[^$]*\$", text))
        return re.sub("\x02+", lambda m: _take(formulas, len(m.group())), fixed)


def _take(formulas: Iterator[str], size: int) -> str:
    out = ""
    while len(out) < size:
        out += next(formulas)
    return out


def noised(text: str, rng: random.Random, headers: list[str]) -> tuple[list[tuple[str, str]], list[tuple[str, int]]]:
    """A clean text as if scanned: lines with what each is, and for each break what it was.

    Lines are (line, "text" or "furniture"); breaks are (kind, index of the line before) with kind
    ``hyphen``, ``blank`` or ``none``.
    """
    width = rng.randint(18, 76)
    if _HAN.search(text):
        width = max(10, width // 2)
    hyphens = rng.random() < 0.6
    lines, kinds = [], []
    rest = text
    while len(rest) > width:
        at = min(width + rng.randint(-2, 2), len(rest) - 1)
        if _HAN.match(rest[at]) or _HAN.match(rest[at - 1]):
            lines.append(rest[:at])
            kinds.append("none")
            rest = rest[at:]
            continue
        word = re.search(r"[A-Za-z]+\Z", rest[:at])
        if hyphens and word and len(word.group()) > 1 and re.match(r"[a-z]{2,}", rest[at:]):
            lines.append(rest[:at] + rng.choice(HYPHENS))
            kinds.append("hyphen")
            rest = rest[at:]
            continue
        space = rest.rfind(" ", 0, at)
        if space < 3:
            break
        lines.append(rest[:space])
        kinds.append("blank")
        rest = rest[space + 1 :]
    lines.append(rest)
    trail = " " if rng.random() < 0.3 else ""
    marked = [(x + trail, "text") for x in lines]
    breaks = [(k, i) for i, k in enumerate(kinds)]
    if len(marked) > 1 and headers and rng.random() < 0.8:
        at = rng.randint(1, len(marked) - 1)
        page = rng.randint(1, 60)
        numbers = [f"— {page} —", f"- {page} -", f"·{page}·", f"~ {page} ~", f"[{page}]", f"{page} / {page + 9}", f"p. {page}", f"Page {page} of {page + 20}", f"第{page}页", f"第 {page} 页  共 {page + 30} 页", str(page)]
        block = []
        if rng.random() < 0.6:
            block.append((rng.choice(numbers) + trail, "furniture"))
        if rng.random() < 0.6 or not block:
            head = rng.choice(headers)
            block.append(((head + (f"  {page}" if rng.random() < 0.4 else "")) + trail, "furniture"))
        if rng.random() < 0.4:
            block.insert(rng.randint(0, len(block)), (trail, "text"))
        marked[at:at] = block
    return marked, breaks


def _with_case(w: str, edits: Edits) -> str:
    """``w`` with the edits made, printed letters in capitals where the word is."""
    capitals = w.isupper() and sum(c.isalpha() for c in w) > 1
    for at, read, printed in reversed(edits):
        w = w[:at] + (printed.upper() if capitals else printed) + w[at + len(read) :]
    return w


def misread(word: str, rng: random.Random, rules: list[tuple[str, str]], most: int = 3) -> str:
    """The word with one to ``most`` places misread; as it is where no rule applies."""
    for _ in range(rng.choice([1, 1, 1, 2, 2, 3][: most * 2])):
        options = [(m.start(), read, printed) for read, printed in rules for m in re.finditer(re.escape(printed), word)]
        if options:
            at, read, printed = rng.choice(options)
            word = word[:at] + read + word[at + len(printed) :]
    return word


def fit(texts: list[str], headers: list[str], counts: Counts, recurs: dict[int, float], rules: list[tuple[str, str]], seed: int = 5) -> Editor:
    """Train the stages on noise put into clean texts; ``rules`` are the (read, printed) segments of misread words."""
    rng = random.Random(seed)
    out = Editor(counts, recurs, rules)
    line, join, edit, han = [], [], [], []
    common = [h for h in headers if h.strip()] or ["Mock Paper", "SAMPLE", "模拟试题"]
    shapes = [*common, *(h.upper() for h in common if h.isascii()), *(re.sub(r"\s*\d+\s*$", "", h) for h in common)]
    more = random.Random(seed + 1)  # further readings draw apart, so the noise of lines and breaks does not change with their number
    inverse: dict[str, list[tuple[str, random.Random]]] = {}
    for read, several in MISREAD_HAN.items():
        for printed in several:
            inverse.setdefault(printed, []).append((read, rng if printed == several[-1] else more))
    for t in texts:
        marked, breaks = noised(t, rng, shapes)
        lines = [x for x, _ in marked]
        if len(lines) > 1:
            for i, (x, kind) in enumerate(marked):
                if x.strip():
                    line.append((line_features(lines, i, rng.choice([0.004, 0.02, 0.1]) if kind == "furniture" else out.seen(x)), kind == "furniture"))
        kept = [x for x, kind in marked if kind == "text" and x.strip()]
        for _, i in breaks:
            if i + 1 < len(kept):
                join.append((join_features(kept[i], kept[i + 1], counts, kept), True))
        padded = "  " + t + "  "
        for i, c in enumerate(t):
            for printed in MISREAD_HAN.get(c, ()):
                han.append((han_features(padded[i : i + 5], printed, counts), False))
            for read, draws in inverse.get(c, ()):
                window = padded[i : i + 2] + read + padded[i + 3 : i + 5]
                if draws.random() < 0.6 and _known(window, c, counts) > _known(window, read, counts):  # what is no worse known is no misreading
                    han.append((han_features(window, c, counts), True))
    doubtful: list[list[str]] = []
    tokens = Counter(w for t in texts for w in _WHOLE_WORD.findall(Editor._outside(t).lower()) if not w.isdigit())
    for w in sorted(tokens):
        now, weight = counts.word(w), math.ceil(math.sqrt(tokens[w]))  # a misread word among the clean ones weighs less than its printed form
        stay = [edit_features(w, form, edits, now, counts.word(form)) for form, edits in out.forms.of(w).items()]
        if tokens[w] > 2:
            edit += [(f, False) for f in stay] * weight
        else:
            doubtful += stay
        for _ in range(6 * weight if len(w) != 3 and now > 1 else 0):  # words of one or two letters lie too close to tell
            if (bad := misread(w, more, out.forms.rules)) != w:
                # As rare among its kind as misreadings are, at any size of the table.
                seen = max(counts.word(bad), round(math.log2(1 + max(1.0, 2.0 ** (now - more.uniform(3, 10))))))
                if seen < now:  # else another word
                    edit += [(edit_features(bad, form, edits, seen, counts.word(form)), form == w and len(w) > 3) for form, edits in out.forms.of(bad).items()]
    # Line breaks that stay: lists, code and separate paragraphs built from the same texts.
    for i in range(0, len(texts) - 2, 2):
        a, b = texts[i][:120], texts[i + 1][:120]
        items = (a, b) if i % 8 < 4 else [re.split(r"(?<=[。.])", x)[0] for x in (a, b)]  # cut short, and whole sentences
        listed = [f"({k + 1}) {x}" for k, x in enumerate(items)] if i % 4 else [f"{'ABCD'[k]}. {x[:20]}" for k, x in enumerate(items)]
        code = ["for (i = 0; i < n; i++)", "    s += a[i] * 3;", "return s;", "while (p != NULL) {", "    q = p->next;", "}", "count = count + 1;"]
        for block in (listed, [b, *listed], [a, *rng.sample(code, 3)]):
            for j in range(1, len(block)):
                join.append((join_features(block[j - 1], block[j], counts, block), False))
            for j in range(len(block)):
                line.append((line_features(block, j, rng.choice([0.0, 0.004, 0.1])), False))
    out.line.fit(line)
    out.join.fit(join)
    out.edit.fit(without_doubtful(edit, doubtful, (2.0, 0.5)), margin=(2.0, 0.5))
    out.han.fit(han, margin=(2.0, 0.5))
    return out


FOUND = "repaired string, furniture boolean, split_word boolean, misread boolean"


def _rows(df: DataFrame, keys: list[str], text: str, group: str) -> DataFrame:
    return spread(df.select(*keys, F.coalesce(F.col(group), F.lit("")).alias("_group"), F.col(text).alias("_text")).where(F.col("_text").rlike(r"\S")))


def trained(rows: DataFrame, headers: DataFrame | None = None) -> Editor:
    """The editor for (_group, _text): counts over all rows, stages trained on a bounded sample of clean ones."""
    (counts, words), recurs = tally(rows.select("_text")), recurring_lines(rows)
    clean = rows.where((~F.col("_text").contains("\n")) & F.length("_text").between(40, 600) & ~F.col("_text").rlike("[\x80-\x9f\u00ad\u200b-\u200f\ufeff\ufffd]"))
    n = clean.count()
    rate = min(1.0, TRAIN_TEXTS / max(1, n))
    sample = clean.where(F.pmod(F.xxhash64("_text"), F.lit(1 << 20)) < rate * float(1 << 20)).select("_text").limit(2 * TRAIN_TEXTS).collect()
    known = []
    if headers is not None:
        first = headers.columns[0]
        lines = headers.select(F.trim(F.regexp_replace(F.col(first), r"\s*\d+\s*$", "")).alias("_l")).where("_l is not null and _l <> ''")
        known = [r["_l"] for r in lines.distinct().orderBy(F.xxhash64("_l")).limit(TRAIN_HEADERS).collect()]
    return fit(sorted({r["_text"] for r in sample}), sorted(known), counts, recurs, [*MISREAD, *MERGED, *learned(words)])


def read_scans(df: DataFrame, keys: list[str], text: str, group: str, headers: DataFrame | None = None) -> DataFrame:
    """Every non-empty text repaired, with what was found in it.

    ``group`` names the paper a text belongs to (lines that recur over papers are running headers);
    ``headers`` holds known header lines in its first column, used for training only. Null and blank
    texts give no rows; repeated rows give repeated rows; texts without noise come back unchanged.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = _rows(df, keys, text, group)
    held = df.sparkSession.sparkContext.broadcast(trained(rows, headers))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [held.value.read(t) for t in b["_text"]]
            out = pd.DataFrame({k: pd.Series(b[k].tolist(), dtype=object) for k in keys})
            for j, c in enumerate(("repaired", "furniture", "split_word", "misread")):
                out[c] = [g[j] for g in got]
            yield out

    return rows.select(*keys, "_text").mapInPandas(run, f"{kinds}, {FOUND}")
