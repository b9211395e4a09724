"""Language of texts and of their segments: family first, then one-versus-one linear SVMs.

The family (writing system: Latin, Cyrillic, East Asian) is told by counting words of each script.
Within a family that holds several languages, one linear support vector machine for each pair
votes on hashed character n-grams; the machines are trained here, on a bounded sample of the
table's own labelled segments with label noise removed, plus the function words below.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.glyphs import to_codes
from papyra.session import spread

FAMILIES = {"latin": ("en", "fr", "de", "es"), "cyrillic": ("ru",), "east": ("zh", "ja")}
LANGUAGES = tuple(x for f in FAMILIES.values() for x in f)
# Ways a language is named; a tag counts by its part before "-" or "_".
NAMES = {
    "zh": "zh zho chi cmn cn chinese mandarin 中文 汉语 漢語 中国语 中國語 简体中文 繁体中文 简体 繁體 华语 国语 普通话 zh中文",
    "en": "en eng english 英语 英文 英語",
    "fr": "fr fra fre french français francais 法语 法文 法語",
    "de": "de deu ger german deutsch 德语 德文 德語",
    "es": "es spa esp spanish español espanol castellano 西班牙语 西班牙文 西语",
    "ja": "ja jpn jp japanese 日本語 日语 日文 日語",
    "ru": "ru rus russian русский 俄语 俄文 俄語",
}
# Frequent function words, the labelled text that is always at hand.
FUNCTION_WORDS = {
    "en": "the of and to a in is was he for it with as his on be at by this had not but from or have an they which you were her all she there would their we him been has when who will more no if out so what up about into than them can only other could these may then do any my such our over most also many before must through where should because each how",
    "fr": "le la les un une des du de au aux ce cet cette ces mon ma mes ton son sa ses notre nos votre leur leurs je tu il elle nous vous ils elles on qui que quoi dont où et ou mais donc car ne pas plus moins très bien avec sans pour par dans sur sous entre vers chez est sont était être avoir ont avait comme si quand alors aussi tout tous toute même",
    "de": "der die das den dem des ein eine einen einem einer und oder aber denn weil dass wenn als wie wo was wer ich du er sie es wir ihr mich sich uns mein sein unser nicht kein keine noch schon auch nur sehr mehr in im an am auf aus bei mit nach von vom zu zum zur über unter vor durch für gegen ohne um ist sind war waren wird werden hat haben kann muss",
    "es": "el la los las un una unos unas de del al y o pero sino que quien cual cuando donde como porque si no ni ya muy más menos también tan todo toda todos yo él ella nosotros ellos me te se nos lo le les mi tu su sus nuestro este esta estos ese esa aquel en con sin por para sobre entre hasta es son era fue ser estar está están ha han hay tiene puede",
    "zh": "的 一 是 不 了 在 人 有 我 他 这 个 们 中 来 上 大 为 和 国 地 到 以 说 时 要 就 出 会 可 也 你 对 生 能 而 子 那 得 于 着 下 自 之 年 过 发 后 作 里 因为 所以 如果 虽然 但是 我们 他们 没有 可以 这些",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として や れる など なっ ない この ため その よう また もの という あり まで られ なる へ か だ これ によって により おり による です ます ました ません でした している",
}
#: Labelled segments taken for training, at most this many of each declared language.
TRAIN_SEGMENTS = 1000
#: A labelled row stays in training if the machines of the round before agree with at least this confidence.
SURE = 0.8
#: Hash space of the features.
DIMS = 1 << 15
#: Words that neighbouring segments of one language need to count as a full sentence of it (characters / 1.5 in East Asian scripts), and a single one that ends as a sentence does.
SENTENCE_WORDS, CLOSED_WORDS = 5, 4
_CONFIDENT, _CERTAIN = 0.5, 0.8
_CLOSED = re.compile(r"[.。！？!?][”’」』\"')）]*\s*$")

_SEGMENT = re.compile(r"(?<=[。！？!?])[”’」』\"')）]*|(?<=[.])[”’\"')]*(?=[\s（(])|\n+|(?=（)|(?<=）)|(?=\s\()|(?<=\))(?=\s)|(?<=[.。])(?=[^\s\d.。”’」』\"')）])")


def declared(lang: Column) -> Column:
    """The language a label names, or null if it names none of LANGUAGES."""
    base = F.lower(F.trim(F.regexp_extract(F.coalesce(lang, F.lit("")), r"\A\s*([^-_;,/ ]*)", 1)))
    out = F.lit(None).cast("string")
    for k, names in NAMES.items():
        out = F.when(base.isin(names.split()), k).otherwise(out)
    return out


def segments(text: str) -> list[str]:
    """The text cut after sentence ends, at line breaks and at brackets; blank parts dropped."""
    return [s for s in _SEGMENT.split(text) if s and not s.isspace()]


_SCRIPTS = np.zeros(0x110000, np.uint8)  # 1 Latin, 2 Cyrillic, 3 Han, 4 kana
for _a, _b, _k in ((0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC0, 0xD6, 1), (0xD8, 0xF6, 1), (0xF8, 0x24F, 1), (0x1E00, 0x1EFF, 1), (0xFF21, 0xFF3A, 1), (0xFF41, 0xFF5A, 1), (0x300, 0x36F, 0), (0x400, 0x52F, 2), (0x3400, 0x9FFF, 3), (0xF900, 0xFAFF, 3), (0x20000, 0x2FFFF, 3), (0x3041, 0x30FF, 4), (0xFF66, 0xFF9D, 4)):
    _SCRIPTS[_a : _b + 1] = _k


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words by family for each text [n, 3], feature hashes, feature offsets).

    Features are the hashed 1- to 4-grams of lower-case letters, blanks standing for word ends, and the
    script of each East Asian letter.
    """
    codes, off = to_codes(pa.array([f" {t.lower()} " for t in texts], pa.string()))
    script = _SCRIPTS[codes]
    head = script.copy()
    head[1:][script[1:] == script[:-1]] = 0
    row = np.repeat(np.arange(len(texts)), np.diff(off))
    words = np.zeros((len(texts), 3))
    words[:, 0] = np.bincount(row[head == 1], minlength=len(texts))
    words[:, 1] = np.bincount(row[head == 2], minlength=len(texts))
    words[:, 2] = np.bincount(row[script >= 3], minlength=len(texts)) / 1.5
    letters = np.where(script > 0, codes, 32).astype(np.uint64)
    h = np.zeros((5, len(codes)), np.uint64)
    h[4] = np.where(script >= 3, np.uint64(DIMS) + script, 0)
    same = np.ones(len(codes), bool)
    value = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(4):
            if n:
                same = same[:-1] & (row[n:] == row[:-n])
            size = len(codes) - n
            value = (value[:size] ^ letters[n:]) * np.uint64(0x9E3779B97F4A7C15)
            value = value ^ (value >> np.uint64(29))
            h[n, :size] = np.where(same, value % np.uint64(DIMS - 1) + np.uint64(1), 0)
    return words, h.T.astype(np.int64), off


class Separator:
    """The one-versus-one machines of all families."""

    def __init__(self) -> None:
        self.pairs = [(a, b) for f in FAMILIES.values() for a, b in itertools.combinations(f, 2)]
        self.weights = np.zeros((DIMS + 8, max(1, len(self.pairs))), np.float32)

    def _sets(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(features, counts scaled to the text's length) of each text."""
        _, h, off = measure(texts)
        out = []
        for a, b in zip(off[:-1], off[1:], strict=True):
            x, n = np.unique(h[a:b][h[a:b] > 0], return_counts=True)
            out.append((x, (n / np.sqrt(max(1, b - a) * h.shape[1])).astype(np.float32)))
        return out

    def fit(self, labelled: list[tuple[str, str]], rounds: int = 4, updates: int = 6000, rate: float = 0.5) -> Separator:
        """Train on (text, language): first on the function words alone, then with the rows that the
        machines of the round before agree with, so wrong labels drop out.

        Averaged stochastic subgradient descent on the hinge loss, in a fixed order.
        """
        seeds = [(" ".join(w[i : i + 8]), k) for k, text in FUNCTION_WORDS.items() for w in [text.split()] for i in range(0, len(w), 4)]
        lines = seeds + [(t, k) for t, k in labelled if t and k in LANGUAGES]
        family = {x: f for f, xs in FAMILIES.items() for x in xs}
        words, _, _ = measure([t for t, _ in lines])
        fits = [family[k] == list(FAMILIES)[f] for (_, k), f in zip(lines, words.argmax(1), strict=True)]
        sets = self._sets([t for t, _ in lines])
        label = np.array([k for _, k in lines])
        seed = np.arange(len(lines)) < len(seeds)
        keep = seed.copy()
        for r in range(rounds):
            for p, (a, b) in enumerate(self.pairs):
                sides = [np.flatnonzero(keep & (label == k)) for k in (a, b)]
                w, total = np.zeros(len(self.weights), np.float32), np.zeros(len(self.weights), np.float32)
                rng = np.random.default_rng(7 + r)
                n = max(map(len, sides))
                left, step, snapshots = updates, rate, 0
                while left > 0:
                    for i in np.column_stack([np.resize(rng.permutation(s), n) for s in sides]).ravel():  # both sides weigh the same
                        x, c = sets[i]
                        y = 1.0 if label[i] == a else -1.0
                        if y * float(w[x] @ c) < 1:
                            w[x] += np.float32(y * step) * c
                        left -= 1
                        if left % 40 == 0 and left < updates * 3 // 4:
                            total += w
                            snapshots += 1
                        if left == 0:
                            break
                    step = rate * max(0.05, left / updates)
                self.weights[:, p] = total / max(1, snapshots)
            if r + 1 < rounds:
                told = self.tell([t for t, _ in lines])
                keep = seed | np.array([ok and k == g and sure >= SURE for ok, (g, sure, _), k in zip(fits, told, label, strict=True)])
        return self

    def tell(self, texts: list[str]) -> list[tuple[str | None, float, float]]:
        """(language or None without words, confidence 0 to 1, words) of each text."""
        if not texts:
            return []
        words, h, off = measure(texts)
        table = self.weights
        score = np.zeros((len(h), table.shape[1]), np.float32)
        for n in range(h.shape[1]):
            score += table[h[:, n]]  # row 0 is never trained: no feature
        total = np.add.reduceat(score, off[:-1], axis=0)
        margin = total / np.sqrt(np.maximum(np.diff(off), 1) * h.shape[1])[:, None]
        vote = 1 / (1 + np.exp(-2 * np.clip(margin, -20, 20)))
        out = []
        order = list(FAMILIES)
        for i in range(len(texts)):
            n = words[i].sum()
            if not n:
                out.append((None, 0.0, 0.0))
                continue
            f = int(words[i].argmax())
            share = words[i, f] / n
            best = (None, -1.0, -1.0)
            members = FAMILIES[order[f]]
            for k in members:
                ps = [vote[i, p] if a == k else 1 - vote[i, p] for p, (a, b) in enumerate(self.pairs) if k in (a, b)]
                wins, least = sum(x > 0.5 for x in ps), min(ps, default=1.0)
                if (wins, least) > best[1:]:
                    best = (k, wins, least)
            out.append((best[0], float(share * best[2]), float(words[i, f])))
        return out


def train(df: DataFrame, text: str, lang: str, most: int = TRAIN_SEGMENTS) -> Separator:
    """Machines fitted on at most ``most`` segments of each declared language.

    The sample is by hash, so it is the same on every run and spread over all rows; a count per
    language sets its rate, and no row outside the sample leaves the executors.
    """
    rows = df.select(F.col(text).alias("_t"), declared(F.col(lang)).alias("_l")).where("_l is not null and _t rlike '\\\\S'")
    sizes = {r["_l"]: r["n"] for r in rows.groupBy("_l").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for k, n in sizes.items():
        rate = F.when(F.col("_l") == k, min(1.0, most / n)).otherwise(rate)
    chosen = rows.where(F.pmod(F.xxhash64("_t"), F.lit(1 << 20)) < rate * float(1 << 20)).limit(2 * most * len(LANGUAGES)).collect()
    labelled: list[tuple[str, str]] = []
    left = dict.fromkeys(LANGUAGES, most)
    for r in sorted(chosen, key=lambda r: (r["_l"], r["_t"])):
        for s in segments(r["_t"]):
            if left[r["_l"]] > 0:
                left[r["_l"]] -= 1
                labelled.append((s, r["_l"]))
    return Separator().fit(labelled)


SEGMENTS = "segment int, segment_text string, lang string, confidence double, words double"


def label_segments(df: DataFrame, keys: list[str], text: str, machines: Separator) -> DataFrame:
    """One row for each segment of every text with its language and confidence.

    Null and blank texts give no rows; a segment without words has a null language and confidence 0.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    held = df.sparkSession.sparkContext.broadcast(machines)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [segments(t) for t in b["_text"]]
            told = held.value.tell([s for c in cut for s in c])
            at = np.repeat(np.arange(len(b)), [len(c) for c in cut])
            out = b[keys].iloc[at].reset_index(drop=True)
            out["segment"] = [i for c in cut for i in range(len(c))]
            out["segment_text"] = [s for c in cut for s in c]
            for j, name in enumerate(("lang", "confidence", "words")):
                out[name] = [t[j] for t in told]
            yield out

    rows = df.select(*keys, F.col(text).alias("_text")).where(F.col("_text").rlike(r"\S"))
    return spread(rows).mapInPandas(run, f"{kinds}, {SEGMENTS}")


TEXTS = "main_lang string, langs array<string>, confidence double, mixed boolean"


def label_texts(df: DataFrame, keys: list[str], text: str, machines: Separator) -> DataFrame:
    """One row for each text: main language, all languages with a full sentence, confidence, mixed.

    The words of neighbouring segments of one language are counted together, so a text of several short
    sentences is not lost; a language other than the main one counts only with SENTENCE_WORDS such
    words, or with CLOSED_WORDS in a segment that ends as a sentence, so single foreign words and
    titles do not make a text mixed. Null texts, blank ones and those without words have null
    languages, an empty list and confidence 0. Repeated rows give repeated rows.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    held = df.sparkSession.sparkContext.broadcast(machines)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["_text"]]
            cut = [segments(t) for t in texts]
            told = held.value.tell([s for c in cut for s in c])
            whole = held.value.tell([t or " " for t in texts])
            rows, at = [], 0
            for i, c in enumerate(cut):
                mine, at = told[at : at + len(c)], at + len(c)
                weight: dict[str, float] = {}
                sure: dict[str, float] = {}
                full: set[str] = set()
                run: tuple[str | None, float] = (None, 0.0)
                for (k, p, n), s in zip(mine, c, strict=True):
                    if k is None:
                        continue
                    weight[k] = weight.get(k, 0.0) + n
                    sure[k] = sure.get(k, 0.0) + n * p
                    if p >= _CONFIDENT:
                        run = (k, n + run[1] * (run[0] == k))
                        if run[1] >= SENTENCE_WORDS or n >= CLOSED_WORDS and p >= _CERTAIN and _CLOSED.search(s):
                            full.add(k)
                if not weight:
                    rows.append((None, [], 0.0, False))
                    continue
                main = max(sorted(weight), key=lambda k: sure[k])
                if len(full) < 2 and whole[i][0] is not None and main not in full:
                    main = whole[i][0]
                langs = sorted(full | {main})
                rows.append((main, langs, (sure[main] / weight[main]) if main in weight else whole[i][1], len(langs) > 1))
            out = b[keys].reset_index(drop=True)
            out[["main_lang", "langs", "confidence", "mixed"]] = pd.DataFrame(rows, columns=["main_lang", "langs", "confidence", "mixed"], index=out.index)
            yield out

    rows = df.select(*keys, F.col(text).alias("_text"))
    return spread(rows).mapInPandas(run, f"{kinds}, {TEXTS}")
