"""Text decoded with the wrong character encoding: latent encoding chains found by expectation-maximization.

A chain says which encoding a text was in and which it was read with (perhaps twice). Each chain
proposes what a record would have been; the evidence for it is the log-likelihood ratio between the
proposal and the text as it stands, under a model of clean text estimated from all records that no
chain can explain. One record's evidence can be weak or fit several chains, so the chains' shares
are latent parameters of each source and field, estimated by EM with the whole table's shares as
their prior; every record is then judged and repaired by its posterior.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from papyra.session import cut, spread

#: (name, encoding of the text, encoding it was read with, times). ``lost`` holds what cannot be undone.
CHAINS = (
    ("utf8_cp1252", "utf-8", "cp1252", 1), ("utf8_latin1", "utf-8", "latin-1", 1), ("utf8_mac", "utf-8", "mac_roman", 1),
    ("utf8_cp1251", "utf-8", "cp1251", 1), ("utf8_cp1250", "utf-8", "cp1250", 1), ("utf8_cp437", "utf-8", "cp437", 1), ("utf8_cp850", "utf-8", "cp850", 1),
    ("utf8_koi8", "utf-8", "koi8-r", 1), ("utf8_cp1252_twice", "utf-8", "cp1252", 2), ("utf8_latin1_twice", "utf-8", "latin-1", 2), ("utf8_mac_twice", "utf-8", "mac_roman", 2),
    ("utf8_gbk", "utf-8", "gb18030", 1), ("gbk_cp1252", "gb18030", "cp1252", 1), ("gbk_mac", "gb18030", "mac_roman", 1), ("cp1252_gbk", "cp1252", "gb18030", 1),
    ("lost", "", "", 1),
)
NAMES = [c[0] for c in CHAINS]
#: Log-likelihood a repaired stretch must gain to pay for being one.
STRETCH_COST = 6.0
FLOOR = -18.0
#: Log-probability of a character that no text holds (replacement, unassigned, private) in a text that lost some.
LOST_CHARACTER = -3.0
_HAN = "㐀-鿿"


@lru_cache(maxsize=1)
def _unreadable_codes() -> np.ndarray:
    """Characters that no text holds: the replacement character, unassigned and private ones."""
    return np.array([0xFFFD, *(o for o in range(0x370, 0x110000) if unicodedata.category(chr(o)) in ("Cn", "Co"))])


@lru_cache(maxsize=1)
def _unreadable() -> re.Pattern[str]:
    bad = _unreadable_codes()[1:].tolist()
    runs, start = [], None
    for a, b in zip(bad, [*bad[1:], -1], strict=True):
        start = a if start is None else start
        if b != a + 1:
            runs.append(f"\\U{start:08x}-\\U{a:08x}")
            start = None
    return re.compile("[�" + "".join(runs) + "]")


@lru_cache(maxsize=None)
def _bytes_of(codec: str) -> dict[int, int]:
    """Character -> byte of a one-byte encoding; undefined bytes read as the control of that number."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out[ord(c)] = b
    if codec != "latin-1":
        for b in range(0x80, 0xA0):
            out.setdefault(b, b)
    return out


@lru_cache(maxsize=None)
def _pattern(e: str, d: str) -> re.Pattern[str]:
    """Stretches that may come from a text in ``e`` read as ``d``."""
    if d == "gb18030":
        # Characters beyond ASCII; a swallowed ASCII letter is part of the last of them.
        return re.compile(r"[^\x00-\x7f�]+")
    rev: dict[int, list[str]] = {}
    for o, b in _bytes_of(d).items():
        rev.setdefault(b, []).append(re.escape(chr(o)))
    cls = lambda a, z: "[" + "".join(c for b in range(a, z + 1) for c in rev.get(b, [])) + "]"
    if e == "utf-8":
        c = cls(0x80, 0xBF)
        return re.compile(f"(?:{cls(0xC2, 0xDF)}{c}|{cls(0xE0, 0xEF)}{c}{c}|{cls(0xF0, 0xF4)}{c}{c}{c})+")
    if e == "gb18030":
        return re.compile(cls(0xA1, 0xFE) + "{2,}")
    return re.compile(cls(0x80, 0xFF))


def _decode(stretch: str, e: str, d: str) -> str | None:
    try:
        if d == "gb18030":
            raw = stretch.encode("gb18030")
        else:
            raw = stretch.translate(_bytes_of(d)).encode("latin-1")
        out = raw.decode(e)
    except UnicodeError:
        if e == "gb18030" and len(stretch) > 2:
            return next((x + stretch[-1] for x in [_decode(stretch[:-1], e, d)] if x), None)
        return None
    if out == stretch or any(c < " " and c not in "\t\n\r" for c in out) or any(c != "�" for c in _unreadable().findall(out)):
        return None
    return out


_UTF8_RUN = re.compile(rb"(?:[\xe0-\xef][\x80-\xbf]{2}){2,}")  # of three bytes each: sequences of two are common ideographs


def _within(stretch: str) -> tuple[str, int]:
    """(the stretch with the UTF-8 sequences undone that were read as GBK between characters that were not, their runs)."""
    raw = stretch.encode("gb18030", "replace")
    if not _UTF8_RUN.search(raw):
        return stretch, 0
    starts = {0: 0}
    at = 0
    for i, c in enumerate(stretch, 1):
        at += len(c.encode("gb18030", "replace"))
        starts[at] = i
    out, done, n = "", 0, 0
    for m in _UTF8_RUN.finditer(raw):
        a, z = m.span()
        while a < z and a not in starts:  # begin and end where a character and a sequence do
            a += 3
        z = next((x for x in range(z, a, -3) if x in starts), a)
        if z - a >= 6:
            out, done, n = out + stretch[done : starts[a]] + raw[a:z].decode("utf-8", "replace"), starts[z], n + 1
    return out + stretch[done:], n


def invert(text: str, e: str, d: str) -> tuple[str, int]:
    """(the text with every stretch that can be undone undone, number of such stretches)."""
    n = 0

    def undo(m: re.Match[str]) -> str:
        nonlocal n
        out = _decode(m.group(), e, d)
        if out is None:
            if e == "utf-8" and d == "gb18030" and len(m.group()) > 2:
                out, k = _within(m.group())
                n += k
                return out
            return m.group()
        n += 1
        return out

    return _pattern(e, d).sub(undo, text), n


@lru_cache(maxsize=None)
def _needs(e: str, d: str) -> frozenset[str]:
    """Characters of which a text must hold one for the chain to explain anything."""
    least = 0xC2 if e == "utf-8" else 0xA1
    return frozenset(chr(o) for o, b in _bytes_of(d).items() if b >= least)


def proposals(text: str) -> dict[int, tuple[str, int]]:
    """chain -> (what the text would have been, stretches) for every chain that can explain it."""
    if text.isascii():
        return {}
    out, chars = {}, set(text)
    for k, (_, e, d, times) in enumerate(CHAINS[:-1]):
        if d == "gb18030":
            got = _swallowed(text) if e == "cp1252" else invert(text, e, d)
        elif _needs(e, d).isdisjoint(chars):
            continue
        else:
            got = invert(text, e, d)
            if times > 1 and got[1]:
                again = invert(got[0], e, d)
                got = again if again[1] else (text, 0)
        if got[1] and got[0] != text:
            out[k] = got
    if _unreadable().search(text):
        out[len(CHAINS) - 1] = (text, 1)
    return out


def _swallowed(text: str) -> tuple[str, int]:
    """Undo an accented letter and its neighbour read as one ideograph inside a Latin word."""
    n = 0

    def undo(m: re.Match[str]) -> str:
        nonlocal n
        try:
            raw = m.group().encode("gb18030")
            out = raw.decode("cp1252") if len(raw) == 2 else ""
        except UnicodeError:
            return m.group()
        if len(out) == 2 and out.isalpha() and ord(out[1]) < 0x80:
            n += 1
            return out
        return m.group()

    return re.sub(rf"(?<=[A-Za-z])[{_HAN}](?![{_HAN}])|(?<![{_HAN}])[{_HAN}](?=[A-Za-z])", undo, text), n


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Class of each code point: blank, ASCII letter, digit, ASCII mark, other Latin letter, Han, kana, CJK mark, other letter, other, raised and lowered digits."""
    k = np.full(0x110000, 9, np.uint8)
    for o in range(0x250):
        c = chr(o)
        k[o] = 0 if c.isspace() else 1 if o < 128 and c.isalpha() else 2 if o < 128 and c.isdigit() else 3 if o < 128 else 4 if c.isalpha() else 9
    k[0x250:0x1E00] = 8
    k[0x1E00:0x2000] = 4
    k[0x2000:0x2070] = 7
    k[0x3000:0x3040] = 7
    k[0x3040:0x3100] = 6
    k[0x3400:0xA000] = 5
    k[0xF900:0xFB00] = 5
    k[0xFF00:0xFF70] = 7
    k[[o for o in range(0x80, 0x2190) if unicodedata.category(chr(o)) == "No"]] = 10
    return k


#: Classes, and the number that stands for a text's start.
_KINDS = 11


class CleanText:
    """Log-probability of text: class after class, and character within its class."""

    def __init__(self, chars: dict[int, int], steps: dict[tuple[int, int], int]):
        kinds = _kinds()
        self.step = np.full((_KINDS + 1, _KINDS), 0.5)
        for (a, b), n in steps.items():
            self.step[a, b] += n
        self.step = np.log(self.step / self.step.sum(1, keepdims=True))
        totals = np.full(_KINDS, 100.0)
        for o, n in chars.items():
            totals[kinds[o]] += n
        # What occurs nowhere has the share of what occurs once, spread over the rest of its class.
        once, sizes = np.ones(_KINDS), np.bincount(kinds, minlength=_KINDS).astype(float)
        for o, n in chars.items():
            once[kinds[o]] += n == 1
            sizes[kinds[o]] -= 1
        unseen = np.maximum(FLOOR, np.log(once / totals / np.maximum(sizes, 1)))
        self.char = unseen[kinds].astype(np.float32)
        self.char[_unreadable_codes()] = FLOOR
        for o, n in chars.items():
            self.char[o] = max(unseen[kinds[o]], np.log(n / totals[kinds[o]]))

    def score(self, text: str) -> float:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        k = _kinds()[codes].astype(int)
        return float(self.char[codes].sum() + self.step[np.concatenate([[_KINDS], k[:-1]]), k].sum()) if len(k) else 0.0

    def lost(self, text: str) -> float:
        """Log-probability of a text that lost characters: those that no text holds stand for what they were."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        k = _kinds()[codes].astype(int)
        each = self.char[codes] + self.step[np.concatenate([[_KINDS], k[:-1]]), k]
        gone = np.zeros(len(codes), bool)
        gone[[i for m in _unreadable().finditer(text) for i in range(*m.span())]] = True
        after = np.concatenate([[False], gone[:-1]])  # nothing is known of what follows one
        return float(np.where(gone, LOST_CHARACTER, np.where(after, self.char[codes], each)).sum())

    def evidence(self, text: str) -> list[float] | None:
        """Log-likelihood ratio of each chain, or None if no chain can explain the text."""
        found = proposals(text)
        if not found:
            return None
        now = self.score(text)
        out = [-1e3] * len(CHAINS)
        for k, (was, n) in found.items():
            out[k] = self.lost(was) - now - STRETCH_COST * n
        return out


def scan(rows: DataFrame, columns: list[str], kinds: str) -> DataFrame:
    """One pass over (columns, _text): counts of clean text, and the rows that some chain may explain.

    Rows of kind 0 count a code point, of kind 1 a class pair; kind 2 are records in question.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chars, steps, of = Counter(), Counter(), _kinds()
        for b in batches:
            odd = np.array([bool(proposals(t)) for t in b["_text"]], bool)
            codes = np.frombuffer("\x00".join(b["_text"][~odd]).encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(codes):
                o, n = np.unique(codes, return_counts=True)
                chars.update(dict(zip(o.tolist(), n.tolist(), strict=True)))
                k = of[codes].astype(int)
                before = np.where(codes[:-1] == 0, _KINDS, k[:-1])
                pairs = np.bincount((before * _KINDS + k[1:])[codes[1:] != 0])
                steps.update({i: int(pairs[i]) for i in np.flatnonzero(pairs)})
            at = np.flatnonzero(odd)
            if len(at):
                yield pd.DataFrame({"kind": 2, "at": 0, "n": 0} | {c: pd.Series(b[c].iloc[at].tolist(), dtype=object) for c in [*columns, "_text"]})
        chars.pop(0, None)
        counts = pd.DataFrame({"kind": [0] * len(chars) + [1] * len(steps), "at": [*chars, *steps], "n": [*chars.values(), *steps.values()]})
        for c in [*columns, "_text"]:
            counts[c] = pd.Series([None] * len(counts), dtype=object)
        yield counts

    return cut(rows.mapInPandas(run, f"kind int, at long, n long, {kinds}, _text string"))


def clean_model(scanned: DataFrame) -> CleanText:
    """The model of clean text from every row that no chain can explain.

    Its size is bounded by Unicode: one count for each code point that occurs, and class pairs.
    """
    counts = scanned.where("kind < 2").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()
    return CleanText({r["at"]: r["n"] for r in counts if r["kind"] == 0}, {(r["at"] // _KINDS, r["at"] % _KINDS): r["n"] for r in counts if r["kind"] == 1})


def posteriors(df: DataFrame, key: str, text: str, source: list[str], rounds: int = 8, weight: float = 2.0, settled: float = 0.02) -> DataFrame:
    """(key, source columns, chain, probability): the most probable chain of each record that some chain explains.

    ``chain`` is null where the record is more probably clean. Null, empty and ASCII texts are clean
    and give no row; repeated rows count once. Rows of a source without a value form one source.
    ``weight`` is the pull of the whole table's shares on each source's. The rounds end when no share of
    the whole table moves by more than ``settled`` of itself.
    """
    rows = df.select(F.col(key).alias("_k"), *[F.coalesce(F.col(s), F.lit("")).alias(f"_s{i}") for i, s in enumerate(source)], F.col(text).alias("_text"))
    rows = spread(rows.where(F.length("_text") > 0))
    by = [f"_s{i}" for i in range(len(source))]
    kind = f"_k {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{s} string" for s in by)
    scanned = scan(rows, ["_k", *by], kind)
    model = df.sparkSession.sparkContext.broadcast(clean_model(scanned))
    marks = scanned.where("kind = 2").select("_k", *by, "_text")
    columns = [f"_e{i}" for i in range(len(CHAINS))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            e = [model.value.evidence(t) for t in b["_text"]]
            keep = np.array([x is not None for x in e], bool)
            at = np.flatnonzero(keep)
            out = pd.DataFrame({c: pd.Series(b[c].iloc[at].tolist(), dtype=object) for c in ["_k", *by]})
            yield pd.concat([out, pd.DataFrame([x for x in e if x is not None], columns=columns, dtype=float)], axis=1)

    seen = cut(marks.mapInPandas(run, kind + ", " + ", ".join(f"{c} double" for c in columns)).dropDuplicates(["_k"]).withColumn("_m", F.greatest(F.lit(0.0), *columns)))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    n_rows = rows.count()
    share = {c: 0.01 / len(columns) for c in columns}
    local = None
    for _ in range(rounds):
        # Weights relative to the largest log-likelihood, so that none overflows and none ties by being cut off.
        if local is None:
            odds = seen.withColumns({f"_w{i}": F.exp(F.col(c) - F.col("_m")) * share[c] for i, c in enumerate(columns)}).withColumn("_w", F.exp(-F.col("_m")) * 0.99)
        else:
            odds = seen.join(local, by).withColumns({f"_w{i}": F.exp(F.col(c) - F.col("_m")) * F.col(f"_p{i}") for i, c in enumerate(columns)}).withColumn("_w", F.exp(-F.col("_m")) * F.col("_p"))
        total = sum((F.col(f"_w{i}") for i in range(len(columns))), F.col("_w"))
        odds = odds.withColumn("_z", total)
        sums = odds.groupBy(*by).agg(*[F.sum(F.col(f"_w{i}") / F.col("_z")).alias(f"_r{i}") for i in range(len(columns))])
        whole = sums.agg(*[F.sum(f"_r{i}").alias(f"_r{i}") for i in range(len(columns))]).first()
        before, share = share, {c: ((whole[f"_r{i}"] or 0.0) + 0.01) / (n_rows + 0.01 * len(columns) + 1) for i, c in enumerate(columns)}
        known = sums.join(sizes, by)
        shares = {f"_p{i}": (F.col(f"_r{i}") + weight * share[c]) / (F.col("_n") + weight) for i, c in enumerate(columns)}
        rest = sum(shares.values(), F.lit(0.0))
        local = known.select(*by, *[v.alias(k) for k, v in shares.items()], F.greatest(1 - rest, F.lit(1e-6)).alias("_p"))
        local = cut(local)
        if max(abs(share[c] - before[c]) / share[c] for c in columns) < settled:
            break
    final = seen.join(local, by)
    scores = F.array(*[F.struct((F.col(c) + F.log(F.col(f"_p{i}"))).alias("v"), F.lit(NAMES[i]).alias("chain")) for i, c in enumerate(columns)])
    final = final.withColumn("_best", F.array_max(scores)).withColumn("_clean", F.log("_p"))
    most = F.col("_best.v")
    probability = 1 / (1 + F.exp(F.least(F.col("_clean") - most, F.lit(300.0))))
    return final.select(F.col("_k").alias(key), *[F.col(f"_s{i}").alias(s) for i, s in enumerate(source)], F.when(probability > 0.5, F.col("_best.chain")).alias("chain"), probability.alias("probability"))


def repair(text: str, chain: str) -> str:
    """The text with the chain undone; a lossy chain leaves what cannot be restored."""
    k = NAMES.index(chain)
    found = proposals(text)
    if k == len(CHAINS) - 1:  # some stretches may still be undone
        gained = [(len(text) - len(was), was) for j, (was, n) in found.items() if j < k and len(was) < len(text) - n]
        return max(gained)[1] if gained else text
    return found[k][0] if k in found else text


@F.pandas_udf(StringType())
def repaired(text: pd.Series, chain: pd.Series) -> pd.Series:
    """The repaired text; rows without a chain keep theirs."""
    return pd.Series([repair(t, c) if isinstance(t, str) and isinstance(c, str) else t for t, c in zip(text, chain, strict=True)])
