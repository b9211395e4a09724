"""One consistent form for text that looks the same, on numpy code-point arrays.

A batch's Arrow text is copied once into one uint32 array; every step is a gather through a
lookup table or an offset computation over the whole batch:

1. decompose and replace look-alikes by table gathers, with expansion offsets for characters
   that become several or none (zero-width characters);
2. put runs of combining marks in canonical order;
3. compose starters and marks by sorted-pair lookup, one mark rank at a time.

What counts as looks and is kept apart: case, accents, superscripts, circled figures, ordinary
spaces. What looks the same and is unified: full- and half-width forms, composed and combining
accents, zero-width characters and soft hyphens, spaces of any kind, presentation ligatures,
radicals printed as ideographs, Roman-numeral characters, look-alike letters of other scripts.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Letters of other scripts printed exactly like a Latin letter.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i",
    "ј": "j", "Ѵ": "V", "ѵ": "v", "һ": "h", "Ӏ": "I", "ӏ": "l", "ԁ": "d", "Ԍ": "G", "Ԛ": "Q", "ԛ": "q", "Ԝ": "W", "ԝ": "w", "Ү": "Y",
    # Armenian, Latin
    "օ": "o", "ց": "g", "ɡ": "g", "ƽ": "5",
}
# Radicals of the supplement block with the ideograph each is printed like.
RADICALS = {
    "⺁": "厂", "⺇": "几", "⺌": "小", "⺎": "兀", "⺏": "尣", "⺐": "尢", "⺒": "巳", "⺓": "幺", "⺛": "旡", "⺝": "月", "⺠": "民",
    "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺥": "爫", "⺩": "王", "⺫": "罒", "⺬": "示", "⺭": "礻", "⺯": "糹", "⺱": "罓", "⺲": "罒",
    "⺶": "羊", "⺹": "耂", "⺻": "肀", "⺼": "月", "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西",
    "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅", "⻑": "長",
    "⻒": "镸", "⻓": "长", "⻔": "门", "⻖": "阝", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠",
    "⻠": "饣", "⻢": "马", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻬": "齐", "⻮": "齿",
    "⻰": "龙", "⻳": "龟",
}
# Hyphens that print as the ordinary one.
HYPHENS = "‐‑﹣"
#: Compatibility decompositions that keep the looks, by code-point range.
_SAME_LOOKS = ((0x00B5, 0x00B5), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2126, 0x212B), (0x2160, 0x217F), (0x2E80, 0x2FDF), (0x3000, 0x3000), (0xFB00, 0xFB4F), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
_TOP = 0x110000
_HANGUL = (0xAC00, 0xD7A3)


def _silent(c: str) -> bool:
    """Prints nothing: format characters (zero-width, direction, soft hyphen), variation selectors."""
    o = ord(c)
    return unicodedata.category(c) == "Cf" and not 0x600 <= o <= 0x6DD or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)


def _looks(c: str) -> str:
    """The decomposed form of one character by its looks; one rule for every code point."""
    o = ord(c)
    if _silent(c):
        return ""
    if _HANGUL[0] <= o <= _HANGUL[1]:
        return c
    if c in HYPHENS:
        return "-"
    d = unicodedata.decomposition(c)
    if unicodedata.category(c) == "Zs" or o == 0x3000:
        return " "
    if d.startswith(("<wide>", "<narrow>")) or d.startswith("<compat>") and any(a <= o <= b for a, b in _SAME_LOOKS):
        return "".join(_looks(chr(int(x, 16))) for x in d.split()[1:])
    if d and not d.startswith("<"):
        return "".join(_looks(chr(int(x, 16))) for x in d.split())
    return RADICALS.get(c) or LOOKALIKES.get(c) or c


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, built once per worker from the Unicode data and the rule above."""
    start = np.zeros(_TOP, np.int64)
    count = np.ones(_TOP, np.int8)
    pool: list[int] = []
    simple = np.arange(_TOP, dtype=np.uint32)
    ccc = np.zeros(_TOP, np.uint8)
    firsts: list[tuple[int, int, int]] = []
    for o in [*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)]:
        c = chr(o)
        if k := unicodedata.combining(c):
            ccc[o] = k
        d = unicodedata.decomposition(c)
        if d and d[0] != "<" and " " in d:
            a, b = (int(x, 16) for x in d.split())
            if unicodedata.normalize("NFC", chr(a) + chr(b)) == c:
                firsts.append((a, b, o))
        if o < 0x80:
            continue
        to = _looks(c)
        if to != c:
            start[o], count[o] = len(pool), len(to)
            pool += map(ord, to)
            if len(to) == 1:
                simple[o] = ord(to)
    # Pairs are keyed by the mapped starter, so a look-alike base composes as the Latin letter does.
    pairs = np.array(sorted((a << 21 | b, o) for a, b, o in firsts), np.uint64)
    return {"start": start, "count": count, "pool": np.array(pool or [0], np.uint32), "simple": simple, "ccc": ccc, "pair": pairs[:, 0].copy(), "composed": pairs[:, 1].astype(np.uint32)}


def to_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets of each text); nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(texts) else np.zeros(0, np.uint8)
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return codes, before[off - off[0]] if len(texts) else np.zeros(1, np.int64)


def to_arrow(codes: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The texts as an Arrow array: one encode for the batch, offsets by byte widths."""
    widths = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(widths)])[offsets]
    data = codes.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    out = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.string())
    return out if null is None or not null.any() else pc.if_else(pa.array(null), pa.scalar(None, pa.string()), out)


def _expand(codes: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = t["count"][codes]
    if (n == 1).all():
        return t["simple"][codes], row
    at = np.repeat(np.cumsum(n.astype(np.int64)) - n, n)
    inner = np.arange(len(at)) - at
    source = np.repeat(codes, n)
    many = t["count"][source] > 1
    out = t["simple"][source]
    out[many] = t["pool"][t["start"][source[many]] + inner[many]]
    return out, np.repeat(row, n)


def _order_marks(codes: np.ndarray, row: np.ndarray, ccc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable sort of each run of marks by combining class; only runs out of order are touched."""
    if not ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (row[1:] == row[:-1])).any():
        return codes, ccc
    new = np.concatenate([[True], (ccc[1:] == 0) | (row[1:] != row[:-1])])
    order = np.lexsort((ccc, np.cumsum(new)))
    return codes[order], ccc[order]


def _lookup(t: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)
    i = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
    return t["pair"][i] == key, t["composed"][i]


def _compose(codes: np.ndarray, row: np.ndarray, ccc: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    marks = np.flatnonzero(ccc > 0)
    keep = np.ones(len(codes), bool)
    codes = codes.copy()
    if len(marks):
        starter = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(codes)), -1))[marks]
        ok = starter >= 0
        ok[ok] = row[starter[ok]] == row[marks[ok]]
        marks, starter = marks[ok], starter[ok]
        last = np.zeros(len(codes), np.uint8)  # class of the last mark left standing, by starter
        rank = marks - starter
        order = np.argsort(rank, kind="stable")
        marks, starter = marks[order], starter[order]
        for chunk in np.split(np.arange(len(marks)), np.flatnonzero(np.diff(rank[order])) + 1):
            m, s = marks[chunk], starter[chunk]
            hit, to = _lookup(t, codes[s], codes[m])
            hit &= last[s] < ccc[m]
            codes[s[hit]] = to[hit]
            keep[m[hit]] = False
            last[s[~hit]] = ccc[m[~hit]]
        codes, row, ccc = codes[keep], row[keep], ccc[keep]
    # Starter pairs: conjoining jamo by arithmetic, others by the same table.
    for _ in range(2):
        if len(codes) < 2:
            break
        a, b = codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
        same = (row[1:] == row[:-1]) & (ccc[1:] == 0) & (ccc[:-1] == 0) & (b >= 0x900)
        if not same.any():
            break
        lv = same & (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        lvt = same & (a >= _HANGUL[0]) & (a <= _HANGUL[1]) & ((a - _HANGUL[0]) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        hit, to = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
        some = np.flatnonzero(same & ~lv & ~lvt & (b < 0x11FFF))
        hit[some], to[some] = _lookup(t, codes[:-1][some], codes[1:][some])
        to[lv] = _HANGUL[0] + ((a[lv] - 0x1100) * 21 + b[lv] - 0x1161) * 28
        to[lvt] = a[lvt] + b[lvt] - 0x11A7
        hit |= lv | lvt
        hit[1:] &= ~hit[:-1]
        if not hit.any():
            break
        at = np.flatnonzero(hit)
        codes[at] = to[at]
        keep = np.ones(len(codes), bool)
        keep[at + 1] = False
        codes, row, ccc = codes[keep], row[keep], ccc[keep]
    return codes, row


@lru_cache(maxsize=1)
def one_to_one() -> tuple[np.ndarray, np.ndarray]:
    """(form, hard): the one-character form of each code point; hard where a text needs the full path.

    Hard are characters of no or several forms, marks, and characters that compose with the one before.
    """
    t = tables()
    form = t["simple"].copy()
    hard = t["ccc"] > 0
    hard[(t["pair"] & np.uint64((1 << 21) - 1)).astype(np.int64)] = True
    hard[0x1100:0x1200] = True
    hard[t["count"] == 0] = True
    many = np.flatnonzero(t["count"] > 1)
    whole, ends = _full(many.astype(np.uint32), np.arange(len(many) + 1))
    single = np.diff(ends) == 1
    form[many[single]] = whole[ends[:-1][single]]
    hard[many[~single]] = True
    return form, hard


def _full(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = tables()
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    codes, row = _expand(codes, row, t)
    codes, ccc = _order_marks(codes, row, t["ccc"][codes])
    codes, row = _compose(codes, row, ccc, t)
    return codes, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(off) - 1))])


def consistent_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of the texts in the one form; nulls are empty."""
    codes, off = to_codes(texts)
    form, hard = one_to_one()
    if not len(codes) or not (is_hard := hard[codes]).any():
        return form[codes], off
    n_hard = np.diff(np.concatenate([[0], np.cumsum(is_hard)])[off])
    rows = np.repeat(n_hard > 0, np.diff(off))
    sizes = np.diff(off)
    slow, slow_off = _full(codes[rows], np.concatenate([[0], np.cumsum(sizes[n_hard > 0])]))
    new = sizes.copy()
    new[n_hard > 0] = np.diff(slow_off)
    ends = np.concatenate([[0], np.cumsum(new)])
    out = np.empty(ends[-1], np.uint32)
    at = np.repeat(n_hard > 0, new)
    out[at] = slow
    out[~at] = form[codes[~rows]]
    return out, ends


def consistent(texts: pa.Array) -> pa.Array:
    """Every text in the one form; null stays null, empty stays empty. Idempotent."""
    return to_arrow(*consistent_codes(texts), np.asarray(pc.is_null(texts)))
