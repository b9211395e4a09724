"""Splitting oversized texts at natural boundaries by agglomerative merging.

Atoms are the smallest segments between natural boundaries (paragraph, line, sentence, clause,
word; a run without any is cut at whole characters). Adjacent pairs lie in a heap ordered by the
strength of the boundary between them; the weakest are merged first while the merged size plus the
overlap fits, so the cuts that remain are at the strongest boundaries. Sizes are exact: atoms are
ranges of the whole text's token sequence.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.tokens import TOKENIZER, encoding, may_exceed
from papyra.session import spread

#: Boundaries from the strongest; each pattern ends where the next segment begins.
_BOUNDARIES = (
    (5, re.compile(r"\n[ \t\r]*\n\s*")),
    (4, re.compile(r"\n")),
    (3, re.compile(r"[。！？!?…]+[”’」』）)\"']*|\.[”’\"')]*(?=\s)")),
    (2, re.compile(r"[，；、：,;:](?=\D)")),
    (1, re.compile(r"(?<=\S)(?=\s)")),
)
#: A piece encoded alone can differ by a few tokens from its range of the whole; kept free.
SLACK = 8


def _atoms(text: str, first: list[int], limit: int) -> list[tuple[int, int]]:
    """(token index, strength) of every boundary used, in order; gaps are at most ``limit`` tokens.

    ``first[i]`` is the character at which token i starts. A gap of at most ``limit`` between two
    boundaries is left whole: its own weaker ones would be merged again before either of the two, as
    what they part fits together.
    """
    import bisect

    cuts: dict[int, int] = {0: 9, len(first): 9}

    def refine(a: int, b: int, level: int) -> None:
        """Cut tokens [a, b) at boundaries of this level and, where still needed, weaker ones."""
        todo = [(a, b, level)]
        while todo:
            a, b, k = todo.pop()
            if k and b - a <= limit:
                continue
            lo, hi = first[a], first[b] if b < len(first) else len(text)
            if k == len(_BOUNDARIES):  # no boundary left: whole characters
                step = max(1, limit)
                at = a + step
                while at < b:
                    while at > a + 1 and at < len(first) and first[at] == first[at - 1]:
                        at -= 1
                    cuts.setdefault(at, 0)
                    at += step
                continue
            strength, pattern = _BOUNDARIES[k]
            points = [a]
            for m in pattern.finditer(text, lo, hi):
                i = bisect.bisect_left(first, m.end())
                if points[-1] < i < b:
                    cuts.setdefault(i, strength)
                    points.append(i)
            points.append(b)
            todo += [(p, q, k + 1) for p, q in zip(points, points[1:], strict=False)]

    refine(0, len(first), 0)
    return sorted(cuts.items())


def merge(cuts: list[tuple[int, int]], limit: int) -> list[int]:
    """The token indices at which pieces start and end after merging weakest boundaries first."""
    at = [c for c, _ in cuts]
    n = len(at) - 1
    left, right = list(range(-1, n)), list(range(1, n + 2))  # neighbours of boundary i
    alive = [True] * (n + 1)
    heap = [(cuts[i][1], at[i + 1] - at[i - 1], i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        strength, size, i = heapq.heappop(heap)
        now = at[right[i]] - at[left[i]]
        if now > limit:
            continue  # sizes only grow, so this boundary stays for good
        if now != size:
            heapq.heappush(heap, (strength, now, i))
            continue
        alive[i] = False
        right[left[i]], left[right[i]] = right[i], left[i]
    return [at[i] for i in range(n + 1) if alive[i]]


def pieces(text: str, limit: int = 2000, overlap: int = 100, path: str = TOKENIZER) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece as character positions; one piece if the text fits.

    Each piece after the first begins ``overlap`` tokens before its own part (moved out to a whole
    character). The tokens are those of the piece encoded alone, at most ``limit``.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half the limit")
    enc = encoding(path)
    ids = enc.encode_ordinary(text)
    if len(ids) <= limit:
        return [(0, len(text), len(ids))]
    _, first = enc.decode_with_offsets(ids)
    slack = min(SLACK, limit // 20)
    while True:
        room = max(1, limit - overlap - slack - 3)
        edges = merge(_atoms(text, first, room), room)
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            start = first[max(0, a - overlap)] if a else 0
            end = first[b] if b < len(first) else len(text)
            out.append((start, end, len(enc.encode_ordinary(text[start:end]))))
        if all(k <= limit for *_, k in out):
            return out
        if room == 1:
            raise ValueError(f"a character and its overlap take more than {limit} tokens")
        slack = 2 * slack + 1


SCHEMA = "piece int, n_pieces int, start int, end int, n_tokens int, piece_text string"


def split_texts(df: DataFrame, key: str, text: str, limit: int = 2000, overlap: int = 100, path: str = TOKENIZER, with_text: bool = True) -> DataFrame:
    """The pieces of every text longer than ``limit`` tokens, one row each, numbered from 0.

    Texts within the limit, empty and null texts give no rows (they need no cut). ``start`` and
    ``end`` are character positions, so pieces without their overlap rebuild the text exactly.
    Texts that cannot exceed the limit by their byte length are dropped in the scan. Repeated rows
    give repeated pieces; other columns are ignored whatever their names.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["_k"], b["_t"], strict=True):
                cut = pieces(t, limit, overlap, path)
                if len(cut) > 1:
                    rows += [(k, i, len(cut), a, z, n, t[a:z] if with_text else None) for i, (a, z, n) in enumerate(cut)]
            yield pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in SCHEMA.split(", "))])

    long = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(may_exceed(F.col("_t"), limit))
    return spread(long).mapInPandas(run, f"{key} {kind}, {SCHEMA}")
