"""Evaluation texts leaking into training text: BM25 over an inverted index with block-max WAND.

The indexed units are the sentences of the test items' passages (shared instruction lines and the
closing question taken out). Terms are short token n-grams, so a sentence with a word or two changed
keeps most of its terms while sentences that merely share a template keep few. Every passage (window of
tokens) of every training document is a query:

1. texts are folded to one form (character forms, case, punctuation, spacing, line breaks) and cut
   into hashed tokens on numpy arrays, a batch at a time;
2. a passage whose terms' upper bounds cannot reach the threshold is passed over, by one running
   sum per batch (WAND's own bound, for all passages at once);
3. the others run block-max WAND over the posting lists: everything at or above the threshold
   comes back, no top-k;
4. each hit is verified by its overlap with the item's two parts: the answer part, i.e. which
   sentences of the passage that answers the question occur in the document but for a few changed
   words, and the question part, i.e. the share of the closing question's terms the document has.

A sentence's threshold is what two changed words leave of its weight at worst, so none is lost by them;
short sentences, of which they would leave too little, are indexed by shorter n-grams.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.glyphs import consistent_codes
from papyra.session import spread

#: Tokens in a term, at most: words, and characters of scripts without word spaces.
GRAM_WORDS, GRAM_CHARS = 3, 4
#: Share of a sentence's own BM25 weight that a passage must reach, at most (see ``_left``).
THRESHOLD = 0.3
#: Least share that two changed words must leave; below it shorter terms are taken.
LEAST_SHARE = 0.2
#: Tokens of a sentence that may differ: about two words (a word is some two or three characters there).
CHANGED_WORDS, CHANGED_CHARS = 3, 6
#: Sentences of fewer words or characters are quoted phrases, not passages.
LEAST_WORDS, LEAST_CHARS = 4, 6
BLOCK = 32
#: Characters of test text that one index may hold; more items make more indexes, each a pass over the documents.
INDEX_CHARS = 4_000_000
_P = np.uint64(0x9E3779B97F4A7C15)

# Sentence ends, and what closes a question.
_SENTENCE = re.compile(r"(?<=[。！？!?])|(?<=\.)(?=\s|$)|\n")
_QUESTION = re.compile(r"[?？][\s\"'”’）)]*$")


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case form, class, powers): class 0 separates, 1 continues a word, 2 is a token by itself."""
    import unicodedata

    lower, kind = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
    for o in [*range(0x30), *range(0x30, 0xD800), *range(0xF900, 0x30000)]:
        c = chr(o)
        if c.isalnum() or unicodedata.category(c)[0] == "M":
            kind[o] = 2 if 0x2E80 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or o >= 0x20000 else 1
            if len(c.lower()) == 1:
                lower[o] = ord(c.lower())
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(4096, _P, np.uint64))
    return lower, kind, powers


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, 1 where it is a word and 2 a lone character, token offsets of each text)."""
    lower, kind, powers = _classes()
    codes, off = consistent_codes(texts)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(len(off), np.int64)
    k = kind[codes]
    new = k == 2
    word = k == 1
    head = word.copy()
    head[1:] &= ~word[:-1]
    inner = off[1:-1]
    inner = inner[inner < len(codes)]
    head[inner] |= word[inner]
    new |= head
    start = np.flatnonzero(new)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(len(off), np.int64)
    used = np.flatnonzero(k > 0)
    token = np.cumsum(new)[used] - 1
    place = (used - start[token]) & 4095
    with np.errstate(over="ignore"):
        value = (lower[codes[used]].astype(np.uint64) + np.uint64(1)) * powers[place]
        h = np.add.reduceat(value, np.searchsorted(used, start))
        h ^= h >> np.uint64(29)
        h *= _P
        h ^= h >> np.uint64(32)
    return h, k[start], np.searchsorted(start, off)


def terms(h: np.ndarray, kind: np.ndarray, off: np.ndarray, words: int = GRAM_WORDS, chars: int = GRAM_CHARS) -> np.ndarray:
    """The hash of the n-gram that starts at each token, by its kind of ``words`` or ``chars`` tokens; 0 where the text ends too soon or the size is 0."""
    n = len(h)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    end = np.repeat(off[1:], np.diff(off))
    at = np.arange(n)
    with np.errstate(over="ignore"):
        for size, mine in ((words, kind == 1), (chars, kind == 2)):
            if not size:
                continue
            i = np.flatnonzero(mine & (at + size <= end))
            g = np.full(len(i), np.uint64(size))
            for j in range(size):
                g = (g ^ h[i + j]) * _P
                g ^= g >> np.uint64(31)
            out[i] = g | np.uint64(1)
    return out


def _left(weights: list[float], reach: int) -> float:
    """Share of the weights that is left at worst when two runs of ``reach`` neighbours are lost."""
    total = sum(weights)
    runs = sorted((sum(weights[i : i + reach]) for i in range(max(1, len(weights) - reach + 1))), reverse=True)
    return 1 - sum(runs[:2]) / total if total else 0.0


class Index:
    """Posting lists of the sentences of a block of test items, with block maxima; built once, on flat arrays.

    ``items`` are (item, passage, question). Weights are BM25 weights of a term in a sentence divided by
    what a passage must reach for it, so the threshold is 1 for every sentence.
    """

    def __init__(self, items: list[tuple], threshold: float = THRESHOLD, k1: float = 1.2, b: float = 0.75):
        sentences = [(item, s) for item, text, *_ in items for s in _SENTENCE.split(text or "") if s and s.strip()]
        h, kind, off = tokens(pa.array([s for _, s in sentences], pa.string()))
        sizes = list(zip([*range(GRAM_WORDS, 0, -1), 1], range(GRAM_CHARS, 0, -1), strict=True))  # from the longest terms
        grams = [terms(h, kind, off, *x) for x in sizes]
        kept: list[int] = []
        self.item, self.tokens, self.kinds = [], [], []
        for i, (item, _) in enumerate(sentences):
            a, z = off[i], off[i + 1]
            if z - a >= (LEAST_CHARS if np.count_nonzero(kind[a:z] == 2) * 2 > z - a else LEAST_WORDS):
                kept.append(i)
                self.item.append(item)
                self.tokens.append(h[a:z].tolist())
                self.kinds.append(kind[a:z].tolist())
        self.threshold = 1.0
        self.longest = max((len(t) for t in self.tokens), default=0)
        self.of_item = Counter(self.item)
        bags = [[[int(x) for x in g[off[i] : off[i + 1]] if x] for g in grams] for i in kept]
        df = [Counter(t for bag in bags for t in set(bag[level])) for level in range(len(sizes))]
        mean = sum(map(len, self.tokens)) / max(1, len(bags))
        posts: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.sizes: set[tuple[int, int]] = set()
        for s, bag in enumerate(bags):
            norm = k1 * (1 - b + b * len(self.tokens[s]) / mean)
            chars = self.kinds[s].count(2) * 2 > len(self.kinds[s])
            for level, size in enumerate(sizes):
                n = Counter(bag[level])
                w = {t: math.log(1 + (len(bags) - df[level][t] + 0.5) / (df[level][t] + 0.5)) * x * (k1 + 1) / (x + norm) for t, x in n.items()}
                left = _left([w[t] for t in bag[level]], size[1] + CHANGED_CHARS // 2 - 1 if chars else size[0])
                if left >= LEAST_SHARE or level + 1 == len(sizes):
                    break
            self.sizes.add(size)
            reach = sum(w.values()) * max(min(threshold, left), 0.01)
            for t, x in w.items():
                posts[t].append((s, x / reach))
        self.terms = np.array(sorted(posts), np.uint64)
        self.start, self.ids, self.weights, self.upper, self.ends, self.tops, self.first = array("l", [0]), array("i"), array("f"), [], array("i"), array("f"), array("l", [0])
        for t in self.terms.tolist():
            p = posts[t]
            self.ids.extend(s for s, _ in p)
            self.weights.extend(x for _, x in p)
            for i in range(0, len(p), BLOCK):
                self.ends.append(p[min(i + BLOCK, len(p)) - 1][0])
                self.tops.append(max(x for _, x in p[i : i + BLOCK]))
            self.start.append(len(self.ids))
            self.first.append(len(self.ends))
            self.upper.append(max(x for _, x in p))
        self.upper = np.array(self.upper)
        self.questions: dict = {}
        asked = [(x[0], x[2]) for x in items if len(x) > 2 and x[2]]
        qh, qk, qo = tokens(pa.array([q for _, q in asked], pa.string()))
        for size in ((2, 2), (1, 1)):
            g = terms(qh, qk, qo, *size)
            for i, (item, _) in enumerate(asked):
                if item not in self.questions and (mine := {int(x) for x in g[qo[i] : qo[i + 1]] if x}):
                    self.questions[item] = (size, mine)

    def wand(self, query: list[int]) -> list[int]:
        """Sentences whose score over the distinct terms of the query reaches the threshold."""
        theta = self.threshold - 1e-6
        ids, start, first, ends, tops = self.ids, self.start, self.first, self.ends, self.tops
        cursors = [[ids[start[t]], t, start[t]] for t in query]  # sentence, term, position
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(cursors):
                bound += self.upper[t]
                if bound >= theta:
                    pivot = i
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            # Block-max test: the blocks that hold ``doc`` may already rule it out, and all up to the nearest block end.
            bound, nearest = 0.0, None
            for _, t, at in cursors[: pivot + 1]:
                k = bisect_left(ends, doc, first[t] + (at - start[t]) // BLOCK, first[t + 1])
                if k < first[t + 1]:
                    bound += tops[k]
                    nearest = ends[k] if nearest is None else min(nearest, ends[k])
            if bound < theta:
                beyond = (nearest if nearest is not None else doc) + 1
                if pivot + 1 < len(cursors):
                    beyond = min(beyond, cursors[pivot + 1][0])
                cursors = self._advance(cursors, pivot + 1, max(beyond, doc + 1))
            elif cursors[0][0] == doc:
                if sum(self.weights[at] for s, _, at in cursors[: pivot + 1] if s == doc) >= theta:
                    out.append(doc)
                cursors = self._advance(cursors, pivot + 1, doc + 1)
            else:
                cursors = self._advance(cursors, pivot + 1, doc)
        return out

    def _advance(self, cursors: list[list[int]], n: int, to: int) -> list[list[int]]:
        """The first ``n`` cursors moved to sentence ``to`` or beyond, over whole blocks at a time."""
        out = []
        for i, (s, t, at) in enumerate(cursors):
            if i < n and s < to:
                k = bisect_left(self.ends, to, self.first[t] + (at - self.start[t]) // BLOCK, self.first[t + 1])
                if k == self.first[t + 1]:
                    continue
                begins = self.start[t] + (k - self.first[t]) * BLOCK
                at = bisect_left(self.ids, to, max(at, begins), min(begins + BLOCK, self.start[t + 1]))
                s = self.ids[at]
            out.append([s, t, at])
        return out

    def question_overlap(self, item: object, h: np.ndarray, kind: np.ndarray) -> float:
        """Share of the terms of the item's closing question that the document (its tokens) has; 0 without a question."""
        if item not in self.questions:
            return 0.0
        size, mine = self.questions[item]
        return len(mine & set(terms(h, kind, np.array([0, len(h)]), *size).tolist())) / len(mine)

    def occurs(self, s: int, doc: list[int]) -> bool:
        """Whether the sentence occurs within ``doc`` (token hashes) but for a few changed tokens."""
        want, chars = self.tokens[s], self.kinds[s].count(2)
        most = CHANGED_CHARS if chars * 2 > len(want) else CHANGED_WORDS
        most = min(most, len(want) // 3)
        before = [0] * (len(doc) + 1)  # edits of the empty prefix: it may begin anywhere
        for i, x in enumerate(want, 1):
            row, low = [i], i
            for j, y in enumerate(doc, 1):
                e = before[j - 1] if x == y else 1 + min(before[j - 1], before[j], row[-1])
                row.append(e)
                if e < low:
                    low = e
            if low > most:
                return False
            before = row
        return min(before) <= most


def leaked(index: Index, keys: list, texts: pa.Array) -> list[tuple]:
    """(key, item, sentences of the passage found, their share, share of the question found) of the batch's documents, each pair once."""
    h, kind, off = tokens(texts)
    if not len(index.terms) or not len(h):
        return []
    hits, which = [], []
    for size in sorted(index.sizes):
        g = terms(h, kind, off, *size)
        at = np.minimum(np.searchsorted(index.terms, g), len(index.terms) - 1)
        hit = np.flatnonzero((index.terms[at] == g) & (g > 0))
        hits.append(hit)
        which.append(at[hit])
    hit, which = np.concatenate(hits), np.concatenate(which)
    if not len(hit):
        return []
    order = np.argsort(hit, kind="stable")
    hit, which = hit[order], which[order]
    row = np.searchsorted(off, hit, "right") - 1
    # Passages: windows of twice the longest sentence, one begins every half of that, so each sentence is whole in one.
    span = max(1, index.longest + CHANGED_CHARS)
    total = np.concatenate([[0.0], np.cumsum(index.upper[which])])
    found: dict[int, dict[object, set[int]]] = defaultdict(lambda: defaultdict(set))
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    bounds = [*first.tolist(), len(hit)]
    least = index.threshold - 1e-6
    for a, z in zip(bounds, bounds[1:], strict=False):
        if total[z] - total[a] < least:
            continue
        d = int(row[a])
        own = hit[a:z]
        begins = np.arange((own[0] - off[d]) // span * span + off[d], own[-1] + 1, span)
        lo = a + np.searchsorted(own, begins)
        hi = a + np.searchsorted(own, begins + 2 * span)
        for i in np.flatnonzero(total[hi] - total[lo] >= least):
            query = sorted(set(which[lo[i] : hi[i]].tolist()))
            for s in index.wand(query):
                if s in found[d][index.item[s]]:
                    continue
                b = int(begins[i])
                if index.occurs(s, h[max(off[d], b - CHANGED_CHARS) : min(off[d + 1], b + 2 * span + CHANGED_CHARS)].tolist()):
                    found[d][index.item[s]].add(s)
    return [
        (keys[d], item, len(got), len(got) / index.of_item[item], index.question_overlap(item, h[off[d] : off[d + 1]], kind[off[d] : off[d + 1]]))
        for d, of in sorted(found.items()) for item, got in sorted(of.items()) if got
    ]


def passages(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, passage, question): item texts without lines that several items share, and their closing question apart.

    Only a last line of its own that ends in a question mark is a closing question, and only if a
    passage stands before it; else the question is null.
    """
    lines = items.select(F.col(key).alias("_k"), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("_p", "_l")).withColumn("_l", F.trim("_l")).where("_l <> ''")
    shared = lines.groupBy("_l").agg(F.count_distinct("_k").alias("_n")).where("_n > 1").select("_l")
    own = lines.join(shared, "_l", "left_anti")
    kept = own.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_p", "_l"))).alias("_a"))
    last = F.element_at("_a", -1)["_l"]
    closes = (F.size("_a") > 1) & last.rlike(_QUESTION.pattern)
    body = F.when(closes, F.slice("_a", 1, F.size("_a") - 1)).otherwise(F.col("_a"))
    return kept.select(F.col("_k").alias(key), F.array_join(F.transform(body, lambda x: x["_l"]), "\n").alias("passage"), F.when(closes, last).alias("question"))


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_key, item_key, sentences, answer_overlap, question_overlap): documents that contain at least one full sentence of the item's passage.

    ``sentences`` counts the sentences of the passage found, ``answer_overlap`` is their share of it and
    ``question_overlap`` the share of the closing question's terms, which is told but decides nothing.
    Sentences under LEAST_WORDS or LEAST_CHARS are not looked for. Null and empty texts on either side
    match nothing; repeated rows and equal texts each give their own pairs, once. An item that is nothing
    but shared lines has no passage and matches nothing. The test items are split into index blocks of at
    most INDEX_CHARS characters; each block is searched by all documents, so a larger test set makes more
    passes, never a larger index. An index is built once, on the driver, and broadcast.
    """
    clean = passages(items.where(F.col(item_text).isNotNull()), item_key, item_text)
    total = clean.agg(F.sum(F.length("passage"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / INDEX_CHARS * 1.25)) if total > INDEX_CHARS else 1
    spark = docs.sparkSession
    kinds = [docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()]
    out_type = f"{doc_key} {kinds[0]}, {item_key} {kinds[1]}, sentences int, answer_overlap double, question_overlap double"
    rows = docs.select(F.col(doc_key).alias("_k"), F.col(doc_text).alias("_t")).where(F.length("_t") > 0)
    rows = spread(rows)
    found = spark.createDataFrame([], out_type)
    item_type = pa.string() if kinds[1] == "string" else pa.int64()
    for block in range(n_blocks):
        part = clean if n_blocks == 1 else clean.where(F.pmod(F.xxhash64(item_key), F.lit(n_blocks)) == block)
        held = spark.sparkContext.broadcast(Index([tuple(r) for r in part.orderBy(item_key).collect()], threshold))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                schema = pa.schema([(doc_key, b.schema.field(0).type), (item_key, item_type), ("sentences", pa.int32()), ("answer_overlap", pa.float64()), ("question_overlap", pa.float64())])
                for i in range(0, b.num_rows, 2000):  # bounds the arrays of one step
                    part = b.slice(i, 2000)
                    pairs = leaked(index, part.column(0).to_pylist(), part.column(1))
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in pairs], schema=schema)

        found = found.unionByName(rows.mapInArrow(run, out_type))
    return found.distinct()
