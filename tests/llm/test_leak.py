from __future__ import annotations

import random

import pyarrow as pa

from papyra.llm import leak

VOCAB = [f"{a}{b}" for a in ("pre", "con", "mul", "tra", "ver") for b in ("dent", "tion", "ple", "vel", "sorb", "mit", "ble", "cast", "gard", "ling")]
HAN = "经济历史文化教育科学技术自然社会问题方法结构理论实践发展变化影响原因结果过程"


def sentence(rng):
    if rng.random() < 0.3:
        return "".join(rng.choice(HAN) for _ in range(24)) + "。"
    w = [rng.choice(VOCAB) for _ in range(12)]
    return f"By the {w[0]} {w[1]}, {rng.randint(10, 99)} per cent of the {' '.join(w[2:9])} had {w[9]} the {w[10]}. "


def indexed(rng, n=40):
    return leak.Index([(i, "".join(sentence(rng) for _ in range(4)), None) for i in range(n)])


def postings(index, t):
    return list(zip(index.ids[index.start[t] : index.start[t + 1]], index.weights[index.start[t] : index.start[t + 1]], strict=True))


def test_wand_equals_scoring_everything():
    rng = random.Random(1)
    index = indexed(rng, 120)
    assert max(len(postings(index, t)) for t in range(len(index.terms))) > 2 * leak.BLOCK  # so that blocks are passed over
    for _ in range(300):
        some = rng.sample(range(len(index.terms)), rng.randint(1, 60))
        s = rng.randrange(len(index.item))  # mostly a sentence's own terms
        own = [t for t in range(len(index.terms)) if any(d == s for d, _ in postings(index, t))]
        query = sorted(set(some + rng.sample(own, rng.randint(0, len(own)))))
        scores: dict[int, float] = {}
        for t in query:
            for d, x in postings(index, t):
                scores[d] = scores.get(d, 0.0) + x
        assert sorted(index.wand(query)) == sorted(d for d, v in scores.items() if v >= index.threshold - 1e-6)


def brute(index, texts):
    """Every sentence against every document, without an index."""
    out = set()
    for k, t in enumerate(texts):
        h, _, _ = leak.tokens(pa.array([t]))
        out |= {(k, index.item[s]) for s in range(len(index.item)) if index.occurs(s, h.tolist())}
    return out


def test_search_equals_brute_force():
    rng = random.Random(2)
    items = [(i, "".join(sentence(rng) for _ in range(3))) for i in range(30)]
    index = leak.Index(items)
    texts = []
    for i in range(120):
        parts = [sentence(rng) for _ in range(6)]
        if i % 3 == 0:
            s = rng.choice([x for x in leak._SENTENCE.split(rng.choice(items)[1]) if x and x.strip()])
            if i % 2:
                w = s.split(" ")
                if len(w) > 8:
                    w[6] = "changed"
                s = " ".join(w).upper().replace(",", " ;")
            parts[2] = s.replace(" ", "\n", 2) + " "
        texts.append("".join(parts))
    assert {x[:2] for x in leak.leaked(index, list(range(len(texts))), pa.array(texts))} == brute(index, texts)


def test_two_changed_words_lose_no_sentence_of_any_length():
    rng = random.Random(8)
    items = [(i, " ".join(rng.sample(VOCAB, 4 + i % 12)) + ".", None) for i in range(60)] + [(100 + i, "".join(rng.choice(HAN) for _ in range(6 + i % 20)) + "。", None) for i in range(60)]
    index = leak.Index(items)
    texts, want = [], set()
    for i, s, _ in items:
        cjk = i >= 100
        parts = list(s[:-1]) if cjk else s[:-1].split(" ")
        for j in rng.sample(range(len(parts)), 2 if len(parts) >= (12 if cjk else 6) else 1):
            parts[j] = "我" if cjk else "other"
        texts.append("before that, " + ("" if cjk else " ").join(parts) + " and after")
    got = {x[:2] for x in leak.leaked(index, list(range(len(texts))), pa.array(texts))}
    assert got == brute(index, texts) and len(got) >= len(items)


def test_overlap_of_both_parts():
    index = leak.Index([(1, "The old harbour lies behind the northern hills. Nobody has repaired its broken wall.", "Who should repair the broken wall?")])
    got = leak.leaked(index, ["a", "b", "c"], pa.array(["THE OLD HARBOUR lies behind the northern hills. Who should repair the broken wall?", "Nobody has repaired its broken wall; the old harbour lies behind the northern hills.", "Who should repair the broken wall?"]))
    assert [(k, i, n, share) for k, i, n, share, _ in got] == [("a", 1, 1, 0.5), ("b", 1, 2, 1.0)]
    assert got[0][4] == 1.0 and 0 < got[1][4] < 1


def test_find_leaks(spark):
    rng = random.Random(3)
    line = "Directions: read the following text and choose the best answer to each question."
    items = [(1, f"{line}\n{sentence(rng)}{sentence(rng)}\nWhat does the conversation of the people show?"), (2, f"{line}\n{sentence(rng)}"), (3, None), (4, line), (5, "")]
    first = [s for s in leak._SENTENCE.split(items[0][1].split("\n")[1]) if s.strip()][0]
    docs = [(10, "intro. " + first.upper() + " outro"), (11, line + " What does the conversation of the people show?"), (12, None), (13, ""), (14, first[: len(first) // 3]), (15, ("x " * 50_000) + first), (10, "intro. " + first.upper() + " outro")]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    got = sorted(tuple(r)[:2] for r in leak.find_leaks(d, e, "doc_id", "text", "item_id", "text").collect())
    assert got == [(10, 1), (15, 1)]
    assert leak.find_leaks(d.limit(0), e, "doc_id", "text", "item_id", "text").count() == 0
    assert leak.find_leaks(d, e.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    small, leak.INDEX_CHARS = leak.INDEX_CHARS, 60  # several index blocks give the same
    try:
        assert sorted(tuple(r)[:2] for r in leak.find_leaks(d, e, "doc_id", "text", "item_id", "text").collect()) == got
    finally:
        leak.INDEX_CHARS = small
