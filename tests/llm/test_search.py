"""Hard negatives, ranked search and decontamination against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import fm_index, hard_negatives, impact_index
from loomspan.llm.terms import terms_of

ROWS = "vec_id long, embedding array<float>, label int, id string, score long"


def negatives(rows, k=5, most=10):
    """As the contract says, row by row."""
    good = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if None not in (i, v, y) and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    anchors = {(i, y, tuple(v)) for i, y, v in good if i % 100 == 0}
    for i, y, v in anchors:
        others = [(sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in good if j != i and len(w) == len(v)]
        for p, j, _ in sorted((x for x in others if x[2] == y), key=lambda x: (-x[0], x[1]))[:k]:
            window = sorted((x for x in others if x[2] != y and 30 * p <= 100 * x[0] <= 90 * p), key=lambda x: (-x[0], x[1]))[:most]
            out += [(i, j, n + 1, q, p, s) for n, (s, q, _) in enumerate(window)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, y, "clash", 1) for i, v, y in rows], ROWS).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("id") % 100 == 0, **more).collect())


def vectors(n, seed, copies=0):
    r = np.random.default_rng(seed)
    rows = [(k, (r.standard_normal(8) + 0.7).round(1).astype(np.float32).astype(float).tolist(), int(r.integers(0, 3))) for k in range(n)]
    return rows + [(n + k, rows[1][1], k % 2) for k in range(copies)]


def test_hard_negatives(spark, monkeypatch):
    rows = vectors(700, 1, 400)  # a third are copies of one vector, so most scores are ties
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 1), (2100, [1.0] * 8, None), (2200, [1.0, None] + [0.5] * 6, 1), (2300, [nan] * 8, 1), (2400, [inf] * 8, 0), (None, [1.0] * 8, 1), (2500, [], 1), (2600, [0.0] * 8, 1), (2700, [1.0, 2.0, 3.0], 1), (2701, [1.0, 2.0, 2.0], 1), (2702, [0.5, 1.0, 1.0], 2)]
    rows += [rows[100], rows[100], rows[3]]  # a repeated anchor, a repeated candidate
    expected = negatives(rows)
    assert mined(spark, rows) == expected and len(expected) > 300
    monkeypatch.setattr(hard_negatives, "ROUND_BYTES", 300)  # several rounds
    monkeypatch.setattr(hard_negatives, "SIDE", 37)
    monkeypatch.setattr(hard_negatives, "ROWS", 2)
    assert mined(spark, rows) == expected


def test_hard_negatives_without_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1)]) == []
    with pytest.raises(Exception, match="2\\*\\*53"):
        mined(spark, [(0, [1e6] * 4, 1), (1, [1e6] * 4, 1)])


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def ranking(docs, items, k=10):
    held = [(i, split(t)) for i, t in docs]
    held = [(i, ws) for i, ws in held if ws]
    n, total = len(held), sum(len(ws) for _, ws in held)
    df = Counter(w for _, ws in held for w in set(ws))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, ws in held:
            tf, m = Counter(ws), 100 - 90 + (90 * len(ws) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


ITEMS = "item_id long, text string, rank string, block int"


def test_terms():
    for text in ("Ab c-D_e\x00f 9Ä ß x🙂y Z", "", "\t", "ÀÉ ıİ K 0A"):
        assert [w.decode() for w in terms_of(text.encode())] == split(text)
    assert terms_of(None) == []


def test_ranked_search(spark, docs, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    texts = [t for _, t in rows if t]
    items = [(k, t[:300]) for k, t in enumerate(texts[:25])] + [(50, None), (51, ""), (52, "?!"), (None, texts[4][:60]), (53, "unheard-of"), (54, "one"), (3, "one 日本")]
    items = spark.createDataFrame([(*x, "clash", 1) for x in items], ITEMS)
    expected = ranking(rows, [(r["item_id"], r["text"]) for r in items.collect()])

    def got():
        return sorted((tuple(r) for r in impact_index.search(*impact_index.build(docs), items).collect()), key=str)

    assert got() == expected and any(r[2] is None for r in expected)
    monkeypatch.setattr(impact_index, "SHARD", 7)
    monkeypatch.setattr(impact_index, "QUERIES", 6)
    assert got() == expected
    monkeypatch.setattr(impact_index, "POSTINGS", 50)
    assert got() == expected


def test_ranked_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame([(1, "one two", "x", 1)], ITEMS)
    assert impact_index.search(*impact_index.build(none), items).collect() == []
    assert impact_index.search(*impact_index.build(docs), items.where("false")).collect() == []


def test_bitmaps_add_and_find(monkeypatch):
    r = np.random.default_rng(2)
    maps = lambda x, bits: np.stack([np.packbits((x >> b & 1).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(bits)])
    xs = [r.integers(0, 1 << 20, 640) * (r.random(640) < 0.5) for _ in range(6)]
    total = np.zeros((40, 10), np.uint64)
    for k, x in enumerate(xs):
        impact_index.added(total, maps(x, 20), k)
    sums = sum(x << k for k, x in enumerate(xs))
    assert (total == maps(sums, 40)).all()
    for few in (sums, sums // 100_000_000, sums * 0, np.where(np.arange(640) % 200 == 3, 5, 0)):
        at, score = impact_index.highest(maps(few, 40), 10)
        best = sorted(((-s, i) for i, s in enumerate(few.tolist()) if s))[:10]
        assert list(zip((-score).tolist(), at.tolist())) == best


def leaks(docs, items):
    wins = {}
    for i, t in items:
        ws = split(t)
        for k in range(max(1, len(ws) - 9) if ws else 0):
            wins.setdefault(tuple(ws[k : k + 10]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        ws = split(t)
        hit, found = set(), set()
        for n in {len(w) for w in wins}:
            for k in range(len(ws) - n + 1):
                if (w := tuple(ws[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[w]
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark, docs, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    texts = [t for _, t in rows if t and len(t) > 300]
    items = [(k, " ".join(split(t)[k : k + 9 + k % 14])) for k, t in enumerate(texts[:30])] + [(7, texts[0][:200]), (31, texts[0][:200]), (None, texts[0][:90]), (40, None), (41, ""), (42, "one"), (43, "never seen before"), (44, "é " * 30)]
    items = spark.createDataFrame([(*x, "clash", 1) for x in items], ITEMS)
    expected = leaks(rows, [(r["item_id"], r["text"]) for r in items.collect()])

    def got():
        return sorted((tuple(r) for r in fm_index.contaminated(fm_index.build(docs), items).collect()), key=str)

    assert got() == expected and sum(r[5] for r in expected) > 20
    monkeypatch.setattr(fm_index, "WORDS", 500)
    monkeypatch.setattr(fm_index, "PIECE", 23)  # documents in many pieces
    monkeypatch.setattr(fm_index, "ROUND", 60)  # several rounds
    assert got() == expected


def test_decontamination_of_nothing(spark, docs, none):
    items = spark.createDataFrame([(1, "one two", "x", 1)], ITEMS)
    assert fm_index.contaminated(fm_index.build(none), items).collect() == []
    out = fm_index.contaminated(fm_index.build(docs), items.where("false"))
    assert out.count() == docs.count() and not out.where("contaminated or n_hit > 0 or n_items > 0").count()


def test_suffixes_and_places():
    r = np.random.default_rng(3)
    for n, kinds, documents in ((1, 1, 1), (60, 2, 3), (500, 3, 7), (3000, 40, 2)):
        text = r.integers(0, kinds, n) + documents
        text[r.choice(n - 1, documents - 1, replace=False)] = np.arange(1, documents) if documents > 1 else []
        text[-1] = 0
        used = np.unique(text)
        text = np.searchsorted(used, text)
        index = fm_index.Index(n, len(used), *fm_index.encoded(text, len(used)))
        assert (np.diff(index.first) == np.bincount(text)).all()
        for length in (1, 2, 3, 6):
            for at in r.integers(0, max(1, n - length), 30).tolist():
                phrase = text[at : at + length]
                if len(phrase) < length or (phrase < documents).any():
                    continue
                low, high = index.ranges(phrase[None])
                there = [k for k in range(n - length + 1) if (text[k : k + length] == phrase).all()]
                assert sorted(index.located(np.arange(low[0], high[0])).tolist()) == there
