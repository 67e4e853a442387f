import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import ftrl, kneser_ney, masked_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    three = list(zip(words, words[1:], words[2:]))
    n = Counter(three)
    inside = {k for i, w in enumerate(three) if n[w] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_base_counts():
    for t in (None, "", "a b c a b c a b c", "a a a a", "x\n\nx\n \nx", "a b # |", "a\x1cb c", "a b c d a b c"):
        assert kneser_ney.base_counts(t) == by_hand(t)


def slow_model(counts: dict) -> dict:
    """Interpolated modified Kneser-Ney probabilities of the counted 4-grams, straight from the definition."""
    split = lambda code, n: tuple(code >> 5 * (n - 1 - k) & 31 for k in range(n))
    tables = {4: {split(c, 4): n for c, n in counts.items()}}
    for order in (3, 2, 1):
        tables[order] = Counter(g[1:] for g in tables[order + 1])

    def discount(table):
        n = [sum(1 for v in table.values() if v == k) for k in range(5)]
        if not n[1] or not n[2]:
            return lambda c: [0, 0.5, 0.75, 0.9][min(c, 3)]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0.0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 0.9]
        return lambda c: [0.0, *(min(max(x, 0.1), k + 0.9) for k, x in enumerate(d[1:]))][min(c, 3)]

    cut = {o: discount(t) for o, t in tables.items()}

    def p(gram):
        if not gram:
            return 1 / 32
        table = tables[len(gram)]
        after = {g: n for g, n in table.items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return p(gram[1:])
        c = table.get(gram, 0)
        weight = sum(cut[len(gram)](n) for n in after.values()) / total
        return max(c - cut[len(gram)](c), 0) / total + weight * p(gram[1:])

    return p


def test_model_follows_the_definition():
    texts = ["the cat sat on the mat.", "a cat, a hat; the bat!", "ééé 12 ##"]
    codes, _ = kneser_ney.grams(texts)
    seen, n = np.unique(codes, return_counts=True)
    model = kneser_ney.Model(*kneser_ney.fit(seen, n))
    p = slow_model(dict(zip(seen.tolist(), n.tolist())))
    unseen, _ = kneser_ney.grams(["zebra quux", "the dog sat"])
    for c in np.unique(np.concatenate([seen, unseen])).tolist():
        gram = tuple(c >> 5 * (3 - k) & 31 for k in range(4))
        assert abs(2.0 ** model.log2(np.array([c], np.uint32))[0] - p(gram)) < 1e-5
    assert (np.diff(kneser_ney.fit(seen, n)[0].astype(np.int64)) >= 0).all()


def test_quality_rows(spark, docs, none):
    got = kneser_ney.quality(docs)
    assert got.count() == docs.count()
    facts = got.join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in facts:
        n = tuple(r[f"_q_{c}"] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert n == by_hand(r["text"])
        assert r["_q_base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["_q_base_failed"] and r["_q_kept"])
    kept = kneser_ney.filtered(docs)
    assert kept.columns == docs.columns
    assert kept.count() == got.where("_q_kept").count() > 20
    assert kneser_ney.quality(none).count() == kneser_ney.filtered(none).count() == 0


def test_noise_falls_outside_the_bands(spark):
    r = np.random.default_rng(3)
    syllables = ["the", "in", "er", "an", "re", "on", "at", "en"]
    prose = lambda: " ".join("".join(r.choice(syllables, r.integers(1, 4))) for _ in range(120))
    rows = [(i, prose(), "en") for i in range(200)] + [(900, " ".join("".join(r.choice(list("xqzjk#$%"), 6)) for _ in range(120)), "en")]
    got = {x["doc_id"]: x["_q_kept"] for x in kneser_ney.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[900] and sum(got.values()) > 190


def test_small_languages_keep_their_documents(spark):
    r = np.random.default_rng(4)
    prose = lambda parts: " ".join("".join(r.choice(parts, r.integers(1, 4))) for _ in range(120))
    rows = [(i, prose(["the", "in", "er", "an"]), "en") for i in range(200)] + [(500 + i, prose(list("abcdefghijklmnopqrstuvwxyz")), "xx") for i in range(10)]
    got = kneser_ney.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(x["_q_kept"] for x in got if x["lang"] == "xx")


def test_every_language_has_its_own_model(spark):
    r = np.random.default_rng(6)
    rows = [(20 * k + i, " ".join("".join(r.choice(list("abcdefghijklmnopqrstuvwxyz")[k : k + 4], 4)) for _ in range(60 + (k < 18))), f"l{k}") for k in range(20) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    letters = kneser_ney.alphabets(docs)
    models = kneser_ney.build_models(kneser_ney.count_grams(docs, letters))
    assert set(models) == {f"=l{k}" for k in range(20)}
    assert sum(isinstance(m, str) for m in models.values()) == 20 - kneser_ney.MODEL_LANGUAGES
    bits = {x["doc_id"]: x["_q_bits"] for x in kneser_ney.annotate(docs, letters, models, ["doc_id"]).collect()}
    for k in range(20):
        mine = [(i, t) for i, t, x in rows if x == f"l{k}"]
        codes, lens = kneser_ney.grams([t for _, t in mine], kneser_ney.classes(letters[f"l{k}"]))
        own = kneser_ney.Model(*kneser_ney.fit(*np.unique(codes, return_counts=True)))
        for (i, _), b in zip(mine, np.add.reduceat(own.log2(codes), np.cumsum(lens) - lens) / lens):
            assert abs(bits[i] + b) < 1e-5
    few = kneser_ney.Models(models, mb=0.1)  # no more than one at a time
    written = [k for k, m in models.items() if isinstance(m, str)]
    for k in written * 2:
        assert len(few[k].keys) and len(few.read) == 1


def test_letters_of_other_scripts(spark):
    """Clean Cyrillic text stays, and text of the same letters at random goes; letters are the most used of a language."""
    r = np.random.default_rng(13)
    syllables = ["про", "ста", "ни", "ко", "ве", "ра", "то", "ли", "на", "ем"]
    letters = list("абвгдежзийклмнопрстуфхцчшщъыьэюя")
    prose = lambda: " ".join("".join(r.choice(syllables, r.integers(1, 4))) for _ in range(120))
    rows = [(i, prose(), "ru") for i in range(200)] + [(900, " ".join("".join(r.choice(letters, 6)) for _ in range(120)), "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n = Counter(c for _, t, _ in rows for c in kneser_ney.unicodedata.normalize("NFD", t) if c.isalpha())
    expected = sorted(sorted(n, key=lambda c: (-n[c], c))[: kneser_ney.LETTERS])
    assert [chr(c) for c in kneser_ney.alphabets(docs)["ru"]] == expected
    got = {x["doc_id"]: x["_q_kept"] for x in kneser_ney.quality(docs).collect()}
    assert not got[900] and sum(got.values()) > 190


def test_bands_by_hand(spark):
    """Medians, spreads and verdicts of two languages and one that is too small for a band."""
    r = np.random.default_rng(14)
    rows = [(i, lang, bool(i % 7 == 0), float(x)) for lang, n, at in (("en", 301, 2.2), (None, 101, 1.9), ("fr", kneser_ney.MIN_DOCS - 1, 2.0)) for i, x in enumerate(r.normal(at, 0.05 + (np.arange(n) % 20 == 0), n))]
    rows += [(5000, "en", False, None)]
    facts = spark.createDataFrame(rows, "doc_id long, lang string, _q_base_failed boolean, _q_bits double")
    band = kneser_ney.bands(facts).collect()
    got = sorted((str(x["lang"]), x["doc_id"], x["_q_kept"]) for x in kneser_ney.verdict(facts, band).collect())
    expected, limits = [], {}
    for lang in ("en", None, "fr"):
        good = np.sort([b for _, x, failed, b in rows if x == lang and not failed and b is not None])
        if len(good) < kneser_ney.MIN_DOCS:
            limits[lang] = -np.inf, np.inf
            continue
        mid = good[(len(good) - 1) // 2]  # the least value with half of all at or below it
        off = np.sort(abs(good - mid))
        spread = max(1.4826 * off[(len(off) - 1) // 2], kneser_ney.FLOOR) * kneser_ney.WIDTH
        limits[lang] = mid - spread, mid + spread
        found = next(x for x in band if x["lang"] == ("null" if lang is None else "=" + lang))
        assert abs(found["low"] - limits[lang][0]) < 1e-9 and abs(found["high"] - limits[lang][1]) < 1e-9
    assert len(band) == 2
    for d, lang, failed, b in rows:
        expected.append((str(lang), d, not failed and b is not None and limits[lang][0] <= b <= limits[lang][1]))
    assert got == sorted(expected) and any(not k for _, _, k in got)


def test_classifier_learns_and_holds_out(spark, none):
    r = np.random.default_rng(5)
    words = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows = []
    for i in range(400):
        good = i % 3 > 0
        text = " ".join(w if good or r.random() < 0.4 else w.upper() + "!!" for w in r.choice(words, 60))
        rows.append((i, text, int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in ftrl.classify(docs, labels).collect()}
    assert len(got) == 402
    for i, _, y in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    test = [(got[i]["score"], y) for i, _, y in rows if got[i]["held_out"]]
    assert np.mean([(s >= 0.5) == y for s, y in test]) > 0.9
    assert got[None]["held_out"] is False and 0 <= got[999]["score"] <= 1
    assert ftrl.classify(none, labels).count() == 0
    assert {x["score"] for x in ftrl.classify(docs, labels.limit(0)).collect()} == {0.5}


def slow_features(text: str, bits: int) -> dict:
    """Places and values of a text's features, straight from the definition."""
    import re as regex

    import xxhash

    def mixed(x: int) -> int:
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    def shape(w: str) -> str:
        w = regex.sub(r"[^\W\d_a-zß-öø-ÿ]{2,}", "X", w)
        return regex.sub(r"\d+", "9", regex.sub(r"[^\W\d_A-ZÀ-ÖØ-Þ]+", "x", w))

    split = text.split()
    one = [xxhash.xxh3_64_intdigest(w.lower()) for w in split]
    form = [xxhash.xxh3_64_intdigest("\x00" + shape(w)) for w in split]
    form = [f ^ 0x5BD1E995 if k and one[k] == one[k - 1] else f for k, f in enumerate(form)]
    n = Counter()
    for stream, row in ((1, one), (2, form)):
        n.update(mixed((h + stream) % 2**64) >> 64 - bits for h in row)
        n.update(mixed((mixed((a + stream) % 2**64) * 0xC2B2AE3D27D4EB4F + b + 0x9E3779B97F4A7C15) % 2**64) >> 64 - bits for a, b in zip(row, row[1:]))
    values = {k: 1 + np.log(c) for k, c in n.items()}
    norm = sum(v * v for v in values.values()) ** 0.5
    return {k: v / norm for k, v in values.items()}


def test_features_and_training_follow_the_definition():
    texts = ["The cat sat on the the mat, THE END!!", "Ärger über 12 Mäuse 2024 x", "a" * 40 + "B" * 30 + " " + "a" * 40 + "c" * 30, "one", ""]
    row, place, value = ftrl.features(texts, 14)
    for k, t in enumerate(texts):
        assert dict(zip(place[row == k].tolist(), value[row == k].round(9).tolist())) == {p: round(v, 9) for p, v in slow_features(t, 14).items()}
    long = [ftrl.shape("Aa!" * 9 + tail) for tail in ("x", "9")]
    assert long[0] != long[1]  # shapes of long words are told apart to their end
    rows = [(place[row == k].astype(np.int32), value[row == k], k % 2) for k in range(4)]
    z, n = Counter(), Counter()
    weight = lambda k: 0.0 if abs(z[k]) <= ftrl.L1 else -(z[k] - np.sign(z[k]) * ftrl.L1) / ((ftrl.BETA + n[k] ** 0.5) / ftrl.ALPHA + ftrl.L2)
    for _ in range(3):
        for places, values, label in rows:
            x = dict(zip([*places.tolist(), 1 << 14], [*values.tolist(), 1.0]))
            w = {k: weight(k) for k in x}
            p = 1 / (1 + np.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - label) * v
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / ftrl.ALPHA * w[k]
                n[k] += g * g
    got = ftrl.train(rows, 14, 3)
    assert all(abs(got[k] - weight(k)) < 1e-9 for k in range((1 << 14) + 1) if got[k] or z[k])


def test_classifier_takes_all_kinds_of_rows(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 0), (3, 1)], "doc_id long, quality int")
    got = ftrl.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    again = ftrl.classify(docs.repartition(5), labels).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in got) == sorted((str(r["doc_id"]), r["score"]) for r in again)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"a b {'c' if i % 2 else 'd'} e") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    other = labels.withColumn("quality", F.when(ftrl.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(ftrl.fitted(docs, labels), ftrl.fitted(docs, other))


def code_of(ch: str) -> int:
    cp = ord(ch)
    return cp - 96 if "a" <= ch <= "z" else 27 if "0" <= ch <= "9" else 28 + (cp * 2654435761 % 2**32 >> 16) % 36


def spelling(counts: dict, word: str) -> float:
    """log-probability of a word's letters and its end, straight from the counts of three in a row."""
    n1, n2, n2c, n3c = Counter(), Counter(), Counter(), Counter()
    for (a, b, c), n in counts.items():
        n1[c] += n
        n2[b, c] += n
        n2c[b] += n
        n3c[a, b] += n
    total, last = 0.0, (0, 0)
    for c in [*map(code_of, word), 0]:
        low = (n1[c] + 1) / (sum(n1.values()) + 64)
        middle = (n2[last[1], c] + 5 * low) / (n2c[last[1]] + 5)
        total += np.log((counts.get((*last, c), 0) + 5 * middle) / (n3c[last] + 5))
        last = last[1], c
    return total


def class_of(word: str) -> int:
    pair = ([0, 0, *map(code_of, word)])[-2:]
    return masked_lm.CLASSES - masked_lm.OTHERS + ((pair[0] * 64 + pair[1]) * 2654435761 % 2**32 >> 20) % masked_lm.OTHERS


def slow_log_likelihood(text: str, frequent: list, words: Counter, letters: dict, flat: np.ndarray) -> float:
    net, split = masked_lm.views(flat), text.lower().split()
    known = {w: 1 + k for k, w in enumerate(frequent)}
    ids = [known.get(w) or class_of(w) for w in split]
    shared, total, everything = Counter(), 0.0, sum(words.values())
    for w, n in words.items():
        if w not in known:
            shared[class_of(w)] += n
    for i, target in enumerate(ids):
        around = [ids[j] if 0 <= j < len(ids) else 0 for j in (i - 2, i - 1, i + 1, i + 2)]
        h = np.tanh(sum(net["tables"][k][c] for k, c in enumerate(around)) + net["bias"])
        for x, at in ((h @ net["group"] + net["group_bias"], target // 32), (h @ net["within"][target // 32] + net["within_bias"][target // 32], target % 32)):
            total += x[at] - np.log(np.exp(x).sum())
        if split[i] not in known:
            total += min(0.0, spelling(letters, split[i]) - np.log(shared[target] / everything))
    return total


def corpus(docs) -> tuple[Counter, dict]:
    """Counts of all words and of all letters three in a row."""
    words = Counter(w for r in docs.collect() for w in (r["text"] or "").lower().replace("\x0b", " ").split())
    letters = Counter()
    for w, n in words.items():
        codes = [0, 0, *map(code_of, w), 0]
        for three in zip(codes, codes[1:], codes[2:]):
            letters[three] += n
    return words, dict(letters)


def test_scores_match_the_formula_and_training_helps(spark, docs, none, monkeypatch):
    monkeypatch.setattr(masked_lm, "FREQUENT", 120)
    frequent, letters = masked_lm.counted_words(docs, most=120)
    words, three = corpus(docs)
    by_hash = {masked_lm.word_hash(w.encode()): w for w in words}
    coded = masked_lm.coded(docs, frequent, letters).cache()
    flat = masked_lm.trained(coded)
    rows = masked_lm.scored(coded, flat).collect()
    assert len(rows) == docs.count()
    text = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 12 or doc_id > 129").collect()}
    checked = 0
    for r in rows:
        if r["doc_id"] in text and r["n_tokens"] < 200:
            checked += 1
            assert abs(r["log_likelihood"] - slow_log_likelihood(text[r["doc_id"]] or "", [by_hash[h] for h, _, _ in frequent], words, three, flat)) < 2e-2
    assert checked > 8
    before = masked_lm.scored(coded, masked_lm.initial()).agg(F.sum("log_likelihood")).first()[0]
    assert sum(r["log_likelihood"] for r in rows) > before
    assert masked_lm.pseudo_likelihood(none).count() == 0


def test_scores_do_not_depend_on_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(masked_lm, "LANE", 1500)  # tens of lanes
    got = [sorted((str(r["doc_id"]), r["n_tokens"], r["log_likelihood"]) for r in masked_lm.pseudo_likelihood(docs.repartition(n)).collect()) for n in (1, 7, 50)]
    for other in got[1:]:
        assert np.allclose([x[2] for x in got[0]], [x[2] for x in other], rtol=1e-9, atol=1e-9) and [x[:2] for x in got[0]] == [x[:2] for x in other]


KERNELS = """
import numpy as np
from loomspan.llm import masked_lm as m
r = np.random.default_rng(1)
flat = m.initial() + r.standard_normal(len(m.initial())).astype(np.float32) * np.float32(0.3)
ids = (r.zipf(1.2, 6000) % m.CLASSES).astype(np.int32)
around = m.contexts(ids, np.array([len(ids)]))
def scores(cuts):
    return np.concatenate([m.scores(m.views(flat), around[:, a:b], ids[a:b]) for a, b in zip(cuts, cuts[1:])])
whole = scores([0, len(ids)])
for k in (1, 7, 300):
    assert (scores([0, *sorted(r.choice(np.arange(1, len(ids)), k, replace=False).tolist()), len(ids)]) == whole).all(), k
assert abs(whole - m.forward(m.views(flat), around, ids)[0]).max() < 1e-4
"""


@pytest.mark.parametrize("kernel", ["", "Haswell", "Nehalem"])
def test_scores_do_not_depend_on_the_kernel(kernel):
    """Kernels of matrix products that other processors have: a token's score is the same whatever tokens come with it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", KERNELS], cwd=root, env=os.environ | {"OPENBLAS_CORETYPE": kernel, "OMP_NUM_THREADS": "1"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_words_of_one_class_are_told_apart(spark):
    """Of two texts that differ in a rare word only, that with the odder spelling scores less."""
    r = np.random.default_rng(3)
    parts = ["ka", "to", "mi", "re", "su", "no"]
    rows = [(i, " ".join("".join(r.choice(parts, int(r.integers(2, 5)))) for _ in range(80))) for i in range(60)]
    rows += [(100, "kato mire sunokamino toka mire"), (101, "kato mire xqzwvjjpkmino toka mire")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    coded = masked_lm.coded(df, *masked_lm.counted_words(df, most=20))
    got = {x["doc_id"]: x["log_likelihood"] for x in masked_lm.scored(coded, masked_lm.trained(coded)).collect()}
    assert got[101] < got[100] - 10


def test_word_counts_are_exact(spark, docs):
    words, three = corpus(docs)
    got, letters = masked_lm.counted_words(docs, most=50)
    order = sorted(((masked_lm.word_hash(w.encode()), c) for w, c in words.items()), key=lambda x: (-x[1], x[0]))
    assert [(h, n) for h, _, n in got] == order[:50]
    assert {(k >> 12, k >> 6 & 63, k & 63): int(letters[k]) for k in np.flatnonzero(letters).tolist()} == three


def test_every_character_has_its_gram(spark):
    """Letters beyond those with a class of their own, scripts, signs and code points above 65,535 included."""
    texts = ["aà" * 40, "的一是不了" * 30, "".join(chr(c) for c in range(0x4E00, 0x4E00 + 300)), "😀 x\n", "", None]
    df = spark.createDataFrame([(t, "zh" if i % 2 else None) for i, t in enumerate(texts)], "text string, lang string")
    n = kneser_ney.count_grams(df, kneser_ney.alphabets(df)).selectExpr("sum(n)").first()[0]
    assert n == sum(len(t or "") for t in texts)
