"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

A word gives two tokens: itself in lower case, and its shape (runs of capitals, small letters and digits, with
other characters as they stand; ``=`` where the word before is the same). Features are the hashed uni- and
bigrams of both token rows in ``2**BITS`` places, weighted 1 + log(count) and scaled to length 1 for each row;
a score is the logistic function of a sparse dot product.

Training (FTRL-Proximal, McMahan et al. 2013) reads at most ``SAMPLE`` labelled documents, the first by hash of
their ids, in ``EPOCHS`` passes in that order; weights are thus the same in every run. Scoring covers every
document and is a map without a shuffle. Rows of the held-out fold never train.

Edge cases: a null or empty text has the bias alone as its score; very long texts are scored whole; labels that are null are
passed over; an id with several labels trains once for each, one with several texts on that of the least hash, so that training
never has more than ``SAMPLE`` rows; repeated rows get equal scores; without any label the weights are 0 and scores 0.5; a null
id is not held out; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.chosen_path import P1, P2, mix
from loomspan.llm.common import cache, claim, slices, small_batches

BITS = 18
SAMPLE = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.1, 0.02
FOLDS = 5
PREDICT = 0.3

UPPER, LOWER, DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]{2,}"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")
_TOKENS: dict[bytes, tuple[int, int]] = {}
cache("features", _TOKENS.clear)


def shape(word: str) -> str:
    if word.isascii() and word.isalpha() and word.islower():
        return "x"
    return DIGIT.sub("9", LOWER.sub("x", UPPER.sub("X", word)))


def _token(word: bytes) -> tuple[int, int]:
    import xxhash

    text = word.decode("utf-8", "replace")
    return xxhash.xxh3_64_intdigest(text.lower()), xxhash.xxh3_64_intdigest("\x00" + shape(text))


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of all features, by row and place."""
    claim("features")
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    flat = [w for ws in split for w in ws]
    if len(_TOKENS) > 500_000:
        _TOKENS.clear()
    for w in set(flat):
        if w not in _TOKENS:
            _TOKENS[w] = _token(w)
    both = np.array([_TOKENS[w] for w in flat], np.uint64).reshape(-1, 2)
    row = np.repeat(np.arange(len(split)), [len(ws) for ws in split])
    word, form = both[:, 0], both[:, 1].copy()
    same = row[1:] == row[:-1]
    form[1:][same & (word[1:] == word[:-1])] ^= np.uint64(0x5BD1E995)
    parts, rows = [], []
    for stream, one in ((np.uint64(1), word), (np.uint64(2), form)):
        parts += [mix(one + stream), mix(mix(one[:-1] + stream) * P2 + one[1:] + P1)[same]]
        rows += [row, row[1:][same]]
    place = np.concatenate(parts) >> np.uint64(64 - bits)
    key, n = np.unique(np.concatenate(rows).astype(np.int64) << bits | place.astype(np.int64), return_counts=True)
    row, place, value = key >> bits, key & ((1 << bits) - 1), 1 + np.log(n)
    norm = np.sqrt(np.bincount(row, value * value, len(split)))
    return row, place, value / norm[row]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) from (places, values, label) rows, in the order given."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for _ in range(epochs):
        for places, values, label in rows:
            at, x = np.append(places, 1 << bits), np.append(values, 1.0)
            zi, ni = z[at], n[at]
            w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2) * (np.abs(zi) > L1)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            grown = ni + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[at] = grown
    return -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2) * (np.abs(z) > L1)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from at most ``sample`` labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out("doc_id"))
    chosen = chosen.withColumn("h", F.xxhash64("doc_id", F.lit(17))).orderBy("h", "doc_id", "label").limit(sample)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # at most `sample` rows of three numbers
    rows = texts.join(F.broadcast(chosen.distinct()), "doc_id").groupBy("h", "doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = []
        for whole in batches:
            for batch in slices(whole):
                row, place, value = features(batch.column(3).to_pylist(), bits)
                cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
                for k, (a, b, y) in enumerate(zip(cuts[:-1], cuts[1:], batch.column(2).to_pylist())):
                    held.append((place[a:b].astype(np.int32), value[a:b].astype(np.float32), y))
        w = train(held, bits, epochs).astype(np.float32)
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(w[at])], names=["place", "w"])

    ordered = rows.repartition(1).sortWithinPartitions("h", "doc_id", "label", F.xxhash64("text"))
    got = ordered.mapInArrow(run, "place long, w float").toPandas()
    w = np.zeros((1 << bits) + 1, np.float32)
    w[got["place"].to_numpy(np.int64)] = got["w"].to_numpy(np.float32)
    return w


def scores(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        w = sent.value
        for whole in batches:
            for batch in slices(whole):
                row, place, value = features(batch.column(1).to_pylist(), bits)
                margin = w[-1] + np.bincount(row, value * w[place], batch.num_rows)
                score = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
                yield pa.record_batch([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    return scores(docs, fitted(docs, labels, doc_id, text, label), doc_id, text)
