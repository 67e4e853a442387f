"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Tokens are words. The network predicts a word's class of ``CLASSES``: the most frequent words of the corpus have a class each,
all others share ``OTHERS`` classes by their last two letters. It adds up a vector for each of the ``2 * SIDE`` neighbours (their
places have tables of their own; beyond the ends of a text stands class 0), takes the hyperbolic tangent, and predicts in two
steps: the group of 32 classes, then the class within the group. Within a class that words share, a word has the probability of its
spelling (a trigram model of letters in 64 codes, with the end of the word) as a share of that of its class. So every word, also one that the
corpus has once, has a conditional probability of its own: ``p(class | both sides) * p(word | class)``.

Counting and training read every document. Each task counts its words and their letters and sends one row for each distinct
one. Then documents are dealt by hash to lanes of about ``LANE`` tokens each, whose number grows with the corpus, and in
``ROUNDS`` rounds each lane trains its own copy of the network on masked tokens (``MASK`` of all positions of all its texts,
others in each round) with Adagrad steps; the copies are averaged, weighted by their tokens, in stages of 64. Lanes and
masks depend on the documents alone, so scores don't depend on how files or tasks are cut. What moves is the vocabulary counts
and the copies of the lanes, both of which grow with the corpus; the network, the list of frequent words and the letters'
counts have a fixed size.

A document's score is the sum over all its tokens of the log-probability given the tokens on both sides.

Edge cases: a null or empty text has 0 tokens, a score of 0 and no mean; texts of any length are scored whole;
repeated rows get equal scores; a null id is an id; words of equal frequency go by their hash; an empty table gives an empty
result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import cache, claim, dropped, row_key, slices, small_batches, written

GROUP = 32
CLASSES = GROUP * GROUP
OTHERS = 256
FREQUENT = CLASSES - OTHERS - 1
SIDE = 2
HIDDEN = 24
MASK = 0.15
ROUNDS = 2
BATCH = 2048
RATE = 0.15
SLICE = 4096
LANE = 1 << 20  # tokens
PLACES = 23  # bits after the point of a hidden layer when scores are made
LETTER = 6  # bits of a letter's code
LETTERS = 1 << LETTER


def sizes(hidden: int = HIDDEN, side: int = SIDE) -> dict[str, tuple[int, ...]]:
    return {"tables": (2 * side, CLASSES, hidden), "bias": (hidden,), "group": (hidden, GROUP), "group_bias": (GROUP,), "within": (GROUP, hidden, GROUP), "within_bias": (GROUP, GROUP)}


def views(flat: np.ndarray, hidden: int = HIDDEN, side: int = SIDE) -> dict[str, np.ndarray]:
    """The network's arrays as views of one flat array."""
    out, at = {}, 0
    for name, shape in sizes(hidden, side).items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(hidden: int = HIDDEN, side: int = SIDE, seed: int = 5) -> np.ndarray:
    n = sum(int(np.prod(s)) for s in sizes(hidden, side).values())
    flat = np.random.default_rng(seed).standard_normal(n).astype(np.float32) * np.float32(0.1)
    v = views(flat, hidden, side)
    for name in ("bias", "group_bias", "within_bias"):
        v[name][:] = 0
    return flat


def exponentials(x: np.ndarray) -> np.ndarray:
    """exp(x); rows with large numbers are shifted by their maximum."""
    if x.size and max(float(x.max()), -float(x.min())) > 60:
        far = np.abs(x).max(1) > 60
        x[far] -= x[far].max(1, keepdims=True)
    return np.exp(x)


def forward(net: dict, context: np.ndarray, target: np.ndarray) -> tuple:
    """log-probabilities of the targets; context: (2 * side, n) classes. Also what a training step needs: the hidden
    layer, the probabilities of groups, and, with rows in order of their group, the order, where groups begin and
    the probabilities within."""
    h = np.take(net["tables"][0], context[0], axis=0)
    for k in range(1, len(context)):
        h += np.take(net["tables"][k], context[k], axis=0)
    h += net["bias"]
    np.tanh(h, out=h)
    group, member = target // GROUP, target % GROUP
    rows = np.arange(len(target))
    first = exponentials(h @ net["group"] + net["group_bias"])
    first /= (first @ np.ones(GROUP, first.dtype))[:, None]
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(GROUP + 1)).tolist()
    sorted_h = h[order]
    x = np.empty((len(target), GROUP), h.dtype)
    for g in range(GROUP):
        a, b = cuts[g], cuts[g + 1]
        if b > a:
            np.matmul(sorted_h[a:b], net["within"][g], out=x[a:b])
            x[a:b] += net["within_bias"][g]
    second = exponentials(x)
    second /= (second @ np.ones(GROUP, second.dtype))[:, None]
    out = np.log(np.maximum(first[rows, group], 1e-30))
    out[order] += np.log(np.maximum(second[rows, member[order]], 1e-30))
    return out, h, first, order, cuts, sorted_h, second, group, member


def stepped(w: np.ndarray) -> np.ndarray:
    """Weights in steps of a power of two, so fine that sums of their products with a hidden layer in steps of 2**-PLACES have 53 bits:
    doubles add them up without rounding, in any order."""
    places = 53 - PLACES - int(np.ceil(np.log2(w.shape[-2]))) - int(np.frexp(np.abs(w).max())[1])
    return np.ldexp(np.rint(np.ldexp(w.astype(np.float64), places)), -places)


def scores(net: dict, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-probabilities that :func:`forward` gives, each of which depends on its token's context alone. On some processors kernels of
    matrix products add up in an order that hangs on how many rows come along, so the products here are exact."""
    n = len(target)
    h = np.zeros((n, net["bias"].shape[0]), np.float32)
    for k in range(len(context)):
        h += np.take(net["tables"][k], context[k], axis=0)
    h += net["bias"]
    np.tanh(h, out=h)
    h *= np.float32(2.0**PLACES)
    np.rint(h, out=h)
    h *= np.float32(2.0**-PLACES)
    group, member = target // GROUP, target % GROUP
    rows = np.arange(n)
    e = exponentials((h.astype(np.float64) @ stepped(net["group"])).astype(np.float32) + net["group_bias"])
    out = np.log(np.maximum(e[rows, group] / e.sum(1), 1e-30))
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(GROUP + 1)).tolist()
    sorted_h, within = h[order].astype(np.float64), stepped(net["within"])
    x = np.empty((n, GROUP), np.float32)
    for g in range(GROUP):
        a, b = cuts[g], cuts[g + 1]
        if b > a:
            x[a:b] = sorted_h[a:b] @ within[g]
            x[a:b] += net["within_bias"][g]
    e = exponentials(x)
    out[order] += np.log(np.maximum(e[rows, member[order]] / e.sum(1), 1e-30))
    return out


def step(net: dict, grads: dict, sums: np.ndarray, flat: np.ndarray, grad: np.ndarray, context: np.ndarray, target: np.ndarray, rate: float) -> float:
    """One Adagrad step on a batch; returns the mean log-probability before it."""
    out, h, d, order, cuts, sorted_h, e, group, member = forward(net, context, target)
    n = len(target)
    rows = np.arange(n)
    grad[:] = 0
    d[rows, group] -= 1
    d /= n
    grads["group"][:] = h.T @ d
    grads["group_bias"][:] = d.sum(0)
    dh = d @ net["group"].T
    e[rows, member[order]] -= 1
    e /= n
    back = np.empty_like(dh)
    for g in range(GROUP):
        a, b = cuts[g], cuts[g + 1]
        if b > a:
            grads["within"][g] = sorted_h[a:b].T @ e[a:b]
            grads["within_bias"][g] = e[a:b].sum(0)
            np.matmul(e[a:b], net["within"][g].T, out=back[a:b])
    dh[order] += back
    dh *= 1 - h * h
    grads["bias"][:] = dh.sum(0)
    for k in range(len(context)):
        by = np.argsort(context[k], kind="stable")
        c = context[k][by]
        starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        grads["tables"][k][c[starts]] = np.add.reduceat(dh[by], starts, axis=0)
    sums += grad * grad
    flat -= rate * grad / (np.sqrt(sums) + 1e-6)
    return float(out.mean())


def letter_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of three letters in a row, their last being each letter of each word in turn and its end; how many each
    word has). a to z have a code each, digits share one, all others share 36 by hash; 0 is the end and what is before a word."""
    text = "  ".join([*(w.decode("utf-8", "replace") for w in words), ""])
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = 28 + ((cps * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(36)
    c[(cps >= 97) & (cps <= 122)] = cps[(cps >= 97) & (cps <= 122)] - 96
    c[(cps >= 48) & (cps <= 57)] = 27
    c[cps == 32] = 0
    c = np.concatenate([[0, 0], c]).astype(np.int32)
    here, before = c[2:], c[1:-1]
    keep = (here > 0) | (before > 0)  # of the two spaces after a word the first is its end
    three = (c[:-2] << 2 * LETTER | before << LETTER | here)[keep]
    ends = np.flatnonzero(here[keep] == 0)
    return three, np.diff(ends, prepend=-1)


def shared_class(pair: np.ndarray) -> np.ndarray:
    """The class, among those that words share, of words with these codes of the last two letters."""
    return CLASSES - OTHERS + (pair.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(20)).astype(np.int32) % OTHERS


class Words:
    """Numbers of the words that a worker process has met, kept from task to task up to ``limit``; each word's hash and the
    codes of its last two letters."""

    def __init__(self, limit: int = 600_000):
        self.limit, self.generation = limit, 0
        self.clear()

    def clear(self) -> None:
        self.generation += 1
        self.known: dict[bytes, int] = {}
        self.order: list[bytes] = []
        self.hash, self.pair = np.zeros(4096, np.int64), np.zeros(4096, np.int32)

    def full(self) -> bool:
        return len(self.known) > self.limit

    def numbers(self, flat: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            absent = [flat[i] for i in missing.tolist()]
            new, n = list(dict.fromkeys(absent)), len(self.known)
            while n + len(new) > len(self.hash):
                self.hash, self.pair = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.pair))
            self.hash[n : n + len(new)] = [word_hash(w) for w in new]
            three, lens = letter_codes(new)
            self.pair[n : n + len(new)] = three[np.cumsum(lens) - 1] >> LETTER  # of the end's three, the two before it
            self.known.update(zip(new, range(n, n + len(new))))
            self.order += new
            at[missing] = np.fromiter(map(self.known.__getitem__, absent), np.int64, len(absent))
        return at


_WORDS = Words()
cache("classes", _WORDS.clear)


def met_words() -> Words:
    """The table of this worker process. Functions that travel to workers call this: a name they used directly would
    travel with them as a copy."""
    claim("classes")
    return _WORDS


class Vocabulary:
    """Classes of words and the logarithm of their share of their class, given the frequent words as (hash, codes of the last
    letters, count) in order, and the counts of three letters in a row."""

    def __init__(self, frequent: list[tuple[int, int, int]], letters: np.ndarray):
        h = np.array([x[0] for x in frequent], np.int64)
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        three = letters.reshape(LETTERS, LETTERS, LETTERS).astype(np.float64)
        one, two = three.sum((0, 1)), three.sum(0)
        low = (one + 1) / (one.sum() + LETTERS)
        middle = (two + 5 * low) / (two.sum(1, keepdims=True) + 5)
        self.spelling = np.log((three + 5 * middle) / (three.sum(2, keepdims=True) + 5)).ravel().astype(np.float32)
        # the share of all words that each shared class has, less the words with a class of their own
        ends = three[:, :, 0].ravel()
        mass = np.bincount(shared_class(np.arange(LETTERS * LETTERS)), ends, CLASSES)
        if frequent:
            mass -= np.bincount(shared_class(np.array([x[1] for x in frequent])), [x[2] for x in frequent], CLASSES)
        self.mass = np.log(np.maximum(mass, 0.5) / max(1.0, ends.sum()))
        self.generation, self.of, self.share = -1, np.zeros(0, np.int32), np.zeros(0, np.float32)

    def look(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(class, log of the share of the class) of every word of all texts on end."""
        claim("classes")
        if _WORDS.full():
            _WORDS.clear()
        at = _WORDS.numbers([w for ws in split for w in ws])
        if self.generation != _WORDS.generation:
            self.generation, self.of, self.share = _WORDS.generation, np.zeros(0, np.int32), np.zeros(0, np.float32)
        have, size = len(self.of), len(_WORDS.known)
        if size > have:
            h = _WORDS.hash[have:size]
            place = np.minimum(np.searchsorted(self.sorted, h), max(len(self.sorted) - 1, 0))
            found = self.sorted[place] == h if len(self.sorted) else np.zeros(len(h), bool)
            new = np.where(found, 1 + self.order[place] if len(self.sorted) else 0, shared_class(_WORDS.pair[have:size])).astype(np.int32)
            three, lens = letter_codes(_WORDS.order[have:size])
            spelt = np.bincount(np.repeat(np.arange(len(lens)), lens), self.spelling[three], len(lens))
            share = np.where(found, 0.0, np.minimum(spelt - self.mass[new], 0.0))
            self.of, self.share = np.concatenate([self.of, new]), np.concatenate([self.share, share.astype(np.float32)])
        return self.of[at], self.share[at]


def word_hash(word: bytes) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def words_of(texts: list[str | None]) -> list[list[bytes]]:
    return [(t or "").lower().encode("utf-8", "surrogatepass").split() for t in texts]


def contexts(ids: np.ndarray, lens: np.ndarray, side: int = SIDE) -> np.ndarray:
    """(2 * side, n) neighbours of every token: from the farthest on the left to the farthest on the right."""
    n, ends = len(ids), np.cumsum(lens)
    place = np.arange(n) - np.repeat(ends - lens, lens)
    rest = np.repeat(lens, lens) - 1 - place
    out = np.zeros((2 * side, n), np.int32)
    for k in range(1, side + 1):
        has = np.flatnonzero(place >= k)
        out[side - k, has] = ids[has - k]
        has = np.flatnonzero(rest >= k)
        out[side + k - 1, has] = ids[has + k]
    return out


def counted_words(docs: DataFrame, text: str = "text", most: int = FREQUENT) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """The ``most`` most frequent words of the corpus as (hash, codes of the last two letters, count), and the counts of all codes of
    three letters in a row, by exact counts over all documents."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, letters = met_words(), np.zeros(LETTERS**3, np.int64)

        def sent(n: np.ndarray) -> Iterator:
            at = np.flatnonzero(n)
            for k in range(0, len(at), 100_000):
                part = at[k : k + 100_000]
                three, lens = letter_codes([words.order[i] for i in part.tolist()])
                letters[:] += np.bincount(three, np.repeat(n[part], lens), LETTERS**3).astype(np.int64)
                yield pa.record_batch([pa.array(words.hash[part]), pa.array(words.pair[part]), pa.array(n[part])], names=["h", "pair", "n"])

        total = np.zeros(0, np.int64)
        for whole in batches:
            for batch in slices(whole):
                if words.full():  # pass the counts on: sums are taken later
                    yield from sent(total)
                    words.clear()
                    total = np.zeros(0, np.int64)
                n = np.bincount(words.numbers([w for ws in words_of(batch.column(0).to_pylist()) for w in ws]), minlength=len(total))
                n[: len(total)] += total
                total = n
        yield from sent(total)
        at = np.flatnonzero(letters)
        yield pa.record_batch([pa.array(at), pa.array(np.full(len(at), -1, np.int32)), pa.array(letters[at])], names=["h", "pair", "n"])

    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "h long, pair int, n long").groupBy("h", "pair").agg(F.sum("n").alias("n"))
    counts = written(counts)
    first = [(r["h"], r["pair"], r["n"]) for r in counts.where("pair >= 0").orderBy(F.desc("n"), "h").limit(most).collect()]
    known = counts.where("pair < 0").toPandas()  # at most LETTERS**3 rows
    letters = np.zeros(LETTERS**3, np.int64)
    letters[known["h"].to_numpy(np.int64)] = known["n"].to_numpy(np.int64)
    dropped(counts)
    return first, letters


def coded(docs: DataFrame, frequent: list[tuple[int, int, int]], letters: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, _k1, _k2, n_tokens, shares, ids): the classes of every document's words, 16-bit, so that training rounds and
    scoring read these rather than texts, and the sum of the logarithms of the words' shares of their classes."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((frequent, letters))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = Vocabulary(*sent.value)
        for whole in batches:
            for batch in slices(whole):
                split = words_of(batch.column(3).to_pylist())
                lens = np.array([len(ws) for ws in split], np.int64)
                ids, share = words.look(split)
                total = np.bincount(np.repeat(np.arange(len(lens)), lens), share, len(lens))
                raw, ends = ids.astype("<u2").tobytes(), np.cumsum(lens).tolist()
                data = pa.array([raw[2 * a : 2 * b] for a, b in zip([0, *ends[:-1]], ends)], pa.binary())
                yield pa.record_batch([*batch.columns[:3], pa.array(lens), pa.array(total, pa.float64()), data], names=["doc_id", "_k1", "_k2", "n_tokens", "shares", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).select("doc_id", *row_key(), "text")
    return rows.mapInArrow(run, "doc_id long, _k1 long, _k2 long, n_tokens long, shares double, ids binary")


def _classes(batch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(column)).to_pylist()), "<u2").astype(np.int32)


def train_round(rows: DataFrame, flat: np.ndarray, round_: int, lanes: int, mask: float = MASK, rate: float = RATE) -> np.ndarray:
    """The average, weighted by tokens, of the copies that all lanes trained from ``flat``. rows: as from ``coded``."""
    spark = rows.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(flat)

    def run(key, table):
        import pyarrow as pa

        lane = key[0].as_py()
        rng = np.random.default_rng([round_, lane])
        own = sent.value.copy()
        net, grad, sums, seen = views(own), np.zeros_like(own), np.full_like(own, 1e-4), 0
        grads = views(grad)
        for whole in table.sort_by([("_k1", "ascending"), ("_k2", "ascending")]).combine_chunks().to_batches():
            for batch in slices(whole, 2.0, "ids"):
                ids = _classes(batch, "ids")
                masked = np.flatnonzero(rng.random(len(ids)) < mask)
                if not len(masked):
                    continue
                around = contexts(ids, batch.column("n_tokens").to_numpy())[:, masked]
                target = ids[masked]
                order = rng.permutation(len(masked))
                for at in range(0, len(order), BATCH):
                    k = order[at : at + BATCH]
                    step(net, grads, sums, own, grad, around[:, k], target[k], rate)
                seen += len(masked)
        parts = [own[at : at + SLICE] for at in range(0, len(own), SLICE)] if seen else []
        return pa.table([pa.array(range(len(parts)), pa.int32()), pa.array([lane] * len(parts), pa.int64()), pa.array([seen] * len(parts), pa.int64()), pa.array([(p.astype(np.float64) * seen).tobytes() for p in parts], pa.binary())], names=["part", "lane", "n", "w"])

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(np.frombuffer(rows["w"].iloc[0])))
        for w in rows.sort_values("lane")["w"]:  # in order, so that the sum is the same in every run
            total += np.frombuffer(w)
        return pd.DataFrame({"part": [key[0]], "lane": [key[1]], "n": [rows["n"].sum()], "w": [total.tobytes()]})

    schema = "part int, lane long, n long, w binary"
    # a number of partitions is given as the work of a lane is more than its bytes say
    dealt = rows.where("n_tokens > 0").select("_k1", "_k2", "n_tokens", "ids", F.pmod("_k1", F.lit(lanes)).alias("lane")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lane")
    sums, left = dealt.groupBy("lane").applyInArrow(run, schema), lanes
    while left > 1:
        left = -(-left // 64)
        sums = sums.groupBy("part", F.expr("lane div 64").alias("to")).applyInPandas(added, schema)
    parts = sums.orderBy("part").collect()  # the network's size
    if not parts:
        return flat
    return np.concatenate([np.frombuffer(r["w"]) / r["n"] for r in parts]).astype(np.float32)


def trained(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The network, from all documents as ``coded`` gives them."""
    flat, tokens = initial(), rows.agg(F.sum("n_tokens")).first()[0] or 0
    for r in range(rounds):
        flat = train_round(rows, flat, r, max(1, -(-tokens // LANE)), rate=RATE / (1 + r))
    return flat


def scored(rows: DataFrame, flat: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (natural, summed), mean_log_likelihood of every coded document."""
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        net = views(sent.value)
        for whole in batches:
            for batch in slices(whole, 2.0, "ids"):
                lens, ids = batch.column(1).to_numpy(), _classes(batch, "ids")
                around = contexts(ids, lens)
                logp = np.zeros(len(ids))
                for at in range(0, len(ids), 16_384):
                    k = slice(at, at + 16_384)
                    logp[k] = scores(net, around[:, k], ids[k])
                total = np.bincount(np.repeat(np.arange(len(lens)), lens), logp, len(lens)) + batch.column(2).to_numpy()
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(total, pa.float64())], names=["doc_id", "n_tokens", "log_likelihood"])

    out = rows.select("doc_id", "n_tokens", "shares", "ids").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double")
    return out.withColumn("mean_log_likelihood", F.col("log_likelihood") / F.nullif("n_tokens", F.lit(0)))


def pseudo_likelihood(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = written(coded(docs, *counted_words(docs, text), doc_id, text))
    return scored(rows, trained(rows))
