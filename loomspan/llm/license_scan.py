"""License scans: normalised text against licence templates by the Dice coefficient of their word bigrams.

A text is normalised to words of small letters and digits, whatever its lines, and is a sequence of bigrams. The
coefficient of a window of it and a template is ``2 * common / (window + template)``, of bigrams counted as often as they
occur. It reaches ``threshold`` t only

* where the template has between ``t / (2 - t)`` and ``(2 - t) / t`` times the window's bigrams (the size bounds), and
* where the window has ``t / (2 - t)`` of the template's bigrams, so at least one of any ``1 - t / (2 - t)`` of them: a
  template is a candidate for a text only if the text has one of its rarest such bigrams (rare among templates).

For a candidate, windows of all lengths within the bounds are counted at all places where they can begin, by differences
of sums over the places of the template's bigrams; a bigram counts in a window up to as often as the template has it. The
work is thus linear in the text for a given set of templates, repeated lines included. Long templates are tried in steps of length
with a margin that covers the steps; from places where a step came near, the stretches between steps are swept that can
hold a better end than all steps have. Of overlapping windows the one
with the most bigrams in common is reported (then that of the higher coefficient, the shorter, the first), so a text is
preferred to a notice within it.

Every document is scanned whole, in a map without a shuffle; templates have a fixed size.

Edge cases: a null or empty text has no match; lines of any length count whole, and a notice inside a line is found;
repeated rows get equal results; ties of licences go by name; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import slices, small_batches
from loomspan.llm.license_templates import templates

THRESHOLD = 0.85
WORD = re.compile(r"[^\W_]+")
LICENCE = str.maketrans({"’": "'"})
STEPS = 40  # of a long template's length
SWEEP = 1 << 19  # bigrams that are swept over at once


def normal(text: str) -> list[str]:
    """Words of small letters and digits; British and American spelling agree."""
    return ["license" + w[7:] if w.startswith("licence") else w for w in WORD.findall(text.translate(LICENCE).lower())]


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


class Templates:
    """Templates with the numbers of their bigrams, and for each bigram the templates that it is a rare one of."""

    def __init__(self, pairs: list[tuple[str, str]], threshold: float = THRESHOLD):
        seen: dict = {}
        for licence, text in pairs:
            counts = bigrams(normal(text))
            if counts:
                seen.setdefault((licence, frozenset(counts.items())), counts)
        self.threshold = threshold
        self.rows = sorted(((sum(c.values()), licence, c) for (licence, _), c in seen.items()), key=lambda r: (r[0], r[1], sorted(r[2])))
        common = Counter(b for _, _, c in self.rows for b in c)
        self.ids = {b: k for k, b in enumerate(common)}
        self.rare: dict[int, list[int]] = defaultdict(list)
        for k, (n, _, c) in enumerate(self.rows):
            spare = n - self.needed(n)  # bigrams that a window can do without
            for b in sorted(c, key=lambda b: (common[b], b)):
                self.rare[self.ids[b]].append(k)
                spare -= c[b]
                if spare < 0:
                    break
        self.counts: dict[int, np.ndarray] = {}

    def needed(self, n: int) -> int:
        """Bigrams of a template of ``n`` that any match has."""
        return int(np.ceil(n * self.threshold / (2 - self.threshold) - 1e-9))

    def lengths(self, n: int) -> range:
        """Bigrams that windows may have."""
        t = self.threshold
        return range(self.needed(n), int(n * (2 - t) / t + 1e-9) + 1)

    def of(self, k: int) -> np.ndarray:
        """How often template ``k`` has each known bigram."""
        if k not in self.counts:
            if len(self.counts) > 256:
                self.counts.clear()
            out = np.zeros(len(self.ids), np.int32)
            for b, n in self.rows[k][2].items():
                out[self.ids[b]] = n
            self.counts[k] = out
        return self.counts[k]


@cache
def default_templates() -> Templates:
    return Templates(templates())


def between(at: np.ndarray, used: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray, common: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficient, length) of the best window, the shortest of equals, from each of ``starts`` to any of the bigrams after number ``low`` up to
    ``high``, given what it has in common up to ``low``. A bigram counts where the window has room for it (``used`` lies before its beginning)."""
    dice, length = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
    rows = max(1, SWEEP // max(1, int((high - low).max(initial=1))))
    for a in range(0, len(starts), rows):
        i, first, last = starts[a : a + rows], low[a : a + rows] + 1, high[a : a + rows]
        place = first[:, None] + np.arange(int((last - first).max(initial=0)) + 1)
        inside = place <= last[:, None]
        place = np.minimum(place, len(at) - 1)
        true = at[place] - at[i][:, None] + 1
        have = common[a : a + rows, None] + np.cumsum(inside & (used[place] < at[i][:, None]), axis=1)
        score = np.where(inside, 2 * have / (true + n), 0.0)
        best = np.argmax(score >= score.max(1, keepdims=True) - 1e-12, axis=1)
        pick = np.arange(len(i)), best
        dice[a : a + rows], length[a : a + rows] = score[pick], true[pick]
    return dice, length


def windows(at: np.ndarray, ids: np.ndarray, have: np.ndarray, n: int, known: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficient, begin, end) of the best window from every place on where one reaches the threshold, given the
    places ``at`` of a template's bigrams ``ids``, how often it has each (``have``), and its size."""
    t = known.threshold
    # the place from which on a bigram's own count is not yet used up, when a window begins after it
    order = np.lexsort((at, ids))
    s, times = ids[order], have[order]
    first = np.searchsorted(s, s)
    back = np.arange(len(s)) - times
    used = np.full(len(at), -1, np.int64)
    ok = back >= first
    used[order[ok]] = at[order[back[ok]]]
    best, length = np.zeros(len(at)), np.zeros(len(at), np.int64)

    def tried(size: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Coefficients and lengths, up to their last bigram of the template, of the windows of ``size`` at ``starts``; the numbers of these
        bigrams, and what the windows have in common with the template."""
        low = np.searchsorted(at, np.maximum(used, at - size), "right")  # a bigram counts in windows that begin from here to itself
        sums = np.bincount(low, minlength=len(at) + 1)[: len(at)].cumsum() - np.arange(len(at))
        stop = np.searchsorted(at, at[starts] + size) - 1
        true = at[stop] - at[starts] + 1
        return 2 * sums[starts] / (true + n), true, stop, sums[starts]

    every = np.arange(len(at))
    lengths = known.lengths(n)
    step = max(1, n // STEPS)
    margin = 0.0 if step == 1 else 1.5 * step / n
    near = np.zeros(len(at), bool)
    sizes = [*range(lengths.start, lengths.stop, step), lengths.stop - 1]
    for size in sizes:
        dice, true, _, _ = tried(size, every)
        better = (dice > best + 1e-12) | ((dice > best - 1e-12) & (true < length))
        better &= dice >= t - 1e-12
        best[better], length[better] = dice[better], true[better]
        near |= dice >= t - margin
    starts = np.flatnonzero(near) if step > 1 else every[:0]
    if len(starts):
        _, short, low, least = tried(sizes[0], starts)
        for size in sizes[1:]:
            _, true, high, most = tried(size, starts)
            # what lies between two steps can't be better than all of the longer's bigrams in little more than the shorter's length
            some = np.flatnonzero((high > low) & (2 * most / (short + 1 + n) >= np.maximum(best[starts], t) - 1e-12))
            if len(some):
                at_ = starts[some]
                dice, true_ = between(at, used, at_, low[some], high[some], least[some], n)
                better = ((dice > best[at_] + 1e-12) | ((dice > best[at_] - 1e-12) & (true_ < length[at_]))) & (dice >= t - 1e-12)
                best[at_[better]], length[at_[better]] = dice[better], true_[better]
            short, low, least = true, high, most
    found = np.flatnonzero(length)
    return best[found], at[found], at[found] + length[found]


def scan(text: str | None, known: Templates | None = None) -> list[tuple[int, int, str, float]]:
    """(first line, last line, licence, coefficient) of the matches in a text, in its order."""
    known = known or default_templates()
    if not text:
        return []
    lines = [normal(x) for x in text.split("\n")]
    words = [w for ws in lines for w in ws]
    get = known.ids.get
    ids = np.fromiter((get(b, -1) for b in zip(words, words[1:])), np.int64, max(0, len(words) - 1))
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return []
    ids = ids[at]
    met = np.bincount(ids, minlength=len(known.ids))
    some = {k for b in np.flatnonzero(met).tolist() for k in known.rare.get(b, ())}
    rows = []
    for k in sorted(some):
        n, of = known.rows[k][0], known.of(k)
        if int(np.minimum(met, of).sum()) < known.needed(n):
            continue
        mine = np.flatnonzero(of[ids] > 0)
        dice, begin, end = windows(at[mine], ids[mine], of[ids[mine]], n, known)
        rows.append((dice, begin, end, np.full(len(dice), k), np.rint(dice * (end - begin + n) / 2)))
    if not rows:
        return []
    dice, begin, end, which, common = map(np.concatenate, zip(*rows))
    line = np.repeat(np.arange(len(lines)), [len(ws) for ws in lines])
    out, taken = [], np.zeros(len(words), bool)
    for k in np.lexsort((which, begin, end - begin, -np.round(dice, 12), -common)).tolist():
        a, b = int(begin[k]), int(end[k])  # bigrams a to b - 1 are the words a to b
        if not taken[a] and not taken[b] and not taken[a : b + 1].any():
            taken[a : b + 1] = True
            out.append((a, int(line[a]), int(line[b]), known.rows[int(which[k])][1], float(dice[k])))
    return [x[1:] for x in sorted(out)]


def matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, matches: array of (first_line, last_line, license, dice) of every row. ``pairs``: (licence, text) of the
    templates, by default those of this package."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(pairs or templates())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("first_line", pa.int32()), ("last_line", pa.int32()), ("license", pa.string()), ("dice", pa.float64())]))
        known = prepared(sent.value, threshold)
        for whole in batches:
            for batch in slices(whole):
                got = [[dict(zip(("first_line", "last_line", "license", "dice"), m)) for m in scan(t, known)] for t in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(got, kind)], names=["doc_id", "matches"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, matches array<struct<first_line:int,last_line:int,license:string,dice:double>>")


_PREPARED: list = []


def prepared(pairs: list[tuple[str, str]], threshold: float) -> Templates:
    """The templates of the scan that a worker process is at."""
    key = threshold, len(pairs), hash(tuple(pairs))
    if not _PREPARED or _PREPARED[0] != key:
        _PREPARED[:] = [key, Templates(pairs, threshold)]
    return _PREPARED[1]


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_matches, and the best match (the highest coefficient, then the first line)."""
    best = F.expr("get(array_sort(matches, (a, b) -> CASE WHEN a.dice > b.dice THEN -1 WHEN a.dice < b.dice THEN 1 ELSE a.first_line - b.first_line END), 0)")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), best.alias("b")).select("doc_id", "n_matches", F.col("b.license").alias("license"), F.col("b.dice").alias("dice"), F.col("b.first_line").alias("first_line"), F.col("b.last_line").alias("last_line"))
