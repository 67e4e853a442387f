"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text places chunk ends, so that texts which share a passage share its chunks wherever the
passage stands. A worker encodes a chunk once and keeps the ids of its chunks
across documents and tasks (in two generations of a bounded size, of which the older one goes when the newer is full, and what
was used again moves to the newer). Within a chunk, words are looked up in a table of words; those that are not there yet are encoded by
the tokenizers library, many at a time, and odd ones with the text around them. The ids are those of the chunk as a text of its own.

A chunk mostly ends inside a word, where its ids are not those of the whole text. At every join some bytes to the left, to
the right, and both together are encoded anew. The join is repaired if these bytes begin and end with a whole word, and the ids of the
two parts agree with the end of the ids of the left chunk and the beginning of those of the right one: then the ids of both
together take their place, as the vocabulary's splitting rule joins nothing across white space. Else the window is doubled until they do;
a text in which windows meet or can't agree is encoded whole.

Edge cases: a null text counts as empty; an empty text has no ids and decodes to ""; texts of any length
are encoded whole, those without white space as one chunk; repeated rows and ties give equal rows; an empty table gives an
empty result; columns other than the two named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import cache, claim, slices, small_batches
from loomspan.llm.wordtable import WordTable, default_vocabulary, word_table

WINDOW = 32  # bytes that the rolling hash sees
GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
SPACE = b" \t\n\r\x0b\x0c"
JOIN = 16  # bytes on each side of a join that are tried first


def chunk_ends(data: bytes, starts: np.ndarray, bits: int = 10) -> np.ndarray:
    """Ends of chunks in texts laid on end in ``data``: where the high ``bits`` bits of a gear hash of the last
    32 bytes are 0, at a character's end, and at every text's end. Chunks have 2**bits bytes in the mean and a quarter of that at
    least, but for whole texts."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    h, span = GEAR[b], 1
    while span < WINDOW:  # the hash of 2n bytes is made of two hashes of n bytes
        h2 = h.copy()
        h2[span:] += h[:-span] << np.uint32(span) if span < len(h) else 0
        h, span = h2, span * 2
    # the high bits depend on all 32 bytes
    hit = (h >> np.uint32(32 - bits)) == 0
    ends = np.flatnonzero(hit) + 1
    ends = ends[ends < len(b)]
    ends = ends[(b[ends] & 0xC0) != 0x80]
    text = np.searchsorted(starts, ends, "right") - 1
    stops = np.append(starts[1:], len(b))
    least, out, last, now = max(WINDOW, 1 << bits >> 2), [], 0, -1
    for e, k, begin, stop in zip(ends.tolist(), text.tolist(), starts[text].tolist(), stops[text].tolist()):
        if k != now:
            now, last = k, begin
        if e - last >= least and stop - e >= least:
            out.append(e)
            last = e
    return np.unique(np.concatenate([np.array(out, np.int64), stops]))


class ChunkEncoder:
    """Ids of chunks, up to about ``limit_bytes`` of memory."""

    def __init__(self, table: WordTable, bits: int = 10, limit_bytes: int = 48_000_000, memo: bool = True):
        self.table, self.memo = table, memo
        self.bits, self.limit = bits, limit_bytes // 2
        self.new: dict[bytes, np.ndarray] = {}
        self.old: dict[bytes, np.ndarray] = {}
        self.bytes = self.reused = self.encoded = self.joined = self.widened = self.whole = 0

    def library(self, parts: list[bytes]) -> list[np.ndarray]:
        """The library's ids of each part as a text of its own, pieces of words at its ends included; with ``memo`` it sees no
        word or piece twice."""
        if not self.memo:
            return [np.array(x, np.int32) for x in self.table.library([p.decode("utf-8", "replace") for p in parts])]
        split = [p.split() for p in parts]
        ids, lens = self.table.encode([w for ws in split for w in ws])
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum([len(ws) for ws in split], dtype=np.int64)]).astype(np.int64)].tolist()
        return [ids[a:b].copy() for a, b in zip(ends, ends[1:])]

    def _load(self, parts: list[bytes]) -> dict[bytes, np.ndarray]:
        """Ids of all chunks; those that aren't kept are encoded."""
        out, missing = {}, {}
        for p in parts:
            if p in out or p in missing:
                self.reused += 1
                continue
            ids = self.new.get(p)
            if ids is None:
                ids = self.old.get(p)
                if ids is not None:
                    self._keep(p, ids)
            if ids is None:
                missing[p] = None
            else:
                self.reused += 1
                out[p] = ids
        self.encoded += len(missing)
        for p, ids in zip(missing, self.library(list(missing))):
            out[p] = ids
            self._keep(p, ids)
        return out

    def _keep(self, part: bytes, ids: np.ndarray) -> None:
        size = len(part) + ids.nbytes + 250
        if self.bytes + size > self.limit:
            self.old, self.new, self.bytes = self.new, {}, 0
        self.new[part] = ids
        self.bytes += size

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        full = [k for k, r in enumerate(raw) if r]
        out = [np.zeros(0, np.int32) for _ in raw]
        if not full:
            return out
        data = b"".join(raw)
        starts = np.cumsum([0, *[len(raw[k]) for k in full[:-1]]]).astype(np.int64)
        ends = chunk_ends(data, starts, self.bits)
        cuts = [0, *ends.tolist()]
        parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        ids = self._load(parts)
        last = (np.searchsorted(ends, np.append(starts[1:], len(data))) + 1).tolist()
        # joins are between the chunks k and k + 1 of one text
        spans = list(zip([0, *last[:-1]], last))
        joins = [k for a, b in spans for k in range(a, b - 1)]
        fixed = self._repair([(parts[k], parts[k + 1], ids[parts[k]], ids[parts[k + 1]]) for k in joins])
        repaired = dict(zip(joins, fixed))
        again = []
        for k, (a, b) in zip(full, spans):
            pieces, skip, good = [], 0, True
            for c in range(a, b):
                have, join = ids[parts[c]], repaired.get(c) if c < b - 1 else (0, None, 0)
                if join is None or skip + join[0] > len(have):  # no agreement, or windows that meet in a chunk
                    good = False
                    break
                pieces.append(have[skip : len(have) - join[0]])
                if join[1] is not None:
                    pieces.append(join[1])
                skip = join[2]
            if good:
                out[k] = np.concatenate(pieces)
            else:
                again.append(k)
        self.whole += len(again)
        for k, got in zip(again, self.library([raw[k] for k in again])):
            out[k] = got
        return out

    def _repair(self, joins: list) -> list:
        """For each (left chunk, right chunk, ids of both): how many ids go from the end of the left chunk, what stands in their
        place, and how many go from the beginning of the right one; None if no window agrees."""
        out: list = [None] * len(joins)
        todo, width = list(range(len(joins))), JOIN
        self.joined += len(joins)
        while todo:
            tried, again = [], []
            for k in todo:
                left, right = joins[k][:2]
                a, b = window(left, width), window(right, width, False)
                if a is not None and b is not None:
                    tried.append((k, left[a:], right[:b]))
                elif width < max(len(left), len(right)):
                    again.append(k)
            got = self.library([x for _, left, right in tried for x in (left, right, left + right)])
            for n, (k, left, right) in enumerate(tried):
                before, after, both = got[3 * n : 3 * n + 3]
                _, _, ids, more = joins[k]
                if np.array_equal(ids[len(ids) - len(before) :], before) and np.array_equal(more[: len(after)], after):
                    out[k] = len(before), both, len(after)
                elif width < max(len(joins[k][0]), len(joins[k][1])):
                    again.append(k)
            self.widened += len(again)
            todo, width = again, width * 2
        return out


def window(chunk: bytes, width: int, end: bool = True) -> int | None:
    """Where the last ``width`` bytes of a chunk begin a word after which there is white space, or (not ``end``) where the first
    ``width`` bytes end one before which there is: None if they don't."""
    if end:
        part = chunk[-width:]
        # the first white space, then a word, then white space: what is before the word is cut off
        at = next((i for i, c in enumerate(part) if c in SPACE), None)
        if at is None:
            return None
        word = next((i for i in range(at, len(part)) if part[i] not in SPACE), None)
        if word is None or not any(c in SPACE for c in part[word:]):
            return None
        return len(chunk) - len(part) + word
    part = chunk[:width]
    at = next((i for i in range(len(part) - 1, -1, -1) if part[i] in SPACE), None)
    if at is None:
        return None
    word = next((i for i in range(at, -1, -1) if part[i] not in SPACE), None)
    if word is None or not any(c in SPACE for c in part[: word + 1]):
        return None
    return word + 1


_ENCODERS: dict[tuple, ChunkEncoder] = {}
cache("tokens", _ENCODERS.clear)


def chunk_encoder(path: str, bits: int) -> ChunkEncoder:
    """The encoder of this worker process, kept from task to task."""
    claim("tokens")
    if (path, bits) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, bits] = ChunkEncoder(word_table(path), bits)
    return _ENCODERS[path, bits]


def encode_decode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, bits: int = 10) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row: a map without a shuffle."""
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole):
                encoder = chunk_encoder(path, bits)
                ids = encoder.encode(batch.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                token = encoder.table.tokens.__getitem__
                decoded = [" ".join(map(token, x.tolist())) for x in ids]
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids and of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
