"""Exact ids of a BPE vocabulary, with each distinct word given to the tokenizers library once.

The vocabulary's splitting rule never joins characters across ASCII white space, and its normaliser works
within such words, so the ids of a text are the ids of its words one after the other. Tests hold this against
the library on whole texts, white space and special tokens of all kinds included.
"""

from __future__ import annotations

import json
import re
from itertools import repeat

import numpy as np

from loomspan.llm.common import cache, claim, quiet_threads

#: Words in which the library finds one piece each, whose last token ends the word.
LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
#: Such a word, and ASCII punctuation without apostrophes after it.
PARTS = re.compile(rb"(" + LETTERS + rb")([!-&(-/:-@\[-`{-~]*)")
WORDS_PER_TEXT = 256


class WordTable:
    """Ids of words; beyond ``limit`` words, those that were met in one batch only are forgotten."""

    def __init__(self, path: str, limit: int = 500_000):
        quiet_threads()
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.limit = limit
        # the same model for plain words in lower case, which need neither normaliser nor splitting rule
        rules = json.loads(self.lib.to_str())
        rules["normalizer"] = None
        rules["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.plain = Tokenizer.from_str(json.dumps(rules))
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.tokens = [""] * self.size
        self.ends = np.zeros(self.size, bool)
        for token, i in vocab.items():
            self.tokens[i] = token
            self.ends[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.generation = getattr(self, "generation", 0) + 1
        self.known: dict[bytes, int] = {}
        self.starts = np.zeros(1024, np.int64)
        self.lens = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)
        self.hits = np.zeros(1024, np.int32)
        self.used = 0

    def _forget(self) -> None:
        known, keep = list(self.known), self.hits[: len(self.known)] > 1
        if keep.sum() > self.limit // 2:
            keep[:] = False
        at = np.flatnonzero(keep)
        lens, starts, flat, hits = self.lens[at], self.starts[at], self.flat, self.hits[at]
        self._clear()
        if len(at):
            stops = np.cumsum(lens)
            self._add([known[i] for i in at.tolist()], flat[np.repeat(starts - stops + lens, lens) + np.arange(stops[-1])], lens)
            self.hits[: len(at)] = hits >> 1

    def library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[bytes], more: np.ndarray, lens: np.ndarray) -> None:
        n = len(self.known)
        while n + len(words) > len(self.starts):
            self.starts, self.lens, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens, self.hits))
        while self.used + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.lens[n : n + len(words)] = lens
        self.starts[n : n + len(words)] = self.used + np.cumsum(lens) - lens
        self.flat[self.used : self.used + len(more)] = more
        self.used += len(more)
        self.known.update(zip(words, range(n, n + len(words))))

    def learn(self, words: set[bytes], forget: bool = True) -> None:
        """Give the words that are new to the library. A word in capitals has the ids of its small letters, and
        letters before a run of punctuation have those of the two parts, which the library splits there too."""
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if forget and self.known and len(self.known) + len(new) > self.limit:
            self._forget()
            new = [w for w in words if w not in self.known]
        plain, joined, other = {}, [], []
        for w in new:
            found = PARTS.fullmatch(w)
            if not found:
                other.append(w)
                continue
            head, tail = found[1].lower(), found[2]
            if head not in self.known:
                plain[head] = None
            if tail and tail not in self.known:
                other.append(tail)
            if head != w:
                joined.append((w, head, tail))
        self._learn_plain(list(plain), other)
        other = list(dict.fromkeys(w for w in other if w not in self.known))
        if other:
            ids = self.library([w.decode("utf-8", "replace") for w in other])
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            self._add(other, np.fromiter((i for x in ids for i in x), np.int32, int(lens.sum())), lens)
        joined = [j for j in joined if j[0] not in self.known]
        if joined:
            get = self.known.__getitem__
            first = np.fromiter((get(h) for _, h, _ in joined), np.int64, len(joined))
            second = np.fromiter((get(t) if t else -1 for _, _, t in joined), np.int64, len(joined))
            lens = np.stack([self.lens[first], np.where(second >= 0, self.lens[second], 0)], 1)
            starts = np.stack([self.starts[first], self.starts[second]], 1)
            self._add([w for w, _, _ in joined], self._gather(starts.ravel(), lens.ravel()), lens.sum(1))

    def _learn_plain(self, plain: list[bytes], other: list[bytes]) -> None:
        groups = [plain[i : i + WORDS_PER_TEXT] for i in range(0, len(plain), WORDS_PER_TEXT)]
        for group, found in zip(groups, self.plain.encode_batch_fast([b" ".join(g).decode().lower() for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, np.int32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group) and stops[-1] == len(ids):
                self._add(group, ids, np.diff(stops, prepend=0))
            else:
                other += group

    def _gather(self, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        ends = np.cumsum(lens)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.int32)
        return self.flat[np.repeat(starts - ends + lens, lens) + np.arange(ends[-1])]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words on end, and how many ids each word has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            absent, generation = [words[i] for i in missing.tolist()], self.generation
            self.learn(set(absent))
            if self.generation != generation:  # some were forgotten, and places have changed
                self.learn(set(words), forget=False)
                at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            else:
                at[missing] = np.fromiter(map(self.known.__getitem__, absent), np.int64, len(absent))
        self.hits[at] += 1  # once for each word
        lens = self.lens[at]
        return self._gather(self.starts[at], lens), lens

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts on end, and how many each text has. A null text counts as empty."""
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        ids, lens = self.encode([w for ws in split for w in ws])
        word_ends = np.concatenate([[0], np.cumsum(lens)])
        doc_ends = np.concatenate([[0], np.cumsum([len(ws) for ws in split], dtype=np.int64)]).astype(np.int64)
        return ids, np.diff(word_ends[doc_ends])


_TABLES: dict[tuple, WordTable] = {}
cache("tokens", _TABLES.clear)


def word_table(path: str, limit: int = 500_000) -> WordTable:
    """One table for each worker process, kept from task to task."""
    claim("tokens")
    if (path, limit) not in _TABLES:
        _TABLES.clear()
        _TABLES[path, limit] = WordTable(path, limit)
    return _TABLES[path, limit]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
