import hashlib
import random
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
from loomspan.llm import bpe_chunks, token_files  # noqa: E402
from loomspan.llm.wordtable import WordTable, default_vocabulary  # noqa: E402


@pytest.fixture(scope="module")
def lib():
    return tokenizers.Tokenizer.from_file(default_vocabulary())


def awkward(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    alphabet = "abcXYZéÉ'.,;<|>endoftext 12_#!\n\tİß’́ 日"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 90))) for _ in range(n)] + ["", " ", "<|endoftext|>x <|startoftext|>,", "I'LL don't ABC!! abc'. É.", "x" * 4000, "é" * 1500]


def test_words_have_the_ids_of_the_library(lib):
    table = WordTable(default_vocabulary(), limit=500)
    texts = awkward(600, 1)
    for at in range(0, len(texts), 50):
        ids, lens = table.texts(texts[at : at + 50])
        for t, part in zip(texts[at:], np.split(ids, np.cumsum(lens)[:-1])):
            assert part.tolist() == lib.encode(t, add_special_tokens=False).ids
    assert table.generation > 1  # words were forgotten on the way


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(1, 14))) for _ in range(300)]
    return " ".join(r.choice(vocabulary) + r.choice(["", "", "", ",", ".\n", "'s", " \t"]) for _ in range(n))


@pytest.mark.parametrize("memo", [True, False])
@pytest.mark.parametrize("bits", [4, 7, 10])
def test_chunks_agree_with_the_library(lib, bits, memo):
    encoder = bpe_chunks.ChunkEncoder(WordTable(default_vocabulary()), bits, limit_bytes=60_000, memo=memo)
    shared = prose(3000, 9)
    texts = awkward(300, 2) + [" ".join(awkward(30, 3))] * 3 + [prose(400, 4) + " " + shared, shared, "x" * 9000 + " " + prose(90, 5), prose(2000, 6).replace(" ", "")]
    for at in range(0, len(texts), 60):
        for t, ids in zip(texts[at:], encoder.encode(texts[at : at + 60])):
            assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids
    assert encoder.reused > 0 and encoder.encoded > 0


def test_joins_are_repaired(lib):
    """Chunks end inside words: their own ids on end are not those of the text, and windows grow until they agree."""
    encoder = bpe_chunks.ChunkEncoder(WordTable(default_vocabulary()), 8)
    text = prose(4000, 11)
    assert encoder.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids
    raw = text.encode()
    cuts = [0, *bpe_chunks.chunk_ends(raw, np.zeros(1, np.int64), 8).tolist()]
    apart = [i for a, b in zip(cuts, cuts[1:]) for i in lib.encode(raw[a:b].decode(), add_special_tokens=False).ids]
    assert apart != lib.encode(text, add_special_tokens=False).ids
    assert encoder.joined == len(cuts) - 2 > 50 and encoder.widened > 20 and not encoder.whole
    before = encoder.encoded
    assert encoder.encode(["another beginning " + text])[0].tolist() == lib.encode("another beginning " + text, add_special_tokens=False).ids
    assert encoder.encoded - before <= 3  # all but the first chunks are known


def test_texts_without_agreement_are_encoded_whole(lib):
    encoder = bpe_chunks.ChunkEncoder(WordTable(default_vocabulary()), 5)
    texts = ["".join(random.Random(7).choice("abcdefgh") for _ in range(5000)), prose(50, 12)]
    assert [x.tolist() for x in encoder.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.whole >= 1
    # ids that a chunk has by mistake don't agree either
    left, right = b"one two th", b"ree four five"
    ids = [encoder.library([x])[0] for x in (left, right)]
    assert encoder._repair([(left, right, ids[0] + 1, ids[1])]) == [None]
    n, both, m = encoder._repair([(left, right, *ids)])[0]
    assert [*ids[0][: len(ids[0]) - n], *both, *ids[1][m:]] == lib.encode("one two three four five", add_special_tokens=False).ids


def test_chunks_follow_the_content():
    shared = " ".join(f"word{i}" for i in range(900)).encode()
    ends = []
    for prefix in (b"", b"another beginning "):
        data = prefix + shared
        e = bpe_chunks.chunk_ends(data, np.zeros(1, np.int64), 6)
        ends.append({int(x) - len(prefix) for x in e if x > len(prefix) + 400})
    assert ends[0] == ends[1] and len(ends[0]) > 50


def test_encode_and_decode(spark, docs, none, lib):
    got = bpe_chunks.digests(bpe_chunks.encode_decode(docs)).collect()
    expected = []
    for r in docs.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted((tuple(r) for r in got), key=key) == sorted(expected, key=key)
    assert bpe_chunks.encode_decode(none).count() == 0


def test_codes_round_trip():
    values = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        control, data = token_files.pack(values[:n])
        assert token_files.unpack(control, data, n).tolist() == values[:n].tolist()
    assert len(token_files.pack(values[:3])[1]) == 3


def test_files_hold_all_documents_in_order(spark, docs, none, lib):
    shards = token_files.write(docs, shard_ids=2_000)
    assert shards.count() > 3
    rows = token_files.read(shards, with_ids=True).orderBy("start").collect()
    source = [(r["doc_id"], lib.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert [key((r["doc_id"],)) for r in rows] == sorted(key(x) for x in source)
    assert sorted((key((r["doc_id"],)), list(r["ids"])) for r in rows) == sorted((key(x), x[1]) for x in source)
    start = 0
    for r in rows:
        assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    assert token_files.read(token_files.write(none)).count() == 0


def test_frequent_ids_have_small_ranks(spark, docs):
    encoded = token_files.encode_ids(docs).cache()
    counts = {r["id"]: r["n"] for r in token_files.id_counts(encoded).collect()}
    assert counts[1] == docs.count()
    assert sum(counts.values()) == sum(r["n_tokens"] or 0 for r in encoded.select("n_tokens").collect())
