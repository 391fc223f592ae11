import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from fixtures import texts

from lamina.llm import byte_bpe
from lamina.llm.queries import QUERIES

BPE = byte_bpe.ByteBpe(byte_bpe.RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})


def ids_of(text):
    return np.array(LIBRARY.encode_ordinary(text), "<u4").tobytes()


def some_texts(n):
    r = random.Random(4)
    wide, narrow = "ab '.\n\t  　\x1c\x85é漢1_<|>sÀßtheing", "abcth"
    return ["".join(r.choice(narrow if k % 3 else wide) for _ in range(r.randint(0, 200))) for k in range(n)]


def test_ids_are_those_of_the_library():
    for t in [*some_texts(2000), *[t or "" for _, t, *_ in texts()], "<|endoftext|>", "don't 'll we've ''s", "​ ﻿", "🙂🙂  🙂"]:
        (ids,) = BPE.encode([t])
        assert ids == ids_of(t), repr(t)
        assert BPE.decode(ids) == t.encode()


def test_texts_share_a_queue_without_touching():
    some = some_texts(500)
    fresh = byte_bpe.ByteBpe(byte_bpe.RANKS)
    assert fresh.encode(some) == [ids_of(t) for t in some]


def test_the_table_of_matches_turns_over(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 20)
    fresh, some = byte_bpe.ByteBpe(byte_bpe.RANKS), some_texts(300)
    for k in range(0, 300, 10):
        assert fresh.encode(some[k : k + 10]) == [ids_of(t) for t in some[k : k + 10]]


def test_a_lower_rank_goes_first():
    """With these ranks the merge of ``bc`` makes a pair of a lower rank than its own, which the rest of the bucket waits for."""
    bpe = byte_bpe.ByteBpe(byte_bpe.RANKS)
    single = {bytes([b]): b for b in range(256)}
    bpe.ranks = single | {b"abc": 256, b"bc": 257, b"cb": 258, b"abcb": 259}
    bpe.pieces = sorted(bpe.ranks, key=bpe.ranks.get)
    bpe.size = len(bpe.pieces)
    bpe.single = np.arange(256)
    bpe.pair = np.full(1 << 16, -1, np.int64)
    bpe.pair[ord("b") << 8 | ord("c")], bpe.pair[ord("c") << 8 | ord("b")] = 257, 258
    library = tiktoken.Encoding("small", pat_str=r"[^ ]+", mergeable_ranks=bpe.ranks, special_tokens={})
    r = random.Random(8)
    for _ in range(500):
        w = "".join(r.choice("abc") for _ in range(r.randint(2, 40)))
        if w.encode() not in bpe.ranks:
            assert bpe.merge([w.encode()])[0] == np.array(library.encode_ordinary(w), "<u4").tobytes(), w


def test_a_very_long_match():
    r = random.Random(6)
    t = "x" * 100_000 + "".join(r.choice("etaoin") for _ in range(200_000))
    assert BPE.encode([t])[0] == ids_of(t)


def test_round_trip_of_a_table(spark, docs):
    encoded = byte_bpe.encode_bytes(docs)
    rows = byte_bpe.decode_bytes(encoded.withColumn("decoded", encoded.doc_id).withColumn("a.b", encoded.doc_id)).collect()
    assert sorted(bytes(x.decoded) for x in rows) == sorted((t or "").encode() for _, t, *_ in texts())
    assert sorted(bytes(x.ids) for x in rows) == sorted(ids_of(t or "") for _, t, *_ in texts())
    assert sum(x.n_tokens for x in encoded.collect()) == sum(len(ids_of(t or "")) // 4 for _, t, *_ in texts())


def test_empty_table(none):
    assert byte_bpe.decode_bytes(byte_bpe.encode_bytes(none)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {r.doc_id: (len(ids_of(r.text)) // 4, sha(ids_of(r.text)), sha(r.text.encode())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_byte_bpe"](spark, sf).collect()}
    assert got == want
