import random
import zlib

import numpy as np
import sentencepiece as library
from fixtures import texts
from tokenizers import Tokenizer

from lamina.llm import packing, sentencepiece, token_files
from lamina.llm.tokens import TOKENIZER, Encoder

T = Tokenizer.from_file(TOKENIZER)


def ids_of(text, end):
    return np.array(T.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def awkward(n):
    r = random.Random(2)
    alphabet = "ab '.\n\t  　\x1c\x85é漢1_<|>sÀß"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_parts_give_the_ids_of_whole_texts():
    e = Encoder(TOKENIZER)
    for t in [*awkward(3000), *[x[1] or "" for x in texts()], "don't 'll we've ''s", "a\r\n\r\nb", " ", "<|endoftext|>x <|endoftext|>"]:
        assert e.encode([t])[0] == np.array(T.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_files_round_trip(spark, docs):
    manifest = token_files.write_token_files(docs)
    got = token_files.read_token_files(spark, manifest).collect()
    want = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [w[0] for w in want]
    start = 0
    for r, w in zip(got, want):
        ids = ids_of(w[1], 2)
        assert (r.start, r.n_tokens, bytes(r.ids)) == (start, len(ids), ids.tobytes())
        start += len(ids)


def test_wide_ids(spark, docs):
    manifest = token_files.write_token_files(docs.where("doc_id = 304"), end_id=70000)
    (row,) = token_files.read_token_files(spark, manifest).collect()
    assert np.frombuffer(row.ids, "<u4")[-1] == 70000


def test_empty_tables(spark, none):
    assert token_files.read_token_files(spark, token_files.write_token_files(none)).count() == 0
    assert packing.pack(none).count() == 0
    assert sentencepiece.encode_pieces(none).count() == 0


def test_packing_cuts_everything_once(docs):
    pieces = packing.pack(docs, length=64, keep_ids=True).cache()
    rows = pieces.collect()
    by_sequence = {}
    for r in rows:
        assert r.length == len(r.ids) // 4 and zlib.crc32(r.ids) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, some in by_sequence.items():
        some.sort(key=lambda r: r.offset)
        assert [r.offset for r in some] == np.cumsum([0] + [r.length for r in some])[:-1].tolist()
        assert sum(r.length for r in some) == 64 or k == len(by_sequence) - 1
    stream = b"".join(bytes(r.ids) for k in sorted(by_sequence) for r in by_sequence[k])
    whole = sorted(bytes(ids_of(t, 0).tobytes()) for _, t, *_ in texts())
    ends = np.flatnonzero(np.concatenate([[True], [r.start + r.length == r.doc_tokens for k in sorted(by_sequence) for r in by_sequence[k]]]))
    lengths = np.cumsum([0] + [4 * r.length for k in sorted(by_sequence) for r in by_sequence[k]])[ends]
    assert sorted(stream[a:b] for a, b in zip(lengths, lengths[1:])) == whole
    seq = {r.sequence_id: r for r in packing.sequences(pieces, 64, pad_id=9).collect()}
    assert b"".join(bytes(seq[k].ids)[: 4 * seq[k].n_tokens] for k in sorted(seq)) == stream
    assert all(len(r.ids) == 256 for r in seq.values())


def test_sentencepiece_equals_the_library(docs):
    sp = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    v = sentencepiece.Vocabulary(sentencepiece.MODEL)
    some = [*awkward(1500), *[x[1] or "" for x in texts()], "▁▁ a▁b", "🙂 \x00 x", "aaaa aaaaaaaaaaaaaaaa"]
    for t, raw in zip(some, v.encode(some)):
        assert raw == np.array(sp.encode(t), "<u4").tobytes(), repr(t)
        assert v.decode(raw) == t.replace("▁", " ")
    decoded = sentencepiece.decode_pieces(sentencepiece.encode_pieces(docs)).collect()
    assert sorted(r.text for r in decoded) == sorted((t or "").replace("▁", " ") for _, t, *_ in texts())


def test_a_word_after_a_space_is_kept_once():
    e = Encoder(TOKENIZER)
    some = ["one Straße. don't, one Straße", "Straße <|endoftext|>. x", "a  b\nc d\n", "12 ab12 été-là ", " ", "漢字 été"]
    got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(some)]
    assert got == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    assert " Straße" not in e.pieces and {"Straße", "one"} <= set(e.parts)
