"""SentencePiece ids: distinct marked words in sorted order form a trie that is
walked depth first, and forward states are reused along shared prefixes.

The public vocabulary is of the BPE kind, for which the path of least cost is
not the sum of piece scores. The forward state that fits it is the last piece of
a prefix's encoding: a split is the encoder's own exactly when each pair of
neighbouring pieces, taken alone, would be merged into that same pair. So each
prefix has one last piece, found from the states of shorter prefixes, as in the
forward pass of a Viterbi search. Words that share a prefix share its states.

A word is a run of marks with what follows it; no piece of the vocabulary
crosses from another character to a mark (checked when it is loaded), so words
are encoded apart. Characters without a piece become bytes. A null or empty
text has no ids; repeated rows are encoded each; other columns are ignored.
Decoding gives the text back, but for a mark character (U+2581) in it, which
reads as a space, as the format has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm.common import slices, strings

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Most words and pairs kept by a Python worker, and the longest word kept.
KEPT_WORDS, KEPT_CHARS = 300_000, 60


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: -sp.get_score(i) for i in plain}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            lengths.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {end: sorted(n - {1}, reverse=True) for end, n in lengths.items()}  # of the pieces that end so
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces across words: words can't be encoded apart")
        byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.bytes = [bytes([byte_of[i]]) if i in byte_of else b"" if sp.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, chars: str) -> list[str]:
        """The pieces of a short string by repeated merging of the best pair."""
        parts = list(chars)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get(parts[k] + parts[k + 1], np.inf))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces side by side stay as they are."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Depth first through the trie of ``words``, which must be sorted. ``last[k]``: the last piece of the first k characters."""
        last, before = [""], ""
        ids, pairs, lengths = self.ids, self.pairs, self.lengths
        for word in words:
            shared, size = 0, min(len(before), len(word))
            while shared < size and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for n in lengths.get(word[end - 2 : end] if end > 1 else "", ()):
                    if n <= end and (piece := word[end - n : end]) in ids:
                        left = last[end - n]
                        fits = pairs.get((left, piece))
                        if fits or fits is None and self.fits(left, piece):
                            break
                else:
                    piece = word[end - 1]
                last.append(piece)
            before, out, at = word, [], len(word)
            while at:
                out.append(last[at])
                at -= len(last[at])
            yield word, out[::-1]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        found = {}
        for word, parts in self.walk(sorted(words)):
            ids = [i for p in parts for i in ([self.ids[p]] if p in self.ids else [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")])]
            found[word] = np.array(ids, "<u4").tobytes()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        if len(self.words) > KEPT_WORDS:
            self.words = {}
        if len(self.pairs) > KEPT_WORDS:
            self.pairs = {}
        split = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        found = [list(map(self.words.get, s)) for s in split]
        missing = {w for s, f in zip(split, found) if None in f for w, v in zip(s, f) if v is None}
        fresh = self.learn(missing)
        out = [b"".join([fresh[w] if v is None else v for w, v in zip(s, f)] if None in f else f) for s, f in zip(split, found)]
        self.words.update((w, v) for w, v in fresh.items() if len(w) <= KEPT_CHARS)
        return out

    def decode(self, raw: bytes) -> str:
        text = b"".join([self.bytes[i] for i in np.frombuffer(raw, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker."""
    return Vocabulary(path)


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for some in slices(batch, "text"):
                ids = v.encode(strings(some.column("text")))
                yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The columns of ``encoded`` with the ``text`` of its ``ids``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            texts = [v.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    base = encoded.drop("text")
    return base.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in base.dtypes) + ", text string")
