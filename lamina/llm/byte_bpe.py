"""Byte-level BPE by a rank queue: ids of texts and back.

Merges wait in buckets, one per merge rank, that hold positions of a linked
list of pieces. A bitmap of three levels (64 ranks to a word, 64 words to a
word above) says which buckets hold something; find-first-set picks the next
rank. An entry whose pair has changed since it was queued is stale and skipped.
Work grows with the length of a pre-token times a constant, not with its
square, so one of a million bytes is no trouble. All unknown pre-tokens of a
slice of texts share one queue: they are laid end to end without links between
them, so each goes through its own merges in its own order.

A text is split by ``public_tokenizers.PATTERN`` and each match encoded apart,
without special tokens, as the tiktoken library does: a match that is a piece of
the vocabulary is that piece. Ids of matches are kept in a table of two
generations, so that a worker's memory is bounded and frequent matches stay.

A null or empty text has no ids. Repeated rows are encoded each; columns other
than the ones named are not read. An empty table gives an empty table. Decoding
gives the bytes of the text back; null ids give no bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lamina.llm.common import slices, strings

#: The default vocabulary; any file of base64 pieces and ranks will do.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Most matches in a generation of a worker's table, and the longest match kept.
KEPT, KEPT_CHARS = 300_000, 48
#: Bytes of texts whose unknown matches share a queue.
TOGETHER = 1 << 21


class RankQueue(dict):
    """Buckets of positions by rank; the lowest rank with a bucket in three find-first-sets."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0

    def __missing__(self, rank: int) -> list[int]:
        """A new bucket, and its bits."""
        bucket = self[rank] = []
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)
        return bucket

    def first(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions, which leave the queue."""
        a = (self.top & -self.top).bit_length() - 1
        m = self.mid[a]
        b = a << 6 | (m & -m).bit_length() - 1
        w = self.low[b]
        rank = b << 6 | (w & -w).bit_length() - 1
        self.low[b] = w = w & (w - 1)
        if not w:
            self.mid[a] = m = m & (m - 1)
            if not m:
                self.top &= self.top - 1
        return rank, self.pop(rank)


class ByteBpe:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.pieces = [b""] * self.size
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair = np.full(1 << 16, -1, np.int64)  # ranks of two single bytes
        for piece, rank in self.ranks.items():
            if len(piece) == 2:
                self.pair[piece[0] << 8 | piece[1]] = rank
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of words of one byte or more."""
        data = b"".join(words)
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        waiting = np.full(len(raw), -1, np.int64)  # the rank of each place's pair
        waiting[:-1] = self.pair[raw[:-1] << 8 | raw[1:]]
        waiting[ends - 1] = -1
        after = np.arange(1, len(raw) + 1)
        after[ends - 1] = -1
        before = np.arange(-1, len(raw) - 1)
        before[ends - sizes] = -1
        queue = RankQueue(self.size)
        places = np.flatnonzero(waiting >= 0)
        places = places[np.argsort(waiting[places], kind="stable")]
        found, cuts = np.unique(waiting[places], return_index=True)
        for rank, some in zip(found.tolist(), np.split(places, cuts[1:])):
            queue[rank].extend(some.tolist())
        waiting, after, before = waiting.tolist(), after.tolist(), before.tolist()
        part = [self.pieces[i] for i in self.single[raw].tolist()]
        gone = bytearray(len(raw))
        pieces, ranks = self.pieces, self.ranks.get
        while queue.top:
            rank, bucket = queue.first()
            bucket.sort()  # equal ranks from left to right
            merged, lower = pieces[rank], False
            for k, p in enumerate(bucket):
                if waiting[p] != rank:
                    continue  # stale
                q = after[p]
                after[p] = right = after[q]
                part[p], gone[q], waiting[q], waiting[p] = merged, 1, -1, -1
                if right >= 0:
                    before[right] = p
                    new = ranks(merged + part[right])
                    if new is not None:
                        waiting[p] = new
                        queue[new].append(p)
                        lower = new < rank
                left = before[p]
                if left >= 0:
                    new = ranks(part[left] + merged)
                    if new is None:
                        waiting[left] = -1
                    else:
                        waiting[left] = new
                        queue[new].append(left)
                        lower = lower or new < rank
                if lower:  # it goes first, the rest of the bucket waits
                    queue[rank].extend(bucket[k + 1 :])
                    break
        alive = np.frombuffer(gone, np.uint8) == 0
        flat = np.array([self.ranks[x] for x, dead in zip(part, gone) if not dead], "<u4").tobytes()
        cuts = np.concatenate([[0], np.cumsum(alive)[ends - 1]]) * 4
        return [flat[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def learn(self, matches: list[str]) -> dict[str, bytes]:
        out, long = {}, []
        for m in matches:
            raw = m.encode()
            rank = self.ranks.get(raw)
            if rank is None:
                long.append((m, raw))
            else:
                out[m] = rank.to_bytes(4, "little")
        if long:
            out.update(zip([m for m, _ in long], self.merge([raw for _, raw in long])))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        if len(self.young) > KEPT:
            self.young, self.old = {}, self.young
        split = [self.split(t) for t in texts]
        found = [list(map(self.young.get, s)) for s in split]
        missing = {m for s, f in zip(split, found) if None in f for m, v in zip(s, f) if v is None}
        if missing:
            fresh = {m: v for m in missing if (v := self.old.get(m)) is not None}
            fresh.update(self.learn(list(missing - fresh.keys())))
            found = [[fresh[m] if v is None else v for m, v in zip(s, f)] if None in f else f for s, f in zip(split, found)]
            self.young.update((m, v) for m, v in fresh.items() if len(m) <= KEPT_CHARS)
        return list(map(b"".join, found))

    def decode(self, raw: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(raw, "<u4").tolist()))


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One per Python worker."""
    return ByteBpe(path)


def encode_bytes(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit) of every text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks)
        for batch in batches:
            for some in slices(batch, "text", TOGETHER):
                ids = bpe.encode(strings(some.column("text")))
                yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_bytes(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded``, the bytes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks)
        for batch in batches:
            decoded = [bpe.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
