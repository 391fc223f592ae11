"""Byte-level BPE ids, fast: each distinct piece between spaces is encoded once.

A boundary between a character that isn't white space and a plain space is
always a boundary of the tokenizer's own pieces, so a text's ids are those of
its parts one after the other. Parts are looked up in a bounded table; what is
missing goes through the tokenizers library. Texts with doubled or unusual
white space take a slower split that keeps whole runs together.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache
from struct import pack

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: The default vocabulary; any byte-level BPE file of the tokenizers library will do.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Most parts kept by a Python worker, and the longest part that is kept.
KEPT_PARTS, KEPT_CHARS = 600_000, 60

#: A part: white space, then anything up to the next plain space that follows a character which isn't white space.
_PART = re.compile(r"[ \t\r\n]*[^ \t\r\n]+(?:(?<=\s)[ \t\r\n]+[^ \t\r\n]*)*|[ \t\r\n]+")
#: Letters whose class no Unicode version disputes; parts of these and of printable ASCII need no full pre-tokenizer.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(f" ?[!-~{_LETTERS}]+")
#: One run of letters is one piece.
_WORD = re.compile(f" ?[{_LETTERS}]+")
#: Fixed value: the vocabulary's own split pattern, for plain parts.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^ {_LETTERS}0-9]+")


def _alphabet() -> dict[int, int]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(hidden)}


_ALPHABET = _alphabet()
_SPACE = chr(_ALPHABET[32])


class _Unusual(Exception):
    """A part with white space at an end."""


class _Parts(dict):
    """Ids of parts by their text without the space before; what is missing is learned."""

    def __init__(self, ids: Callable[[str], bytes]):
        self.ids = ids

    def __missing__(self, key: str) -> bytes:
        if not key or key[0].isspace() or key[-1].isspace():
            raise _Unusual
        out = self.ids(" " + key)
        if len(key) <= KEPT_CHARS:
            self[key] = out
        return out


class _Pieces(dict):
    """Ids of the tokenizer's own pieces; what is missing is learned."""

    def __init__(self, ids: Callable[[str], bytes]):
        self.ids = ids

    def __missing__(self, key: str) -> bytes:
        out = self[key] = self.ids(key)
        return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
        self.word = re.compile(r"(?!)") if any(map(re.compile(f" ?[{_LETTERS}]*").fullmatch, specials)) else _WORD
        self._forget()

    def _forget(self) -> None:
        self.parts = _Parts(self._ids)  # after a space; the key leaves the space out
        self.heads: dict[str, bytes] = {}  # as they stand
        self.pieces = _Pieces(self._piece)  # but for words after a space, which are parts

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.parts) + len(self.heads) > KEPT_PARTS:
            self._forget()
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> bytes:
        if not text:
            return b""
        head, *rest = text.split(" ")
        if not head or head[0].isspace() or head[-1].isspace():
            return self._slow(text)
        try:
            return self._head(head) + b"".join(map(self.parts.__getitem__, rest))
        except _Unusual:
            return self._slow(text)

    def _slow(self, text: str) -> bytes:
        return b"".join(map(self._head, _PART.findall(text)))

    def _head(self, part: str) -> bytes:
        out = self.heads.get(part)
        if out is None:
            out = self._ids(part)
            if len(part) <= KEPT_CHARS:
                self.heads[part] = out
        return out

    def _ids(self, part: str) -> bytes:
        if self.word.fullmatch(part):
            return self._piece(part)
        if not _PLAIN.fullmatch(part) or self.special.search(part):
            before, newline, after = part.partition("\n")
            if newline and _PLAIN.fullmatch(before) and _PLAIN.fullmatch(after) and after[0] != " " and not self.special.search(part):
                return self._ids(before) + self._ids(newline) + self._ids(after)
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
            return pack(f"<{len(ids)}I", *ids)
        first, *rest = _PIECE.findall(part)
        return (self.parts[first[1:]] if self.word.fullmatch(first) and first[0] == " " else self.pieces[first]) + b"".join(map(self.pieces.__getitem__, rest))

    def _piece(self, piece: str) -> bytes:
        letters = piece.replace(" ", _SPACE) if piece.isascii() else piece.encode().decode("latin-1").translate(_ALPHABET)
        ids = [t.id for t in self.model.tokenize(letters)]
        return pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)
