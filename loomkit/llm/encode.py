"""Ids of whole texts as the tokenizers library gives them, with worker caches over parts that encode independently.

A text is cut where the library's own pre-tokenizer always cuts, each part is encoded once in a worker and remembered.
Where a cut isn't certain (special strings, unusual white space, letters outside Latin) the library gets the whole text
or the whole part. Ids are little-endian unsigned 32-bit integers in a bytes object.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import regex
from tokenizers import Tokenizer

#: Entries of a worker's cache, and the longest part that it keeps.
CACHE, LONGEST = 400_000, 48
#: The pre-tokenizers' patterns (fixed values of the two public tokenizers).
GPT_PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SEPARATORS = re.compile(r"[\x1c-\x1f]")
BEYOND_LATIN = re.compile(r"[^\x00-ɏ]")

_encoders: dict[str, "Encoder"] = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers, whatever the machine."""
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class Parts(dict):
    """Ids by part of a text; a missing one is encoded by the library. A part that begins with a line feed has no space before it."""

    def __init__(self, encoder: Encoder, prefix: str):
        super().__init__()
        self.encoder, self.prefix = encoder, prefix

    def __missing__(self, part: str) -> bytes:
        ids = self.encoder.newline + self.encoder.first[part[1:]] if part[:1] == "\n" else self.encoder.part(self.prefix + part)
        if len(part) <= LONGEST and len(self) < CACHE:
            self[part] = ids
        return ids


class Pieces(dict):
    """Ids by pre-token; a missing one goes through the library's model."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # such bytes stand for themselves, but for the space
            letters = piece.replace(" ", self.encoder.letters[32])
        else:
            letters = piece.encode().decode("latin-1").translate(self.encoder.letters)
        ids = packed([t.id for t in self.encoder.model.tokenize(letters)])
        if len(piece) <= LONGEST and len(self) < CACHE:
            self[piece] = ids
        return ids


class Encoder:
    """encode(text) for a byte-level tokenizer file, words kept with their space (GPT style) or without (word style)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = self.tokenizer.normalizer is not None
        self.pattern = regex.compile(WORD_PARTS if self.by_word else GPT_PARTS)
        self.letters = byte_letters()
        self.pieces, self.first, self.rest = Pieces(self), Parts(self, ""), Parts(self, " ")
        self.newline = b"" if self.by_word else self.part("\n")

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def part(self, text: str) -> bytes:
        if "<|" in text or not text.isascii() and BEYOND_LATIN.search(text):
            return self.whole(text)
        plain = text.lower() if self.by_word else text  # Latin text is in normal form C already
        if self.by_word and not plain.isascii() and BEYOND_LATIN.search(plain):
            return self.whole(text)
        word = plain.removeprefix(" ")
        if word.isalpha():  # one pre-token
            return self.pieces[plain]
        if plain[-1:] in ".," and word[:-1].isalpha():
            return self.pieces[plain[:-1]] + self.pieces[plain[-1]]
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(plain)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return self.whole(text)
        if self.by_word:
            if SEPARATORS.search(text):
                return self.whole(text)
            return b"".join(map(self.first.__getitem__, text.split()))
        if text.split() != text.replace("\n", " ").split(" "):  # other white space than single spaces and line feeds between words
            return self.part(text)
        words = text.replace("\n", " \n").split(" ")
        return self.first[words[0]] + b"".join(map(self.rest.__getitem__, words[1:]))


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
