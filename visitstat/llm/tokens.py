"""Encoding texts with a public tokenizer, many times the same words.

Byte-level BPE with the usual split pattern never merges across a single
space that is followed by another character: that space starts a new piece. So
a text is cut there, each distinct chunk is encoded once by the tokenizers
library, and the ids are looked up afterwards (a bounded cache per Python
worker). The result equals encoding the whole text, which the tests check on
generated texts. Tokenizers of another kind encode the whole text.
"""

from __future__ import annotations

import os
import re
from array import array

# An id is taken as part of a chunk only up to this length; longer chunks are
# encoded each time and not kept. A cache holds at most CACHE_CHUNKS, those met last.
CHUNK_CHARS = 64
CACHE_CHUNKS = 1_000_000
_SPLIT = re.compile(r" (?=\S)")
_SPACE = re.compile(r"\s")
_STOPS = ".,;:!?#*$%&|"
_SINGLE = re.compile(r"(?<=[^ ]) (?=[^ ])")
_INNER = re.compile("[^\u2581]\u2581")   # a piece that goes on after a space
_OLD_LETTERS = "\u0530"     # letters below it are in every version of the character tables


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: printable
    bytes stand for themselves, the others follow from code point 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class _Uneven(Exception):
    """A space that starts no piece: another white space or the end follows."""


class _Cache(dict):
    """At most ``limit`` values, made by ``make(key)`` where they are missing (``make`` keeps those it wants
    with ``keep``). When one half is full it becomes the older half, whose values come back when they are met."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.half, self.older = make, max(1, limit // 2), {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        return self.make(key) if found is None else self.keep(key, found)

    def keep(self, key: str, value: bytes) -> bytes:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """ids of texts under one tokenizer file, as little-endian unsigned 32-bit bytes.
    With ``plain`` the strings of special tokens are ordinary text; ``limit`` bounds the cache."""

    def __init__(self, path: str, plain: bool = False, limit: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # the tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.cut = self._splits_at_spaces()
        self.letters = byte_letters()
        self.merge = self.tokenizer.model.tokenize      # the merges alone, without the split pattern
        self.space, self.line = self.letters[0x20], self._ids("\n")
        self.cache, self.bare = _Cache(self._chunk, limit), _Cache(self._bare, limit)
        self.stops = _Cache(self._stops, limit)

    def _splits_at_spaces(self) -> bool:
        import json
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                and all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"]
                        for t in spec.get("added_tokens", [])))

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, space: str, word: str) -> bytes:
        """Letters, after a space or not: a single piece, so the library's BPE model
        encodes it without the split pattern."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(space + letters)]).tobytes()

    def _bare(self, word: str) -> bytes:
        return self.bare.keep(word, self._word("", word))

    def _stops(self, stops: str) -> bytes:
        return self.stops.keep(stops, self._ids(stops))

    def _piece(self, text: str, space: str) -> bytes:
        """The ids of ``space`` and a text without white space. Letters and the stops after
        them are separate pieces, each kept on its own."""
        word = text.rstrip(_STOPS)
        if not word.isalpha() or not (word.isascii() or max(word) < _OLD_LETTERS):
            return self._ids((" " if space else "") + text)
        if not space:
            ids = self.bare[word]
        elif len(word) < len(text):
            ids = self.cache[word]
        else:
            return self._word(space, word)
        return ids + self.stops[text[len(word):]] if len(word) < len(text) else ids

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a space and ``chunk``, which is not in the cache yet. A line break
        between two other characters is a piece of its own."""
        if chunk.isascii() and chunk.isalpha() and len(chunk) <= CHUNK_CHARS:     # most of them: one word
            return self.cache.keep(chunk, self._word(self.space, chunk))
        if not chunk or chunk[0].isspace():
            raise _Uneven
        if len(chunk) > CHUNK_CHARS:
            return self._ids(f" {chunk}")
        if "\n" in chunk:
            lines = chunk.split("\n")
            if all(x and not _SPACE.search(x) for x in lines):
                first = self.cache.get(lines[0]) or self._piece(lines[0], self.space)
                return self.line.join([first, *[self._piece(x, "") for x in lines[1:]]])
            return self._ids(f" {chunk}")
        return self.cache.keep(chunk, self._piece(chunk, self.space))

    def _joined(self, chunks: list[str]) -> bytes:
        first = chunks[0]
        known = self._piece(first, "") if first and len(first) <= CHUNK_CHARS else self._ids(first) if first else b""
        return known + b"".join(map(self.cache.__getitem__, chunks[1:]))

    def encode(self, text: str) -> bytes:
        """The ids of one whole text."""
        if not text or not self.cut:
            return self._ids(text) if text else b""
        try:
            return self._joined(text.split(" "))
        except _Uneven:       # no chunk in the cache is empty or starts with white space
            return self._joined(_SPLIT.split(text))


class PieceEncoder:
    """ids of texts under one sentencepiece model, as little-endian unsigned 32-bit bytes.

    The model writes a space as a letter of its own and puts one before the text. Where
    no piece has that letter after another one, nothing is merged across a space that
    follows a character, so a text is cut at single spaces and each distinct chunk is
    encoded once (the cache is bounded as that of ``Encoder``). A text that has that
    letter itself is encoded whole.
    """

    def __init__(self, path: str, limit: int = CACHE_CHUNKS):
        from sentencepiece import SentencePieceProcessor
        self.model, self.limit = SentencePieceProcessor(model_file=path), limit
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cut = not any(_INNER.search(p) for p in self.pieces) and self._ids("x") + self._ids("x") == self._ids("x x")
        self.cache: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.model.encode(text, num_threads=1)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of one whole text."""
        if not text or not self.cut or "\u2581" in text:
            return self._ids(text) if text else b""
        even = "  " not in text and text[0] != " " and text[-1] != " "
        chunks = text.split(" ") if even else _SINGLE.split(text)
        found = list(map(self.cache.get, chunks))
        if None in found:
            new = list(dict.fromkeys(c for c, ids in zip(chunks, found) if ids is None))
            made = {c: array("I", ids).tobytes() for c, ids in zip(new, self.model.encode(new, num_threads=1))}
            found = [made[c] if ids is None else ids for c, ids in zip(chunks, found)]
            if len(self.cache) >= self.limit:
                self.cache.clear()
            self.cache.update((c, ids) for c, ids in made.items() if len(c) <= CHUNK_CHARS)
        return b"".join(found)


_ENCODERS: dict[tuple, Encoder] = {}
_PIECES: dict[tuple, PieceEncoder] = {}


def encoder(path: str, plain: bool = False, limit: int = CACHE_CHUNKS) -> Encoder:
    """The worker's encoder of a tokenizer file (loaded once per Python worker)."""
    if (path, plain, limit) not in _ENCODERS:
        _ENCODERS[path, plain, limit] = Encoder(path, plain, limit)
    return _ENCODERS[path, plain, limit]


def piece_encoder(path: str, limit: int = CACHE_CHUNKS) -> PieceEncoder:
    """The worker's encoder of a sentencepiece model (loaded once per Python worker)."""
    if (path, limit) not in _PIECES:
        _PIECES[path, limit] = PieceEncoder(path, limit)
    return _PIECES[path, limit]
