"""Encoding with a public tokenizer's file, at the speed of a dictionary look-up.

The tokenizers library encodes a text as the concatenation of its pre-tokens.
Here each worker keeps the ids of the pre-tokens it has met, so the library is
called once per new one, in batches. The cut between pre-tokens is made at the
same places as the tokenizer's own pattern makes them; the ids equal those of
a whole-text call (tests compare them). A text that holds an added token, such
as <|endoftext|>, goes through the library whole.

Two levels: runs of non-space characters, and below them single pre-tokens.
Both caches are bounded: a full one is cut back to what the last batch used,
which holds the frequent words.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import regex

#: White space as the tokenizer's pattern has it: Python's \s without U+001C to U+001F.
_GAP, _INK = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
_CONTROL = re.compile("[\x1c-\x1f]")

#: What lies outside the Latin blocks, where libraries' Unicode versions may differ, and the letter that falls apart in lower case.
_UNSETTLED = re.compile("[^\x00-\u024f]|\u0130")


def _settled(text: str) -> bool:
    """Whether composing changes nothing and Python's letter classes and lower case are the tokenizer's."""
    return text.isascii() or not _UNSETTLED.search(text)


CACHE_WORDS = 600_000
CACHE_PIECES = 500_000


def _signs() -> dict[int, str]:
    """The printable sign of each byte in byte-level vocabularies: itself, or the next from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_SIGNS = _signs()


def byte_signs(text: str) -> str:
    return text.encode().decode("latin-1").translate(_SIGNS)


#: A space's sign; the other printable ASCII signs are themselves.
_SPACE = byte_signs(" ")


class _Words(dict):
    """ids by word; a word that is not there is encoded when it is asked for, so each is looked up once."""

    def __init__(self, new: Callable[[str], bytes], known: dict[str, bytes] | None = None) -> None:
        super().__init__(known or {})
        self.new = new

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.new(word)
        return ids


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes.

    With added_tokens, texts are read as the library reads them by default:
    an added token in a text has its own id. Without, it is plain characters.
    """

    def __init__(self, path: str, added_tokens: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values() if added_tokens else []
        if any(t.normalized for t in added):
            raise ValueError("an added token is sought in normal forms of the text")
        self.added = [t.content for t in added]
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.words = _Words(self._new_word)
        self.pieces: dict[str, bytes] = {}
        self.parts_met: set[str] = set()

    def split(self, text: str) -> list[str]:
        raise NotImplementedError

    def pretokens(self, word: str) -> list[str]:
        raise NotImplementedError

    def encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each whole text."""
        collecting = gc.isenabled()
        gc.disable()  # the many short lists of a batch hold no cycles
        try:
            return self._encode_batch(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        self.tokenizer.encode_special_tokens = False
        try:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        finally:
            self.tokenizer.encode_special_tokens = True

    def _new_word(self, word: str) -> bytes:
        """The ids of a word that was not met before."""
        parts = self.pretokens(word)
        self.parts_met.update(parts)
        pieces = self.pieces
        for p in parts:
            if p not in pieces:
                pieces[p] = self._new_piece(p)
        return pieces[parts[0]] if len(parts) == 1 else b"".join([pieces[p] for p in parts])

    def _new_piece(self, piece: str) -> bytes:
        """The ids of one pre-token: where its form is settled, the merges alone are left to do."""
        if piece.isascii() and piece.isprintable():
            ids = [t.id for t in self.merge(piece.replace(" ", _SPACE))]
        elif _settled(piece) and not _CONTROL.search(piece):
            ids = [t.id for t in self.merge(byte_signs(piece))]
        else:
            ids = self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids
        return array("I", ids).tobytes()

    def _encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        texts = list(texts)
        marked = [i for i, t in enumerate(texts) if t and any(a in t for a in self.added)]
        if marked:
            whole = self._encode_whole([texts[i] for i in marked])
            for i in marked:
                texts[i] = ""
        texts = [self.split(t) if t else [] for t in texts]
        self.parts_met = set()
        word = self.words.__getitem__
        coded = [b"".join(map(word, words)) for words in texts]
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {p: self.pieces[p] for p in self.parts_met}
        if len(self.words) > CACHE_WORDS:
            self.words = _Words(self._new_word, {w: self.words[w] for w in set(chain.from_iterable(texts))})
        for k, i in enumerate(marked):
            coded[i] = whole[k]
        return coded


class ByteEncoder(Encoder):
    """For the byte-level tokenizer: a pre-token may begin with one space."""

    _plain = re.compile(r" ?\S+|\s+(?!\S)|\s+")
    _exact = re.compile(rf" ?{_INK}+|{_GAP}+(?!{_INK})|{_GAP}+")
    _pre = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def split(self, text: str) -> list[str]:
        return (self._exact if _CONTROL.search(text) else self._plain).findall(text)

    def pretokens(self, word: str) -> list[str]:
        if word.isascii() and word.lstrip(" ").isalpha() or not _settled(word) or _CONTROL.search(word):
            return [word]
        return self._pre.findall(word)


class WordEncoder(Encoder):
    """For the lower-casing tokenizer, which composes characters first and drops white space."""

    _exact = re.compile(rf"{_INK}+")
    _pre = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def split(self, text: str) -> list[str]:
        if _settled(text):
            text = text.lower()
        return self._exact.findall(text) if _CONTROL.search(text) else text.split()

    def pretokens(self, word: str) -> list[str]:
        if word.isascii() and word.isalpha():
            return [word.lower()]
        if not _settled(word) or _CONTROL.search(word):
            return [word]
        return self._pre.findall(word.lower()) or [word]


_encoders: dict[tuple[type, str], Encoder] = {}


def encoder(kind: Callable[..., Encoder], path: str) -> Encoder:
    """One encoder per worker process and file; it heeds added tokens."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path, added_tokens=True)
    return _encoders[kind, path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def as_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")
