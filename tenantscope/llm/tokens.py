"""Tokenising whole texts with a public vocabulary file (read only, by path).

Invented or natural prose repeats its words, and encoding a word costs far
more than looking it up. Where the vocabulary's rules drop white space and
never let a token cross it, a text's ids are the ids of its words in order, so
words are encoded once per worker and looked up after. Any other vocabulary is
encoded text by text. Both give the ids of ``Tokenizer.encode``.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: Pre-tokeniser pattern of vocabularies whose tokens end at white space
#: (fixed value of the vocabulary file).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters have no white space or special token in them, and
#: lower-casing alone normalises them (letters up to U+012F).
_PLAIN = re.compile("[!-;=-~\u00a1-\u012f]+")
#: ``WORD_PATTERN`` for lower-cased words of these characters.
_LETTER, _NUMBER = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u012f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")
#: Words and word pieces kept per worker; beyond it a cache starts anew.
CACHE_WORDS = 400_000


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class _Pieces(dict):
    """Ids of word pieces (lower-cased), by the vocabulary's merges."""

    def __init__(self, model, dtype: np.dtype):
        self.model, self.letters = model, _byte_letters()
        self.code = "H" if dtype.itemsize == 2 else "I"

    def __missing__(self, piece: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        spelt = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        ids = array(self.code, [t.id for t in self.model.tokenize(spelt)]).tobytes()
        self[piece] = ids
        return ids


class _Words(dict):
    """Ids of words."""

    def __init__(self, tok, dtype: np.dtype):
        self.tok, self.dtype, self.pieces = tok, dtype, _Pieces(tok.model, dtype)

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        if _PLAIN.fullmatch(word):
            low = word.lower()
            if low.isascii() and low.isalpha():
                ids = self.pieces[low]
            else:
                ids = b"".join([self.pieces[p] for p in _PIECES.findall(low)])
        else:
            ids = np.array(self.tok.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()
        self[word] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_word = _words_apart(spec)
        self.words = _Words(self.tok, self.dtype)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        if not self.by_word:
            return [np.array(self.tok.encode(t or "", add_special_tokens=False).ids, self.dtype).tobytes() for t in texts]
        get = self.words.__getitem__
        return [b"".join([b"".join(map(get, p.replace("\n", " ").split(" "))) for p in _stretches(t)]) if t else b""
                for t in texts]


def _stretches(text: str, limit: int = 1 << 20):
    """A long text in stretches of about ``limit`` characters, cut at blanks."""
    at = 0
    while len(text) - at > limit:
        cut = text.find(" ", at + limit)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


def _words_apart(spec: dict) -> bool:
    """Whether the vocabulary file's rules let texts be encoded word by word."""
    norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (norm == ["NFC", "Replace", "Lowercase"]
            and spec["normalizer"]["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
            and [p["type"] for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"] == {"Regex": WORD_PATTERN} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
            and not pre[1]["add_prefix_space"] and not pre[1].get("use_regex", True)
            and spec["model"].get("end_of_word_suffix") == "</w>"
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file (kept between tasks)."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Empty the encoders' caches: a worker that goes on to work without a
    tokenizer needs the memory."""
    for e in _encoders.values():
        e.words.clear()
        e.words.pieces.clear()
