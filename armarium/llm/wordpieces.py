"""Token ids and token counts of texts as the ``tokenizers`` library gives them, faster on repeated words.

White space always ends a pre-token, so a text is cut there and each piece is tokenised once per worker and
then looked up in a cache of bounded size. A piece that is new goes through the library's own merge model;
whatever the cut might treat differently from the library (special strings, rare white space, letters beyond
Latin) goes to the library as it is.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import numpy as np
import regex
from tokenizers import Tokenizer

from .common import of_worker

# --- fixed values: patterns of the two public vocabularies ------------------------------------
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space on which the two regular expression engines may differ, and the opening of special strings.
UNSURE = re.compile("[\x1c-\x1f\x85\u1680\u180e\u2000-\u200d\u2028-\u202f\u205f-\u2064\u3000\ufeff]|<\\|")
# The same for texts that `settled_latin` tells of: the classes of the word vocabulary there, and what is unsure.
LATIN_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-\u017f]+|[0-9²³¹¼½¾]|[^\sA-Za-zªµºÀ-ÖØ-öø-\u017f0-9²³¹¼½¾]+"
LATIN_UNSURE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")
BEYOND_LATIN = re.compile("[^\x00-\u012f\u0131-\u017f]")
UNITS = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where Latin-1 prints
    it, else the next free one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


def lettered(text: str) -> str:
    return text.encode().decode("latin-1").translate(LETTERS)


class Bounded(dict):
    """A cache of two generations: when the young one is full it becomes the old one, and what is still in
    use moves over on its next use."""

    def __init__(self, make: Callable[[str], Any], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def latin(text: str) -> bool:
    """Letters below U+0180 only, on which lower case, composition and letter classes are settled."""
    return text.isascii() or (max(text) < "\u0180" and "\u0130" not in text)


def settled_latin(text: str) -> bool:
    """Whether the whole text is ``latin`` and holds nothing unsure."""
    return (text.isascii() or not BEYOND_LATIN.search(text)) and not any(x in text for x in LATIN_UNSURE)


class WordIds:
    """Ids of a whole text under a word-end vocabulary, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 250_000):
        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.find = regex.compile(WORD_PATTERN).findall
        self.find_latin = re.compile(LATIN_WORD_PATTERN).findall
        self.coded = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.parts = Bounded(self.part, limit)
        self.words = Bounded(self.word, limit // 4)

    def library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def part(self, part: str) -> bytes:
        return b"".join([self.coded[t.id] for t in self.merge(lettered(part))])

    def word(self, word: str) -> bytes:
        if not latin(word):
            return self.library(word)
        return b"".join(map(self.parts.__getitem__, self.find(word.lower())))

    def __call__(self, text: str) -> bytes:
        if settled_latin(text):  # its parts are the same whether words are cut off first or not
            return b"".join(map(self.parts.__getitem__, self.find_latin(text.lower())))
        if UNSURE.search(text):
            return self.library(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def whole_tokens(path: str) -> frozenset[str]:
    """The strings of a byte-level vocabulary that provably encode alone as their one token: the library's
    own merges, run on each string, must end in exactly its id."""
    tokenizer = Tokenizer.from_file(path)
    byte_of = {c: b for b, c in LETTERS.items()}
    proven = set()
    for letters, token in tokenizer.get_vocab(with_added_tokens=False).items():
        found = tokenizer.model.tokenize(letters)
        if len(found) == 1 and found[0].id == token:
            try:
                proven.add(bytes(byte_of[c] for c in letters).decode())
            except UnicodeDecodeError:
                pass  # part of a letter: no text has it as a pre-token
    return frozenset(proven)


class TokenCounts:
    """Number of tokens of a whole text under a byte-level vocabulary."""

    def __init__(self, path: str, proven: frozenset[str], limit: int = 400_000):
        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.find = regex.compile(BYTE_PATTERN).findall
        self.proven = proven
        self.units = Bounded(self.unit, limit)

    def library(self, text: str) -> int:
        return len(self.whole.encode(text, add_special_tokens=False).ids)

    def unit(self, unit: str) -> int:
        if unit in self.proven:
            return 1
        if not latin(unit):
            return self.library(unit)
        return sum(1 if p in self.proven else len(self.merge(lettered(p))) for p in self.find(unit))

    def __call__(self, text: str) -> int:
        if UNSURE.search(text):
            return self.library(text)
        return sum(map(self.units.__getitem__, UNITS.findall(text)))


def word_ids(path: str) -> WordIds:
    return of_worker(f"word_ids:{path}", lambda: WordIds(path))


def token_counts(path: str, proven: frozenset[str]) -> TokenCounts:
    return of_worker(f"token_counts:{path}", lambda: TokenCounts(path, proven))
