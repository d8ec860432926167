"""Text to words to ids, as the tokenizers library does it for a lower-casing BPE with word ends.

The library normalises (NFC, white space to one blank, lower case), splits into letters, single digits, contractions and
runs of other signs, and merges inside each word only. A word's ids thus depend on the word alone; they are kept per
worker, in a table of bounded size, and joined for each text.
"""

from __future__ import annotations

import functools
import json
import re
import sys
from collections.abc import Callable

import numpy as np
from tokenizers import Regex as TokenizerRegex
from tokenizers import Tokenizer, pre_tokenizers

#: Words that a worker keeps at most; beyond that it starts anew. Bounds memory, never changes results.
KEPT_WORDS = 700_000


@functools.cache
def _ranges(kind: str, top: int) -> str:
    """The code points up to top of a general category (L or N) as ranges of a character class, as the library's own pattern engine sees them."""
    signs = "".join(chr(c) for c in range(top + 1) if not 0xD800 <= c < 0xE000)
    found = sorted(ord(s) for s, _ in pre_tokenizers.Split(TokenizerRegex(f"\\p{{{kind}}}"), "removed", invert=True).pre_tokenize_str(signs))
    out: list[list[int]] = []
    for c in found:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@functools.cache
def word_pattern(top: int = sys.maxunicode) -> re.Pattern:
    """For texts with code points up to top: smaller classes are faster.

    Letters come first: no other alternative starts with one, so the order doesn't matter to them.
    """
    letter, digit = _ranges("L", top), _ranges("N", top)
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{digit}]|[^{space}{letter}{digit}]+")


@functools.cache
def byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file holds, from its bytes."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        spec = json.loads(data)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.merges: list[tuple[str, str]] = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.strings = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for known in (self.ids, self.special):
            for s, i in known.items():
                self.strings[i] = s

    def signs(self, word: str) -> str:
        return "".join(map(byte_signs().__getitem__, word.encode()))


class Encoder(dict):
    """Texts to ids as little-endian unsigned 32-bit integers. The dict keeps each word's ids; of_word finds new ones."""

    def __init__(self, vocabulary: Vocabulary, of_word: Callable[[str], list[int]], kept: int = KEPT_WORDS) -> None:
        super().__init__()
        self.vocabulary, self.of_word, self.kept = vocabulary, of_word, kept
        self.normalised = Tokenizer.from_buffer(vocabulary.data).normalizer.normalize_str

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.kept:
            self.clear()
        found = self[word] = np.array(self.of_word(word), dtype="<u4").tobytes()
        return found

    def encode(self, text: str) -> bytes:
        special = self.vocabulary.special_pattern
        if special is not None and "<" in text and special.search(text):
            parts = special.split(text)
            return b"".join(np.array([self.vocabulary.special[p]], dtype="<u4").tobytes() if i % 2 else self.encode_plain(p) for i, p in enumerate(parts))
        return self.encode_plain(text)

    def words(self, text: str) -> list[str]:
        """Latin-1 needs no NFC and has simple lower case; the library normalises all other texts."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = self.normalised(text)
            return word_pattern(0xFFFF if max(text, default="") <= "\uffff" else sys.maxunicode).findall(text)
        text = text.lower()
        return word_pattern(0xFF).findall(text)

    def encode_plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.words(text)))


def library_encoder(data: bytes) -> Encoder:
    """New words go through the tokenizers library's own model."""
    vocabulary = Vocabulary(data)
    model = Tokenizer.from_buffer(data).model
    return Encoder(vocabulary, lambda word: [t.id for t in model.tokenize(vocabulary.signs(word))])
