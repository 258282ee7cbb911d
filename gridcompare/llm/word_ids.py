"""The ids a public word tokenizer gives to texts, found per distinct word and not per occurrence."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import numpy as np

CACHED_WORDS = 300_000  # of each of two generations; about 160 bytes a word

# White space, and how the tokenizer's file splits text that is normalised and lower-cased. Letters begin
# none of the other kinds, so they can be tried first.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SUFFIXES = "'(?:s|t|re|ve|m|ll|d)"

_ASCII = re.compile(rf"[a-z]+|{_SUFFIXES}|[0-9]|[^\t-\r a-z0-9]+")
_FAST = re.compile(rf"[^\W\d_]+|{_SUFFIXES}|\d|(?:[^\w{_SPACE}]|_)+")


def _class_of(*kinds: str, last: int = sys.maxunicode) -> str:
    """The inside of a character class of the code points of these general categories, up to ``last``."""
    runs, end = [], -2
    for c in range(last + 1):
        if unicodedata.category(chr(c)) in kinds:
            if c == end + 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
            end = c
    return "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in runs)


# Classes are looked up in a table below this; beyond it they are searched range by range, which is slow.
_TABLE_END = 0xFFFF
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


@cache
def _bare(kind: tuple[str, ...]) -> re.Pattern:
    return re.compile(f"[{_class_of(*kind, last=_TABLE_END)}]")


def _holds(text: str, *kinds: str) -> bool:
    """Whether a text holds a code point of these general categories."""
    if _bare(kinds).search(text):
        return True
    return any(unicodedata.category(c) in kinds for c in set(_BEYOND.findall(text)))


@cache
def _with_numbers() -> re.Pattern:
    """Splits a text that holds numbers which are no decimal digits."""
    numbers = _class_of("No", "Nl")
    return re.compile(rf"[^\W\d_{numbers}]+|{_SUFFIXES}|[\d{numbers}]|(?:[^\w{_SPACE}]|_)+")


@cache
def _letters_by_table() -> re.Pattern:
    """``_FAST`` for texts without code points beyond the table, with letters and digits looked up there."""
    letters = _class_of("Ll", "Lu", "Lt", "Lm", "Lo", last=_TABLE_END)
    digits = _class_of("Nd", last=_TABLE_END)
    return re.compile(rf"[{letters}]+|{_SUFFIXES}|[{digits}]|[^{letters}{digits}{_SPACE}]+")


def pre_tokens(normal: str) -> list[str]:
    """The pre-tokens of a normalised text."""
    if normal.isascii():
        return _ASCII.findall(normal)
    if _holds(normal, "No", "Nl"):
        return _with_numbers().findall(normal)
    return (_FAST if _BEYOND.search(normal) else _letters_by_table()).findall(normal)


def normalized(text: str) -> str | None:
    """What the tokenizer's normalizers make of a text, white space aside: composed, and lower-cased letter by
    letter, so that a sigma at a word's end is like any other. None for the rare texts that must go through the
    tokenizer whole: they hold a special token's marks or a code point unknown to this Python, or lower case has
    put their accents out of order."""
    if "<|" in text:
        return None
    if text.isascii():
        return text.lower()
    low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return low if unicodedata.is_normalized("NFC", low) and not _holds(low, "Cn") else None


class WordIds:
    """The ids of pre-tokens as little-endian bytes, looked up, or made by the tokenizer on first use."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.cached_words = cached_words
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Encodes new words in one go; every word's last id has the mark of a word's end. Words not met since the
        last time the store filled up are forgotten when it fills up again."""
        if len(self.known) > self.cached_words:
            self.older, self.known = self.known, {}
        # Tested word by word: the difference with a view of the keys would go through the whole store.
        known, older = self.known, self.older
        missing = [word for word in words if word not in known]
        met = [word for word in missing if word in older]
        known.update(zip(met, map(older.__getitem__, met), strict=True))
        new = sorted(word for word in missing if word not in known)
        if not new:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(new):
            raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
            self.known.update((word, raw[at[i] : at[i + 1]]) for i, word in enumerate(new))
        else:
            self.known.update((word, self._whole(word)) for word in new)

    def encode(self, texts: list[str]) -> list[bytes]:
        """All ids of each text, four bytes each."""
        words = [None if (low := normalized(t)) is None else pre_tokens(low) for t in texts]
        self._learn(set().union(*(w for w in words if w)))
        known = self.known.__getitem__
        return [self._whole(t) if w is None else b"".join(map(known, w)) for t, w in zip(texts, words, strict=True)]


@cache
def word_ids(path: str, cached_words: int = CACHED_WORDS) -> WordIds:
    return WordIds(path, cached_words)
