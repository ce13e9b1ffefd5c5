"""Byte-level pre-splitting of texts into words, and a memory of encoded words."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import regex

#: Words in each of the two tables of a :class:`Memory`.
REMEMBERED = 300_000
#: Longer words are encoded but not remembered.
LONGEST_REMEMBERED = 40

# White space of the pre-splitting pattern, and the pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
           rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

split_pieces = regex.compile(PATTERN).findall
#: A space between two characters that are not white always begins a word.
_gap = re.compile(rf"(?<=[^{WHITE}]) (?=[^{WHITE}])")
#: A space that is not such.
_odd_space = re.compile(rf"(?<![^{WHITE}]) | (?![^{WHITE}])").search
_odd_pairs = tuple(x for c in "\t\n\v\f\r" for x in (c + " ", " " + c)) + ("  ",)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


def uneven(text: str) -> bool:
    """Whether some space does not begin a word."""
    if text.isascii():
        return text[0] == " " or text[-1] == " " or any(pair in text for pair in _odd_pairs)
    return _odd_space(text) is not None


class Memory(dict):
    """Ids of words, as little-endian 32-bit integers; encodes a word it does not hold.

    Of bounded size: when full it becomes the older table and starts anew, and
    words still in use move over.
    """

    def __init__(self, encode):
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word) or self.encode(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


#: Marks of which one may end a word, and which never join letters.
STOPS = frozenset(",.;:!?|$%#*&()-/")


class WordEncoder:
    """Encodes whole texts word by word; subclasses encode one piece.

    A word is what stands between two spaces that each part two characters which
    are not white: no piece of the pattern reaches over its ends, so words are
    encoded alone.
    """

    def __init__(self, special: dict[str, int]):
        self.special = special
        self._cut = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        #: words after a space, by the word without it; and their last marks
        self._spaced = Memory(lambda word: self.encode_word(" " + word))
        self._stops = Memory(self.encode_piece)

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece of the pattern, as little-endian 32-bit integers."""
        raise NotImplementedError

    def encode_word(self, word: str) -> bytes:
        """Ids of a word; the two common shapes need no pattern."""
        if word[:1] == " ":
            body = word[1:]
            if body.isalpha():
                return self.encode_piece(word)
            if body[-1:] in STOPS:
                stem = body[:-1]
                if stem.isalpha():
                    return (self._spaced.get(stem) or self.encode_piece(word[:-1])) + self._stops[body[-1]]
        return b"".join(map(self.encode_piece, split_pieces(word)))

    def _plain(self, text: str, out: list[bytes]) -> None:
        words = _gap.split(text) if uneven(text) else text.split(" ")
        out.append(self.encode_word(words[0]))
        out.extend(map(self._spaced.__getitem__, words[1:]))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; the strings of special tokens become their ids."""
        parts = [text]
        if self._cut is not None and any(s in text for s in self.special):
            parts = self._cut.split(text)
        out: list[bytes] = []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], "<i4").tobytes())
            elif part:
                self._plain(part, out)
        return np.frombuffer(b"".join(out), "<i4")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of many texts, as bytes; a word that stands in several is looked up once.

        Most words of a batch stand in it several times, and the batch's own small
        table answers faster than the large one.
        """
        plain = [i for i, t in enumerate(texts)
                 if t and not uneven(t) and not any(s in t for s in self.special)]
        split = [texts[i].split(" ") for i in plain]
        first = [words[0] for words in split]
        for words in split:
            del words[0]
        own = dict.fromkeys(chain.from_iterable(split))
        own = dict(zip(own, map(self._spaced.__getitem__, own)))
        out = {i: self.encode_word(head) + b"".join(map(own.__getitem__, words))
               for i, head, words in zip(plain, first, split)}
        return [out[i] if i in out else self.encode(t).tobytes() for i, t in enumerate(texts)]
