"""Words and word shingles of whole batches of texts, as arrays of hashes.

A kernel sees the UTF-8 bytes of many documents at once: a table says which
bytes belong to words, and a word's hash takes in eight bytes at a time, mixing
after each, so that no arrangement of letters makes words collide by structure
(as it does with polynomials modulo 2**64). No Python object is made per word.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

#: Words of more bytes are hashed one by one.
LONG = 256
SHINGLE = 5

_PLACE = np.random.default_rng(20240301).integers(1, 1 << 63, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_STEP = np.uint64(0x9FB21C651E98DF25)
#: Masks of a number's first 0 to 8 bytes.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_bytes = np.arange(256)
#: Bytes with A-Z in lower case.
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))
#: 0-9, a-z (after lower-casing) and every byte of a character beyond ASCII.
ALNUM = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)


class Words(NamedTuple):
    """``starts``/``ends``: byte positions; ``first[d]:first[d + 1]``: words of text d."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> Words:
    """Maximal runs of member bytes; a run never crosses from one text into the next."""
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64))
    inside = member[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hash_words(data: np.ndarray, words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; another seed gives another, unrelated one."""
    starts, lengths = words.starts, words.ends - words.starts
    # every place's next eight bytes as one number
    eights = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    out = mix(lengths.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    at, left, which = starts, lengths, slice(None)
    short = lengths <= LONG
    if not short.all():
        which = np.flatnonzero(short)
        at, left = starts[which], lengths[which]
        for i in np.flatnonzero(~short):
            digest = hashlib.blake2b(data[starts[i]:words.ends[i]], digest_size=8, salt=seed.to_bytes(8, "little"))
            out[i] = int.from_bytes(digest.digest(), "little")
    while len(at):
        block = eights[at]
        few = left < 8
        np.bitwise_and(block, _HEAD[np.minimum(left, 8)], out=block, where=few)
        out[which] = mix(out[which] ^ block) * _STEP
        more = np.flatnonzero(left > 8)
        which = more if isinstance(which, slice) else which[more]
        at, left = at[more] + 8, left[more] - 8
    return mix(out)


def hash_text(word: str) -> int:
    """The hash :func:`hash_words` gives this one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hash_words(data, Words(np.array([0]), np.array([len(data)]), np.array([0, 1])))[0])


def hash_runs(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words (across texts too: the caller cuts)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += hashes[k:n + k] * _PLACE[k]
    return mix(total)


def shingles(runs: np.ndarray, hashes: np.ndarray, low: int, high: int) -> np.ndarray:
    """Shingles of the text with words ``low:high``, with repeats, in order.

    ``runs`` are the :func:`hash_runs` of all words. A text with fewer words
    than a shingle has one, its whole sequence; a text without words has none.
    """
    if high - low >= SHINGLE:
        return runs[low:high - SHINGLE + 1]
    return hash_runs(hashes[low:high], high - low) if high > low else np.empty(0, np.uint64)
