"""Hashes of words and word shingles of many texts at once, in numpy.

A word is a maximal run of bytes other than ASCII white space, in lower case. A shingle is ``width`` words
in a row; a text of fewer words has the one shingle of all its words, and a text without words has none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit word over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of several texts in order."""

    hashes: np.ndarray  # uint64 of each word
    text: np.ndarray  # number of its text
    starts: np.ndarray  # first byte, counted from the start of its text
    ends: np.ndarray
    first: np.ndarray  # number of the first word of each text, and the count of all at the end


def words_of(texts: Sequence[str | None]) -> Words:
    return _split([_lower(t) for t in texts], _SPACE)


def terms_of(texts: Sequence[str | None]) -> Words:
    """Maximal runs of ASCII letters and digits and of any other characters beyond ASCII, A-Z alone in lower case."""
    return _split([(t or "").encode("utf-8", "replace") for t in texts], _NO_TERM)


def _split(encoded: list[bytes], separator: np.ndarray) -> Words:
    """Runs of bytes that do not separate; a line end must, and A-Z count as a-z."""
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    begins = np.cumsum([0, *(len(e) + 1 for e in encoded)])
    space = separator[data]
    at_start = ~space
    at_start[1:] &= space[:-1]
    at_end = space.copy()
    at_end[1:] &= ~space[:-1]
    at_end[:1] = False
    starts, ends = np.flatnonzero(at_start), np.flatnonzero(at_end)
    power, inverse = _power_tables(max(1, len(data)))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, begins)
    text = np.repeat(np.arange(len(encoded)), np.diff(first))
    return Words(hashes, text, starts - begins[text], ends - begins[text], first)


def _lower(text: str | None) -> bytes:
    """Lower case in UTF-8, byte for byte at the same place as in the text itself.

    Characters are folded one by one, and those whose lower case has another length stay as they are.
    """
    if not text:
        return b""
    plain, lower = text.encode("utf-8", "replace"), text.lower().encode("utf-8", "replace")
    if len(lower) == len(plain) and "Σ" not in text:  # the one letter whose lower case depends on what follows
        return lower
    same_length = {ord(c): c.lower() for c in set(text) if len(c.lower().encode("utf-8", "replace")) == len(c.encode("utf-8", "replace"))}
    return text.translate(same_length).encode("utf-8", "replace")


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every ``width`` consecutive word hashes: a polynomial in a fixed base."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = out * np.uint64(_WORD_BASE) + hashes[k : n + k]
    return mix(out)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of every shingle, in order."""
    counts = np.diff(words.first)
    hashes = windows(words.hashes, width)
    whole = words.text[: len(hashes)] == words.text[width - 1 :] if len(hashes) else np.zeros(0, bool)
    hashes, text = hashes[whole], words.text[: len(whole)][whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = [windows(words.hashes[words.first[i] : words.first[i + 1]], int(counts[i]))[0] for i in short]
        hashes, text = np.concatenate([hashes, np.array(extra, np.uint64)]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        hashes, text = hashes[order], text[order]
    return hashes, text
