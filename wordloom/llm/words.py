"""Words of many texts at once, as arrays over the bytes of an Arrow batch."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: An odd number and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Scripts that put no spaces between words; each of their characters is a word.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))


def unspaced(c: int) -> bool:
    return any(low <= c <= high for low, high in UNSPACED)


#: A block of letters that still grows: Arrow knows the lower case of more of them than Python does.
_LATER = slice(0xA7C0, 0xA7F2)


@functools.lru_cache(1)
def word_kinds() -> np.ndarray:
    """For each code point 1 if it is part of words (a letter, digit, mark or underscore), 2 if it is a word of its own, else 0."""
    out = np.zeros(0x110000, np.uint8)
    out[[c for c in _assigned() if unicodedata.category(chr(c))[0] in "LNM"]] = 1
    out[_LATER] |= 1
    for low, high in UNSPACED:
        of = out[low : high + 1]
        of[[unicodedata.category(chr(c))[0] in "LN" for c in range(low, high + 1)]] = 2
    out[ord("_")] = 1
    return out


@functools.lru_cache(1)
def letter_kinds() -> np.ndarray:
    """For each code point 1 if it is a letter, or a number that is no decimal digit."""
    out = np.zeros(0x110000, np.uint8)
    out[[c for c in _assigned() if (k := unicodedata.category(chr(c)))[0] == "L" or k in ("Nl", "No")]] = 1
    out[_LATER] |= 1
    return out


def _assigned() -> Iterator[int]:
    return (c for block in (range(0xD800), range(0xE000, 0x323B0), range(0xE0000, 0xE0200)) for c in block)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """``data``: the bytes of all texts; ``offsets``: where each begins, and the end. For each word its hash, text, start and length."""

    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    start: np.ndarray
    length: np.ndarray


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of strings; a null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _high(data: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where characters of several bytes begin, how many they have, and their kinds."""
    lead = np.flatnonzero(data >= 0xC0)
    more = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
    a, b, c, d = more[lead], more[lead + 1] & 0x3F, more[lead + 2] & 0x3F, more[lead + 3] & 0x3F
    size = 2 + (a >= 0xE0) + (a >= 0xF0)
    points = np.where(size == 2, (a & 0x1F) << 6 | b, np.where(size == 3, (a & 0xF) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d))
    return lead, size, kinds[points]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, or more, of the base and of its inverse."""
    return _powers(max(1 << 20, 1 << max(n - 1, 0).bit_length()))


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)))) for x in (_BASE, _BACK))


def composed(texts: pa.Array) -> pa.Array:
    """The texts in normal form C."""
    if not len(high := raw(texts)[0]) or high.max() < 128:
        return texts
    return pa.array([t and unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def split(texts: pa.Array, lower: bool = True, kinds: np.ndarray | None = None) -> Words:
    """Runs of letters, digits and marks, in lower case; ``hashes`` depend on nothing else. Where scripts put no spaces, each character is a word.

    ``kinds`` says of each code point what it is to words, by default ``word_kinds()``.
    """
    kinds = word_kinds() if kinds is None else kinds
    data, offsets = raw(pc.utf8_lower(texts) if lower else texts)
    inside = np.append(kinds[:128] > 0, np.zeros(128, bool))[data]
    lead, size, kind = _high(data, kinds)
    for k in range(4):
        inside[lead[(kind > 0) & (size > k)] + k] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] |= inside[heads]
    if (alone := kind == 2).any():
        first[lead[alone]] = True
        after = (lead + size)[alone]
        after = after[after < len(data)]
        first[after] |= inside[after]
    start = np.flatnonzero(first)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(data, offsets, np.zeros(0, np.uint64), none, none, none)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    # A word's hash is a polynomial of its bytes: the running sum over all bytes, with the power of its first place divided out.
    up, down = powers(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_BYTE[data], up[: len(data)], out=run[1:])
    np.cumsum(run[1:], out=run[1:])
    length = end - start
    hashes = mix((run[end] - run[start]) * down[start] + length.astype(np.uint64))
    text = np.searchsorted(offsets, start, "right") - 1
    return Words(data, offsets, hashes, text, start, length)
