"""Words of a text as arrays of 64-bit hashes, without a Python object for each word.

A text is looked at as its UTF-8 bytes.  A table gives every byte a class: 0 separates
words, and a word is a longest run of bytes of one class.  The hash of a word is a
polynomial in its bytes modulo 2**64, taken from running sums, so the cost is a few array
operations for the whole text however many words it has.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
_powers = np.ones(1, U64), np.ones(1, U64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_classes(separators: bytes = b"", **groups: bytes) -> np.ndarray:
    """Class of each byte: 0 for separators, 2, 3, ... for the given groups, 1 for the rest."""
    table = np.ones(256, np.uint8)
    for number, members in enumerate(groups.values(), start=2):
        table[list(members)] = number
    table[list(separators)] = 0
    return table


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            factors = np.full(size, base, U64)
            factors[0] = 1
            tables.append(np.cumprod(factors, dtype=U64))
        _powers = tuple(tables)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def words(data: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (in bytes) and hashes of the words of ``data``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64)
    kind = classes[data]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], edge))
    ends = np.concatenate((edge, [len(data)]))
    inside = kind[starts] != 0
    starts, ends = starts[inside], ends[inside]
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUE[data] * power[: len(data)], dtype=U64, out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * inverse[starts])


def word_hash(word: str, classes: np.ndarray) -> int:
    """Hash of a text that is one word under ``classes``."""
    found = words(utf8(word), classes)[2]
    if len(found) != 1:
        raise ValueError(f"not one word: {word!r}")
    return int(found[0])


_ORDER = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], U64)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words (at most eight), in order, with repeats.

    With fewer words than ``n``, but one at least, the whole sequence is the only run.
    """
    if not len(hashes):
        return np.zeros(0, U64)
    width = min(n, len(hashes))
    total = np.full(len(hashes) - width + 1, width, U64)
    for i in range(width):
        total += hashes[i : len(hashes) - width + 1 + i] * _ORDER[i]
    return mix(total)
