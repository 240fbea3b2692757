"""Hashed character n-grams of a text, vectorised over its code points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 18


@lru_cache(maxsize=1)
def _alphanumeric() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = _CHUNK + 16
    ups, downs = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    ups[0] = downs[0] = 1
    return np.cumprod(ups), np.cumprod(downs)


def _mix(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def has_letter(text: str) -> bool:
    return bool(_letters()[code_points(text)].any())


def _chunks(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of at most ``_CHUNK`` codes, cut after a zero; a longer word is cut where it has to be."""
    while len(codes) > _CHUNK:
        zeros = np.nonzero(codes[:_CHUNK] == 0)[0]
        cut = int(zeros[-1]) + 1 if len(zeros) and zeros[-1] else _CHUNK
        yield codes[:cut]
        codes = codes[cut:]
    yield codes


def word_grams(text: str, least: int, most: int, bits: int, letters_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Per chunk: bucket of every n-gram, the word it belongs to, and the number of words.

    Words are runs of letters and digits (letters only, if asked) in lower case; n-grams
    of ``least`` to ``most`` characters lie within a word and its two boundary marks; the
    marked word as a whole is one more.
    """
    table = _letters() if letters_only else _alphanumeric()
    codes = code_points(text)
    codes = np.where(table[codes], codes, 0)
    ups, downs = _powers()
    for part in _chunks(codes):
        c = np.zeros(len(part) + 2, np.uint64)
        c[1:-1] = part
        mark = c == 0
        begins = np.nonzero(mark[:-1] & ~mark[1:])[0]
        if not len(begins):
            continue
        ends = np.nonzero(~mark[:-1] & mark[1:])[0] + 1
        word = np.cumsum(np.concatenate(([False], mark[:-1] & ~mark[1:]))) - 1
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((c + np.uint64(7)) * ups[: len(c)])))
        marks = np.concatenate(([0], np.cumsum(mark)))
        at = [begins]
        hashes = [((total[ends + 1] - total[begins]) * downs[begins]) ^ np.uint64(1)]
        for n in range(least, most + 1):
            i = np.arange(len(c) - n + 1)
            i = i[marks[i + n - 1] == marks[i + 1]] if n > 2 else i[~mark[i]]
            at.append(i)
            hashes.append((total[i + n] - total[i]) * downs[i])
        where = np.concatenate(at)
        yield _mix(np.concatenate(hashes), bits), word[where + (1 if least > 2 else 0)] if least > 2 else word[where], len(begins)
