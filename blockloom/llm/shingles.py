"""Hashes of words and word windows, in numpy, for the deduplication operators."""

from __future__ import annotations

import numpy as np
import xxhash

from blockloom.llm.common import memo, using

#: Words whose hashes a Python worker keeps; when there are more, it begins anew.
MEMO_ROWS = 250_000


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ROWS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_memo = _Memo()
memo("words", _memo.clear)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A factor for each place in a window, of two families.
_PLACES = mix(np.arange(1, 257, dtype=np.uint64)).reshape(2, 128) | np.uint64(1)


def words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text; lower: with A-Z in lower case."""
    if not text:
        return []
    return (text.lower() if lower else text).split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    using("words")
    return np.fromiter(map(_memo.__getitem__, found), np.uint64, len(found))


def windows(hashes: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """A hash of each run of so many words (128 at most), in order; none if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * _PLACES[family, k]
    return mix(out)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The distinct shingles of a text, sorted: of fewer words, their whole sequence; of none, nothing."""
    hashes = word_hashes(words(text, lower=True))
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(width, len(hashes))))
