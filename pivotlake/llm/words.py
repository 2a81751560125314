"""Words of whole texts inside tasks. Texts come as UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import xxhash

# ``bytes.split()`` cuts at exactly the ASCII white space \x20 \x09-\x0D, so
# ``text.split()`` gives the words [^\x20\x09-\x0D]+.

_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_FOLD = bytes(b if b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def folded_words(text: bytes) -> list[bytes]:
    """Words of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split()


class WordCodes(dict):
    """64-bit codes of words, remembered up to a bound; beyond it they are computed again."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_ODD, n, 1 << 64))


def gram_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of every run of ``k`` words: a polynomial in the word codes, modulo 2^64.

    Runs are put together from halves, so the cost is logarithmic in ``k``.
    """
    if k == 1 or len(codes) < k:
        return codes[: max(0, len(codes) - k + 1)]
    left = k // 2
    a = gram_codes(codes, left)
    b = a if k - left == left else gram_codes(codes, k - left)
    n = len(codes) - k + 1
    return a[:n] * _power(k - left) + b[left : left + n]


def mixed(codes: np.ndarray) -> np.ndarray:
    """Scrambled so that order and low bits look random (an invertible step)."""
    x = codes ^ (codes >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))
