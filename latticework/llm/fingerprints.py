"""Hashes of word windows, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np
import pandas as pd

_U = np.uint64
#: An odd multiplier and its inverse modulo 2^64.
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    n, held = int(n), _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(1 << 16, 1 << (n - 1).bit_length()), base, dtype=np.uint64)
        steps[0] = 1
        held = _powers[base] = np.multiply.accumulate(steps)
    return held[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, dtype=np.uint64)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words that start at each place; rolling sums, so linear in the words."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(_MULT, n), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * powers(_INVERSE, n - width + 1))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    if len(x) < width:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def split_all(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts (ASCII white space parts them), and how many each text has."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            own = text.split()
            counts[i] = len(own)
            words += own
    return words, counts
