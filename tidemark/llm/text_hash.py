"""Hashes of words and word windows of whole texts, by numpy over the bytes of an Arrow batch.

Word hashes are polynomials over table values of the bytes, modulo 2**64; window hashes are
polynomials over mixed word hashes. Both come from prefix sums, so a window of any length costs
the same.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _STEP, _OTHER = (int(x) | 1 for x in _rng.integers(2**40, 2**63, 3, dtype=np.int64))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        held = np.full(size, base, np.uint64)
        held[0] = 1
        held = _powers[base] = np.multiply.accumulate(held)
    return held[:n]


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a text's bytes."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none
    edge = np.diff(np.concatenate([[True], _BLANK[raw], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(raw: np.ndarray, lower: bool = False) -> np.ndarray:
    starts, ends = words(raw)
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = _BYTE[_LOWER[raw]] if lower else _BYTE[raw]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(raw)), out=sums[1:])
    inverse = _power(pow(_BASE, -1, 1 << 64), len(raw))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, length: int, other: bool = False) -> np.ndarray:
    """Hashes of all runs of ``length`` words; ``other`` gives a second, independent one."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = _OTHER if other else _STEP
    h = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) if other else hashes
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(step, len(h)), out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * _power(pow(step, -1, 1 << 64), n))


def text_bytes(value) -> np.ndarray:
    """Bytes of an Arrow string scalar; null is empty."""
    return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid and len(value.as_buffer()) else np.zeros(0, np.uint8)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by doubling."""
    m, have = x, 1
    while have * 2 <= width:
        m, have = np.minimum(m[:-have], m[have:]), have * 2
    rest = width - have
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the word runs from ``starts`` to ``ends`` (exclusive), of any lengths."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power(_STEP, len(hashes)), out=sums[1:])
    inverse = _power(pow(_STEP, -1, 1 << 64), len(hashes))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
