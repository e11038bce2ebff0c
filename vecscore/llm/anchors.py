"""Content anchors: of each window of a text the grain (short substring) with the least hash.

Equal windows have equal least grains, wherever they stand. Neighbouring windows with the same least grain form a run;
every window lies in one run, and two equal windows lie in runs with the same key. So the runs whose key occurs once
need no closer look. Ties between equal grains are broken by position modulo TIE, which keeps runs long in periodic
text too; the key is the grain's hash without the position, so a tie never separates equal windows.
"""

from __future__ import annotations

import numpy as np

GRAIN, TIE = 32, 512
_LOW = np.uint64(TIE - 1)
_rng = np.random.default_rng(20260101)
_SIGN = _rng.integers(1 << 63, size=256, dtype=np.uint64)


#: Odd multipliers, one for each doubling.
_FACTORS = [np.uint64(int(x) | 1) for x in _rng.integers(1 << 63, size=40, dtype=np.uint64)]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes."""
    a = a * np.uint64(0x9E3779B97F4A7C15)
    a += b
    a ^= a >> np.uint64(29)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    return a


def grain_hashes(data: np.ndarray, size: int, signs: np.ndarray = _SIGN) -> np.ndarray:
    """The hash of the size bytes that start at each place: sums of the bytes' random values, weighted by place modulo 2 ** 64, and mixed at the end. Doubling makes the hashes of powers of two, which are put together for size."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, done, step, out = signs[data], 0, 1, None
    for factor in _FACTORS:
        if size & step:
            part = power[done : done + n]
            out = part.copy() if out is None else out * factor + part
            done += step
        if done == size:
            break
        left = power[:-step] * factor
        left += power[step:]
        power, step = left, 2 * step
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, window: int, grain: int = GRAIN) -> tuple[np.ndarray, ...]:
    """Of texts that lie in data from begins to ends, in order: each run's first window, last window, key, whether it holds tied grains (so that it may hold a window twice by itself), its anchor's place (if it has no ties, the only grain with its key), and the number of its text. And the hashes of all grains. No run crosses a text's end."""
    width = window - grain + 1
    h = grain_hashes(data, grain)
    if len(h) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, bool), none, none, h
    low = np.arange(len(h), dtype=np.uint64) & _LOW
    packed = h | _LOW
    packed ^= low
    least = sliding_min(packed, width)
    packed ^= _LOW
    other = sliding_min(packed, width)
    # low bits are stored inverted: ties go to the last place modulo TIE in one and to the first in the other
    own = np.full(len(least), -1, np.int64)
    sizes = np.maximum(ends - begins - window + 1, 0)
    at = np.repeat(begins, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own[at] = np.repeat(np.arange(len(begins)), sizes)
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (own[1:] != own[:-1])]))
    last = np.append(first[1:] - 1, len(least) - 1)
    tied = np.logical_or.reduceat((least & _LOW) ^ _LOW != (other & _LOW), first)
    inside = own[first] >= 0
    first, last, tied = first[inside], last[inside], tied[inside]
    place = first + ((((least[first] & _LOW) ^ _LOW).astype(np.int64) - first) & (TIE - 1))
    return first, last, (least[first] >> np.uint64(9)).astype(np.int64), tied, place, own[first], h
