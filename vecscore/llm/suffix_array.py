"""Suffix array by induced sorting and permuted longest common prefixes, as array operations.

Suffixes are classified as larger or smaller than their right neighbour. The leftmost-smaller substrings are sorted by
one pass of induction, named, and, if names repeat, the string of names is sorted in the same way; the order of the
leftmost-smaller suffixes then induces the whole array. Induction runs bucket by bucket: all entries of a bucket that
are known induce their left neighbours at once, in order, and what falls into the same bucket is the next round. A
reduced string with so many different names that buckets hold a few entries each is sorted by doubling instead.
"""

from __future__ import annotations

import numpy as np

#: Entries a bucket on average, below which a reduced string is sorted by doubling.
LEAST_BUCKET = 500
#: Masks of the first 0 to 8 of eight bytes.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a place later; the end is smaller than all."""
    n = len(text)
    at = np.arange(n)
    differs = np.empty(n, bool)
    differs[-1], differs[:-1] = True, text[:-1] != text[1:]
    nearest = np.where(differs, at, n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    less = np.zeros(n, bool)
    less[:-1] = text[:-1] < text[1:]
    return less[nearest]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by key, the keys that occur, how often, and the place of each entry among its equals."""
    if not len(keys):
        return (np.zeros(0, np.int64),) * 4
    order = np.argsort(keys, kind="stable")
    found = keys[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    sizes = np.diff(np.append(first, len(keys)))
    return order, found[first], sizes, np.arange(len(keys)) - np.repeat(first, sizes)


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether text holds the same from each a and b on, over sizes places. Bytes are compared eight at a time."""
    out = np.ones(len(a), bool)
    live, at, step = np.arange(len(a)), 0, 1
    if text.dtype == np.uint8:
        step, text = 8, np.ndarray((len(text),), "<u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))
    while len(live):
        x = text[a + at] ^ text[b + at]
        if step > 1:
            x &= _LOWEST[np.minimum(sizes - at, 8)]
        equal = x == 0
        out[live[~equal]] = False
        at += step
        more = equal & (sizes > at)
        live, a, b, sizes = live[more], a[more], b[more], sizes[more]
    return out


def _induce(text: np.ndarray, small: np.ndarray, begins: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    n = len(text)
    out = np.full(n, -1, np.int32)
    order, keys, sizes, place = _groups(text[seeds])
    seeded = ends.copy()
    seeded[keys] -= sizes
    out[np.repeat(seeded[keys], sizes) + place] = seeds[order]
    head, tail = begins.copy(), ends.copy()
    out[head[text[-1]]] = n - 1
    head[text[-1]] += 1
    used = np.flatnonzero(ends > begins).tolist()

    def forward(found: np.ndarray) -> None:
        left = found - 1
        left = left[left >= 0]
        left = left[~small[left]]
        if len(left):
            order, keys, sizes, place = _groups(text[left])
            out[np.repeat(head[keys], sizes) + place] = left[order]
            head[keys] += sizes

    def backward(found: np.ndarray) -> None:
        left = found - 1
        left = left[left >= 0]
        left = left[small[left]]
        if len(left):
            order, keys, sizes, place = _groups(text[left])
            out[np.repeat(tail[keys], sizes) - 1 - place] = left[order]
            tail[keys] -= sizes

    for c in used:
        a = begins[c]
        while a < (b := head[c]):
            forward(out[a:b])
            a = b
        if seeded[c] < ends[c]:
            forward(out[seeded[c] : ends[c]])
    for c in reversed(used):
        b = ends[c]
        while (a := tail[c]) < b:
            backward(out[a:b][::-1])
            b = a
        if begins[c] < head[c]:
            backward(out[begins[c] : head[c]][::-1])
    return out


def _doubling(ranks: np.ndarray) -> np.ndarray:
    """The order of the suffixes of ranks, at first by as many ranks as 62 bits hold. A rank is the place of the first of its class; classes of one drop out of the sorting."""
    n, bits = len(ranks), int(ranks.max() + 1).bit_length()
    step = min(62 // bits, n)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: n - k] += ranks[k:] + 1
    order = np.argsort(key)
    found = key[order]
    first = np.concatenate([[True], found[1:] != found[:-1]])
    place = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = place
    while True:
        # slots of the order whose class holds more than one
        open_slots = np.flatnonzero(~first | ~np.append(first[1:], True))
        if not len(open_slots):
            return order
        own = order[open_slots]
        after = np.where(own + step < n, rank[np.minimum(own + step, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + after
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[open_slots] = own
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first[open_slots] = new
        rank[own] = np.maximum.accumulate(np.where(new, open_slots, 0))
        step *= 2


def suffix_array(text: np.ndarray, kinds: int = 256) -> np.ndarray:
    """The starts of text's suffixes in order; text holds numbers from 0 to kinds - 1."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _smaller(text)
    counts = np.bincount(text, minlength=kinds)
    ends = np.cumsum(counts)
    begins = ends - counts
    leftmost = small.copy()
    leftmost[0] = False
    leftmost[1:] &= ~small[:-1]
    seeds = np.flatnonzero(leftmost)
    if len(seeds) > 1:
        order = _induce(text, small, begins, ends, seeds)
        order = order[leftmost[order]]
        length = np.zeros(n, np.int64)
        length[seeds] = np.append(np.diff(seeds) + 1, n)
        sizes = length[order]
        same = np.flatnonzero((sizes[:-1] == sizes[1:]) & (sizes[:-1] < n))
        same = same[_equal(text, order[same].astype(np.int64), order[same + 1].astype(np.int64), sizes[same])]
        names = np.zeros(n, np.int64)
        new = np.ones(len(order), np.int64)
        new[0], new[same + 1] = 0, 0
        names[order] = np.cumsum(new)
        reduced = names[seeds]
        most = int(reduced.max()) + 1
        if most == len(seeds):
            seeds = order
        elif len(seeds) < most * LEAST_BUCKET:
            seeds = seeds[_doubling(reduced)]
        else:
            seeds = seeds[suffix_array(reduced, most)]
    return _induce(text, small, begins, ends, seeds)


def permuted_common_prefixes(data: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix of bytes, in text order, its neighbour below in the suffix array (-1: none) and how many bytes both begin with. Where both are preceded by the same byte, the value follows from the place before; only the others are compared, eight bytes at a time."""
    n = len(data)
    below = np.full(n, -1, np.int64)
    below[order[1:]] = order[:-1]
    at = np.arange(n)
    has = below >= 0
    reducible = has & (at > 0) & (below > 0)
    reducible[reducible] = data[at[reducible] - 1] == data[below[reducible] - 1]
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    own = np.flatnonzero(has & ~reducible)
    value = np.zeros(n, np.int64)
    live, other, done = own, below[own], 0
    limit = n - np.maximum(own, other)
    while len(live):
        x = eight[live + done] ^ eight[other + done]
        low = x & (~x + np.uint64(1))
        bits = np.where(x == 0, 64, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64))
        value[live] = np.minimum(done + bits // 8, limit)
        more = (x == 0) & (limit > done + 8)
        live, other, limit, done = live[more], other[more], limit[more], done + 8
    source = np.maximum.accumulate(np.where(reducible, 0, at))
    value = np.where(reducible, value[source] - (at - source), value)
    return below, value


def repeated_starts(data: np.ndarray, window: int) -> np.ndarray:
    """Whether the window bytes from each place also start at another place."""
    order = suffix_array(data)
    below, value = permuted_common_prefixes(data, order)
    long = value >= window
    out = long.copy()
    out[below[long]] = True
    return out
