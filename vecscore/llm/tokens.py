"""Token ids of a word-level BPE file of the public tokenizers, the same as the tokenizers library gives but several times faster.

The file's normaliser and splitter never look across white space, so a text's ids are those of its white-space-separated
chunks. A batch's chunks are numbered by Arrow; only the different ones are cut into pieces, only the different pieces are
merged, in blocks of rows step by step as array operations, and the texts' ids are then gathered by number. No chunk that these
rules cover becomes a Python object, and nothing is kept from one batch to the next. What they don't cover (special tokens inside
a text, letters whose lower case depends on their place, separators that the two libraries class differently, chunks outside the
Latin blocks) goes to the library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What sends a text to the library: special tokens, capital sigma, control characters that str.split() takes for white space.
HARD_MARKS = ("<|", "Σ", "\x1c", "\x1d", "\x1e", "\x1f")
#: Chunks that are merged here.
EASY_CHUNK = re.compile("[\x21-\x7e¡-ſ‐-…]+")
PIECE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Symbols of a piece that is merged here, pieces of a block, and words that are gathered at once.
LONGEST, ROWS, GATHERED = 48, 16_384, 1 << 18
NONE = np.int32(1 << 30)
#: Bits of a slot's number, and what spreads the pairs over the slots.
SLOT_BITS, SPREAD = 18, np.uint64(0x9E3779B97F4A7C15)
#: Bytes of lower-case letters up to U+017F (1), of signs that are neither letter, digit nor apostrophe (2), and all others.
LETTER, SIGN = 1, 2
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = SIGN
KINDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x27]] = 0
KINDS[[*range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = LETTER


def byte_signs() -> list[str]:
    """The character that stands for each byte: itself where it is printable and no space, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        signs = byte_signs()
        self.inner = np.array([ids[c] for c in signs], np.int32)
        self.last = np.array([ids[c + end] for c in signs], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # by rank, and a last one that no pair has
        self.keys = np.array([*(ids[a] << 20 | ids[b] for a, b in pairs), -2], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        # a slot's lowest rank, and of each rank the next one of its slot
        self.slots = np.full(1 << SLOT_BITS, len(pairs), np.int32)
        self.further = np.full(len(pairs) + 1, -1, np.int32)
        for rank, slot in reversed(list(enumerate(self._slot(self.keys[:-1]).tolist()))):
            if self.slots[slot] < len(pairs):
                self.further[rank] = self.slots[slot]
            self.slots[slot] = rank
        # the ranks of two bytes, the second of which is or is not a word's last
        left, right = np.repeat(self.inner, 512), np.tile(np.concatenate([self.inner, self.last]), 256)
        self.first = self._ranks(left, right)
        self.split = regex.compile(PIECE).findall
        self.kind = np.uint16 if max(ids.values()) < 1 << 16 else np.uint32

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        # an absent sign, -1, makes a key below zero, which none has
        keys = left.astype(np.int64) << 20 | right
        rank = self.slots[self._slot(keys)]
        out = np.where(same := self.keys[rank] == keys, rank, NONE)
        open_ = np.flatnonzero(~same & (self.further[rank] >= 0))
        while len(open_):
            rank[open_] = own = self.further[rank[open_]]
            same = self.keys[own] == keys[open_]
            out[open_[same]] = own[same]
            open_ = open_[~same & (self.further[own] >= 0)]
        return out

    def _merge_block(self, raw: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols are rows of places with an absent one at either end; a place knows its neighbours, and the rank of the pair that it begins."""
        width, rows = int(n.max()), np.arange(len(n))
        columns, full = np.arange(width), width + 2
        inside = columns < n[:, None]
        signs = raw[np.minimum(starts[:, None] + columns, len(raw) - 1)].astype(np.int32)
        state = np.full((len(n), full), -1, np.int32)
        state[:, 1:-1] = np.where(inside, self.inner[signs], -1)
        state[rows, n] = self.last[signs[rows, n - 1]]
        ranks = np.full((len(n), full), NONE, np.int32)
        seconds = signs[:, 1:] + 256 * (columns[1:] == n[:, None] - 1)
        ranks[:, 1:-2] = np.where(inside[:, 1:], self.first[signs[:, :-1] << 9 | seconds], NONE)
        after = np.tile(np.arange(1, full + 1, dtype=np.int8), len(n))
        before = np.tile(np.arange(-1, full - 1, dtype=np.int8), len(n))
        live, symbols = rows * full, state.ravel()
        while True:
            best = ranks.argmin(axis=1)
            low = ranks[rows, best]
            on = low != NONE
            if not on.all():
                live, ranks, best, low = (x[on] for x in (live, ranks, best, low))
                rows = rows[: len(live)]
                if not len(live):
                    break
            at = live + best
            gone = after[at]
            nxt, prev = after[live + gone], before[at]
            new = self.merged[low]
            symbols[at], symbols[live + gone] = new, -1
            after[at], before[live + nxt] = nxt, best
            ranks[rows, gone] = NONE
            ranks[rows, best] = self._ranks(new, symbols[live + nxt])
            ranks[rows, prev] = self._ranks(symbols[live + prev], new)
        there = state >= 0
        return state[there].astype(self.kind), there.sum(axis=1)

    def merge(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The ids of pieces of raw, in parts of one pool, and where in the pool each piece's begin and how many they are. The lowest merge goes first, of equal ones the leftmost."""
        parts, held = [], 0
        begins, sizes = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for low, high in ((1, 6), (7, 9), (10, 12), (13, 24), (25, LONGEST)):
            group = np.flatnonzero((lengths >= low) & (lengths <= high))
            for first in range(0, len(group), ROWS):
                own = group[first : first + ROWS]
                flat, n = self._merge_block(raw, starts[own], lengths[own])
                begins[own], sizes[own] = held + np.cumsum(n) - n, n
                parts.append(flat)
                held += len(flat)
        for k in np.flatnonzero(lengths > LONGEST).tolist():
            flat = self._library(raw[starts[k] : starts[k] + lengths[k]].tobytes().decode())
            begins[k], sizes[k] = held, len(flat)
            parts.append(flat)
            held += len(flat)
        return parts, begins, sizes

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)

    def _odd(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of chunks that are not letters or signs alone."""
        cut = [self.split(c) if EASY_CHUNK.fullmatch(c) else None for c in chunks]
        pieces = list({p for own in cut if own for p in own})
        raw = [p.encode() for p in pieces]
        lengths = np.array([len(p) for p in raw], np.int64)
        parts, begins, sizes = self.merge(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths) - lengths, lengths)
        pool = np.concatenate([*parts, np.zeros(0, self.kind)])
        ids = {p: pool[b : b + n] for p, b, n in zip(pieces, begins.tolist(), sizes.tolist(), strict=True)}
        return [self._library(c) if own is None else np.concatenate([ids[p] for p in own]) for c, own in zip(chunks, cut, strict=True)]

    def _chunk_ids(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each chunk's begin and how many they are."""
        ends, kinds, _ = bytes_of(chunks)
        # letters and what follows them, where a chunk is letters and then signs; else the chunk and nothing
        letters, signs = counted(kinds == LETTER), counted(kinds == SIGN)
        middle = ends[:-1] + letters[ends[1:]] - letters[ends[:-1]]
        plain = (letters[middle] - letters[ends[:-1]] == middle - ends[:-1]) & (signs[ends[1:]] - signs[middle] == ends[1:] - middle)
        cuts = np.append(np.stack([ends[:-1], np.where(plain, middle, ends[1:])], axis=1), ends[-1]).astype(np.int32)
        halves = pa.Array.from_buffers(pa.binary(), 2 * len(chunks), [None, pa.py_buffer(cuts), chunks.buffers()[2]]).dictionary_encode()
        pieces, number = halves.dictionary, halves.indices.to_numpy()
        ends, kinds, raw = bytes_of(pieces)
        lengths = np.diff(ends)
        letters, signs = counted(kinds == LETTER), counted(kinds == SIGN)
        whole = (np.diff(letters[ends]) == lengths) | (np.diff(signs[ends]) == lengths)
        parts, begins, sizes = self.merge(raw, ends[:-1], np.where(whole, lengths, 0))
        others, held = np.flatnonzero(~whole), sum(map(len, parts))
        for k, ids in zip(others.tolist(), self._odd(pieces.take(pa.array(others)).cast(pa.string()).to_pylist()), strict=True):
            begins[k], sizes[k] = held, len(ids)
            parts.append(ids)
            held += len(ids)
        pool = gathered(np.concatenate([*parts, np.zeros(0, self.kind)]), begins[number], sizes[number])
        own = sizes[number].reshape(-1, 2).sum(axis=1)
        return pool, np.cumsum(own) - own, own

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens. All of the texts are worked on at once."""
        plain, hard = [], set()
        for k, t in enumerate(texts):
            if any(m in t for m in HARD_MARKS):
                hard.add(k)
                t = ""
            elif not t.isascii() and not unicodedata.is_normalized("NFC", t):
                t = unicodedata.normalize("NFC", t)
            plain.append(t.lower())
        split = pc.utf8_split_whitespace(pa.array(plain, pa.string()))
        chunks, ends = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        del plain, split
        pool, begins, sizes = self._chunk_ids(chunks.dictionary)
        number = chunks.indices.to_numpy()
        out: list[np.ndarray] = []
        while len(out) < len(texts):
            first = len(out)
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + GATHERED, side="right")) - 1)
            own = number[ends[first] : ends[last]]
            n = sizes[own]
            flat = gathered(pool, begins[own], n)
            edges = np.concatenate([[0], np.cumsum(n)])[ends[first : last + 1] - ends[first]].tolist()
            out += [flat[a:b] for a, b in zip(edges, edges[1:])]
        for k in hard:
            out[k] = self._library(texts[k])
        return out


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The offsets of strings in their bytes, the bytes' kinds, and the bytes. Signs that share a letter's first byte are of no kind."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32, len(strings) + 1, 4 * strings.offset).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None and ends[-1] else np.zeros(0, np.uint8)
    kinds = KINDS[raw]
    lead = np.flatnonzero(raw == 0xC3)
    kinds[lead[(raw[lead + 1] == 0x97) | (raw[lead + 1] == 0xB7)]] = 0
    return ends, kinds, raw


def counted(marks: np.ndarray) -> np.ndarray:
    """How many marks stand before each place, the place after the last included."""
    out = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks, out=out[1:])
    return out


def gathered(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of the pool one after another."""
    ends = np.cumsum(sizes)
    at = np.repeat(begins - ends + sizes, sizes)
    at += np.arange(len(at))
    return pool[at]
