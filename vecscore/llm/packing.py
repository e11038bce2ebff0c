"""Packing: documents as token ids into sequences of a fixed length, by best-fit decreasing.

A document longer than the window is first cut into full windows. The rests are placed longest first, each into the open
window with the least room that still holds it; a segment tree indexed by remaining capacity finds that window. Windows
that stay open are then closed: the emptiest gives its pieces, cut where needed, to the fullest, and the last one is
cut into sequences whose lengths are powers of two, which need no padding.

Packing runs shard by shard inside each input partition: a shard is SHARD tokens of consecutive documents, so memory
is bounded whatever a partition holds, there is no exchange, a hot source is spread as its files are, and a
lost task gives the same sequences again. Sequence ids hold the partition's number, so they are unique.

Defined cases: null text counts as empty; an empty document is its end token alone. Repeated rows are packed each time.
Empty tables give empty results, extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecscore.llm.common import kept, slices
from vecscore.llm.tokens import WordBpe

WINDOW, END_ID, SHARD = 4096, 2, 4_000_000
#: Characters of the texts whose ids are found at once, and their number.
ROUND, TEXTS = 8_000_000, 1 << 16
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Capacities:
    """Open windows by remaining capacity: a segment tree of counts. tightest(n) is the least capacity of at least n that any has, or -1."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, n: int) -> None:
        at = self.base + room
        while at:
            self.count[at] += n
            at >>= 1

    def push(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def pop(self, room: int) -> int:
        self._add(room, -1)
        return self.open[room].pop()

    def tightest(self, n: int) -> int:
        at, count = self.base + n, self.count
        if count[at]:
            return n
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.base
            at >>= 1
        return -1


Piece = tuple[int, int, int]  #: document, start, length


def best_fit(pieces: Iterable[Piece], window: int = WINDOW) -> list[list[Piece]]:
    """Windows of the pieces, none longer than the window; the longest go first."""
    rooms, out = Capacities(window), []
    for piece in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        room = rooms.tightest(piece[2])
        if room < 0:
            out.append([piece])
            own, left = len(out) - 1, window - piece[2]
        else:
            own, left = rooms.pop(room), room - piece[2]
            out[own].append(piece)
        if left:
            rooms.push(left, own)
    return out


def close(windows: list[list[Piece]], window: int = WINDOW) -> list[list[Piece]]:
    """The same pieces, some of them cut, in windows that are full or whose length is a power of two."""
    used = [sum(p[2] for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda k: -used[k])
    out = [windows[k] for k in order]
    room = [window - used[k] for k in order]
    first, last = 0, len(out) - 1
    while first < last:
        if not room[first]:
            first += 1
            continue
        doc, start, n = out[last].pop()
        take = min(n, room[first])
        out[first].append((doc, start, take))
        room[first] -= take
        if take < n:
            out[last].append((doc, start + take, n - take))
        if not out[last]:
            last -= 1
    out = out[: last + 1]
    if out and (total := sum(p[2] for p in out[-1])) < window:
        rest = out.pop()[::-1]
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            part: list[Piece] = []
            while size:
                doc, start, n = rest.pop()
                take = min(n, size)
                part.append((doc, start, take))
                size -= take
                if take < n:
                    rest.append((doc, start + take, n - take))
            out.append(part)
    return out


def pack_shard(ids: list[np.ndarray], window: int = WINDOW) -> list[list[Piece]]:
    full, rests = [], []
    for k, own in enumerate(ids):
        cut = len(own) // window * window
        full += [[(k, at, window)] for at in range(0, cut, window)]
        if cut < len(own):
            rests.append((k, cut, len(own) - cut))
    return full + close(best_fit(rests, window), window)


def rounds(batches: Iterator[pa.RecordBatch], most: int = ROUND, count: int = TEXTS) -> Iterator[tuple[list[int | None], list[str]]]:
    """All ids and texts of the rows, in runs of at most so many texts, and of so many characters or a single text."""
    names: list[int | None] = []
    texts: list[str] = []
    held = 0
    for b in slices(batches, 64):
        for name, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if texts and (held + len(text) > most or len(texts) == count):
                yield names, texts
                names, texts, held = [], [], 0
            names.append(name)
            texts.append(text)
            held += len(text)
    if texts:
        yield names, texts


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """A row for each piece: SCHEMA, and with with_ids its token ids (array<int>). tokenizer_path is read where the work is done and must be there."""
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe = kept(f"tokenizer {tokenizer_path}", lambda: WordBpe(tokenizer_path))
        sequence = TaskContext.get().partitionId() << 40
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            rows: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for own in pack_shard(ids, window):
                offset = 0
                for k, start, n in own:
                    part = ids[k][start : start + n]
                    values = (names[k], start, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids[k]), sequence, offset, *([part.astype(np.int32)] if with_ids else []))
                    for column, v in zip(rows.values(), values, strict=True):
                        column.append(v)
                    offset += n
                sequence += 1
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))

        end = np.array([end_id], bpe.kind)
        for keys, texts in rounds(batches):
            for name, own in zip(keys, bpe.encode_batch(texts), strict=True):
                names.append(name)
                ids.append(np.concatenate([own, end]))
                held += len(own) + 1
                if held >= shard:
                    yield flush()
                    names, ids, held = [], [], 0
        if ids:
            yield flush()

    return slim.mapInArrow(run, schema)

