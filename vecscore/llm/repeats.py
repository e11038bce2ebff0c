"""Suffix-array dedup: removes every byte covered by a long string that also starts elsewhere in the corpus.

1. Runs. Each document's windows are grouped into runs by content anchors (see anchors): equal windows always lie in
   runs with the same key. Runs whose key occurs once are done.
2. Copies. Runs with equal bytes are collapsed to one context with a count; a context that occurs twice is covered whole.
3. Probes. A window that holds the anchor at offset x holds a fixed stretch of bytes around it for each range of x. Contexts
   none of whose stretches is shared with another context, and that hold no tied grain, need no closer look.
4. Suffix arrays. The bytes of the contexts left go, by key, to shards of bounded size. Each shard's suffix array is
   induced linearly, its permuted common prefixes give the windows that start twice. A key with more bytes than a shard
   holds is settled exactly by counting its windows' 128-bit hashes in an aggregate instead, so no task holds a hot key.
5. What is covered goes back to all occurrences of each context and is joined to the documents.

The same is done with the documents as sequences of words, each word a code of CODE bytes, to find passages of more than
PASSAGE words that occur twice. These are reported and not removed: in bytes they are often shorter than the window.

Texts move where something is cut out of them or removed from them, all else is a few numbers a run; other texts stay in place.

Defined cases: null text is empty. Texts shorter than the window lose nothing. Rows are told apart by two hashes of id and text,
so null ids are no exception, and rows that repeat both are copies of each other and lose what they share, which is all windows. Words
are compared with A to Z lower-cased, by 32-bit codes (so 51 words by 1632 bits). Equality of whole
contexts and of a hot key's windows is by hash (64 bits within a key, 128 bits). Extra columns are ignored, empty tables
give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecscore.llm import anchors
from vecscore.llm.common import drop_written, suspects, written
from vecscore.llm.near_dedup import Shingler
from vecscore.llm.suffix_array import repeated_starts

WINDOW, SHARD = 400, 2_000_000
#: Passages longer than PASSAGE words are reported; a word's code has CODE bytes, none of them END.
PASSAGE, CODE = 50, 4
#: Bytes of text that are looked at together: the numbers of each place stay in a core's cache.
SLICE = 1 << 17
#: Ranges of the anchor's offset in a window, each with a probe.
PROBES = 5
END = np.uint8(255)  #: never in UTF-8


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row's begin; the last entry is the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8), at


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Like _texts(), with a code of CODE bytes for each word in place of the text."""
    codes, sizes = [], [0]
    for value, ends in Shingler(1, SLICE).words_of(column.cast(pa.binary()).to_pylist()):
        value, own = value >> np.uint64(32), np.zeros((len(value), CODE), np.uint8)
        for k in range(CODE):
            value, own[:, k] = np.divmod(value, np.uint64(END))
        codes.append(own.reshape(-1))
        sizes += np.diff([0, *ends]).tolist()
    return np.concatenate(codes) if codes else np.zeros(0, np.uint8), np.cumsum(np.array(sizes, np.int64)) * CODE


def probe_hashes(grains: np.ndarray, place: np.ndarray, window: int, grain: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of the anchors at place: for each range of offsets, the hash of the bytes that all its windows hold, and whether those lie in the text."""
    reach = window - grain + 1
    step = -(-reach // PROBES)
    size = window - step + 1
    inner = [*range(0, size - grain, grain), size - grain]
    out = []
    for k in range(PROBES):
        begin = place - k * step
        inside = (begin >= 0) & (begin + size - grain < len(grains))
        at = np.where(inside, begin, 0)
        value = np.full(len(place), k, np.uint64)
        for d in inner:
            value = anchors.combine(value, grains[np.minimum(at + d, len(grains) - 1)])
        out.append((value.astype(np.int64), inside))
    return out


RUNS = "doc_id bigint, th bigint, first int, last int, key bigint, context bigint, tied boolean, place int, " + ", ".join(f"p{k} bigint" for k in range(PROBES))


KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]


def find_runs(docs: DataFrame, window: int = WINDOW, grain: int = anchors.GRAIN, view: Callable = _texts) -> DataFrame:
    """docs: doc_id, th, text. A row for each run (RUNS); a probe that no window of the run has is null."""
    step = -(-(window - grain + 1) // PROBES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = view(b.column("text"))
            ids, hashes = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("th").to_numpy()
            row = 0
            while row < b.num_rows:
                # as many texts as fill a slice, one at least
                end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE)) - 1)
                base = at[row]
                own = data[base : at[end]]
                first, last, key, tied, place, text, grains = anchors.runs(own, at[row:end] - base, at[row + 1 : end + 1] - base, window, grain)
                starts = at[row:end][text] - base
                digest = b"".join([hashlib.blake2b(own[i:j], digest_size=8).digest() for i, j in zip(first.tolist(), (last + window).tolist(), strict=True)])
                columns = [ids[row:end][text], hashes[row:end][text], first - starts, last - starts, key, np.frombuffer(digest, np.int64), tied, place - starts]
                arrays = [pa.array(v).cast(t) for v, t in zip(columns, KINDS, strict=True)]
                for k, (value, inside) in enumerate(probe_hashes(grains, place, window, grain)):
                    low, top = place - (k + 1) * step + 1, place - k * step
                    arrays.append(pa.array(value, mask=~(inside & (low <= last) & (top >= first) & ~tied)))
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in RUNS.split(", ")])
                row = end

    return docs.mapInArrow(run, RUNS)


def cut_contexts(docs: DataFrame, wanted: DataFrame, view: Callable = _texts) -> DataFrame:
    """wanted: doc_id, th and cuts (key, context, from, to). A row for each cut: key, context, from, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list] = [], [], [], []
            data, at = view(b.column("text"))
            for begin, cuts in zip(at[:-1].tolist(), b.column("cuts").to_pylist(), strict=True):
                for c in cuts:
                    for column, v in zip(out, (c["key"], c["context"], c["from"], data[begin + c["from"] : begin + c["to"]].tobytes()), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["key", "context", "from", "bytes"])

    by_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "context", "from", "to")).alias("cuts"))
    by_doc = written(by_doc, "by_doc")
    _, looked = suspects(docs, by_doc.select(F.xxhash64("doc_id", "th").alias("key")), F.xxhash64("doc_id", "th"))
    joined = looked.join(by_doc, ["doc_id", "th"]).select("text", "cuts")
    return joined.mapInArrow(run, "key bigint, context bigint, `from` int, bytes binary")


def _spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Where windows from starts (in order) cover, as ranges."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) > window]))
    ends = np.append(new[1:], len(starts)) - 1
    return list(zip(starts[new].tolist(), (starts[ends] + window).tolist(), strict=True))


def shard_repeats(cuts: DataFrame, window: int = WINDOW, shard: int = SHARD, step: int = 1) -> DataFrame:
    """Windows start at multiples of step. cuts: key, context, from, bytes. A row for each range of a context that repeated windows cover: key, context, from, to. Keys never share windows, so shards end between keys."""

    def settle(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        data = np.frombuffer(b"\xff".join([*(r[3] for r in rows), b""]), np.uint8)
        lengths = np.array([len(r[3]) for r in rows])
        begins = np.cumsum(lengths + 1) - lengths - 1
        starts = np.flatnonzero(repeated_starts(data, window))
        own = np.searchsorted(begins, starts, "right") - 1
        place = starts - begins[own] + np.array([r[2] for r in rows])[own]
        inside = (starts + window <= begins[own] + lengths[own]) & (place % step == 0)
        starts, own = starts[inside], own[inside]
        out: tuple[list, list, list, list] = [], [], [], []
        # a shard's contexts are candidates, so none of them may repeat a window
        edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])).tolist() if len(own) else []
        for a, z in zip(edges, [*edges[1:], len(own)] if edges else [], strict=True):
            key, context, base, _ = rows[own[a]]
            for low, high in _spans(starts[a:z] - begins[own[a]], window):
                for column, v in zip(out, (key, context, base + low, base + high), strict=True):
                    column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "context", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "context", "from", "bytes")), strict=True):
                if size >= shard and row[0] != rows[-1][0]:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield settle(rows)

    parts = cuts.repartition("key").sortWithinPartitions("key", "context")
    return parts.mapInArrow(run, "key bigint, context bigint, `from` int, `to` int")


def counted_repeats(cuts: DataFrame, window: int = WINDOW, step: int = 1) -> DataFrame:
    """The same for hot keys, by counting windows: partial sums leave each task, no group meets in one."""
    other = np.random.default_rng(7).integers(1 << 63, size=256, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, context, base, raw in zip(*(b.column(c).to_pylist() for c in ("key", "context", "from", "bytes")), strict=True):
                data = np.frombuffer(raw, np.uint8)
                one, two = anchors.grain_hashes(data, window).astype(np.int64), anchors.grain_hashes(data, window, other).astype(np.int64)
                one, two = one[-base % step :: step], two[-base % step :: step]
                n = len(one)
                yield pa.RecordBatch.from_pydict({"w1": one, "w2": two, "key": np.full(n, key), "context": np.full(n, context), "from": np.arange(n, dtype=np.int32) * np.int32(step) + np.int32(base + -base % step)})

    windows = cuts.mapInArrow(run, "w1 bigint, w2 bigint, key bigint, context bigint, `from` int")
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return windows.join(twice, ["w1", "w2"], "left_semi").select("key", "context", "from", (F.col("from") + window).cast("int").alias("to"))


def covered(docs: DataFrame, window: int = WINDOW, grain: int = anchors.GRAIN, shard: int = SHARD, view: Callable = _texts, unit: int = 1) -> DataFrame:
    """view gives the bytes to look at, of which windows start at multiples of unit. docs: doc_id, th, text. A row for each range of a document that is to go: doc_id, th, from, to; ranges may overlap."""
    step = -(-(window - grain + 1) // PROBES)
    every = written(find_runs(docs, window, grain, view), "runs")
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("tied").alias("t")).filter("n > 1 or t").select("key")
    runs = written(every.join(shared, "key", "left_semi"), "shared")
    drop_written(every)
    probes = [f"p{k}" for k in range(PROBES)]
    # one row for each different context; its first occurrence stands for it
    contexts = written(
        runs.groupBy("key", "context").agg(
            F.count(F.lit(1)).alias("n"), F.max("tied").alias("tied"), F.min(F.struct("doc_id", "th", "first")).alias("at"),
            F.max(F.col("last") - F.col("first")).alias("reach"), F.min(F.col("place") - F.col("first")).alias("place"), *[F.min(p).alias(p) for p in probes]
        ),
        "contexts",
    )
    each = contexts.select("key", "context", F.posexplode(F.array(*probes)).alias("k", "probe")).filter("probe is not null")
    met = each.groupBy("key", "probe").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    ranges = each.join(met, ["key", "probe"], "left_semi").groupBy("key", "context").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    # ties of a context may hide which grain is the anchor, so whatever shares its key is looked at whole
    ties = contexts.filter("tied").select("key").distinct().withColumn("any_tied", F.lit(True))
    near = contexts.join(ranges, ["key", "context"], "left").join(ties, "key", "left").filter("low is not null or any_tied")
    begin = F.when(F.col("any_tied"), 0).otherwise(F.greatest(F.lit(0), F.col("place") - (F.col("high") + 1) * step + 1))
    end = F.when(F.col("any_tied"), F.col("reach")).otherwise(F.least(F.col("reach"), F.col("place") - F.col("low") * step))
    wanted = near.select("key", "context", "at.doc_id", "at.th", (F.col("at.first") + begin).alias("from"), (F.col("at.first") + end + window).alias("to"), F.col("at.first").alias("base"))
    cuts = written(cut_contexts(docs, wanted, view), "cuts")
    hot = cuts.groupBy("key").agg(F.sum(F.length("bytes")).alias("size")).filter(F.col("size") > shard).select("key")
    if hot.isEmpty():
        found = shard_repeats(cuts, window, shard, unit)
    else:
        hot = written(hot, "hot")
        found = shard_repeats(cuts.join(hot, "key", "left_anti"), window, shard, unit).unionByName(counted_repeats(cuts.join(hot, "key", "left_semi"), window, unit))
    base = contexts.select("key", "context", F.col("at.first").alias("base"))
    found = written(found, "settled")
    drop_written(cuts)
    found = written(found.join(base, ["key", "context"]).select("key", "context", (F.col("from") - F.col("base")).alias("low"), (F.col("to") - F.col("base")).alias("high")), "found")
    copies = written(contexts.filter("n > 1").select("key", "context"), "copies")
    spot = runs.select("doc_id", "th", "first", "last", "key", "context")
    low, high = F.ceil(F.col("first") / unit) * unit, F.floor(F.col("last") / unit) * unit
    whole = spot.join(copies, ["key", "context"], "left_semi").filter(low <= high).select("doc_id", "th", low.cast("int").alias("from"), (high + window).cast("int").alias("to"))
    part = spot.join(found, ["key", "context"]).select("doc_id", "th", (F.col("first") + F.col("low")).alias("from"), (F.col("first") + F.col("high")).alias("to"))
    return whole.unionByName(part)


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_words bigint, n_passages bigint"


def _merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, grain: int = anchors.GRAIN, shard: int = SHARD, passage: int = PASSAGE, with_text: bool = False) -> DataFrame:
    """A row for each document: RESULT (n_passage_words: words in passages of more than passage words that also occur elsewhere; n_passages: runs of such words), and with with_text the text that is left (binary: a cut may fall inside a character) and the spans removed."""
    schema = RESULT + (", kept binary, spans array<array<int>>" if with_text else "")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # doc_id tells rows apart from here on, name is the id that the result shows
    slim = docs.select(F.col(id_col).cast("long").alias("name"), F.xxhash64(F.col(id_col).cast("long"), text).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans = covered(slim, window, grain, shard)
    passages = covered(slim, (passage + 1) * CODE, grain, shard, _codes, CODE)
    both = spans.withColumn("words", F.lit(False)).unionByName(passages.withColumn("words", F.lit(True))).distinct()
    listed = lambda w: F.sort_array(F.collect_list(F.when(F.col("words") == w, F.array("from", "to"))))
    by_doc = written(both.groupBy("doc_id", "th").agg(listed(False).alias("spans"), listed(True).alias("passages")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in schema.split(", ")]
            for name, raw, found, words in zip(b.column("name").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), b.column("passages").to_pylist(), strict=True):
                merged, said = _merged(found), _merged(words)
                edges = [0, *(x for s in merged for x in s), len(raw)]
                left = b"".join([raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)])
                counts = (len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(), sum(z - a for a, z in said) // CODE, len(said))
                for column, v in zip(out, (name, *counts, *((left, merged) if with_text else ())), strict=True):
                    column.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2 + [pa.binary(), pa.list_(pa.list_(pa.int32()))] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    rest, looked = suspects(slim, by_doc.select(F.xxhash64("doc_id", "th").alias("key")), F.xxhash64("doc_id", "th"))
    whole = [F.col("name").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256")]
    whole += [F.lit(0).cast("long").alias(c) for c in ("n_removed", "n_spans", "n_passage_words", "n_passages")]
    if with_text:
        whole += [F.col("text").cast("binary").alias("kept"), F.array().cast("array<array<int>>").alias("spans")]
    # a text without spans is there by chance
    empty = F.array().cast("array<array<int>>")
    looked = looked.join(by_doc, ["doc_id", "th"], "left").select("name", "text", F.coalesce("spans", empty).alias("spans"), F.coalesce("passages", empty).alias("passages"))
    return looked.mapInArrow(run, schema).unionByName(rest.select(*whole))
