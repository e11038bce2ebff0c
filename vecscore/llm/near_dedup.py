"""N-gram Jaccard join by grouped prefixes: links documents whose word-shingle sets are alike, and gives each document its component.

1. Documents with the same set are one node. Of each set only a prefix is kept: its first shingles in one global order, so
   many that two sets of the wanted likeness share one. The order puts frequent shingles last: the most frequent of each
   batch of rows, summed over the corpus, the EACH most frequent of each of BUCKETS classes by hash (a bound on what is
   broadcast; the order is a hint, any order gives the same links).
2. Nodes with identical prefix and size are one group; groups meet by prefix shingle.
3. Per shingle the group with the largest share of common shingles is the pivot. It is paired with the others, group pairs
   are filtered by size and by where in both prefixes the shingle stands, then expanded to members. Members are compared by
   parity sketches first: the bits in which two differ are never more than the shingles that only one of the two has, so
   a pair with too many is dropped for certain. The nearest pivot of each node is verified on whole sets, then
   those of the others that lie in a different component.
4. Shingles whose nodes still lie in different components are looked at again: nodes outside the shingle's largest component
   are held against all of its nodes, in blocks of bounded size, by component, size, place and sketch. What passes
   is verified: first one pair a node by the first shingles of each prefix, at last all pairs by all shingles. So all
   links between components are found, and pairs inside a component are never listed.
5. Components: least ids spread along links with pointer jumping, as joins and aggregates.

Defined cases: null or empty text, or text without words, has an empty set, links with nothing and is its own component.
Texts with fewer words than a shingle are one shingle. Rows that repeat an id are taken to be one document. A row with a null
id is no node: it gets the component of the documents with its set, or null. Extra columns are ignored; empty
tables give empty results. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecscore.llm.common import lean, slices, suspects, written

WORDS, PERCENT = 3, 90
#: Frequent shingles that are broadcast: classes by hash, and shingles of each. What a batch reports: so many shingles, each found so often in it.
BUCKETS, EACH = 1024, 64
BATCH_TOP, BATCH_COUNT = 4096, 3
#: Bits of a sketch: SKETCH at least, more for large sets up to the bound; all are folded to SKETCH where many are compared.
SKETCH, MOST_BITS = 1024, 1 << 20
#: Nodes of a shingle that are held against the others in one go, and members of a pivot that are verified in one task.
BLOCK, MEMBERS = 2048, 256
#: Rounds that verify one pair a node, by the first shingles of each prefix alone, before the one that looks at all shingles and pairs.
BEST_ROUNDS, FIRST = 2, 4
SLICE = 1 << 20

_rng = np.random.default_rng(20260102)
_SIGN = _rng.integers(1 << 63, size=256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """The shingle hashes of texts, as sorted sets."""

    def __init__(self, words: int = WORDS, size: int = SLICE):
        self.words, self.size = words, size
        self.power = self.inverse = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, self.size + self.size // 4)
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The hashes of all words, and where each text's end."""
        data = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
        self._grow(len(data) + 1)
        space = _SPACE[data]
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SIGN[data] * self.power[: len(data)])])
        word = (total[end] - total[start]) * self.inverse[start]
        word = _mix(word + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return word, np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])).tolist()

    def _some(self, texts: list[bytes]) -> list[np.ndarray]:
        word, last = self._words(texts)
        joined = word.copy()
        for k in range(1, self.words):
            joined = _mix(joined[: len(joined) - 1] * np.uint64(3) + word[k:]) if len(joined) else joined
        out, a = [], 0
        for z in last:
            if z - a >= self.words:
                out.append(np.unique(joined[a : z - self.words + 1].view(np.int64)))
            elif z > a:
                value = word[a : a + 1]
                for k in range(a + 1, z):
                    value = _mix(value * np.uint64(5) + word[k : k + 1])
                out.append((value ^ np.uint64(z - a)).view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
            a = z
        return out

    def counts(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the hashes of its words and how often each is in it."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for part in self._slices(texts):
            word, last = self._words(part)
            out += [np.unique(word[a:z], return_counts=True) for a, z in zip([0, *last[:-1]], last, strict=True)]
        return out

    def words_of(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """The hashes of all words of some texts, and where each text's end; all texts in order."""
        for part in self._slices(texts):
            yield self._words(part)

    def _slices(self, texts: list[bytes | None]) -> Iterator[list[bytes]]:
        part: list[bytes] = []
        size = 0
        for t in texts:
            part.append(t or b"")
            size += len(part[-1]) + 1
            if size >= self.size:
                yield part
                part, size = [], 0
        if part:
            yield part

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        return [own for part in self._slices(texts) for own in self._some(part)]


def frequent(docs: DataFrame, words: int = WORDS, each: int = EACH) -> np.ndarray:
    """The most frequent shingles, the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in slices(batches, 2048):
            sets = shingler.sets(b.column("text").cast(pa.binary()).to_pylist())
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            found, n = found[n >= BATCH_COUNT], n[n >= BATCH_COUNT]
            if len(n) > BATCH_TOP:
                top = np.argpartition(n, len(n) - BATCH_TOP)[-BATCH_TOP:]
                found, n = found[top], n[top]
            yield pa.RecordBatch.from_pydict({"shingle": found, "n": n.astype(np.int64)})

    sums = docs.select("text").mapInArrow(lean(run), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(F.pmod("shingle", F.lit(BUCKETS))).orderBy(F.desc("n"), "shingle")
    top = sums.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= each).select("shingle", "n").toPandas()
    return top.sort_values(["n", "shingle"])["shingle"].to_numpy(np.int64)


def sketch(own: np.ndarray) -> np.ndarray:
    """The parity of the shingles that fall on each bit, as 64-bit words. The xor of both halves is the sketch of half as many bits."""
    bits = min(max(SKETCH, 1 << (2 * len(own) - 1).bit_length()), MOST_BITS)
    parity = np.bincount(own & (bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def folded(words: np.ndarray, size: int = SKETCH // 64) -> np.ndarray:
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _lists(rows: list[np.ndarray], mask: list[bool] | None = None) -> pa.Array:
    offsets = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array(mask, pa.bool_()) if mask is not None else None)


BASE = "doc_id bigint, n bigint, s1 bigint, s2 bigint, h1 bigint, h2 bigint, prefix array<bigint>, small array<bigint>, large array<bigint>"


def prefixes(docs: DataFrame, order: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each document: BASE (size and 128-bit hash of its set, 128-bit hash of its prefix, prefix, sketch of SKETCH bits, and the whole sketch where that has more)."""
    by_value = np.argsort(order)
    shared = docs.sparkSession.sparkContext.broadcast((order[by_value], by_value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        values, ranks = shared.value
        for b in slices(batches):
            sets = shingler.sets(b.column("text").cast(pa.binary()).to_pylist())
            firsts, digests, large = [], [], []
            for s in sets:
                p = len(s) - (percent * len(s) + 99) // 100 + 1 if len(s) else 0
                if len(values) and p:
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    often = values[at] == s
                    first = s[~often][:p]
                    if len(first) < p:
                        first = np.concatenate([first, s[often][np.argsort(ranks[at[often]])][: p - len(first)]])
                else:
                    first = s[:p]
                firsts.append(first)
                large.append(sketch(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() + hashlib.blake2b(first.tobytes(), digest_size=16).digest())
            codes = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 4)
            small = [folded(x) for x in large]
            more = [len(x) > SKETCH // 64 for x in large]
            columns = [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(codes[:, k]) for k in range(4)), _lists(firsts), _lists(small)]
            columns.append(_lists([x if m else x[:0] for x, m in zip(large, more, strict=True)], [not m for m in more]))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BASE.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(lean(run), BASE)


def most_apart(n: Column, n2: Column, percent: int) -> Column:
    """How many shingles at most only one of two sets has, if 100 * overlap >= percent * (n + n2 - overlap)."""
    both = F.ceil(percent * (n + n2) / F.lit(100 + percent))
    return n + n2 - 2 * both


def bits_apart(x: Column, y: Column) -> Column:
    """The bits in which two sketches differ, both folded to as many as the shorter has; one may have twice as many as the other."""
    half = lambda a: F.zip_with(F.slice(a, F.lit(1), (F.size(a) / 2).cast("int")), F.slice(a, (F.size(a) / 2 + 1).cast("int"), (F.size(a) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    short = lambda a, b: F.when(F.size(a) > F.size(b), half(a)).otherwise(a)
    return F.aggregate(F.zip_with(short(x, y), short(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """pairs: a, b. With apart, how far their sketches are apart; pairs that these show to be too different are gone."""
    own = nodes.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.coalesce("large", "small").alias("sketch1"))
    other = nodes.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.coalesce("large", "small").alias("sketch2"))
    sized = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent
    met = pairs.join(own, "a").join(other, "b").filter(sized)
    return met.withColumn("apart", bits_apart(F.col("sketch1"), F.col("sketch2"))).filter(F.col("apart") <= most_apart(F.col("n1"), F.col("n2"), percent)).select("a", "b", "apart")


def verify(docs: DataFrame, pairs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """pairs: a, b (ids), each once. Those whose sets are alike enough. The texts move once, then the set of each b once a pair, to where the set of its a is; an a with more than MEMBERS is dealt to several tasks, each with a copy of its set."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        for b in slices(batches):
            out: tuple[list, list, list, list] = [], [], [], []
            held = 0
            for name, own, s in zip(b.column("doc_id").to_pylist(), b.column("pivots").to_pylist(), shingler.sets(b.column("text").cast(pa.binary()).to_pylist()), strict=True):
                raw = s.tobytes()
                for want in own:
                    member = want["pivot"] is not None
                    for column, v in zip(out, (want["pivot"] if member else name, want["salt"], name if member else None, raw), strict=True):
                        column.append(v)
                    held += len(raw)
                    if held > 16 * SLICE:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["a", "salt", "b", "shingles"])
                        out, held = ([], [], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["a", "salt", "b", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, x = None, np.zeros(0, np.int64)
        for batch in slices(batches):
            hits: tuple[list, list] = [], []
            for a, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "shingles")), strict=True):
                y = np.frombuffer(raw, np.int64)
                if b is None:
                    pivot, x = a, y
                elif a == pivot and len(x) and len(y):
                    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        hits[0].append(a)
                        hits[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()) for h in hits], names=["a", "b"])

    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(sizes, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("pivot"), F.pmod(F.hash("b"), F.col("parts")).alias("salt"))
    own = sizes.select(F.col("a").alias("doc_id"), F.lit(None).cast("long").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    wanted = members.unionByName(own).groupBy("doc_id").agg(F.collect_list(F.struct("pivot", "salt")).alias("pivots"))
    # rows that repeat an id are one document, so one of them is enough
    sets = docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(lean(shingle), "a bigint, salt int, b bigint, shingles binary")
    dealt = sets.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return written(dealt.mapInArrow(lean(compare), "a bigint, b bigint").distinct(), "links")


def crossing(rows: DataFrame, percent: int, best: bool) -> DataFrame:
    """rows: token, block, probe, node, component, n, pos, common (whether the component is the token's largest), small. Pairs a, b of a block's nodes and its probes that lie in different components and whose sizes, places and sketches allow a link; with best only the nearest of each probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("node", "component", "n", "pos", "common")
        at: tuple | None = None
        held: list[tuple] = []
        block: list[np.ndarray] = []
        sketches = np.zeros((0, SKETCH // 64), np.uint64)
        for b in batches:
            token, number, probe = (b.column(c).to_numpy(zero_copy_only=False) for c in ("token", "block", "probe"))
            own = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
            flat = b.column("small").flatten().to_numpy().view(np.uint64).reshape(len(token), SKETCH // 64)
            cuts = np.flatnonzero((token[1:] != token[:-1]) | (number[1:] != number[:-1]) | (probe[1:] != probe[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(token)], strict=True):
                if i == j:
                    continue
                key = (token[i], number[i])
                if key != at:
                    at, held, block = key, [], []
                if not probe[i]:
                    held.append(([c[i:j] for c in own], flat[i:j]))
                    block = []
                    continue
                if not held:
                    continue
                if not block:
                    block = [np.concatenate([h[0][k] for h in held]) for k in range(len(names))]
                    sketches = np.concatenate([h[1] for h in held])
                for first in range(i, j, 32):
                    last = min(first + 32, j)
                    node, component, n, pos, _ = (c[first:last, None] for c in own)
                    total = n + block[2]
                    overlap = np.minimum(n - pos, block[2] - block[3])
                    need = (percent * total + 99 + percent) // (100 + percent)
                    fits = (component != block[1]) & (overlap >= need)
                    if not best:
                        # two probes meet in both their blocks, one of these is enough
                        fits &= block[4] | (node < block[0])
                    x, y = np.nonzero(fits)
                    if not len(x):
                        continue
                    apart = np.bitwise_count(flat[first + x] ^ sketches[y]).sum(1).astype(np.int64)
                    good = apart <= (total - 2 * need)[x, y]
                    x, y, apart = x[good], y[good], apart[good]
                    if best and len(x):
                        order = np.lexsort((apart, x))
                        order = order[np.concatenate([[True], np.diff(x[order]) > 0])]
                        x, y, apart = x[order], y[order], apart[order]
                    yield pa.RecordBatch.from_pydict({"a": block[0][y], "b": node[x, 0], "apart": apart})

    return rows.repartition("token", "block").sortWithinPartitions("token", "block", "probe").mapInArrow(lean(run), "a bigint, b bigint, apart bigint")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. A row for each id with an edge: id, component (the least id that it reaches)."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(near, labels.id == near.a).select("id", F.least("component", "near").alias("new"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("further"))
        new = written(new.join(jump, "new").select("id", F.least("new", "further").alias("component"), "old"), "labels")
        if new.filter("component <> old").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def open_rows(posted: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """What crossing() takes: the nodes of all shingles (and of all groups) that lie in several components. A shingle's nodes are dealt into blocks, and those outside its largest component go to each block as probes."""
    placed = written(nodes.join(found.withColumnRenamed("id", "node"), "node", "left").select("node", "n", "g", "small", F.coalesce("component", "node").alias("component")), "placed")
    spans = placed.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    met = posted.join(spans, "g")
    torn = met.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least <> most").select("token")
    rows = met.join(torn, "token", "left_semi").select("token", "g", "pos")
    rows = rows.unionByName(spans.filter("low <> high").select(F.xxhash64(F.lit("group"), "g").alias("token"), "g", F.lit(0).cast("long").alias("pos")))
    rows = rows.join(placed.select("g", "node", "component"), "g")
    sizes = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"))
    dealt = written(sizes.groupBy("token").agg(F.max_by("component", "m").alias("largest"), F.ceil(F.sum("m") / BLOCK).cast("int").alias("blocks")), "blocks")
    rows = rows.join(dealt, "token").withColumn("common", F.col("component") == F.col("largest"))
    everyone = F.array(F.struct(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("probe")))
    probes = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("block"), F.lit(True).alias("probe")))
    rows = rows.select("token", "node", "pos", "common", F.explode(F.when(F.col("common"), everyone).otherwise(F.concat(everyone, probes))).alias("to"))
    return rows.select("token", "to.block", "to.probe", "node", "pos", "common").join(placed.select("node", "component", "n", "small"), "node")


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """found: id, component, as components() gives it. The same with more links: only the components that these join are looked at."""
    of = found.select(F.col("id").alias("a"), F.col("component").alias("of_a")), found.select(F.col("id").alias("b"), F.col("component").alias("of_b"))
    edges = links.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).filter("a <> b").distinct()
    into = components(edges).select(F.col("id").alias("component"), F.col("component").alias("into"))
    new = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct().join(found, "id", "left_anti").withColumn("component", F.col("id"))
    return written(found.unionByName(new).join(into, "component", "left").select("id", F.coalesce("into", "component").alias("component")), "components")


def near_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, each: int = EACH) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. A row for each document (doc_id, n_shingles, node: the least id with the same set, null for empty sets), and of each node with a link its component."""
    base = written(prefixes(docs, frequent(docs, words, each), words, percent), "prefixes")
    ids = base.filter("n > 0 and doc_id is not null").groupBy("n", "s1", "s2", "h1", "h2").agg(F.min("doc_id").alias("node"))
    groups = ids.groupBy("n", "h1", "h2").agg(F.min("node").alias("g"))
    grouped = written(ids.join(groups, ["n", "h1", "h2"]).select("node", "n", "s1", "s2", "g"), "grouped")
    sketches = base.select(F.col("doc_id").alias("node"), "small", "large").dropDuplicates(["node"])
    nodes = written(grouped.select("node", "n", "g").join(sketches, "node"), "nodes")
    heads = grouped.filter("node = g").select(F.col("node").alias("doc_id"), "g")
    posted = base.select("doc_id", "n", "prefix").join(heads, "doc_id").dropDuplicates(["doc_id"]).select("g", "n", F.posexplode("prefix").alias("pos", "token"))
    # size and place in one number: a row of an exchange is as many words as it has columns
    posted = posted.select("token", "g", (F.col("n") * (1 << 31) + F.col("pos")).alias("at"))
    met = posted.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("token")
    posted = written(posted.join(met, "token", "left_semi").select("token", "g", F.shiftright("at", 31).alias("n"), F.col("at").bitwiseAND((1 << 31) - 1).alias("pos")), "posted")
    score = posted.groupBy("g").agg((F.count(F.lit(1)) / F.max("n")).alias("score"))
    scored = posted.join(score, "g")
    best = F.max(F.struct("score", (-F.col("g")).alias("minus"), "n", "pos")).alias("p")
    pivots = scored.groupBy("token").agg(best).select("token", (-F.col("p.minus")).alias("g2"), F.col("p.n").alias("n2"), F.col("p.pos").alias("pos2"))

    least = F.least("n", "n2")
    sized = least * 100 >= F.greatest("n", "n2") * percent
    # an overlap of x is enough if 100 x >= percent (n + n2 - x); the shingles before this one are no part of it, if it is the first that both have
    overlap = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    placed = overlap * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    star = posted.join(pivots, "token").filter((F.col("g") != F.col("g2")) & sized & placed).select(F.col("g2").alias("a"), "g").distinct()
    members = grouped.select("g", F.col("node").alias("b"))
    own = members.filter("g <> b").select(F.col("g").alias("a"), "b")
    star = written(plausible(star.join(members, "g").select("a", "b").unionByName(own), nodes, percent), "star")

    tested = written(star.groupBy("b").agg(F.min_by("a", "apart").alias("a")).select("a", "b"), "tested")
    found = components(verify(docs, tested, words, percent))

    def untested(pairs: DataFrame) -> DataFrame:
        """pairs between components that no round has verified yet."""
        low = pairs.select("a", "b").distinct()
        for mark in ("a", "b"):
            low = low.join(found.select(F.col("id").alias(mark), F.col("component").alias(f"of_{mark}")), mark, "left")
        low = low.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
        low = low.join(tested, ["a", "b"], "left_anti").join(tested.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        return written(low, "untested")

    def settle(more: DataFrame) -> bool:
        """Verifies more and adds what it links; whether there was anything."""
        nonlocal tested, found
        if more.isEmpty():
            return False
        tested = tested.unionByName(more)
        new = verify(docs, more, words, percent)
        if new.isEmpty():
            return False
        found = merged(found, new)
        return True

    settle(untested(star))
    rounds = 0
    while True:
        one = rounds < BEST_ROUNDS
        pairs = crossing(open_rows(posted.filter(F.col("pos") < FIRST) if one else posted, nodes, found), percent, one)
        if one:
            pairs = pairs.groupBy("b").agg(F.min_by("a", "apart").alias("a"))
        linked = settle(untested(plausible(pairs.select("a", "b").distinct(), nodes, percent)))
        if not one:
            break
        rounds = rounds + 1 if linked else BEST_ROUNDS
    rows = base.select("doc_id", "n", "s1", "s2").join(grouped.select("n", "s1", "s2", "node"), ["n", "s1", "s2"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "node"), found


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, each: int = EACH) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the least id that it reaches by links, itself included)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, found = near_links(slim, words, percent, each)
    out = rows.join(found.withColumnRenamed("id", "node"), "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))


def near_dedup_stage(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which each component keeps one: the one with the least id. Rows with a null id stay."""
    gone = written(near_dedup(docs, words=words, percent=percent).filter("doc_id <> component_id").select("doc_id", F.xxhash64("doc_id").alias("key")), "gone")
    rest, looked = suspects(docs, gone, F.xxhash64("doc_id"))
    return rest.unionByName(looked.join(gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns))
